"""The crawl state machine as a fold over ordered events, and guarded upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(events: DataFrame) -> DataFrame:
    """State of every url from its events (url, seq, status, error).

    enqueue only creates; in_progress adds an attempt and clears the error;
    completed resets the attempts; failed and skipped keep them.  Events may also
    carry page_type (an in_progress event of unknown type keeps the one known, an
    enqueue event gives it to a new url only), fetched_at and content_hash (a null
    keeps the value known).  Two aggregates with partial sums: no window, so a url
    with very many events costs rows, not memory.
    """
    done = events.filter("status = 'completed'").groupBy("url").agg(F.max("seq").alias("_done"))
    rows = events.join(done, "url", "left")
    moves = F.col("status") != "pending"
    last = lambda value, there: F.max_by(value, F.when(there, F.col("seq")))
    more = []
    if "page_type" in events.columns:
        kind = F.when(moves & ~((F.col("status") == "in_progress") & (F.coalesce("page_type", F.lit("unknown")) == "unknown")), F.col("page_type"))
        more.append(F.coalesce(last(kind, kind.isNotNull()), F.min_by("page_type", "seq"), F.lit("unknown")).alias("page_type"))
    settled = moves & (F.col("status") != "in_progress")
    more += [last(F.col(c), settled & F.col(c).isNotNull()).alias(c) for c in ("fetched_at", "content_hash") if c in events.columns]
    return rows.groupBy("url").agg(
        F.coalesce(last(F.col("status"), moves), F.lit("pending")).alias("status"),
        F.count(F.when((F.col("status") == "in_progress") & (F.col("_done").isNull() | (F.col("seq") > F.col("_done"))), 1)).alias("attempt_count"),
        last(F.when(F.col("status").isin("failed", "skipped"), F.col("error")), moves).alias("last_error"),
        F.max("seq").alias("updated_seq"),
        *more,
    )


def error_log(events: DataFrame) -> DataFrame:
    """Failed events with the attempt they belong to: attempts since the url was last completed, 1 at least.

    A failure's round is the number of completions before it; one running count of
    attempts less its value at the round's start needs one window and no second one.
    """
    w = Window.partitionBy("url").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tries = F.count(F.when(F.col("status") == "in_progress", 1)).over(w)
    counted = events.withColumn("_tries", tries)
    at_done = F.coalesce(F.max(F.when(F.col("status") == "completed", F.col("_tries"))).over(w), F.lit(0))
    return counted.withColumn("attempt_number", F.greatest(F.lit(1), F.col("_tries") - at_done).cast("long")).filter("status = 'failed'").withColumnRenamed("error", "error_message").drop("_tries")


def stored_errors(errors: DataFrame, path: str, context: Column) -> DataFrame:
    """Append errors to a Parquet table whose ``context`` is a VARIANT, and read the table: a path of it is read alone."""
    errors.withColumn("context", context).write.mode("append").parquet(path)
    return errors.sparkSession.read.parquet(path)


def eligible(status: Column, attempts: Column, max_retries: int, resume: bool = True) -> Column:
    """Whether a discovered url is to be fetched."""
    if not resume:
        return F.lit(True)
    return F.when(status.isNull(), True).when(status.isin("completed", "skipped"), False).when(status == "failed", attempts <= max_retries).otherwise(True)


def resumable(state: DataFrame, max_retries: int) -> DataFrame:
    return state.filter(F.col("status").isin("pending", "in_progress") | ((F.col("status") == "failed") & (F.col("attempt_count") <= max_retries)))


def enqueue(state: DataFrame, urls: DataFrame) -> DataFrame:
    """State with the urls it lacks, as pending."""
    new = inserted(state, urls)
    blank = {"status": F.lit("pending"), "attempt_count": F.lit(0).cast("long"), "last_error": F.lit(None).cast("string"), "updated_seq": F.lit(None).cast("long")}
    return state.unionByName(new.select("url", *[v.alias(k) for k, v in blank.items()]))


def inserted(state: DataFrame, urls: DataFrame) -> DataFrame:
    """The urls that enqueueing adds: those that the state lacks, once each."""
    return urls.select("url").distinct().join(state.select("url"), "url", "left_anti")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace stored ones of the same key."""
    kept = stored.join(new.select(*keys), keys, "left_anti")
    return kept.unionByName(new.select(*stored.columns))


def accepted(new: DataFrame, stored: DataFrame, key: str, complete: str = "variants_complete") -> DataFrame:
    """Snapshots that may be stored: complete ones, and incomplete ones of new products."""
    known = stored.select(F.col(key), F.lit(True).alias("_known")).distinct()
    joined = new.join(known, key, "left")
    return joined.filter(F.col(complete) | F.col("_known").isNull()).drop("_known")


def replace_children(stored: DataFrame, new: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    """Children of the replaced parents are exactly the new ones; others stay.

    A new child whose parent is not among the replaced ones is not stored.
    """
    kept = stored.join(parents.select(parent).distinct(), parent, "left_anti")
    return kept.unionByName(new.join(parents.select(parent).distinct(), parent, "left_semi").select(*stored.columns))


def stale(stored: DataFrame, new: DataFrame, parent: str, key: str) -> DataFrame:
    """Stored children of parents in ``new`` that it doesn't have any more."""
    touched = stored.join(new.select(parent).distinct(), parent, "left_semi")
    return touched.join(new.select(parent, key), [parent, key], "left_anti")


def metadata_regression(new: DataFrame, stored: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, regressed): fields that had a value and are empty now."""

    def has(col: str) -> Column:
        kind = dict(new.dtypes)[col.removeprefix("_old_")]
        return F.coalesce(F.size(col) > 0, F.lit(False)) if kind.startswith(("array", "map")) else F.coalesce(F.trim(col) != "", F.lit(False))

    old = stored.select(key, *[F.col(f).alias(f"_old_{f}") for f in fields])
    lost = F.array_compact(F.array(*[F.when(has(f"_old_{f}") & ~has(f), F.lit(f)) for f in fields]))
    return new.join(old, key, "left").select(key, lost.alias("regressed"))


def count_drift(new_count: Column, old_count: Column, complete: Column, least: int = 4, share: float = 0.5) -> Column:
    """A complete snapshot with under half the variants of a stored product of four or more."""
    return complete & (F.coalesce(old_count, F.lit(0)) >= least) & (new_count < share * old_count)
