"""Run-level summaries: status, discovery per category, the quota latch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def status(extracted: Column, failed: Column, degraded: Column, planned: Column, resume: bool = False) -> Column:
    """completed, partial or failed."""
    none_planned = F.lit(False) if resume else planned == 0
    return F.when((failed > 0) & (extracted > 0), "partial").when(failed > 0, "failed").when(degraded, "partial").when(none_planned, "failed").otherwise("completed")


def summary(outcomes: DataFrame, degraded: bool = False) -> DataFrame:
    """Counters and status of a run from the final status of each planned url."""
    count = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    row = outcomes.agg(count("completed"), count("failed"), count("skipped"), F.count(F.lit(1)).alias("planned"))
    return row.withColumn("status", status(F.col("completed"), F.col("failed"), F.lit(degraded), F.col("planned")))


def counters(outcomes: DataFrame) -> DataFrame:
    """One row with a run's thirteen counters and its duration.

    outcomes: a row per discovered url with category, status, source (http, browser or
    cache), variants, attempts, shadow, fallback, repair, known (booleans), started and
    ended (timestamps, null where the url was not reached).
    """
    return outcomes.agg(*_counts(F.count_distinct("category")))


def counted_while_written(outcomes: DataFrame, path: str) -> DataFrame:
    """Write the outcomes to a new Parquet folder and count them in the same pass; ``counters``' one row.

    The categories are gathered as a set, as an observation takes no distinct count: they are few.
    """
    seen = Observation("counters")
    outcomes.observe(seen, *_counts(F.size(F.collect_set("category")).cast("long"))).write.parquet(path)
    found = seen.get
    names = [c for c in found]
    kinds = ", ".join(f"{c} {'double' if c == 'duration_seconds' else 'long'}" for c in names)
    return outcomes.sparkSession.createDataFrame([tuple(found[c] for c in names)], kinds)


def _counts(categories: Column) -> list[Column]:
    n = lambda c: F.count(F.when(c, 1))
    done = F.col("status") == "completed"
    time = lambda c: F.unix_micros(c.cast("timestamp"))
    seconds = (time(F.max("ended")) - time(F.min("started"))) / 1e6
    return [
        categories.alias("categories_processed"), F.count(F.lit(1)).alias("urls_discovered"), n(done).alias("products_extracted"),
        F.coalesce(F.sum(F.when(done, F.col("variants"))), F.lit(0)).alias("variants_extracted"),
        n(F.col("source") == "http").alias("http_fetches"), n(F.col("source") == "browser").alias("browser_fetches"), n(F.col("source") == "cache").alias("cache_hits"),
        F.coalesce(F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))), F.lit(0)).alias("retries"), n(F.col("status") == "failed").alias("failures"),
        n(F.col("shadow")).alias("llm_shadow_runs"), n(F.col("fallback")).alias("llm_fallback_runs"), n(F.col("repair")).alias("repair_suggestions"),
        n(done & F.col("known")).alias("duplicates_prevented"), F.round(F.coalesce(seconds, F.lit(0.0)), 3).alias("duration_seconds"),
    ]


def discovery(found: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(category, discovered, degraded, status) from (category, method).

    asked: all categories, with ``enabled``; one with nothing found has failed, one that
    is not enabled is skipped.
    """
    fell_back = F.count(F.when(F.col("method") == "json_ld_item_list", 1))
    rows = found.groupBy("category").agg(F.count(F.lit(1)).alias("discovered"), fell_back.alias("degraded"))
    if asked is not None:
        rows = asked.select("category", "enabled").distinct().join(rows, "category", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("discovered", "degraded")})
        rows = rows.withColumn("status", F.when(~F.col("enabled"), "skipped").when(F.col("discovered") == 0, "failed").when(F.col("degraded") > 0, "degraded").otherwise("completed"))
        return rows.drop("enabled")
    return rows.withColumn("status", F.when(F.col("discovered") == 0, "failed").when(F.col("degraded") > 0, "degraded").otherwise("completed"))


def evidence_status(paired: Column, failed: Column, sampled: Column) -> Column:
    """Roll-up of sampled evidence."""
    return F.when(sampled == 0, "skipped").when(paired == sampled, "completed").when(paired > 0, "partial").when(failed > 0, "failed").otherwise("skipped")


def latch(rows: DataFrame, key: str, order: list[str], gave_up: str) -> DataFrame:
    """Adds ``latched``: whether an earlier row of the key gave up.

    The first give-up of each key is one small aggregate with partial sums; a row is
    latched if it comes after it.  So a key with very many rows is never sorted.
    """
    place = F.struct(*order)
    first = rows.groupBy(F.col(key).alias("_key")).agg(F.min(F.when(F.col(gave_up), place)).alias("_first"))
    joined = rows.join(first, F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.withColumn("latched", F.coalesce(place > F.col("_first"), F.lit(False))).drop("_key", "_first")
