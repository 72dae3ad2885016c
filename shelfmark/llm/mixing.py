"""Mixing sources to target weights by the cube method.

A source's target divided by its size is the number of times each of its
documents should be taken: a whole part and a fraction.  The fraction is an
inclusion probability; the flight phase of the cube method moves such
probabilities to 0 or 1 along directions that keep the expected token and
document totals, three documents at a time.  It runs in blocks of one source, so
that a source of any size is spread over many tasks; the few documents that each
block leaves open meet in blocks of the next level until at most LANDING per
source are open, and the landing phase picks the subset nearest to the totals.
What whole documents cannot meet of a source's target, its document with the most
room takes as a part of one more copy (or leaves off its last one).

Defined results: a null or empty text has size 0 and is taken 0 words; a null
source is the last source; blocks and draws depend on doc_id, text and size alone, so
reruns agree; rows with the same doc_id, text and source are drawn together and share
what they get as evenly as it goes; texts are counted whole; an empty table gives no
rows; extra columns, of any name, are carried by ``mix`` and never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store, textkit

#: Weights given to the sources in order, repeated.
WEIGHTS = (5.0, 2.0, 1.0)
#: No source is taken more often than this.
CEILING = 3.0
#: With more sources than this their table is joined by shuffle.
BROADCAST_SOURCES = 10_000
#: Documents of a block of the flight phase; open documents per source that land together.
BLOCK, LANDING = 4000, 14

_SLIM = "doc_id long, source string, size long, tag long"


def count_words(column: pa.Array) -> np.ndarray:
    data, offsets = textkit.raw(column)
    if not len(data):
        return np.zeros(len(offsets) - 1, np.int64)
    space = textkit._IS_SPACE[data]
    begins = ~space
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    begins[1:] &= space[:-1] | edge[1 : len(data)]
    return np.diff(np.concatenate([[0], np.cumsum(begins)])[offsets])


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size (words) and a tag that tells equal doc_ids with other texts apart."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.xxhash64(text).alias("tag"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textkit.pieces(batches, limit=4 << 20):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(count_words(part.column(3)), pa.int64()), part.column(2)], names=["doc_id", "source", "size", "tag"])

    return rows.mapInArrow(textkit.tidy(run), _SLIM)


def targets(totals: DataFrame, weights=WEIGHTS, ceiling: float = CEILING) -> DataFrame:
    """totals (source, words, n) with the words wanted of each source: shares by weight, stopped at ceiling * words.

    What a stopped source can't give is shared again by weight among the rest, until
    none is above; a share only grows, so that a source once stopped stays so.  Sources
    may be many: they are ranked by a range sort, and only sums reach the driver.
    """
    ranked = store.table(totals.orderBy(F.asc_nulls_last("source")).withColumn("at", F.monotonically_increasing_id()), "mix-sources")
    parts = sorted((r.part, r.n) for r in ranked.groupBy(F.shiftright("at", 33).cast("int").alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = {p: sum(n for q, n in parts if q < p) for p, _ in parts}
    start = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in before.items() for x in pair]), F.shiftright("at", 33)) if parts else F.lit(0).cast("long")
    place = start + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))).drop("at")
    per, stopped = 0.0, -1
    while True:
        over = F.lit(per) * F.col("weight") > ceiling * F.col("words")
        row = ranked.agg(
            F.sum(F.col("words").cast("double")).alias("all"), F.sum(F.when(over, ceiling * F.col("words")).otherwise(0.0)).alias("given"),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("free"), F.count(F.when(over, 1)).alias("stopped"),
        ).first()
        if not row.free or (row.stopped == stopped):
            break
        stopped, per = row.stopped, (row["all"] - row.given) / row.free
    return ranked.withColumn("target", F.least(F.lit(per) * F.col("weight"), ceiling * F.col("words")))


def flight(p: list[float], x: list[float], seed: int) -> list[float]:
    """Move probabilities to 0 or 1, keeping sum(p) and sum(p * x), until two or fewer are open.

    Any three open documents have a direction that changes neither sum; a step
    along it, in a random sense, brings one of them to 0 or 1.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    p = list(p)
    draws, at = rng.random(1024).tolist(), 0
    active: list[int] = []
    eps = 1e-9
    for i, value in enumerate(p):
        if not eps < value < 1 - eps:
            p[i] = round(value)
            continue
        active.append(i)
        while len(active) == 3:
            a, b, c = active
            u = (x[b] - x[c], x[c] - x[a], x[a] - x[b])
            if u == (0.0, 0.0, 0.0):
                u = (1.0, -1.0, 0.0)
            up = down = 1e300
            for k, v in zip(active, u, strict=True):
                if v > 0:
                    up, down = min(up, (1 - p[k]) / v), min(down, p[k] / v)
                elif v < 0:
                    up, down = min(up, -p[k] / v), min(down, (p[k] - 1) / v)
            if at == 1024:
                draws, at = rng.random(1024).tolist(), 0
            step = up if draws[at] * (up + down) < down else -down
            at += 1
            still = []
            for k, v in zip(active, u, strict=True):
                p[k] += step * v
                if eps < p[k] < 1 - eps:
                    still.append(k)
                else:
                    p[k] = round(p[k])
            active = still
    return p


def land(p: list[float], x: list[float]) -> list[float]:
    """Round the last open probabilities to the subset nearest to both sums."""
    open_at = [i for i, v in enumerate(p) if 0 < v < 1]
    sums, counts = np.zeros(1), np.zeros(1)
    for i in open_at:
        sums, counts = np.concatenate([sums, sums + x[i]]), np.concatenate([counts, counts + 1])
    tokens = np.abs(sums - sum(p[i] * x[i] for i in open_at))
    documents = np.abs(counts - sum(p[i] for i in open_at))
    best = int(np.lexsort((documents, tokens))[0])
    out = list(p)
    for k, i in enumerate(open_at):
        out[i] = float(best >> k & 1)
    return out


def _sorted(group: pd.DataFrame) -> pd.DataFrame:
    return group.sort_values(["doc_id", "tag", "size"], kind="stable", na_position="first").reset_index(drop=True)


def _fly(group: pd.DataFrame) -> pd.DataFrame:
    """Flight in one block; in the last block of a source some documents stay open to land."""
    group = _sorted(group)
    p, x = group["p"].to_numpy(dtype=float).copy(), group["size"].to_numpy(dtype=float)
    flying = np.flatnonzero((p > 0) & (p < 1))
    if group["blocks"].iloc[0] == 1:
        flying = flying[np.argsort(group["tag"].to_numpy()[flying], kind="stable")][: max(0, len(flying) - (LANDING - 2))]
    seed = int(group["block"].iloc[0]) & ((1 << 62) - 1)
    p[flying] = flight(p[flying].tolist(), x[flying].tolist(), seed)
    group["p"] = p
    return group


def _land(group: pd.DataFrame) -> pd.DataFrame:
    group = _sorted(group)
    group["p"] = land(group["p"].tolist(), group["size"].astype(float).tolist())
    return group


def _with_sources(rows: DataFrame, each: DataFrame, few: bool) -> DataFrame:
    """rows with the columns of their source's row; a table of many sources is joined by shuffle."""
    each = each.withColumnRenamed("source", "of")
    return rows.join(F.broadcast(each) if few else each, F.col("source").eqNullSafe(F.col("of"))).drop("of")


def plan(docs: DataFrame, weights=WEIGHTS, ceiling: float = CEILING) -> DataFrame:
    """doc_id, source, size, tag, source_size, target, copy, times, part for every row.

    A row is taken ``times`` times whole and ``part`` words more (or, below 0, less).
    copy counts the rows with the same doc_id, text and source from 1.
    """
    slim = sizes(docs).groupBy("doc_id", "source", "size", "tag").agg(F.count(F.lit(1)).alias("copies"))
    slim = store.table(slim, "mix-sizes")
    totals = slim.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("words"), F.count(F.lit(1)).alias("n"))
    ratio = F.when(F.col("words") > 0, F.least(F.col("target") / F.col("words"), F.lit(ceiling))).otherwise(0.0)
    each = targets(totals, weights, ceiling).select("source", F.col("words").alias("source_size"), "target", F.floor(ratio).alias("whole"), (ratio - F.floor(ratio)).alias("share"), F.ceil(F.col("n") / BLOCK).alias("blocks"))
    each = store.table(each, "mix-targets")
    few = each.count() <= BROADCAST_SOURCES
    known = _with_sources(slim, each, few)
    # Of rows that are drawn together, the whole part of their shares is certain.
    sure = F.floor(F.col("copies") * F.col("share"))
    state = known.withColumn("p", F.when(F.col("size") > 0, F.col("copies") * F.col("share") - sure).otherwise(0.0)).withColumn("sure", F.when(F.col("size") > 0, F.col("copies") * F.col("whole") + sure).otherwise(0).cast("long"))
    columns = ["doc_id", "source", "size", "tag", "copies", "blocks", "p", "sure"]
    state = state.select(*columns).withColumn("block", F.xxhash64("source", F.pmod(F.xxhash64("doc_id", "tag"), F.col("blocks"))))
    kind = state.schema
    state = store.table(state.groupBy("block").applyInPandas(_fly, kind), "mix-flight")
    done = [state.filter("p = 0 or p = 1").select(*columns)]
    rest = state.filter("p > 0 and p < 1").select(*columns)
    while True:
        # Two open documents per block at most: each level has far fewer than the one before.
        most = rest.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        if most <= LANDING:
            break
        fewer = rest.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("blocks") * 2 / BLOCK)).cast("long")).withColumn("block", F.xxhash64("source", F.pmod(F.xxhash64("tag", "doc_id"), F.col("blocks"))))
        state = store.table(fewer.groupBy("block").applyInPandas(_fly, kind), "mix-flight")
        done.append(state.filter("p = 0 or p = 1").select(*columns))
        rest = state.filter("p > 0 and p < 1").select(*columns)
    done.append(rest.withColumn("block", F.xxhash64("source")).groupBy("source").applyInPandas(_land, kind).select(*columns))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    got = F.col("sure") + F.col("p").cast("long")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    out = store.table(out.select("doc_id", "source", "size", "tag", "copy", (F.floor(got / F.col("copies")) + F.when(F.col("copy") <= got % F.col("copies"), 1).otherwise(0)).cast("long").alias("times")), "mix-times")
    return _with_parts(out, each, few, ceiling)


def _with_parts(rows: DataFrame, each: DataFrame, few: bool, ceiling: float) -> DataFrame:
    """rows with source_size, target and part: one document of each source makes up what whole ones miss."""
    taken = F.col("size") * F.col("times")
    who = F.struct("doc_id", "tag", "copy")
    most = lambda room: F.max_by(F.struct(room.cast("long").alias("room"), who.alias("who")), F.struct(room, "tag", "copy"))
    sums = rows.groupBy("source").agg(F.sum(taken).alias("taken"), most(ceiling * F.col("size") - taken).alias("more"), most(taken).alias("less"))
    sums = _with_sources(sums, each, few)
    miss = F.round("target").cast("long") - F.col("taken")
    sums = sums.select("source", "source_size", "target", F.when(miss > 0, F.least(miss, "more.room")).otherwise(-F.least(-miss, "less.room")).alias("miss"), F.when(miss > 0, F.col("more.who")).otherwise(F.col("less.who")).alias("who"))
    found = _with_sources(rows, store.table(sums, "mix-parts"), few)
    return found.withColumn("part", F.when(F.struct("doc_id", "tag", "copy").eqNullSafe(F.col("who")), F.col("miss")).otherwise(0)).drop("miss", "who")


def mix(docs: DataFrame, weights=WEIGHTS, ceiling: float = CEILING) -> DataFrame:
    """The documents as often as the mix takes them whole, with all their columns.

    Rows with the same doc_id, text and source are numbered by a window over those.
    """
    wide = store.free(docs, "wanted_id", "wanted_tag", "wanted_source", "wanted_times", "wanted_copy", "text_tag", "copy", "turn")
    want_id, want_tag, want_source, times, number, tag, copy, turn = wide
    chosen = plan(docs, weights, ceiling).filter("times > 0").select(F.col("doc_id").alias(want_id), F.col("tag").alias(want_tag), F.col("source").alias(want_source), F.col("times").alias(times), F.col("copy").alias(number))
    tagged = docs.withColumn(tag, F.xxhash64("text"))
    if has_repeats(docs):
        tagged = tagged.withColumn(copy, F.row_number().over(Window.partitionBy("doc_id", tag, "source").orderBy(F.lit(1))))
    else:
        tagged = tagged.withColumn(copy, F.lit(1))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(want_id)) & (F.col(tag) == F.col(want_tag)) & F.col("source").cast("string").eqNullSafe(F.col(want_source)) & (F.col(copy) == F.col(number))
    return tagged.join(chosen, same).withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*docs.columns)


def has_repeats(docs: DataFrame) -> bool:
    """Whether any row has the doc_id, text and source of another."""
    keys = docs.select("doc_id", "source", F.xxhash64("text").alias("tag"))
    return keys.groupBy("doc_id", "source", "tag").count().filter("count > 1").limit(1).count() > 0


def taken(docs: DataFrame, weights=WEIGHTS, ceiling: float = CEILING) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row."""
    return plan(docs, weights, ceiling).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times") + F.col("part")).alias("taken"))
