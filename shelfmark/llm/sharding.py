"""Shards of near-equal bytes by sampled splitters (DataFrame operations only).

Rows are ordered by (text hash, doc_id), so equal texts lie side by side.
Size-weighted samples of that key give quantile boundaries; exact sums per range
follow, and a range with too many rows or bytes is subdivided at the sample's
quantiles inside it.  A prefix sum over the ranges and a running sum inside each
give every row its place in the whole order, from which shard and slot follow.
A group of equal texts of at most SNAP of a shard goes whole to the shard that its
middle falls in; a row of a larger group goes by its own middle.  So only groups too
large to move are split, and shard sizes differ from the mean by at most SNAP or one
document, whichever is larger.

Defined results: a null text has size 1 and the checksum of the empty text; a
null doc_id sorts first; repeated rows take neighbouring slots; texts of any length
are one row; an empty table gives no rows; other columns are not read.  One text may
hold most rows: its rows are told apart by doc_id.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

#: Boundaries of each of the two levels (a power of two) and the expected sample.
FAN, SAMPLE = 64, 16384
#: A range with more rows, or more than OVERFULL times the mean bytes, is subdivided.
RANGE_ROWS, OVERFULL = 20_000, 1.25
#: The share of a shard up to which a group of equal texts is kept together.
SNAP = 0.02

_LOW = -(1 << 63)


def _key_array(keys: list[tuple[int, int]]) -> Column:
    return F.from_json(F.lit("[" + ",".join(f'{{"h":{h},"d":{d}}}' for h, d in keys) + "]"), "array<struct<h:bigint,d:bigint>>")


def _rank(bounds: Column, key: Column) -> Column:
    """How many of the FAN - 1 sorted boundaries are at most ``key``: a binary search."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(FAN.bit_length() - 1))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= key, at + step).otherwise(at))


def _quantiles(keys: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """FAN - 1 boundaries; the last key is repeated where there are few."""
    if not keys:
        return [((1 << 63) - 1, (1 << 63) - 1)] * (FAN - 1)
    return [keys[min(len(keys) - 1, len(keys) * i // FAN)] for i in range(1, FAN)]


def shard(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    slim = store.table(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.xxhash64(body).alias("h"),
            F.coalesce(F.col(doc_id).cast("long"), F.lit(_LOW)).alias("d"),
        ),
        "shard-rows",
    )
    total, rows = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    key = F.struct("h", "d")

    # Size-weighted sample: a row is drawn with a probability in proportion to its size.
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(4), "d", "h"), 11) / F.lit(float(1 << 53))
    drawn = slim.filter(unit < F.col("size") * F.lit(SAMPLE / max(total, 1))).select("h", "d").collect()
    keys = sorted((r.h, r.d) for r in drawn)
    # A boundary stands before its group, unless the group is a large one, which may be cut.
    often = Counter(h for h, _ in keys)
    keys = [(h, d) if often[h] > SNAP * len(keys) / shards / 2 + 4 else (h, _LOW) for h, d in keys]
    top = _quantiles(keys)
    ranged = slim.withColumn("_top", _rank(_key_array(top), key))

    # Exact sums show which ranges are overfull; those get boundaries of their own.
    sums = {r["_top"]: (r.n, r.b) for r in ranged.groupBy("_top").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).collect()}
    inside, mean = [], total / FAN
    for i in range(FAN):
        n, b = sums.get(i, (0, 0))
        if n > RANGE_ROWS or b > OVERFULL * mean:
            lo = bisect_left(keys, top[i - 1]) if i else 0
            hi = bisect_left(keys, top[i]) if i < FAN - 1 else len(keys)
            inside.append(_quantiles(keys[lo:hi]))
        else:
            inside.append(None)
    sub = F.lit(0)
    if any(inside):
        lists = F.array(*[_key_array(x) if x else F.from_json(F.lit("[]"), "array<struct<h:bigint,d:bigint>>") for x in inside])
        own = F.get(lists, F.col("_top"))
        sub = F.when(F.size(own) > 0, _rank(own, key)).otherwise(F.lit(0))
    ranged = ranged.withColumn("_range", F.col("_top") * FAN + sub)

    # Offsets of the ranges: at most FAN * FAN of them, whatever the input.
    before: list[tuple[int, int, int]] = []
    seen_rows = seen_bytes = 0
    for r in sorted(ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).collect(), key=lambda r: r["_range"]):
        before.append((r["_range"], seen_rows, seen_bytes))
        seen_rows, seen_bytes = seen_rows + r.n, seen_bytes + r.b
    offsets = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit("[" + ",".join(f'{{"_range":{a},"_n":{n},"_b":{b}}}' for a, n, b in before) + "]"), "array<struct<_range:int,_n:bigint,_b:bigint>>")))

    order = "PARTITION BY _range ORDER BY h, d, text_crc32, size ROWS UNBOUNDED PRECEDING"
    placed = (
        ranged.join(F.broadcast(offsets), "_range")
        .withColumn("_at", F.col("_n") + F.expr(f"count(1) OVER ({order})") - 1)
        .withColumn("_upto", F.col("_b") + F.expr(f"sum(size) OVER ({order})"))
        .withColumn("_all", F.expr("sum(size) OVER (PARTITION BY _range, h)"))
        .withColumn("_from", F.expr("min(_upto - size) OVER (PARTITION BY _range, h)"))
        .withColumn("_middle", F.expr(f"CASE WHEN _all * {shards} <= {SNAP * max(total, 1)} THEN 2 * _from + _all ELSE 2 * _upto - size END"))
        .withColumn("shard", F.expr(f"cast(least({shards - 1}, (_middle * {shards}) div {2 * max(total, 1)}) as int)"))
        .select("doc_id", "size", "text_crc32", "shard", "_at")
    )
    placed = store.table(placed, "shard-places")
    firsts = {r.shard: r["_first"] for r in placed.groupBy("shard").agg(F.min("_at").alias("_first")).collect()}
    first = F.get(F.array(*[F.lit(firsts.get(i, 0)).cast("long") for i in range(shards)]), F.col("shard"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_at") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
