"""One-permutation MinHash fingerprints (DataFrame operations only).

Every word gives one shingle: the up to five words that end at it.  Each shingle
is hashed once; the hash's top bits name one of BINS bins and the bin keeps its
least hash.  An empty bin j takes the value of the filled bin b that a hash of
(j, b) ranks first, the same for all texts: optimal densification, found by a few
direct probes and, where they all miss, by ranking the filled bins.  The lowest
BITS bits of each bin's value, hashed with the bin, are packed into 64-bit words, written as hexadecimal; the
agreement of two fingerprints is corrected for matches by chance.

Defined results: a text without words (or null) has the empty fingerprint, alike
(1) to another empty one and unlike (0) to all else; equal texts have equal
fingerprints; rows of one doc_id follow each other in the order of their texts; a
null doc_id sorts first; the only row is its own next; texts of any length are read
whole; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

WIDTH, BINS, BITS, PROBES = 5, 128, 4, 8
_BIN_SHIFT = 64 - (BINS - 1).bit_length()
_PER_WORD = 64 // BITS
_WORDS = BINS // _PER_WORD
#: The lowest bit of every packed value.
_ONES = int("1" * _PER_WORD, 16)

#: Rows of a range that is ordered by one task, and the most ranges the driver lists;
#: beyond that the ranges grow and their tasks spill.
RANGE_ROWS, RANGES = 1000, 16_384

_LOW = -(1 << 63)


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, _BIN_SHIFT).cast("int")


def fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with ``out``: the packed bins, array<bigint>, empty for a text without words."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    df = df.withColumn("_words", words)
    ends = F.transform(F.col("_words"), lambda w, i: F.xxhash64(F.slice(F.col("_words"), F.greatest(i - (WIDTH - 2), F.lit(1)), F.least(i + 1, F.lit(WIDTH)))))
    df = df.withColumn("_sorted", F.sort_array(ends)).drop("_words")
    first = F.filter(F.col("_sorted"), lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(F.col("_sorted"), i - 1))))
    df = df.withColumn("_filled", first).drop("_sorted")
    df = df.withColumn("_bins", F.map_from_arrays(F.transform("_filled", _bin), F.col("_filled")))

    def dense(j: Column) -> Column:
        probes = [F.col("_bins")[F.pmod(F.xxhash64(j, F.lit(t)), F.lit(BINS)).cast("int")] for t in range(PROBES)]
        ranked = F.array_min(F.transform(F.col("_filled"), lambda h: F.struct(F.xxhash64(j, _bin(h)).alias("r"), h.alias("h"))))["h"]
        # Hashed with the bin, so that a value copied to many bins leaves other bits in each.
        return F.xxhash64(F.coalesce(F.col("_bins")[j], *probes, ranked), j)

    df = df.withColumn("_dense", F.when(F.size("_filled") > 0, F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), dense)))
    packed = F.transform(
        F.sequence(F.lit(0), F.lit(_WORDS - 1)),
        lambda w: F.aggregate(F.slice(F.col("_dense"), w * _PER_WORD + 1, F.lit(_PER_WORD)), F.lit(0).cast("long"), lambda acc, h: F.shiftleft(acc, BITS).bitwiseOR(h.bitwiseAND(F.lit((1 << BITS) - 1)))),
    )
    return df.withColumn(out, F.coalesce(F.when(F.col("_dense").isNotNull(), packed), F.array().cast("array<bigint>"))).drop("_filled", "_bins", "_dense")


def as_text(packed: Column) -> Column:
    return F.lower(F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Similarity from two packed fingerprints: agreement less what chance gives, 0 to 1."""
    differ = F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))
    differ = F.transform(differ, lambda x: x.bitwiseOR(F.shiftrightunsigned(x, 1)))
    differ = F.transform(differ, lambda x: x.bitwiseOR(F.shiftrightunsigned(x, 2)))
    unequal = F.aggregate(differ, F.lit(0), lambda acc, x: acc + F.bit_count(x.bitwiseAND(F.lit(_ONES))))
    chance = 2.0**-BITS
    share = ((BINS - unequal) / F.lit(float(BINS)) - chance) / (1 - chance)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def _bounds(rows: DataFrame, ranges: int) -> list[int]:
    marks = [i / ranges for i in range(1, ranges)]
    found = rows.agg(F.percentile_approx("d", marks, 100 * 100).alias("q")).first().q if marks else []
    return sorted(set(found or []))


def _rank(bounds: list[int], key: Column) -> Column:
    """How many bounds are at most ``key``: a binary search in a literal array."""
    if not bounds:
        return F.lit(0)
    size = 1 << len(bounds).bit_length()
    padded = F.from_json(F.lit("[" + ",".join(map(str, bounds + [(1 << 63) - 1] * (size - 1 - len(bounds)))) + "]"), "array<bigint>")
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(size.bit_length() - 1))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(padded, at + step - 1) <= key, at + step).otherwise(at))
    return F.least(found, F.lit(len(bounds)))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, fp and the next document's next_text, next_fp, in order of doc_id.

    doc_id ranges are ordered one by one; the last of each takes the first of the
    next range.  Texts are shuffled once.
    """
    ids = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LOW)).alias("d"))
    n = ids.count()
    ranges = min(RANGES, max(4 * store.partitions(docs.sparkSession), -(-n // RANGE_ROWS)))
    bounds = _bounds(ids, ranges)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("d", F.coalesce("doc_id", F.lit(_LOW)))
    rows = rows.withColumn("range", _rank(bounds, F.col("d")))

    # The first document of each range, wanted by the range before it.
    least = sorted((r["range"], r["d"]) for r in ids.withColumn("range", _rank(bounds, F.col("d"))).groupBy("range").agg(F.min("d").alias("d")).collect())
    wanted = [(own[0], least[(i + 1) % len(least)][1]) for i, own in enumerate(least)]
    schema = "array<struct<before:int,d:bigint>>"
    heads = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit("[" + ",".join(f'{{"before":{a},"d":{d}}}' for a, d in wanted) + "]"), schema)))
    firsts = rows.select("d", "text").join(F.broadcast(heads), "d").groupBy("before").agg(F.min("text").alias("first_text"))
    firsts = fingerprint(firsts, "first_text", "first_fp").withColumnRenamed("before", "range")

    marked = fingerprint(rows, "text", "fp")
    order = "OVER (PARTITION BY range ORDER BY d, text)"
    led = marked.withColumn("_next", F.expr(f"lead(struct(text, fp)) {order}"))
    joined = led.join(firsts, "range", "left")
    return joined.select(
        "doc_id",
        "text",
        "fp",
        F.coalesce(F.col("_next.text"), F.col("first_text")).alias("next_text"),
        F.coalesce(F.col("_next.fp"), F.col("first_fp")).alias("next_fp"),
    )


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of it with its last quarter from the next document."""
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    quarter = F.expr("cast(n_chars div 4 as int)")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring("next_text", F.lit(1), quarter))).drop("text", "next_text")
    rows = fingerprint(rows, "edited", "edited_fp")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
