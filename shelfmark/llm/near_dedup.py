"""MinHash near-duplicates with sequential Bayesian verification.

1. Each text becomes its set of distinct word shingles, a MinHash signature and
   band keys.  Texts with equal sets form one class; its smallest doc_id stands
   for it, so copies are never compared.
2. Classes that share a band key are candidates.  In each bucket every member is
   first compared with the bucket's smallest one, its hub.
3. Signatures are compared batch by batch; a pair is dropped once the posterior
   probability that its similarity reaches the threshold, given the agreements so
   far (uniform prior), falls below ``miss``.  Survivors are verified on their
   full sets.
4. Components of the links so far show which buckets still hold several of them.
   Each such bucket draws HUBS other hubs, to which its members of other components
   are compared; a large group of near copies joins up so, at a few rows a member.
5. Where components are still apart, all members of different components are
   compared.  A bucket of at most BLOCK members is one row.  A larger one is cut into
   blocks, and each pair of blocks is a row of its own, dealt out by band and both
   blocks: signatures are compared, survivors verified by one matrix product over the
   shingles that both blocks have, and only links given that join something.  No
   bucket is capped and none emits its pairs.  A pair is taken up in the first band
   it shares.

Defined results: a text without words (or null) has an empty set and is linked
with nothing; a row without doc_id is linked with nothing, its component is null
and it is kept; rows of one doc_id are one document; repeated rows change nothing;
very long texts are read whole; an empty table gives no rows; extra columns, of
any name, are carried by ``deduplicate`` and never read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, textkit
from .components import components, roots

#: Members of a bucket that are compared in one row; other hubs that a bucket draws.
BLOCK, HUBS = 64, 2
#: Members and shingles of a block of a larger bucket, about.
CROWD, CROWD_SHINGLES = 256, 1 << 20


@dataclass(frozen=True)
class Settings:
    """k words a shingle; similarity of at least ``percent`` / 100.

    ``band_miss`` bounds the chance that a pair just at the threshold shares no
    band, ``miss`` that the signatures drop it.
    """

    k: int = 5
    percent: int = 80
    rows: int = 4
    band_miss: float = 1e-5
    miss: float = 1e-5
    batch: int = 16

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.band_miss) / math.log(1 - (self.percent / 100) ** self.rows))

    @property
    def length(self) -> int:
        return self.bands * self.rows

    def least_agreements(self) -> list[tuple[int, int]]:
        """(hashes compared, agreements needed) after each batch.

        With a uniform prior, P(similarity >= t | m of n) = P(Binomial(n + 1, t) <= m).
        """
        out, t = [], self.percent / 100
        stops = [*range(self.batch, self.length, self.batch), self.length]
        for n in stops:
            total, need = 0.0, n
            for m in range(n + 1):
                total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
                if total >= self.miss:
                    need = m
                    break
            out.append((n, need))
        return out


def signature(values: np.ndarray, factors: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """The least of each of the permuted 32-bit hashes of a set."""
    low = (values >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):
        np.minimum(out, ((low[i : i + 2048, None] ^ masks) * factors).min(axis=0), out=out)
    return out


_SETS = "doc_id long, n_shingles long, set_key binary, signature binary, bands array<long>"


def sets(docs: DataFrame, s: Settings, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, set size, digest of the set, signature and band keys of each row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = textkit.stream(31, 2 * s.length)
        factors = (draws[: s.length] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        masks = (draws[s.length :] >> np.uint64(32)).astype(np.uint32)
        salt = textkit.stream(32, s.bands)
        step = np.uint64(0x9E3779B97F4A7C15)
        for part in textkit.pieces(batches):
            w = textkit.words(part.column(1), lower=True)
            sizes, keys, signed, bands = [], [], [], []
            for own in textkit.distinct_sets(*textkit.shingles(w, s.k)):
                sizes.append(len(own))
                if not len(own):
                    keys.append(None), signed.append(None), bands.append(None)
                    continue
                sig = signature(own, factors, masks)
                acc = salt.copy()
                for column in sig.reshape(s.bands, s.rows).T:
                    acc = textkit.mix(acc * step + column.astype(np.uint64))
                keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                signed.append(sig.tobytes())
                bands.append(acc.astype(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signed, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "signature", "bands"])

    return rows.mapInArrow(textkit.tidy(run), _SETS)


def _agree(left: np.ndarray, right: np.ndarray, stops: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of two signature matrices survive all batches."""
    alive, seen, same = np.arange(len(left)), 0, np.zeros(len(left), np.int64)
    for n, need in stops:
        same = same + (left[alive, seen:n] == right[alive, seen:n]).sum(axis=1)
        keep = same >= need
        alive, same, seen = alive[keep], same[keep], n
        if not len(alive):
            break
    return alive


def prune(pairs: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b, signature_a, signature_b) that the posterior leaves, as (a, b)."""
    stops, length = s.least_agreements(), s.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, length) for i in (2, 3))
            at = pa.array(_agree(left, right, stops))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    return pairs.select("a", "b", "signature_a", "signature_b").mapInArrow(textkit.tidy(run), "a long, b long")


def _open_pairs(ids: np.ndarray, labels: np.ndarray, signed: np.ndarray, ids_2: np.ndarray, labels_2: np.ndarray, signed_2: np.ndarray, k: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Places of the open pairs of two lists of members that the posterior leaves.

    Open: of different components, not met in one of the k earlier bands, and taken once.
    """
    take = (labels[:, None] != labels_2[None, :]) & ((ids[:, None] < ids_2[None, :]) if ids is ids_2 else True)
    for i in range(k):
        if not take.any():
            break
        band = slice(i * s.rows, (i + 1) * s.rows)
        _, at = np.unique(np.concatenate([signed[:, band], signed_2[:, band]]), axis=0, return_inverse=True)
        take &= at[: len(ids), None] != at[None, len(ids) :]
    a, b = np.nonzero(take)
    at = [part + low for low in range(0, len(a), 1 << 15) for part in (_agree(signed[a[low : low + (1 << 15)]], signed_2[b[low : low + (1 << 15)]], s.least_agreements()),)]
    at = np.concatenate(at) if at else np.zeros(0, np.int64)
    return a[at], b[at]


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _members(row: dict, s: Settings, side: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels and signatures of a row's list of members."""
    signed = np.frombuffer(b"".join(row[f"signatures{side}"]), np.uint32).reshape(-1, s.length)
    return np.array(row[f"reps{side}"], np.int64), np.array(row[f"labels{side}"], np.int64), signed


def prune_buckets(buckets: DataFrame, s: Settings) -> DataFrame:
    """The open pairs of small buckets (k, reps, labels, signatures) that survive, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                own = _members(row, s)
                a, b = _open_pairs(*own, *own, row["k"], s)
                if len(a):
                    yield _links(own[0][b], own[0][a])

    return buckets.mapInArrow(textkit.tidy(run), "a long, b long")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets: one matrix product over common shingles."""
    common = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)

    def marks(sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), len(common)), np.float32)
        for i, own in enumerate(sets):
            out[i, np.searchsorted(common, np.intersect1d(own, common, assume_unique=True))] = 1
        return out

    return (marks(left) @ marks(right).T).astype(np.int64)


def verify_blocks(blocks: DataFrame, s: Settings) -> DataFrame:
    """Pairs of blocks of large buckets: links among their open pairs, verified on full sets here.

    Only links that join something within the pair of blocks are given.
    """

    def sets_of(texts: list[str | None]) -> list[np.ndarray]:
        return textkit.distinct_sets(*textkit.shingles(textkit.words(pa.array(texts, pa.large_string()), lower=True), s.k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[tuple, list[np.ndarray]] | None = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                own = _members(row, s)
                other = own if row["block"] == row["block_2"] else _members(row, s, "_2")
                a, b = _open_pairs(*own, *other, row["k"], s)
                if not len(a):
                    continue
                left = sets_of(row["texts"])
                key = (row["band"], row["block_2"])
                if other is own:
                    right = left
                elif last is not None and last[0] == key:
                    right = last[1]
                else:
                    right = sets_of(row["texts_2"])
                    last = key, right
                use_a, at_a = np.unique(a, return_inverse=True)
                use_b, at_b = np.unique(b, return_inverse=True)
                shared = shared_counts([left[x] for x in use_a], [right[x] for x in use_b])[at_a, at_b]
                na, nb = np.array([len(x) for x in left])[a], np.array([len(x) for x in right])[b]
                good = (shared > 0) & (100 * shared >= s.percent * (na + nb - shared))
                if good.any():
                    node, root = roots(own[0][a[good]], other[0][b[good]])
                    yield _links(node[node != root], root[node != root])

    return blocks.mapInArrow(textkit.tidy(run), "a long, b long")


def verify(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) whose full shingle sets reach the threshold."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, np.ndarray] | None = None
        for part in textkit.pieces(batches, "text_a"):
            own = textkit.distinct_sets(*textkit.shingles(textkit.words(part.column(2), lower=True), s.k))
            hub_texts, good = part.column(3), []
            for i, mine in enumerate(own):
                hub = hub_texts[i].as_py()
                if last is None or last[0] != hub:
                    last = hub, textkit.distinct_sets(*textkit.shingles(textkit.words(hub_texts.slice(i, 1), lower=True), s.k))[0]
                shared = len(np.intersect1d(mine, last[1], assume_unique=True))
                good.append(100 * shared >= s.percent * (len(mine) + len(last[1]) - shared) and shared > 0)
            yield part.select(["a", "b"]).filter(pa.array(good))

    return both.mapInArrow(textkit.tidy(run), "a long, b long")


def _signed(members: DataFrame, signed: DataFrame) -> DataFrame:
    """(a, b, signature_a, signature_b) of the distinct pairs of a member (a) with hubs (b).

    A member meets one hub a band and draw, so its list is short.
    """
    listed = members.groupBy("a").agg(F.collect_set("b").alias("hubs"))
    out = listed.join(signed.select(F.col("rep").alias("a"), F.col("signature").alias("signature_a")).hint("merge"), "a")
    out = out.select("a", "signature_a", F.explode("hubs").alias("b"))
    return out.join(signed.select(F.col("rep").alias("b"), F.col("signature").alias("signature_b")).hint("merge"), "b")


def group(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    s = settings or Settings()
    work = store.Scratch()
    rows = store.table(sets(docs, s), "near-sets")
    usable = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # One row per class; equal sets have equal signatures.
    classes = work.table(usable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), *[F.any_value(c).alias(c) for c in ("n_shingles", "signature", "bands")]), "near-classes")
    signed = classes.select("rep", "signature")
    banded = classes.select("rep", "n_shingles", F.posexplode("bands").alias("k", "band"))
    hubs = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("n_all"), F.min("rep").alias("hub"), F.max("rep").alias("top")).filter("hub < top")
    members = work.table(banded.drop("n_shingles").join(work.table(hubs.drop("top"), "near-hubs").hint("merge"), "band"), "near-members")

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).filter("doc_id IS NOT NULL")
    texts = work.table(texts.join(members.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"), "near-texts")  # a doc_id with several texts is linked by any of them
    left = work.table(prune(_signed(members.filter("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")), signed), s), "near-pairs")
    links = verify(left, texts, s)
    if _repeated(usable):
        links = links.unionByName(_same_document(usable, classes))
    found = components(work.table(links, "near-links"))

    members = members.filter("n > 2")

    def labelled() -> DataFrame:
        at = members.join(found.withColumnRenamed("node", "rep").hint("merge"), "rep", "left")
        return work.table(at.select("band", "k", "rep", "n", "n_all", "hub", F.coalesce("component", "rep").alias("label")), "near-labels")

    def add(new: DataFrame) -> bool:
        """Add links; whether there are any."""
        nonlocal found
        if not new.limit(1).count():
            return False
        found = components(work.table(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(new), "near-links"))
        return True

    # Other hubs in every bucket that still holds several components, by lot in each band.
    labels = labelled()
    lots = F.array(*[F.min_by(F.struct("rep", "label"), F.when(F.col("rep") != F.col("hub"), F.xxhash64("rep", "band", F.lit(i)))) for i in range(HUBS)])
    apart = labels.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), lots.alias("drawn")).filter("low < high").select("band", "drawn")
    others = labels.join(work.table(apart, "near-open").hint("merge"), "band").select("rep", "label", F.explode("drawn").alias("hub")).filter("label <> hub.label")
    left = work.table(prune(_signed(others.select(F.col("rep").alias("a"), F.col("hub.rep").alias("b")), signed), s), "near-pairs")
    if add(work.table(verify(left, texts, s), "near-links")):
        labels = labelled()

    # What is left: all members of buckets that still hold several components.
    apart = labels.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("band")
    rest = work.table(labels.drop("hub").join(work.table(apart, "near-open").hint("merge"), "band").join(signed.hint("merge"), "rep"), "near-rest")
    lists = [F.collect_list(c).alias(f"{c}s") for c in ("rep", "label", "signature")]
    few = rest.filter(F.col("n") <= BLOCK).groupBy("band", "k").agg(*lists)
    left = work.table(prune_buckets(few, s).distinct(), "near-pairs")
    more = [work.table(verify(left, texts, s), "near-links")]
    if rest.filter(F.col("n") > BLOCK).limit(1).count():
        more.append(work.table(verify_blocks(_block_pairs(rest.filter(F.col("n") > BLOCK), texts, work), s), "near-links"))
    for new in more:
        add(new)

    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    named = store.table(named, "near-named")
    work.clear()
    # Rows without a set get keys of their own, so that they don't meet in one task.
    keyed = rows.select("doc_id", "n_shingles", F.coalesce("set_key", F.unhex(F.lpad(F.hex("doc_id"), 16, "0")), F.unhex(F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0"))).alias("set_key"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return (
        keyed.join(named.hint("merge"), "set_key", "left")
        .withColumn("component_id", component)
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def _block_pairs(rest: DataFrame, texts: DataFrame, work: store.Scratch) -> DataFrame:
    """Every pair of blocks of each large bucket, with the members of both."""
    blocks = F.ceil(F.greatest(F.col("n") / CROWD, F.col("n_all") / CROWD_SHINGLES)).cast("int")
    crowds = rest.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    crowds = crowds.join(texts.withColumnRenamed("doc_id", "rep").hint("merge"), "rep")
    names = [f"{c}s" for c in ("rep", "label", "signature", "text")]
    made = work.table(crowds.groupBy("band", "k", "blocks", "block").agg(*[F.collect_list(c[:-1]).alias(c) for c in names]), "near-blocks")
    first = made.withColumn("block_2", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)))
    second = made.select("band", F.col("block").alias("block_2"), *[F.col(c).alias(f"{c}_2") for c in names])
    return first.join(second.hint("merge"), ["band", "block_2"]).select("band", "k", "block", "block_2", *names, *[f"{c}_2" for c in names])


def _repeated(usable: DataFrame) -> bool:
    """Whether a doc_id has rows with different sets."""
    return usable.groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).filter("low < high").limit(1).count() > 0


def _same_document(usable: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of a doc_id that has rows with different sets."""
    several = usable.groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).filter("low < high").select("doc_id")
    at = usable.join(several, "doc_id", "left_semi").select("doc_id", "set_key").distinct().join(classes, "set_key")
    least = at.groupBy("doc_id").agg(F.min("rep").alias("b"))
    return at.join(least, "doc_id").filter("rep <> b").select(F.col("rep").alias("a"), "b").distinct()


def deduplicate(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One document of each component, with all its columns."""
    (name,) = store.free(docs, "gone")
    gone = group(docs, settings).filter("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti").select(*docs.columns)
