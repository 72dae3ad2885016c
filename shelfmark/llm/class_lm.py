"""Scores of a Brown class bigram model.

Exchange clustering assigns every word to a class so that the likelihood of the class
bigrams rises.  Unknown words are a class of their own.  What follows it, and how often
it follows a class, is learnt from the words seen once in training, as unknown words are
like them.  With a word's class c, the class p before it (or the unknown one) and u(p)
the share of words seen once among what follows p, drawn towards the Good-Turing share,

    P(word | p) = (1 - u(p)) * P(c | p) * count(word) / count(c)    for a known word
    P(word | p) = u(p)                                              for an unknown one,

which add up to 1 over all known words and one unknown word.  Class transitions are
smoothed towards the class frequencies.  A text starts after an end; the end is a token
of a class of its own, and unknown if there is no training text.

All counts cover every training text and every word.  Units of text send their
distinct words, packed, to buckets by hash, and get each word's count back in
their own order; so they do, in each pass, with the classes before and after each
word, and get back its new class.  A bucket moves its own words against the class
bigrams of the whole corpus, which alone are collected.  Half of the words, by hash,
have their turn in one pass and the other half in the next: words that follow each
other and all move at once would swap classes for ever.  No vocabulary is broadcast
or brought to the driver.  A word that no training text has keeps the class that
its hash gave it.

Defined results: a null or empty text is a single end; a null doc_id is in the
training part; rows keep their own results whatever their doc_id, repeated rows too;
texts and words of any length are read whole; with no training text, all words are
unknown; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, textkit

#: Words of a bucket that are moved in small blocks, classes of words, passes of exchange.
TYPES, CLASSES, PASSES = 1024, 32, 4
#: Words of a bucket that are moved one by one.
SINGLY = 256
#: Pseudo-tokens given to a class's smoothed transitions.
PRIOR = 20.0
#: Bytes of text of a unit; bytes of text per bucket of words.
UNIT, PER_BUCKET = 8 << 20, 64 << 20

_END = CLASSES  # class of the end
_UNKNOWN = CLASSES + 1  # class of unknown words
_UNIT = "unit string, doc_ids array<long>, held binary, bounds binary, words binary, counts binary, tokens binary"


def units(docs: DataFrame) -> DataFrame:
    """One row per unit of text: its documents, distinct words, and every token as a place among those.

    docs: doc_id, text, held_out.  counts holds each word's tokens in training texts.
    """

    def pack(ids, held, bounds, hashes) -> pa.RecordBatch:
        sizes = np.concatenate([np.diff(b) for b in bounds])
        held_ = np.concatenate(held)
        words, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
        learned = np.repeat(~held_, sizes)
        counts = np.bincount(tokens[learned], minlength=len(words)) if len(words) else np.zeros(0, np.int64)
        cells = (uuid.uuid4().hex, [x for part in ids for x in part], held_.astype(np.uint8).tobytes(), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64).tobytes(), words.tobytes(), counts.astype(np.uint32).tobytes(), tokens.astype(np.uint32).tobytes())
        kinds = (pa.string(), pa.list_(pa.int64()), *[pa.binary()] * 5)
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names=["unit", "doc_ids", "held", "bounds", "words", "counts", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, bounds, hashes, size = [], [], [], [], 0
        for part in textkit.pieces(batches):
            w = textkit.words(part.column(1), lower=True)
            ids.append(part.column(0).to_pylist()), held.append(np.asarray(part.column(2).to_pylist(), bool))
            bounds.append(w.bounds), hashes.append(w.hashes)
            size += part.column(1).nbytes
            if size >= UNIT:
                yield pack(ids, held, bounds, hashes)
                ids, held, bounds, hashes, size = [], [], [], [], 0
        if ids:
            yield pack(ids, held, bounds, hashes)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "held_out").mapInArrow(run, _UNIT)


def _sequences(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of a unit's tokens among its words, with an end (the place after them) before the first text and after each, the bounds of the texts, and the held-out marks."""
    bounds = np.frombuffer(row["bounds"], np.int64)
    tokens = np.frombuffer(row["tokens"], np.uint32)
    ends = bounds[1:] + np.arange(len(bounds) - 1)  # where each text's end goes
    out = np.full(len(tokens) + len(ends) + 1, len(row["words"]) // 8, np.int64)
    mine = np.ones(len(out) - 1, bool)
    mine[ends] = False
    out[1:][mine] = tokens
    return out, np.concatenate([[0], ends + 1]), np.frombuffer(row["held"], np.uint8).astype(bool)


def _edges(words: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among sorted words."""
    bucket = (words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))


def _classes(row: dict) -> np.ndarray:
    """Class of each of a unit's words and of the end; before the first pass, words are dealt out by their hash."""
    if row.get("kinds") is None:
        own = (np.frombuffer(row["words"], np.uint64) % np.uint64(CLASSES)).astype(np.int64)
    else:
        own = np.frombuffer(b"".join(x["kinds"] for x in row["kinds"]), np.uint8).astype(np.int64)
    return np.append(own, _END)


def _with_classes(rows: DataFrame, kinds: DataFrame | None) -> DataFrame:
    """rows with the classes of each unit's words, by bucket."""
    if kinds is None:
        return rows.withColumn("kinds", F.lit(None).cast("array<struct<bucket:int,kinds:binary>>"))
    return rows.join(kinds.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("bucket", "kinds"))).alias("kinds")).hint("merge"), "unit", "left")


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of their counts."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    out, at = np.unique(keys, return_inverse=True)
    return out, np.bincount(at, weights=counts, minlength=len(out)).astype(np.int64)


_PAIRS = ("before", "n_before", "after", "n_after")
_CONTEXTS = "unit string, bucket int, words binary, kinds binary, before binary, n_before binary, after binary, n_after binary, bigrams array<long>"


def _contexts(rows: DataFrame, kinds: DataFrame | None, buckets: int, turn: int | None) -> DataFrame:
    """A row per unit with its class bigrams (bucket -1) and, with a ``turn``, one per bucket with its words and the contexts of those whose turn it is.

    A context is place * (CLASSES + 1) + class before (or after), kept as the step from the one before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["unit", "bucket", "words", "kinds", *_PAIRS, "bigrams"]
        types = [pa.string(), pa.int32(), *[pa.binary()] * 6, pa.list_(pa.int64())]
        for batch in batches:
            for row in batch.to_pylist():
                seq, bounds, held = _sequences(row)
                of, words = _classes(row), np.frombuffer(row["words"], np.uint64)
                learned = np.repeat(~held, np.diff(bounds))
                left, right = seq[:-1][learned], seq[1:][learned]
                bigrams = np.bincount(of[left] * (CLASSES + 1) + of[right], minlength=(CLASSES + 1) ** 2)
                out = [(row["unit"], -1, *[None] * 6, bigrams.tolist())]
                if turn is not None:
                    moves = (words >> np.uint64(5) & np.uint64(1)) == turn
                    edges = _edges(words, buckets)
                    sides = []
                    for word, other in ((right, left), (left, right)):
                        own = np.append(moves, False)[word]
                        sides.append(_summed(word[own] * (CLASSES + 1) + of[other[own]]))
                    cuts = [np.searchsorted(codes, edges * (CLASSES + 1)) for codes, _ in sides]
                    for b in np.flatnonzero(np.diff(edges)).tolist():
                        packed = []
                        for (codes, counts), cut in zip(sides, cuts, strict=True):
                            own = slice(cut[b], cut[b + 1])
                            packed += [np.diff(codes[own] - edges[b] * (CLASSES + 1), prepend=0).astype(np.uint32).tobytes(), counts[own].astype(np.uint32).tobytes()]
                        at = slice(edges[b], edges[b + 1])
                        out.append((row["unit"], b, words[at].tobytes(), of[:-1][at].astype(np.uint8).tobytes(), *packed, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return _with_classes(rows.select("unit", "words", "bounds", "tokens", "held"), kinds).select("unit", "words", "bounds", "tokens", "held", "kinds").mapInArrow(run, _CONTEXTS)


def _total_bigrams(contexts: DataFrame) -> np.ndarray:
    """Class bigrams of all training texts: the only thing that is collected."""
    found = contexts.filter("bucket = -1").select(F.posexplode("bigrams").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((CLASSES + 1) ** 2)
    for r in found:
        out[r.k] = r.n
    return out.reshape(CLASSES + 1, CLASSES + 1)


def _reassigned(contexts: DataFrame, n: np.ndarray) -> DataFrame:
    """(unit, bucket, kinds): the classes of each unit's words after the words that have contexts were moved against the class bigrams n."""

    def move(table: pa.Table) -> pa.Table:
        cell = {c: table.column(c).to_pylist() for c in ("words", "kinds", *_PAIRS)}
        words = [np.frombuffer(x, np.uint64) for x in cell["words"]]
        edges = np.cumsum([0, *[len(x) for x in words]]).tolist()
        distinct, at = np.unique(np.concatenate(words), return_inverse=True)
        classes = np.empty(len(distinct), np.int64)
        classes[at] = np.frombuffer(b"".join(cell["kinds"]), np.uint8)
        sides = []
        for side in ("before", "after"):
            codes = [np.cumsum(np.frombuffer(x, np.uint32), dtype=np.int64) for x in cell[side]]
            keys = np.concatenate([at[e + c // (CLASSES + 1)] * (CLASSES + 1) + c % (CLASSES + 1) for e, c in zip(edges, codes, strict=False)])
            sides.append(_summed(keys, np.concatenate([np.frombuffer(x, np.uint32) for x in cell[f"n_{side}"]])))
        new = reassign(*sides, classes, n).astype(np.uint8)[at]
        kinds = pa.array([new[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
        return pa.table({"unit": table.column("unit"), "bucket": table.column("bucket"), "kinds": kinds})

    return contexts.filter("bucket >= 0").drop("bigrams").groupBy("bucket").applyInArrow(move, "unit string, bucket int, kinds binary")


def _xlogx(x: np.ndarray) -> np.ndarray:
    x = np.maximum(x, 0.0)
    return x * np.log(np.where(x > 0, x, 1.0))


def _bigrams(before: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Class bigram counts from the counts of (class before, type)."""
    out = np.zeros((CLASSES + 1, CLASSES + 1))
    np.add.at(out.T, classes, before)
    return out


def _likelihood(n: np.ndarray) -> float:
    return float(_xlogx(n).sum() - _xlogx(n.sum(axis=0)).sum() - _xlogx(n.sum(axis=1)).sum())


def exchange(before: np.ndarray, after: np.ndarray, classes: np.ndarray, block: int = 8, n: np.ndarray | None = None) -> np.ndarray:
    """Move every word, most frequent first, to the class that raises the likelihood most.

    The class bigrams are kept up to date after each of the SINGLY most frequent words
    and each block of others; those given as ``n``, which may be of more words, are
    changed in place.
    """
    classes, n = classes.copy(), _bigrams(before, classes) if n is None else n
    order = np.argsort(-before.sum(axis=1), kind="stable")
    order = order[(classes[order] < _END) & (before[order].sum(axis=1) > 0)]
    single = min(SINGLY, len(order))
    for own in [*order[:single, None], *(order[i : i + block] for i in range(single, len(order), block))]:
        a, left, right = classes[own], before[own], after[own]
        count = left.sum(axis=1)
        into, out_of, sizes = _xlogx(n), _xlogx(n), _xlogx(n.sum(axis=0))
        # Taking the types out of their classes, then putting them into each class.
        gone = (_xlogx(n.T[a] - left) - into.T[a]).sum(axis=1) + (_xlogx(n[a] - right) - out_of[a]).sum(axis=1) - 2 * (_xlogx(n.sum(axis=0)[a] - count) - sizes[a])
        to = (_xlogx(n.T[None, :CLASSES] + left[:, None]) - into.T[None, :CLASSES]).sum(axis=2) + (_xlogx(n[None, :CLASSES] + right[:, None]) - out_of[None, :CLASSES]).sum(axis=2)
        to -= 2 * (_xlogx(n.sum(axis=0)[None, :CLASSES] + count[:, None]) - sizes[None, :CLASSES])
        gain = gone[:, None] + to
        gain[np.arange(len(own)), a] = 0.0
        best = gain.argmax(axis=1)
        for t, old, new, l_, r in zip(own, a, best, left, right, strict=True):
            if old != new:
                n[:, old] -= l_
                n[:, new] += l_
                n[old] -= r
                n[new] += r
                classes[t] = new
        np.maximum(n, 0.0, out=n)
    return classes


def reassign(before: tuple[np.ndarray, np.ndarray], after: tuple[np.ndarray, np.ndarray], classes: np.ndarray, n: np.ndarray, block: int = 1 << 13) -> np.ndarray:
    """Classes of all words of a bucket after each with a context was moved.

    before, after: sorted keys word * (CLASSES + 1) + class, and their counts.  The TYPES
    most frequent words move by ``exchange``, the others in blocks: the same gain, summed
    over the contexts that a word has.
    """
    width, size = CLASSES + 1, len(classes)
    classes, n = classes.copy(), n.copy()
    sides = [(keys // width, keys % width, counts.astype(float)) for keys, counts in (before, after)]
    total = np.bincount(sides[0][0], weights=sides[0][2], minlength=size)
    order = np.argsort(-total, kind="stable")
    order = order[total[order] > 0]
    head = order[:TYPES]
    place = np.full(size, -1)
    place[head] = np.arange(len(head))
    dense = []
    for word, other, count in sides:
        own = place[word] >= 0
        dense.append(np.bincount(place[word[own]] * width + other[own], weights=count[own], minlength=len(head) * width).reshape(-1, width))
    classes[head] = exchange(*dense, classes[head], n=n)
    starts = [np.searchsorted(word, np.arange(size + 1)) for word, _, _ in sides]
    for i in range(TYPES, len(order), block):
        own = order[i : i + block]
        a, rows = classes[own], np.arange(len(own))
        gain = np.zeros((len(own), CLASSES))
        sizes = n.sum(axis=0)
        gain -= 2 * (_xlogx(sizes[None, :CLASSES] + total[own][:, None]) - _xlogx(sizes[:CLASSES]))
        gone = -2 * (_xlogx(sizes[a] - total[own]) - _xlogx(sizes[a]))
        held = []
        for (_, other, count), start, m in zip(sides, starts, (n, n.T), strict=True):
            lengths = start[own + 1] - start[own]
            of = np.repeat(rows, lengths)
            at = np.arange(len(of)) + np.repeat(start[own] - np.cumsum(lengths) + lengths, lengths)
            p, c = other[at], count[at]
            # Few pairs of context and count differ.
            pairs, which = np.unique(p * (1 << 40) + c.astype(np.int64), return_inverse=True)
            q, d = pairs >> 40, (pairs & ((1 << 40) - 1)).astype(float)
            raised = _xlogx(m[q, :CLASSES] + d[:, None]) - _xlogx(m[q, :CLASSES])
            first = np.cumsum(lengths) - lengths
            some = lengths > 0
            gain[some] += np.add.reduceat(raised[which], first[some], axis=0) if some.any() else 0.0
            gone += np.bincount(of, weights=_xlogx(m[p, a[of]] - c) - _xlogx(m[p, a[of]]), minlength=len(own))
            held.append((of, p, c))
        gain += gone[:, None]
        gain[rows, a] = 0.0
        new = gain.argmax(axis=1)
        classes[own] = new
        for (of, p, c), m in zip(held, (n, n.T), strict=True):
            np.add.at(m, (p, a[of]), -c)
            np.add.at(m, (p, new[of]), c)
        np.maximum(n, 0.0, out=n)
    return classes


@dataclass
class ClassModel:
    """Classes of every unit's words (unit, bucket, kinds; none before the first pass), log10 transitions [before, after], and tokens of every class."""

    kinds: DataFrame | None
    transitions: np.ndarray
    sizes: np.ndarray

    def steps(self, seldom: np.ndarray, unseen: float) -> np.ndarray:
        """log10 P(class | class before) with the unknown class: its row and column from words seen once, ``unseen`` their Good-Turing share."""
        follows, followed = seldom
        once = followed[:_UNKNOWN].sum()
        own = np.append(self.sizes, once)
        share = (follows + PRIOR * unseen) / (own + PRIOR)  # of what follows each class
        usual = (self.sizes + 1) / (self.sizes.sum() + len(self.sizes))
        after = (followed[:_UNKNOWN] + PRIOR * usual) / (once + PRIOR)
        known = np.vstack([10**self.transitions, after]) * (1 - share)[:, None]
        return np.log10(np.hstack([known, share[:, None]]))


def cluster(rows: DataFrame, buckets: int | None = None) -> ClassModel:
    """Exchange clustering of all words of the units; the best assignment of all passes is kept."""
    buckets = buckets or store.partitions(rows.sparkSession)
    kinds, best, best_score, best_n = None, None, -np.inf, None
    for k in range(PASSES + 1):
        contexts = store.table(_contexts(rows, kinds, buckets, k % 2 if k < PASSES else None), "lm-contexts")
        n = _total_bigrams(contexts)
        score = _likelihood(n)
        if score > best_score:
            if best is not None:
                store.drop(best)
            best, best_score, best_n = kinds, score, n
        elif kinds is not None and k == PASSES:
            store.drop(kinds)
        if k < PASSES:
            old, kinds = kinds, store.table(_reassigned(contexts, n), "lm-classes")
            if old is not None and old is not best:
                store.drop(old)
        store.drop(contexts)
    sizes = best_n.sum(axis=0)
    shares = (sizes + 1) / (sizes.sum() + len(sizes))
    transitions = np.log10((best_n + PRIOR * shares[None, :]) / (best_n.sum(axis=1, keepdims=True) + PRIOR))
    return ClassModel(best, transitions, sizes)


def _bucket_counts(rows: DataFrame, buckets: int) -> DataFrame:
    """(unit, bucket, totals, singles, tokens, kinds): the whole corpus's counts of a unit's words, by bucket.

    singles, tokens and kinds are the bucket's words seen once, tokens and distinct
    words in training, given with its first unit only.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, counts = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["counts"], np.uint32)
                edges = _edges(words, buckets)
                at = np.flatnonzero(np.diff(edges)).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([row["unit"]] * len(at), pa.string()), pa.array(at, pa.int32()), *[pa.array([x[edges[b] : edges[b + 1]].tobytes() for b in at], pa.binary()) for x in (words, counts)]], names=["unit", "bucket", "words", "counts"])

    def total(table: pa.Table) -> pa.Table:
        words = [np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()])
        _, at = np.unique(np.concatenate(words), return_inverse=True)
        sums = np.bincount(at, weights=counts)
        back = sums[at].astype(np.uint32 if sums.max(initial=0) < 2**32 else np.uint64)
        edges = np.concatenate([[0], np.cumsum([len(x) for x in words])])
        first = lambda v: pa.array([int(v), *[0] * (len(words) - 1)], pa.int64())
        totals = pa.array([back[a:b].astype(np.uint64).tobytes() if back.dtype == np.uint64 else back[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary())
        return pa.table({"unit": table.column("unit"), "bucket": table.column("bucket"), "totals": totals, "singles": first((sums == 1).sum()), "tokens": first(sums.sum()), "kinds": first((sums > 0).sum())})

    dealt = rows.select("unit", "words", "counts").mapInArrow(deal, "unit string, bucket int, words binary, counts binary")
    return dealt.groupBy("bucket").applyInArrow(total, "unit string, bucket int, totals binary, singles long, tokens long, kinds long")


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, folds: int = 7, fold: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"))
    facts = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size"), F.coalesce(F.sum(F.when(~F.col("held_out"), 1)), F.lit(0)).alias("learned")).first()
    buckets, ends = max(store.partitions(spark), -(-facts.size // PER_BUCKET)), facts.learned

    rows = store.table(units(named), "lm-units")
    counts = store.table(_bucket_counts(rows, buckets), "lm-counts")
    singles, tokens, kinds = counts.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("singles", "tokens", "kinds")]).first()
    model = cluster(rows, buckets)

    n, v = tokens + ends, kinds + (ends > 0)
    floor = float(np.log10(n + v + 1))
    packed = counts.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("bucket", "totals"))).alias("totals"))
    joined = _with_classes(rows.drop("counts").join(packed.hint("merge"), "unit", "left"), model.kinds).select("doc_ids", "held", "bounds", "words", "tokens", "totals", "kinds")
    steps = model.steps(_seldom(joined, buckets), (singles + 1) / (n + 2))
    sizes, end_base = np.log10(np.maximum(model.sizes, 1.0)), float(np.log10(ends + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seq, bounds, held_out = _sequences(row)
                texts, words = len(held_out), np.frombuffer(row["words"], np.uint64)
                total = _totals(row["totals"] or [], words, buckets)
                at, edges = np.frombuffer(row["tokens"], np.uint32), np.frombuffer(row["bounds"], np.int64)
                owner = np.repeat(np.arange(texts), np.diff(edges))
                seen = total > 0
                of = _classes(row)
                emitted = np.where(seen, np.log10(np.maximum(total, 1.0)) - sizes[of[:-1]], 0.0)
                of = np.where(np.append(seen, ends > 0), of, _UNKNOWN)
                add = lambda per_word, at=at, owner=owner, texts=texts: np.bincount(owner, weights=per_word[at], minlength=texts)
                lengths = np.diff(edges) + 1
                base = add(np.log10(total + 1)) + end_base - lengths * floor
                c = of[seq]
                value = np.add.reduceat(steps[c[:-1], c[1:]], bounds[:-1]) + add(emitted)
                n_known = add(seen.astype(float)).astype(np.int64) + (1 if ends else 0)
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(held_out), pa.array(lengths, pa.int64()), pa.array(n_known, pa.int64()), pa.array(np.full(texts, n), pa.int64()), pa.array(base), pa.array(value)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return joined.mapInArrow(run, _SCORED)


def _seldom(joined: DataFrame, buckets: int) -> np.ndarray:
    """From training texts: how often a word seen once follows each class, and how often each class follows one; the last of both is a word seen once."""
    width = _UNKNOWN + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seq, bounds, held = _sequences(row)
                once = np.append(_totals(row["totals"] or [], np.frombuffer(row["words"], np.uint64), buckets) == 1, False)
                of, learned = _classes(row), np.repeat(~held, np.diff(bounds))
                left, right = seq[:-1][learned], seq[1:][learned]
                follows = np.bincount(of[left][once[right]], minlength=width)
                followed = np.bincount(of[right][once[left]], minlength=width)
                follows[_UNKNOWN] = followed[_UNKNOWN] = (once[left] & once[right]).sum()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * width), pa.int32()), pa.array(np.concatenate([follows, followed]), pa.int64())], names=["k", "n"])

    out = np.zeros(2 * width)
    found = store.table(joined.mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")), "lm-seldom")  # written, so that the join's shuffle goes
    for r in found.collect():
        out[r.k] = r.n
    store.drop(found)
    return out.reshape(2, width)


def _totals(parts: list[dict], words: np.ndarray, buckets: int) -> np.ndarray:
    """Counts in the order of a unit's words, from its buckets in order."""
    if not len(words):
        return np.zeros(0)
    edges = _edges(words, buckets)
    out = np.empty(len(words))
    for part in parts:
        a, b = edges[part["bucket"]], edges[part["bucket"] + 1]
        value = part["totals"]
        out[a:b] = np.frombuffer(value, np.uint32 if len(value) == 4 * (b - a) else np.uint64)
    return out
