"""Removal of long repeated word runs by difference-cover anchors.

{0, 1, 3} is a difference cover modulo 7: for any two positions some shift below 7
brings both onto cover positions.  So two equal runs of 13 words share a 7-word
anchor that lies on cover positions of both documents, and hashing the windows at
cover positions only (3 of 7) finds every repeat.

1. Anchors go to buckets by hash, packed: one row per task unit and bucket holds
   all its hashes.  A bucket tells each document which of its anchors also occur
   in another one.
2. Around those anchors the match is extended: every full window that contains
   one gets 128 bits from two independent hashes of its words and is dealt out in the
   same way; a window whose least doc_id is smaller than its document's is a repeat.
   Two different windows among 1e12 agree in all bits with a chance of about 1e-15.
   The answer names a document's own windows by their first 64 bits.
3. Each document drops the words that its repeats cover.

Hot passages cost one packed entry per document and are never paired.  Answers come
back packed too, a row for each bucket and part of the documents.

Defined results: a null or empty text has no words; a row without doc_id neither
loses words nor takes them from others; rows of one doc_id are one document and do
not repeat each other; texts and words of any length are read whole; an empty table
gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, textkit

#: The perfect difference cover modulo PERIOD (fixed values).
PERIOD, COVER = 7, (0, 1, 3)
#: Bytes of text whose hashes are packed together, and bytes of all texts per bucket.
UNIT, PER_BUCKET = 8 << 20, 64 << 20

_DEALT = "bucket int, hashes binary, owners binary, ids binary"


def _on_cover(w: textkit.Words) -> np.ndarray:
    """Which words stand at a cover position of their document."""
    place = np.arange(len(w.hashes), dtype=np.int64) - np.repeat(w.bounds[:-1], w.counts)
    return np.isin(place % PERIOD, COVER)


def _room(w: textkit.Words, k: int) -> np.ndarray:
    """Which words have k - 1 more words of their document after them."""
    return np.arange(len(w.hashes), dtype=np.int64) + k <= np.repeat(w.bounds[1:], w.counts)


def _in_order(hashes: np.ndarray) -> np.ndarray:
    """Places of the rows (of one or two hashes) in order."""
    return np.argsort(hashes[:, 0], kind="stable") if hashes.shape[1] == 1 else np.lexsort(hashes.T[::-1])


def _new(hashes: np.ndarray) -> np.ndarray:
    """Which rows in order differ from the one before."""
    out = np.ones(len(hashes), bool)
    out[1:] = (hashes[1:] != hashes[:-1]).any(axis=1)
    return out


def _deal(hashes: np.ndarray, ids: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of packed (hash, doc_id) pairs, one per bucket; equal pairs of neighbours once."""
    order = _in_order(hashes)
    hashes, ids = hashes[order], ids[order]
    fresh = _new(hashes)
    fresh[1:] |= ids[1:] != ids[:-1]
    hashes, ids = hashes[fresh], ids[fresh]
    bucket = ((hashes[:, 0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    rows: list[list] = [[], [], [], []]
    for b in np.flatnonzero(np.diff(edges)).tolist():
        part = slice(edges[b], edges[b + 1])
        known, owner = np.unique(ids[part], return_inverse=True)
        for column, value in zip(rows, (b, hashes[part].tobytes(), owner.astype(np.uint32 if len(known) > 0xFFFF else np.uint16).tobytes(), known.tobytes()), strict=True):
            column.append(value)
    yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(x, pa.binary()) for x in rows[1:]]], names=["bucket", "hashes", "owners", "ids"])


def _dealt(found: Iterator[tuple[np.ndarray, np.ndarray, int]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Gather (hashes, doc_ids, bytes of text) into units and deal them out."""
    hashes, ids, size = [], [], 0
    for h, d, n in found:
        hashes.append(h), ids.append(d)
        size += n
        if size >= UNIT:
            yield from _deal(np.concatenate(hashes), np.concatenate(ids), buckets)
            hashes, ids, size = [], [], 0
    if hashes:
        yield from _deal(np.concatenate(hashes), np.concatenate(ids), buckets)


def _undealt(table: pa.Table, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a bucket, in order of hash."""
    hashes, ids = [], []
    for h, o, d in zip(*(table.column(x).to_pylist() for x in ("hashes", "owners", "ids")), strict=True):
        known = np.frombuffer(d, np.int64)
        hashes.append(np.frombuffer(h, np.uint64).reshape(-1, wide))
        ids.append(known[np.frombuffer(o, np.uint32 if len(known) > 0xFFFF else np.uint16)])
    every, owners = np.concatenate(hashes), np.concatenate(ids)
    order = _in_order(every)
    return every[order], owners[order]


def _shared(table: pa.Table, both: bool, parts: int, wide: int) -> pa.Table:
    """The (doc_id, hash) pairs whose hash occurs in another document, packed by the document's part.

    All bits of a hash are compared here; the first 64 go back to its document.  both: with a smaller or larger doc_id; otherwise with a smaller one only.
    """
    hashes, ids = _undealt(table, wide)
    starts = np.flatnonzero(_new(hashes))
    sizes = np.diff(np.append(starts, len(hashes)))
    least = np.repeat(np.minimum.reduceat(ids, starts), sizes)
    keep = ids > least
    if both:
        keep |= ids < np.repeat(np.maximum.reduceat(ids, starts), sizes)
    hashes, ids = hashes[keep, 0], ids[keep]
    part = (textkit.mix(ids.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((ids, part))
    hashes, ids, part = hashes[order], ids[order], part[order]
    edges = np.searchsorted(part, np.arange(parts + 1))
    at = np.flatnonzero(np.diff(edges)).tolist()
    pack = lambda x: pa.array([x[edges[p] : edges[p + 1]].tobytes() for p in at], pa.binary())
    return pa.table({"part": pa.array(at, pa.int32()), "ids": pack(ids), "hashes": pack(hashes)})


def _gathered(table: pa.Table) -> pa.Table:
    """One row per document of a part with all its hashes, sorted."""
    ids, hashes = (np.frombuffer(b"".join(table.column(x).to_pylist()), kind) for x, kind in (("ids", np.int64), ("hashes", np.uint64)))
    order = np.lexsort((hashes, ids))
    hashes, ids = hashes[order], ids[order]
    docs, first = np.unique(ids, return_index=True)
    ends = np.append(first, len(ids))[1:]
    return pa.table({"doc_id": pa.array(docs, pa.int64()), "found": pa.array([hashes[a:b].tobytes() for a, b in zip(first.tolist(), ends.tolist(), strict=True)], pa.binary())})


def _per_document(dealt: DataFrame, both: bool, parts: int, wide: int) -> DataFrame:
    """(doc_id, found): the packed hashes of each document, from all buckets."""
    rows = dealt.groupBy("bucket").applyInArrow(lambda table: _shared(table, both, parts, wide), "part int, ids binary, hashes binary")
    return rows.groupBy("part").applyInArrow(_gathered, "doc_id long, found binary")


def _in(hashes: np.ndarray, packed: bytes) -> np.ndarray:
    known = np.frombuffer(packed, np.uint64)
    at = np.searchsorted(known, hashes)
    at[at == len(known)] = 0
    return known[at] == hashes


def repeats(rows: DataFrame, window: int, buckets: int) -> DataFrame:
    """(doc_id, found): hashes of the windows that a smaller doc_id has too.

    rows: doc_id (not null), text.
    """
    anchor = window - PERIOD + 1
    if anchor < 1:
        raise ValueError(f"windows need at least {PERIOD} words")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for part in textkit.pieces(batches):
                w = textkit.words(part.column(1))
                at = np.flatnonzero(_on_cover(w) & _room(w, anchor) & np.repeat(w.counts >= window, w.counts))
                yield textkit.windows(w.hashes, anchor)[at, None], part.column(0).to_numpy()[w.owner[at]], part.column(1).nbytes

        yield from _dealt(found(), buckets)

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for part in textkit.pieces(batches):
                w = textkit.words(part.column(1), second=True)
                hit = np.zeros(len(w.hashes) + 1, np.int32)
                cover, short, full = _on_cover(w), textkit.windows(w.hashes, anchor), textkit.long_windows(w, window)
                cover &= _room(w, anchor)
                for i, packed in enumerate(part.column(2).to_pylist()):
                    own = np.arange(w.bounds[i], w.bounds[i + 1])
                    own = own[cover[own]]
                    hit[own + 1] = _in(short[own], packed)
                hits = np.cumsum(hit)
                start = np.flatnonzero(_room(w, window))
                start = start[hits[start + PERIOD] > hits[start]]  # an anchor begins within the window's first words
                yield full[start], part.column(0).to_numpy()[w.owner[start]], part.column(1).nbytes

        yield from _dealt(found(), buckets)

    near = store.table(_per_document(rows.mapInArrow(textkit.tidy(anchors), _DEALT), True, buckets, 1), "repeat-anchors")
    joined = rows.join(near.hint("merge"), "doc_id").select("doc_id", "text", "found")
    out = store.table(_per_document(joined.mapInArrow(textkit.tidy(extended), _DEALT), False, buckets, 2), "repeat-windows")
    store.drop(near)
    return out


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def remove(docs: DataFrame, window: int = 13, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(store.partitions(docs.sparkSession), -(-size // PER_BUCKET))
    named = rows.filter("doc_id IS NOT NULL")
    marked = named.join(repeats(named, window, buckets).hint("merge"), "doc_id", "left").select("doc_id", "text", "found")
    marked = marked.unionByName(rows.filter("doc_id IS NULL").withColumn("found", F.lit(None).cast("binary")))
    out = marked.mapInArrow(textkit.tidy(_remover(window, with_text)), _RESULT)
    return out if with_text else out.drop("kept_text")


def _remover(window: int, with_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textkit.pieces(batches):
            w = textkit.words(part.column(1))
            full = textkit.windows(w.hashes, window)
            removed, digests, texts = [], [], []
            for i, (text, packed) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                every = text.encode().split()
                n = len(every)
                if packed and n >= window:
                    hit = _in(full[w.bounds[i] : w.bounds[i] + n - window + 1], packed)
                    cover = np.zeros(n + 1, np.int32)
                    cover[: len(hit)] += hit
                    cover[window : window + len(hit)] -= hit
                    kept = np.flatnonzero(np.cumsum(cover[:n]) == 0).tolist()
                    every = [every[k] for k in kept]
                joined = b" ".join(every)
                removed.append(n - len(every)), digests.append(hashlib.sha256(joined).hexdigest())
                texts.append(joined.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(w.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run
