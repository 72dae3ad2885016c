"""Removal of byte strings that occur before, by suffix arrays of dealt-out text.

A string is ``length`` consecutive bytes of one document.  The *anchor* of a string is
the least hash of its grams (runs of 32 bytes, for strings of 100); equal strings have
equal anchors, and neighbouring strings mostly share theirs.  So text is dealt out in
*segments*: the strings of one document that follow each other and have one anchor.

1. Each document sends its anchors; those that occur once in the whole corpus can't
   belong to a repeated string.  Documents get back which of theirs occur again.
2. Segments with such anchors are dealt out by anchor.  Equal segments become one row
   with the first place, by partial aggregation, so that a passage in very many documents
   is one row.  Anchors that still have over FULL bytes of different segments (such as
   the ends of a passage that goes on differently everywhere) are dealt out again by
   longer grams around the anchor (92 bytes, then whole strings); equal pieces become
   one again.  A whole string is one row for its key, so that every key is bounded.
3. The segments of a key are one text, whose suffix array (``suffix_arrays``) brings
   equal strings together: neighbours that agree in ``length`` bytes.  The first place of
   each is noted; a task orders the texts of some thousand keys side by side.
4. Documents get back the places that are first ones.  All their other strings with a
   repeated anchor occur before; the bytes under these go.

Only segments and places travel, besides the texts of documents that get an answer.  No
result rests on a hash: two strings with one anchor are compared byte by byte.

Defined results: a null or empty text has no bytes; a row without doc_id neither loses
bytes nor takes them from others; rows of one doc_id are one document, whose place is a
first one if it is so in any of them; overlapping repeats in one document count; strings
may begin or end within a character, and what is kept is bytes; texts of any length are
read whole; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, textkit
from .suffix_arrays import suffix_arrays

#: Bytes hashed at a time, bytes of different segments of a key, and of segments ordered side by side.
BLOCK, FULL, BATCH = 1 << 16, 4 << 10, 3 << 20
#: Texts of more bytes are ordered apart from shorter ones, which take fewer steps.
LONG = 1 << 10
#: Strings whose longer grams are one when a key is dealt out again.
STEP = 9

_VALUE = textkit.stream(21, 256)
_FACTOR = 0x9FB21C651E98DF25
_MASK = (1 << 64) - 1


class Runs(NamedTuple):
    """Strings of the texts of a batch: segments, and the places where anchors stand."""

    first: np.ndarray
    last: np.ndarray
    key: np.ndarray
    anchors: np.ndarray
    anchor_at: np.ndarray


def gram_of(length: int) -> int:
    return 32 if length >= 64 else max(1, length // 2)


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k bytes, never 0."""
    if len(data) < k:
        return np.zeros(0, np.uint64)
    power, size, width, done, out = _FACTOR, 1, _VALUE[data], 0, None
    while True:
        if k & size:
            if out is None:
                out = width
            else:
                n = len(width) - done
                out = out[:n] * np.uint64(power) + width[done : done + n]
            done += size
        size *= 2
        if size > k:
            break
        width = width[: -(size // 2)] * np.uint64(power) + width[size // 2 :]
        power = power * power & _MASK
    return textkit.mix(out[: len(data) - k + 1]) | np.uint64(1)


def _sliding(values: np.ndarray, width: int, of: Callable) -> np.ndarray:
    """of (least or greatest) over all runs of ``width`` values."""
    size = 1
    while size * 2 <= width:
        values = of(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return of(values[: len(values) - rest], values[rest:]) if rest else values


def runs(data: np.ndarray, offsets: np.ndarray, length: int, anchors: bool = False) -> Runs:
    """Segments (strings from first to last, both included) of texts one after the other."""
    k = gram_of(length)
    width, n = length - k + 1, len(data) - length + 1
    found: list[list[np.ndarray]] = [[], [], [], [], []]
    room = offsets[1:] - length  # the last string of each text, where it has one
    for a in range(0, max(n, 0), BLOCK):
        b = min(a + BLOCK, n)
        hashes = grams(data[a : b + length - 1], k)
        least = _sliding(hashes, width, np.minimum)
        t0, t1 = np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b, "left")
        if t1 - t0 > 1 or b - 1 > room[t0]:  # 0 where a string would cross into the next text
            inside = np.zeros(b - a + 1, np.int32)
            lows, highs = np.maximum(offsets[t0:t1], a), np.minimum(room[t0:t1] + 1, b)
            some = highs > lows
            np.add.at(inside, lows[some] - a, 1)
            np.add.at(inside, highs[some] - a, -1)
            least = np.where(np.cumsum(inside[:-1]) > 0, least, np.uint64(0))
            cut = np.zeros(b - a, bool)
            cut[lows[some] - a] = True
        else:
            cut = np.zeros(b - a, bool)
        cut[0] = True
        cut[1:] |= least[1:] != least[:-1]
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], b - a) - 1
        solid = least[starts] != 0
        found[0].append(starts[solid] + a), found[1].append(ends[solid] + a), found[2].append(least[starts[solid]])
        if anchors:
            edge = np.zeros(width - 1, np.uint64)
            greatest = _sliding(np.concatenate([edge, least, edge]), width, np.maximum)
            at = np.flatnonzero(greatest == hashes)
            found[3].append(hashes[at]), found[4].append(at + a)
    kinds = (np.int64, np.int64, np.uint64, np.uint64, np.int64)
    return Runs(*(np.concatenate(x) if x else np.zeros(0, kind) for x, kind in zip(found, kinds, strict=True)))


def _batch(**columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return textkit.raw(batch.column(batch.schema.get_field_index("text")))


def _anchored(length: int) -> Callable:
    """(key, doc_id, times): the anchors of each document; times is 2 for more than one place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textkit.pieces(batches):
            data, offsets = _texts(part)
            r = runs(data, offsets, length, anchors=True)
            at, where = np.unique(r.anchor_at, return_index=True)
            doc, key = np.searchsorted(offsets, at, "right") - 1, r.anchors[where]
            order = np.lexsort((key, doc))
            doc, key = doc[order], key[order]
            fresh = np.ones(len(doc), bool)
            fresh[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
            heads = np.flatnonzero(fresh)
            times = np.minimum(np.diff(np.append(heads, len(doc))), 2)
            yield _batch(key=(key[heads].view(np.int64), pa.int64()), doc_id=(part.column(0).to_numpy()[doc[heads]], pa.int64()), times=(times, pa.int8()))

    return run


def _known(r: Runs, offsets: np.ndarray, keys: list) -> tuple[np.ndarray, np.ndarray]:
    """Which segments have one of their document's repeated anchors; the document of each."""
    doc = np.searchsorted(offsets, r.first, "right") - 1
    edges = np.searchsorted(doc, np.arange(len(offsets)))
    out = np.zeros(len(doc), bool)
    for i, own in enumerate(keys):
        if own is not None and edges[i + 1] > edges[i]:
            known, keys_of = np.frombuffer(own, np.int64), r.key[edges[i] : edges[i + 1]].view(np.int64)
            out[edges[i] : edges[i + 1]] = known[np.minimum(np.searchsorted(known, keys_of), len(known) - 1)] == keys_of
    return out, doc


def _segments(length: int) -> Callable:
    """(key, segment, doc_id, place) of the segments that may hold repeated strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textkit.pieces(batches):
            data, offsets = _texts(part)
            r = runs(data, offsets, length)
            keep, doc = _known(r, offsets, part.column(part.schema.get_field_index("found")).to_pylist())
            first, last, doc = r.first[keep], r.last[keep], doc[keep]
            held = data.tobytes()
            yield _batch(
                key=(r.key[keep].view(np.int64), pa.int64()), segment=([held[a : b + length] for a, b in zip(first.tolist(), last.tolist(), strict=True)], pa.binary()),
                doc_id=(part.column(0).to_numpy()[doc], pa.int64()), place=(first - offsets[doc], pa.int64()),
            )

    return run


_SEGMENT = "key long, segment binary, doc_id long, place long"


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return textkit.raw(column.cast(pa.large_binary()))


def _again(length: int, step: int) -> Callable:
    """Segments cut up and dealt out by longer grams: those that ``step`` strings around an anchor share."""
    k = gram_of(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textkit.pieces(batches, "segment"):
            data, offsets = _joined(part.column(1))
            key, doc, place = (part.column(i).to_numpy() for i in (0, 2, 3))
            owner = np.repeat(np.arange(len(key)), np.diff(offsets))
            strings = np.arange(len(data) - length + 1)
            strings = strings[strings + length <= offsets[1:][owner[strings]]]
            if step == 1:
                lead, group = np.zeros(len(strings), np.int64), strings
                behind = strings
            else:
                here = grams(data, k)
                match = np.flatnonzero(here == key.view(np.uint64)[owner[: len(here)]])
                anchor = match[np.searchsorted(match, strings)]
                lead = (anchor - strings) // step
                group, behind = anchor * (length + 1) + lead, anchor - lead * step
            longer = grams(data, length - step + 1)[behind]
            fresh = np.ones(len(strings), bool)
            fresh[1:] = (group[1:] != group[:-1]) | (owner[strings[1:]] != owner[strings[:-1]])
            heads = np.flatnonzero(fresh)
            first, last = strings[heads], strings[np.append(heads[1:], len(strings)) - 1]
            own, held = owner[first], data.tobytes()
            keys = textkit.mix(longer[heads] + key.view(np.uint64)[own] * np.uint64(3 + 2 * step) + lead[heads].astype(np.uint64))
            yield _batch(
                key=(keys.view(np.int64), pa.int64()), segment=([held[a : b + length] for a, b in zip(first.tolist(), last.tolist(), strict=True)], pa.binary()),
                doc_id=(doc[own], pa.int64()), place=(place[own] + first - offsets[own], pa.int64()),
            )

    return run


def first_places(segments: pa.Table | pa.RecordBatch, length: int) -> pa.RecordBatch:
    """(doc_id, first, last): places that are the first of their strings, among segments in order of key."""
    key, doc, place = (segments.column(i).to_numpy() for i in (0, 2, 3))
    data, offsets = _joined(segments.column(1))
    sizes = np.diff(offsets)
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    text = np.cumsum(head) - 1
    starts = offsets[:-1] + np.arange(len(key)) + text  # a separator ends each segment, one more symbol each text
    total = int(offsets[-1]) + len(key) + int(head.sum())
    symbols = np.ones(total, np.int64)
    at = np.repeat(starts - offsets[:-1], sizes) + np.arange(len(data))
    symbols[at] = data.astype(np.int64) + 2
    bounds = np.append(starts[head], total)
    symbols[bounds[1:] - 1] = 0
    order = suffix_arrays(symbols, bounds)

    spare = np.zeros(total, bool)  # where a whole string begins
    owner = np.full(total, -1, np.int64)
    owner[at] = np.repeat(np.arange(len(key)), sizes)
    whole = owner >= 0
    spare[whole] = np.flatnonzero(whole) + length <= (starts + sizes)[owner[whole]]
    order = order[spare[order]]
    if not len(order):
        return _batch(doc_id=([], pa.int64()), first=([], pa.int64()), last=([], pa.int64()))
    flat = np.append(symbols, np.zeros(length, np.int64)).astype(np.uint16)
    strings = np.lib.stride_tricks.sliding_window_view(flat, length)
    fresh = np.ones(len(order), bool)
    for a in range(1, len(order), BLOCK):
        now = order[a : a + BLOCK]
        fresh[a : a + BLOCK] = (strings[now] != strings[order[a - 1 : a - 1 + len(now)]]).any(axis=1)
    own = owner[order]
    docs, rank = np.unique(doc, return_inverse=True)
    where = (rank[own] << 32) + place[own] + order - starts[own]
    heads = np.flatnonzero(fresh)
    least = np.sort(np.minimum.reduceat(where, heads))
    cut = np.ones(len(least), bool)
    cut[1:] = least[1:] != least[:-1] + 1
    heads = np.flatnonzero(cut)
    first, last = least[heads], least[np.append(heads[1:], len(least)) - 1]
    return _batch(doc_id=(docs[first >> 32], pa.int64()), first=(first & 0xFFFFFFFF, pa.int64()), last=(last & 0xFFFFFFFF, pa.int64()))


def _by_length(segments: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Keys whose segments have up to LONG bytes, and the others."""
    key, size = segments.column(0).to_numpy(), pc.binary_length(segments.column(1)).to_numpy()
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    heads = np.flatnonzero(head)
    long = np.repeat(np.add.reduceat(size, heads) > LONG, np.diff(np.append(heads, len(key))))
    return segments.filter(pa.array(~long)), segments.filter(pa.array(long))


def _ordered(length: int) -> Callable:
    """Rows in order of key: whole keys are ordered together, some millions of bytes at a time."""

    def places(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(tables).combine_chunks()
        if table.num_rows:
            yield first_places(table.to_batches()[0], length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        late: list[pa.Table] = []
        for part in textkit.pieces(batches, "segment", BATCH):
            held.append(part)
            if sum(x.column(1).nbytes for x in held) >= BATCH:
                table = pa.Table.from_batches(held).combine_chunks()
                key = table.column(0).to_numpy()
                stop = int(np.searchsorted(key, key[-1]))  # the last key may go on
                if stop:
                    short, long = _by_length(table.slice(0, stop))
                    yield from places([short])
                    late.append(long)
                    if sum(x.nbytes for x in late) >= BATCH:
                        yield from places(late)
                        late = []
                held = table.slice(stop).combine_chunks().to_batches()
        if held:
            short, long = _by_length(pa.Table.from_batches(held).combine_chunks())
            yield from places([short])
            late.append(long)
        if late:
            yield from places(late)

    return run


def _collapsed(rows: DataFrame) -> DataFrame:
    """Equal segments of a key as one, at its first place."""
    return rows.groupBy("key", "segment").agg(F.min(F.struct("doc_id", "place")).alias("at")).select("key", "segment", "at.doc_id", "at.place")


def _bounded(segments: DataFrame, length: int, scratch: store.Scratch) -> DataFrame:
    """Segments whose keys have at most FULL bytes, or one string each."""
    done = None
    for step in (STEP, 1) if length > STEP else (1,):
        full = scratch.table(segments.groupBy("key").agg(F.sum(F.octet_length("segment")).alias("size")).filter(F.col("size") > FULL).select("key"), "suffix-full")
        if full.isEmpty():
            break
        rest = segments.join(full, "key", "left_anti")
        done = rest if done is None else done.unionByName(rest)
        pieces = segments.join(full, "key", "left_semi").mapInArrow(textkit.tidy(_again(length, step)), _SEGMENT)
        segments = scratch.table(_collapsed(pieces), "suffix-pieces")
    return segments if done is None else done.unionByName(segments)


def answers(rows: DataFrame, length: int, scratch: store.Scratch) -> DataFrame:
    """(doc_id, found, first, last): repeated anchors of a document, and its places that are first ones."""
    spark = rows.sparkSession
    anchors = scratch.table(rows.mapInArrow(textkit.tidy(_anchored(length)), "key long, doc_id long, times byte"), "suffix-anchors")
    shared = anchors.groupBy("key").agg(F.sum("times").alias("times")).filter("times > 1").select("key")
    found = anchors.join(shared, "key", "left_semi").groupBy("doc_id").agg(F.collect_list("key").alias("keys"))
    found = scratch.table(found.mapInArrow(_to_bytes, "doc_id long, found binary"), "suffix-found")
    named = rows.join(found.hint("merge"), "doc_id").select("doc_id", "text", "found")
    segments = scratch.table(_collapsed(named.mapInArrow(textkit.tidy(_segments(length)), _SEGMENT)), "suffix-segments")
    ready = _bounded(segments, length, scratch)
    n = store.partitions(spark)
    ordered = ready.repartition(n, "key").sortWithinPartitions("key").mapInArrow(textkit.tidy(_ordered(length)), "doc_id long, first long, last long")
    places = ordered.groupBy("doc_id").agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last"))
    return scratch.table(found.join(places, "doc_id", "left"), "suffix-answers")


def _to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(1)
        flat, edges = keys.flatten().to_numpy(zero_copy_only=False), keys.offsets.to_numpy() - keys.offsets[0].as_py()
        yield _batch(doc_id=(batch.column(0), pa.int64()), found=([np.unique(flat[a:b]).tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary()))


def _remover(length: int, with_bytes: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textkit.pieces(batches):
            data, offsets = _texts(part)
            column = lambda name: part.column(part.schema.get_field_index(name))  # noqa: B023, E731
            found = column("found")
            gone = np.zeros(len(data), bool)
            if found.null_count < len(found):
                r = runs(data, offsets, length)
                keep, _ = _known(r, offsets, found.to_pylist())
                repeat = np.zeros(len(data) + 1, np.int32)
                np.add.at(repeat, r.first[keep], 1)
                np.add.at(repeat, r.last[keep] + 1, -1)
                repeat = np.cumsum(repeat) > 0
                for i, (first, last) in enumerate(zip(column("first").to_pylist(), column("last").to_pylist(), strict=True)):
                    for a, b in zip(first or (), last or (), strict=True):
                        repeat[offsets[i] + a : offsets[i] + b + 1] = False
                so_far = np.cumsum(repeat, dtype=np.int32)  # a byte goes if one of the last ``length`` places repeats; none reaches into the next text
                gone = so_far[:-1] > 0
                gone[length:] = so_far[length:-1] > so_far[: -length - 1]
            before = np.concatenate([[0], np.cumsum(gone)])
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            begins[offsets[:-1][offsets[:-1] < len(data)]] |= gone[offsets[:-1][offsets[:-1] < len(data)]]
            spans = np.concatenate([[0], np.cumsum(begins)])
            kept = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                kept.append(data[a:b].tobytes() if before[b] == before[a] else data[a:b][~gone[a:b]].tobytes())
            yield _batch(
                doc_id=(part.column(0), pa.int64()), n_bytes=(np.diff(offsets), pa.int64()), n_removed=(np.diff(before[offsets]), pa.int64()), n_spans=(np.diff(spans[offsets]), pa.int64()),
                kept_sha256=([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), kept=(kept if with_bytes else [None] * len(kept), pa.binary()),
            )

    return run


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove(docs: DataFrame, length: int = 100, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept: the bytes that stay) for every row."""
    if length < 2:
        raise ValueError("strings need at least two bytes")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    named = rows.filter("doc_id IS NOT NULL")
    scratch = store.Scratch()
    found = answers(named, length, scratch)
    marked = named.join(found.hint("merge"), "doc_id", "left").select("doc_id", "text", "found", "first", "last")
    nothing = {c: F.lit(None).cast(found.schema[c].dataType) for c in ("found", "first", "last")}
    out = marked.unionByName(rows.filter("doc_id IS NULL").withColumns(nothing)).mapInArrow(textkit.tidy(_remover(length, with_bytes)), _RESULT)
    scratch.clear(found)
    return out if with_bytes else out.drop("kept")
