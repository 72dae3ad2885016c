"""Suffix arrays against sorted suffixes, and removal of repeated bytes against a plain search."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import suffix_dedup
from shelfmark.llm.suffix_arrays import suffix_arrays

from . import corpus


def plain(rows, length):
    texts = sorted({(i, (t or "").encode()) for i, t in rows if i is not None})
    first = {}
    for i, t in texts:
        for p in range(len(t) - length + 1):
            first.setdefault(t[p : p + length], (i, p))
    out = {}
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] != (i, p):
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out[i] = (len(t), sum(gone), spans, kept)
    return out


def check(found, rows, length):
    want = plain(rows, length)
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is not None:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept) == want[r.doc_id], r.doc_id
        assert r.kept_sha256 == hashlib.sha256(r.kept).hexdigest()


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, found string, first int, key int").repartition(parts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=40), min_size=1, max_size=6))
def test_suffixes_in_order(texts):
    texts = [[*t, 0] for t in texts]
    bounds = np.cumsum([0] + [len(t) for t in texts])
    want = [int(o) + i for t, o in zip(texts, bounds, strict=False) for i in sorted(range(len(t)), key=lambda i: t[i:])]  # noqa: B023
    assert suffix_arrays(np.array(sum(texts, [])), bounds).tolist() == want


def test_periodic_and_long_texts():
    for t in ([1] * 3000, [1, 2] * 1500, list(range(1, 900)), list(range(900, 0, -1)), [1, 1, 2] * 700 + [1]):
        t = [*t, 0]
        assert suffix_arrays(np.array(t), np.array([0, len(t)])).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_anchors_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    data, offsets = rng.integers(97, 101, 5000).astype(np.uint8), np.array([0, 0, 50, 50, 900, 4999, 5000])
    strings = lambda r: sorted((p, k) for a, b, k in zip(r.first.tolist(), r.last.tolist(), r.key.tolist(), strict=True) for p in range(a, b + 1))
    whole = suffix_dedup.runs(data, offsets, 100, anchors=True)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 137)
    cut = suffix_dedup.runs(data, offsets, 100, anchors=True)
    assert strings(whole) == strings(cut) and len(strings(whole)) == 850 - 99 + 4099 - 99
    assert dict(zip(whole.anchor_at.tolist(), whole.anchors.tolist(), strict=True)) == dict(zip(cut.anchor_at.tolist(), cut.anchors.tolist(), strict=True))


@pytest.mark.parametrize("length", [100, 20])
def test_equals_search(spark, length):
    rows = [r[:2] for r in corpus.documents() if r[0] != 187]  # the longest is left to the next test
    check(suffix_dedup.remove(frame(spark, rows), length).collect(), rows, length)


def test_awkward_texts(spark):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = [
        (0, "-" * 500), (1, "-" * 130), (2, "ab" * 200), (3, "x" + "ab" * 90 + "y"), (4, passage), (5, passage[:150] + "?" + passage[150:]), (6, passage[100:199]), (7, passage[100:200]),
        (8, "é" * 60), (9, "zé" + "é" * 70), (10, "😀" * 30 + passage), (11, None), (12, ""), (None, passage), (13, passage * 3), (14, passage), (14, passage), (15, "\0" * 120), (16, "a\0" * 100),
        (17, "".join(rng.choice("ab") for _ in range(20_000))), (18, (passage + " ") * 70),
    ]
    check(suffix_dedup.remove(frame(spark, rows), 100).collect(), rows, 100)


def test_full_keys_are_dealt_out_again(spark, monkeypatch):
    """A passage and a line that go on differently everywhere: keys have many different segments."""
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage, line = noise(160), noise(64)
    rows = [(i, noise(130) + (passage if i % 3 else line) + noise(120)) for i in range(300)]
    rows += [(300 + i, rows[i][1][: 150 + i]) for i in range(60)]
    found = suffix_dedup.remove(frame(spark, rows), 100).collect()
    check(found, rows, 100)
    monkeypatch.setattr(suffix_dedup, "FULL", 400)
    assert sorted(suffix_dedup.remove(frame(spark, rows), 100).collect()) == sorted(found)


def test_empty_and_short(spark):
    assert suffix_dedup.remove(frame(spark, [(1, "x")]).limit(0)).collect() == []
    check(suffix_dedup.remove(frame(spark, [(1, "x" * 99), (2, "x" * 99)])).collect(), [(1, "x" * 99), (2, "x" * 99)], 100)
