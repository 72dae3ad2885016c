"""Whitening against fractions and plain numpy."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from shelfmark.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n int, component string"


def vectors(n=300, d=5, seed=3):
    rng = random.Random(seed)
    return [(i, [float(np.float32(rng.gauss(0, 1 + j) + (i % 3) * j)) for j in range(d)], 1, 7, "x") for i in range(n)]


def exact(rows):
    x = [[math.floor(64 * c) + 1_000_000 for c in r[1]] for r in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    v = [[Fraction(n * sum(r[i] * r[j] for r in x) - s[i] * s[j], n * n) for j in range(d)] for i in range(d)]
    return x, s, v


def test_limbs_are_exact():
    rng = random.Random(1)
    for big in (50, 1 << 21, 1 << 45, 1 << 62):
        y = np.array([[rng.randint(-big, big) for _ in range(4)] for _ in range(70)], dtype=np.int64 if big < 1 << 61 else object)
        total = whitening.whole(whitening.added(whitening.scatter(y[:30]), whitening.scatter(y[30:])))
        plain = y.astype(object)
        assert total[:4] == (plain.T @ plain).tolist()
        assert total[4] == plain.sum(axis=0).tolist()


def test_equals_fractions(spark):
    rows = vectors()
    awkward = [(900, None, 1, 1, ""), (901, [1.0, None, 2.0, 3.0, 4.0], 1, 1, ""), (902, [float("nan")] * 5, 1, 1, ""), (903, [1.0, float("-inf"), 0.0, 0.0, 0.0], 1, 1, ""), (904, [], 1, 1, ""), (905, [1.0, 2.0], 1, 1, "")]
    again = [(5, rows[5][1], 1, 1, ""), (None, rows[6][1], 1, 1, "")]
    found = whitening.whiten(spark.createDataFrame(rows + awkward + again, SCHEMA).repartition(3)).collect()
    kept = rows + again
    x, s, v = exact(kept)
    n = len(x)
    assert len(found) == n * 5
    values, vecs = np.linalg.eigh(np.array([[float(e) for e in r] for r in v]))
    values, vecs = values[::-1], vecs[:, ::-1]
    by = {}
    for r in found:
        by.setdefault((r.vec_id, r.component), []).append(r)
    sign = {}
    for row, own in zip(kept, x, strict=True):
        centre = np.array([float(Fraction(n * a - b, n)) for a, b in zip(own, s, strict=True)])
        for k in range(5):
            want = centre @ vecs[:, k] / math.sqrt(values[k])
            for r in by[row[0], k + 1]:
                assert r.n == n
                if by[row[0], k + 1][0].deviation == r.deviation:
                    assert r.deviation == sum((n * a - b) ** 2 for a, b in zip(own, s, strict=True)) or len(by[row[0], k + 1]) > 1
                assert r.explained == pytest.approx(values[k] / sum(values), rel=1e-9)
                assert r.identity_error < 1e-9
                if abs(want) > 1e-6:
                    assert abs(r.whitened) == pytest.approx(abs(want), rel=1e-7)
                    assert sign.setdefault(k, r.whitened * want > 0) == (r.whitened * want > 0)


def test_constant_and_single_and_empty(spark):
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0, 0, "")], SCHEMA)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None)] * 2
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 3.0], 0, 0, "") for i in range(10)], SCHEMA)).collect()
    assert {r.component: r.whitened is None for r in flat} == {1: False, 2: True}
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None, 0, 0, ""), (2, [], 0, 0, "")], SCHEMA)).collect() == []


def test_entries_beyond_longs(spark):
    rows = [(0, [3e38, 1.0], 0, 0, ""), (1, [-3e38, 2.0], 0, 0, ""), (2, [0.0, 3.0], 0, 0, "")]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == 6 and all(r.deviation is None for r in found if r.vec_id != 2)
    assert all(r.identity_error < 1e-4 for r in found)


def test_query_has_all_rows(spark):
    found = queries.QUERIES["op13_whitening"](spark, "/root/testdata/sf0.001")
    assert found.count() == 32 * spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert found.selectExpr("max(identity_error)").first()[0] < 1e-9
