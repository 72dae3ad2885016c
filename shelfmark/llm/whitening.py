"""Whitening of embeddings from an exact integer scatter.

Each entry c becomes the long x = floor(64 c) + 1000000.  With y = x - 1000000 and n
vectors, n * (sum of y yT) - (sum of y) (sum of y)T does not depend on the shift and is
an integer matrix: it is worked out exactly, and only n^-2 times it, the covariance, is
turned into floats, entry by entry with one rounding, and decomposed by ``eigh``.

1. Tasks cut y into signed limbs of 20 bits and multiply limb by limb, 4,096 rows at a
   time: every product sum stays under 2^53, so that float matrix products are exact.
   Sums are carried between limbs and sent as one row for each matrix row and task.
2. Partial rows are added up in two levels (salted, then whole).  The driver receives
   one row for each dimension, whatever the number of vectors.
3. Rows are projected in tasks; one more pass sums up what they gave, for the
   covariance of the whitened rows.

Defined results: a vector that is null, or holds a null or non-finite entry, is
dropped.  Vectors of another length than most (of equally frequent lengths: the longer)
and empty ones are dropped.  x beyond a long stands at the nearest long.  A null or
repeated vec_id is a row like others.  ``deviation`` is null where it does not fit into
a long.  A component whose eigenvalue is zero within rounding (at most d * 2^-52 times
the largest) has null ``whitened`` and is left out of ``identity_error``; ``explained``
is null if the trace is zero.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit

SHIFT, SCALE = 1_000_000, 64.0
#: Bits of a limb and rows of a block: 2 * LIMB + log2(BLOCK) stays under 53.
LIMB, BLOCK = 20, 4096
#: Components returned, and groups that add up partial sums before the last level.
COMPONENTS, SALTS = 32, 64
_BASE = 1 << LIMB
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def usable(vector: str) -> Column:
    """Vectors without null and non-finite entries, and not empty."""
    return F.expr(f"{vector} IS NOT NULL AND size({vector}) > 0 AND forall({vector}, c -> c IS NOT NULL AND NOT isnan(c) AND abs(cast(c AS double)) < cast('Infinity' AS double))")


def shifted(column: pa.Array, d: int) -> np.ndarray:
    """y = x - SHIFT of a column of vectors of d entries each, as longs."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    y = np.floor(flat * SCALE)
    high = float(1 << 63)
    if len(y) and (y.max() >= high - 2048 - SHIFT or y.min() < -high):  # x beyond a long stands at the nearest one
        x = [min(max(int(v), _LEAST) + SHIFT, _MOST) - SHIFT for v in y.tolist()]
        return np.array(x, dtype=object).reshape(-1, d)
    return y.astype(np.int64).reshape(-1, d)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Signed limbs of whole numbers, least first, as floats."""
    out = []
    rest = y.copy()
    while True:
        low = ((rest + (_BASE >> 1)) % _BASE) - (_BASE >> 1)
        out.append(low.astype(np.float64))
        rest = (rest - low) // _BASE
        if not np.any(rest != 0):
            return out


def carried(sums: np.ndarray) -> np.ndarray:
    """The same numbers (limbs along the first axis) with all limbs but the last in 0.._BASE - 1."""
    out, over = [], np.zeros(sums.shape[1:], np.int64)
    for part in sums:
        total = part + over
        low = total & (_BASE - 1)
        out.append(low)
        over = (total - low) >> LIMB
    while np.any((over != 0) & (over != -1)):
        low = over & (_BASE - 1)
        out.append(low)
        over = (over - low) >> LIMB
    return np.stack([*out, over])


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of numbers in limbs."""
    if len(a) < len(b):
        a, b = b, a
    total = a.copy()
    total[: len(b)] += b
    return carried(total)


def scatter(y: np.ndarray) -> np.ndarray:
    """In limbs: (d + 1) x d whole numbers, the sums of products and, last, the sums."""
    parts = limbs(y)
    d = y.shape[1]
    sums = np.zeros((2 * len(parts), d + 1, d), np.int64)
    for i, a in enumerate(parts):
        sums[i, d] += a.sum(axis=0).astype(np.int64)
        for j, b in enumerate(parts):
            sums[i + j, :d] += (a.T @ b).astype(np.int64)
    return carried(sums)


def whole(limbs_of: np.ndarray) -> list:
    """Python's integers from limbs."""
    out = np.zeros(limbs_of.shape[1:], dtype=object)
    for k in range(len(limbs_of) - 1, -1, -1):
        out = out * _BASE + limbs_of[k].astype(object)
    return out.tolist()


_ROWS = "row int, salt int, n long, size int, sums binary"


def _packed(total: np.ndarray, n: int, salt: int, rows: range) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(rows, pa.int32()), pa.array([salt] * len(rows), pa.int32()), pa.array([n] * len(rows), pa.int64()), pa.array([len(total)] * len(rows), pa.int32()), pa.array([total[:, i].tobytes() for i in rows], pa.binary())],
        names=["row", "salt", "n", "size", "sums"],
    )


def _scattered(d: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, n = np.zeros((1, d + 1, d), np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                y = shifted(batch.column(0).slice(at, BLOCK), d)
                total, n = added(total, scatter(y)), n + len(y)
        if n:
            yield _packed(total, n, TaskContext.get().partitionId() % SALTS, range(d + 1))

    return run


def _merged(table: pa.Table) -> pa.Table:
    """Partial sums of one matrix row added up."""
    first = {name: table.column(name)[0].as_py() for name in ("row", "salt")}
    total = np.zeros((1, 1), np.int64)
    for size, packed in zip(table.column("size").to_pylist(), table.column("sums").to_pylist(), strict=True):
        part = np.frombuffer(packed, np.int64).reshape(size, -1)
        total = added(np.broadcast_to(total, (len(total), part.shape[1])), part)
    n = pc.sum(table.column("n")).as_py()
    return pa.table({"row": pa.array([first["row"]], pa.int32()), "salt": pa.array([first["salt"]], pa.int32()), "n": pa.array([n], pa.int64()), "size": pa.array([len(total)], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


class Fit:
    """n, the sums, and the components of the exact covariance."""

    def __init__(self, n: int, sums: list[int], products: list[list[int]]):
        self.n, self.sums, d = n, sums, len(sums)
        exact = [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
        trace = sum(exact[i][i] for i in range(d))
        covariance = np.array([[v / (n * n) for v in row] for row in exact])
        values, vectors = np.linalg.eigh(covariance)
        k = min(COMPONENTS, d)
        self.values, self.vectors = values[::-1][:k].copy(), vectors[:, ::-1][:, :k].copy()
        self.real = self.values > max(values[-1], 0.0) * d * 2.0**-52
        self.explained = [float(e) / (trace / (n * n)) if trace else None for e in np.maximum(self.values, 0.0)]

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        most = max(abs(int(y.max())), abs(int(y.min())), 1) if y.size else 1
        if y.dtype == object or self.n * most * 2 > _MOST or max(map(abs, self.sums)) > _MOST // 2:
            return y.astype(object) * self.n - np.array(self.sums, dtype=object)
        return y * self.n - np.array(self.sums, np.int64)

    def deviations(self, v: np.ndarray) -> list[int | None]:
        most = max(abs(int(v.max())), abs(int(v.min()))) if v.size else 0
        if v.dtype != object and most**2 * v.shape[1] <= _MOST:
            return (v * v).sum(axis=1).tolist()
        found = [sum(e * e for e in row) for row in v.tolist()]
        return [x if x <= _MOST else None for x in found]

    def whitened(self, v: np.ndarray) -> np.ndarray:
        """One column a component; not a number where its eigenvalue is zero."""
        centre = np.array([[e / self.n for e in row] for row in v.tolist()], float).reshape(v.shape) if v.dtype == object else v / self.n
        out = np.full((len(v), len(self.values)), np.nan)
        out[:, self.real] = (centre @ self.vectors[:, self.real]) / np.sqrt(self.values[self.real])
        return out


def fit(vectors: DataFrame, d: int) -> Fit | None:
    """The fit of a table of one column of usable vectors of d entries."""
    partial = vectors.mapInArrow(textkit.tidy(_scattered(d)), _ROWS)
    some = partial.groupBy("row", "salt").applyInArrow(_merged, _ROWS)
    rows = some.groupBy("row").applyInArrow(_merged, _ROWS).collect()
    if not rows:
        return None
    found = {r.row: whole(np.frombuffer(r.sums, np.int64).reshape(r.size, -1)) for r in rows}
    return Fit(rows[0].n, found[d], [found[i] for i in range(d)])


def _projected(model: Fit, d: int) -> object:
    """Sums of the whitened rows and of their products, one row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                z = model.whitened(model.centred(shifted(batch.column(0).slice(at, BLOCK), d)))
                sums += z.sum(axis=0)
                products += z.T @ z
        flat = np.concatenate([sums, products.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat, pa.float64())], names=["at", "value"])

    return run


def identity_error(vectors: DataFrame, model: Fit, d: int) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    k = len(model.values)
    rows = vectors.mapInArrow(textkit.tidy(_projected(model, d)), "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(k + k * k)
    for r in rows:
        flat[r.at] = r.value
    mean = flat[:k] / model.n
    covariance = flat[k:].reshape(k, k) / model.n - np.outer(mean, mean)
    error = np.abs(covariance - np.eye(k))[np.ix_(model.real, model.real)]
    return float(error.max()) if error.size else None


_RESULT = "vec_id {id}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame) -> DataFrame:
    """A row for each usable vector of ``embeddings`` (vec_id, embedding) and component up to 32."""
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    schema = _RESULT.format(id=kind)
    spark = embeddings.sparkSession
    rows = embeddings.select("vec_id", "embedding").filter(usable("embedding"))
    usual = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if usual is None:
        return spark.createDataFrame([], schema)
    d = usual.d
    rows = rows.filter(F.size("embedding") == d)
    vectors = rows.select("embedding")
    model = fit(vectors, d)
    error = identity_error(vectors, model, d)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                v = model.centred(shifted(part.column(1), d))
                z = model.whitened(v).ravel()
                m = len(v)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                        pa.array(np.full(m * k, model.n), pa.int64()),
                        pa.array(model.deviations(v), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(z, pa.float64(), mask=np.isnan(z)),
                        pa.array(model.explained * m, pa.float64()),
                        pa.array([error] * (m * k), pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(textkit.tidy(project), schema)
