"""Embedding whitening: principal components by matrix-free block subspace iteration, one Spark pass for each product.

Entries become integers, so that the sums behind the mean are exact. A pass adds up Xᵀ(XQ) over the centred rows, cell by
cell; the covariance itself is never formed. QR and a Rayleigh-Ritz step follow on the driver, whose matrices have as
many rows as a vector has entries, and the residuals of the first k components decide whether another pass follows.
Where a pass doesn't halve them, as in a flat spectrum, the block is doubled, up to the whole space.

Defined cases: a null vector, a null, NaN or infinite entry, and an entry whose integer is no long drop the row. So does
a vector of another length than most have (of equally frequent lengths the longest counts); an empty table, vectors
without entries and vectors that are all equal give no rows. Null and repeated ids stay as they are; repeated rows all
count. A component without variance (an eigenvalue that rounding can't tell from 0) is left out, so that there are fewer
than k. ``deviation`` is null where the exact number is no long. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components, columns of the first block beyond them, and the largest residual of a component as a share of the
#: largest eigenvalue.
COMPONENTS, BEYOND, RESIDUAL = 32, 8, 1e-12
#: Integers are floor(SCALE * entry) + SHIFT. Fixed values.
SCALE, SHIFT = 64, 1_000_000
#: Entries that a task takes up at a time, and the bound of entries whose integers are longs.
_TOGETHER, _LARGEST = 1 << 19, 2.0**56


@dataclass
class Moments:
    """How many vectors there are, the exact sums of their integers, and the largest of these."""

    n: int
    sums: list[int]
    largest: int

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly: as 64-bit integers where all fit, else as Python's."""
        if 2 * self.n * self.largest < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(np.float64)


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, v) for the vectors that can be whitened, and their length."""
    vectors = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= _LARGEST))
    vectors = vectors.where(F.col("v").isNotNull() & ~odd)
    lengths = vectors.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d"))
    most = lengths.first()
    d = most["d"] if most else 0
    return vectors.where(F.size("v") == d), d


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integers, about _TOGETHER entries at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, max(1, _TOGETHER // d)):
            part = batch.slice(at, max(1, _TOGETHER // d))
            entries = part["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            yield part["vec_id"], np.floor(SCALE * entries).astype(np.int64) + SHIFT


def moments(vectors: DataFrame, d: int) -> Moments:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, largest, high, low = 0, 0, np.zeros(d, object), np.zeros(d, object)
        for _, x in _blocks(batches, d):
            n, largest = n + len(x), max(largest, int(np.abs(x).max()))
            high, low = high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            sums = [str((int(h) << 32) + int(w)) for h, w in zip(high, low, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(sums), pa.array([n] * d, pa.int64()), pa.array([largest] * d, pa.int64())], ["cell", "total", "n", "largest"])

    parts = vectors.mapInArrow(add, "cell int, total string, n long, largest long")
    cells = parts.groupBy("cell").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"), F.max("largest").alias("largest")).orderBy("cell").collect()
    return Moments(cells[0]["n"], [int(r["total"]) for r in cells], cells[0]["largest"])


def _summed(vectors: DataFrame, d: int, size: int, add: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``add`` over blocks of integers. Each task sends its own sum, and Spark adds the ``size`` cells up."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for _, x in _blocks(batches, d):
            total += add(x)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], ["cell", "value"])

    out = np.zeros(size)
    for r in vectors.mapInArrow(work, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[r["cell"]] = r["value"]
    return out


def product(vectors: DataFrame, found: Moments, q: np.ndarray) -> tuple[np.ndarray, float]:
    """The covariance times ``q``, and the covariance's trace, from one pass."""
    d, b = q.shape

    def add(x: np.ndarray) -> np.ndarray:
        centred = found.centred(x)
        return np.append((centred.T @ (centred @ q)).ravel(), np.square(centred).sum())

    total = _summed(vectors, d, d * b + 1, add) / found.n
    return total[:-1].reshape(d, b), float(total[-1])


def components(vectors: DataFrame, found: Moments, k: int = COMPONENTS, beyond: int = BEYOND) -> tuple[np.ndarray, np.ndarray, float, int]:
    """The first ``k`` eigenvalues of the covariance, their unit eigenvectors as columns, the trace, and the passes taken."""
    d = len(found.sums)
    k, rng = min(k, d), np.random.default_rng(11)
    q, passes, before = np.linalg.qr(rng.normal(size=(d, min(d, k + beyond))))[0], 0, np.inf
    while True:
        image, trace = product(vectors, found, q)
        passes += 1
        small = q.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        worst = np.linalg.norm(image - q * values, axis=0)[:k].max()
        if worst <= max(RESIDUAL, 8 * d * np.finfo(float).eps) * max(values[0], 0):
            some = values[:k] > max(RESIDUAL, 8 * d * np.finfo(float).eps) * values[0]
            return values[:k][some], q[:, :k][:, some], trace, passes
        if worst > before / 2 and q.shape[1] < d:
            image = np.hstack([image, rng.normal(size=(d, min(d - q.shape[1], q.shape[1]))) * values[0] / np.sqrt(d)])
        q, before = np.linalg.qr(image)[0], worst


def _identity_error(vectors: DataFrame, found: Moments, turn: np.ndarray) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    d, k = turn.shape
    mean = _summed(vectors, d, k, lambda x: (found.centred(x) @ turn).sum(axis=0)) / found.n

    def add(x: np.ndarray) -> np.ndarray:
        w = found.centred(x) @ turn - mean
        return (w.T @ w).ravel()

    covariance = _summed(vectors, d, k * k, add).reshape(k, k) / found.n
    return float(np.abs(covariance - np.eye(k)).max())


def _square_sums(deviations: np.ndarray) -> pa.Array:
    """Exact sums of squares by row; null where one is no long."""
    if deviations.dtype != object and float(np.abs(deviations).max()) ** 2 * deviations.shape[1] < 2.0**62:
        return pa.array(np.square(deviations).sum(axis=1))
    exact = [sum(int(x) * int(x) for x in row) for row in deviations]
    return pa.array([x if x < 1 << 63 else None for x in exact], pa.int64())


KINDS = {"vec_id": ("long", pa.int64()), "component": ("int", pa.int32()), "n": ("long", pa.int64()), "deviation": ("long", pa.int64()), "whitened": ("double", pa.float64()), "explained": ("double", pa.float64()), "identity_error": ("double", pa.float64())}


def whiten(rows: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for every usable row and component."""
    schema = ", ".join(f"{name} {kind}" for name, (kind, _) in KINDS.items())
    vectors, d = usable(rows, id_col, vector_col)
    nothing = rows.sparkSession.createDataFrame([], schema)
    if not d:
        return nothing
    found = moments(vectors, d)
    values, axes, trace, _ = components(vectors, found, k)
    if not len(values):
        return nothing
    turn = axes / np.sqrt(values)
    error, share = _identity_error(vectors, found, turn), values / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, d):
            m = len(turn.T)
            whitened = found.centred(x) @ turn
            every = np.repeat(np.arange(len(x)), m)
            columns = [ids.take(pa.array(every)), np.tile(np.arange(1, m + 1), len(x)), np.full(len(every), found.n), _square_sums(found.deviations(x)).take(pa.array(every)), whitened.ravel(), np.tile(share, len(x)), np.full(len(every), error)]
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(kind) for c, (_, kind) in zip(columns, KINDS.values(), strict=True)], list(KINDS))

    return vectors.mapInArrow(project, schema)
