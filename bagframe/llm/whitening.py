"""Whitening of embeddings: a distributed centred covariance, its leading eigenpairs, and the projection of every vector.

A pass sums the integer vectors exactly, a second one the products of what is left after the mean is taken off, a row per dimension
and task. Only sums per dimension and the covariance, whose size is the square of the dimension, come to the driver; the components
go back to the tasks with the function that projects.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagframe.llm.eigen import leading

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: |SCALE * c| from here on has no exact long.
_REACH = 2.0 ** 62
#: An eigenvalue below this share of the largest, times the dimension, is rounding of zero.
_FLAT = 1e-13
_LOW = (1 << 32) - 1


def _usable(vectors: DataFrame, column: str) -> DataFrame:
    """Rows with a vector of at least one entry and all entries finite; the vector as doubles in `v`, its length in `dim`."""
    v = F.col(f"`{column}`").cast("array<double>")
    found = vectors.withColumn("v", v).where(F.col("v").isNotNull() & (F.size("v") > 0))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * SCALE < _REACH))
    return found.where(fine).withColumn("dim", F.size("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) * SCALE).astype(np.int64) + SHIFT


@dataclass(frozen=True)
class Whitening:
    """Fitted to n vectors: exact sums per dimension, the trace of their covariance, eigenvalues and components (columns)."""

    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    components: np.ndarray

    @property
    def dim(self) -> int:
        return len(self.sums)

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """S/n as (whole part, rest): x minus the whole part is exact, so nothing cancels."""
        return np.array([s // self.n for s in self.sums], np.int64), np.array([(s % self.n) / self.n for s in self.sums])

    def whiten(self) -> Callable[[np.ndarray], np.ndarray]:
        whole, rest = self.centre()
        turn = self.components / np.sqrt(self.values) if len(self.values) else self.components
        return lambda x: ((x - whole) - rest) @ turn

    def deviations(self) -> Callable[[np.ndarray], list[int | None]]:
        """Sum of (n x - S)^2 of every row, exact; None if it passes a long."""
        n, sums = self.n, self.sums
        whole = np.array([s // n for s in sums], np.int64)
        left = np.array([s % n for s in sums], np.int64)

        def of(x: np.ndarray) -> list[int | None]:
            y = x - whole                                     # n x - S = n y - left
            most = n * (int(np.abs(y).max(initial=0)) + 1)
            if most * most * len(sums) < 1 << 62:
                return ((n * y - left) ** 2).sum(axis=1).tolist()
            exact = ((y.astype(object) * n - left.astype(object)) ** 2).sum(axis=1)
            return [int(d) if d < 1 << 63 else None for d in exact]

        return of


def _sums(vectors: DataFrame, dim: int) -> tuple[int, list[int]]:
    """(number, exact sum per dimension)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dim, object), np.zeros(dim, object)
        for batch in batches:
            x = _matrix(batch.column("v"), dim)
            n += len(x)
            high, low = high + (x >> 32).sum(axis=0).astype(object), low + (x & _LOW).sum(axis=0).astype(object)
        if n:
            total = [(int(a) << 32) + int(b) for a, b in zip(high, low)]
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(dim), pa.int32()), "n": pa.array([n] * dim),
                                              "high": pa.array([t >> 32 for t in total]), "low": pa.array([t & _LOW for t in total])})

    parts = vectors.select("v").mapInArrow(scan, "i int, n long, high long, low long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    found = sorted(parts.groupBy("i").agg(F.sum("n").alias("n"), wide("high"), wide("low")).collect())
    return (found[0].n, [(int(r.high) << 32) + int(r.low) for r in found]) if found else (0, [0] * dim)


def _covariance(vectors: DataFrame, dim: int, size: int, n: int, centred: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Covariance, divisor n, of centred(x) with `size` columns: every task sums its products, a row per column."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((size, size)), False
        for batch in batches:
            if batch.num_rows:
                d = centred(_matrix(batch.column("v"), dim))
                total, seen = total + d.T @ d, True
        if seen:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(size), pa.int32()), "row": pa.array(list(total), pa.list_(pa.float64()))})

    parts = vectors.select("v").mapInArrow(scan, "i int, row array<double>")
    add = F.array(*[F.sum(F.col("row")[j]) for j in range(size)]) if size <= 128 else None
    if add is None:
        cells = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
        rows = cells.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda c: c["x"]).alias("row"))
    else:
        rows = parts.groupBy("i").agg(add.alias("row"))
    out = np.array([r.row for r in sorted(rows.collect())]).reshape(size, size) / n
    return (out + out.T) / 2


def fit(vectors: DataFrame, column: str = "embedding", most: int = 32) -> Whitening | None:
    """The whitening of a table of vectors, with up to `most` components; None if no row has a usable vector.

    A usable vector has entries, all finite and below 2^56 in size. If lengths differ, the length that most vectors have counts (the longer
    of two as frequent) and the others are left out. Components whose eigenvalue is zero but for rounding do not exist.
    """
    usable = _usable(vectors, column)
    sizes = usable.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    if sizes is None:
        return None
    dim = sizes["dim"]
    same = usable.where(F.col("dim") == dim)
    n, sums = _sums(same, dim)
    empty = Whitening(n, tuple(sums), 0.0, np.zeros(0), np.zeros((dim, 0)))
    whole, rest = empty.centre()
    covariance = _covariance(same, dim, dim, n, lambda x: (x - whole) - rest)
    values, components = leading(covariance, most)
    real = values > _FLAT * dim * max(float(values.max(initial=0)), 0.0)
    return Whitening(n, tuple(sums), float(np.trace(covariance)), values[real], components[:, real])


def identity_error(vectors: DataFrame, model: Whitening, column: str = "embedding") -> float:
    """Largest absolute entry of (covariance of the whitened vectors - identity), from a pass over all of them. Their mean is that of the
    centred vectors, which is zero by construction of the centre."""
    same = _usable(vectors, column).where(F.col("dim") == model.dim)
    size = len(model.values)
    if size == 0:
        return 0.0
    return float(np.abs(_covariance(same, model.dim, size, model.n, model.whiten()) - np.eye(size)).max())


def whitened(vectors: DataFrame, model: Whitening, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, deviation, whitened) of every usable row: whitened is an array with an entry per component. Repeated and null keys keep their
    rows; other columns are not read."""
    same = _usable(vectors, column).where(F.col("dim") == model.dim).select(F.col(f"`{key}`").alias("k"), "v")
    dim, whiten, deviations = model.dim, model.whiten(), model.deviations()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v"), dim)
                w = whiten(x)
                bounds = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1], pa.int32())
                yield pa.RecordBatch.from_pydict({"k": batch.column("k"), "deviation": pa.array(deviations(x), pa.int64()),
                                                  "whitened": pa.ListArray.from_arrays(bounds, pa.array(w.ravel()))})

    kind = same.schema["k"].dataType.simpleString()
    return same.mapInArrow(scan, f"k {kind}, deviation long, whitened array<double>").withColumnRenamed("k", key)


def whitened_components(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", most: int = 32) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row per usable vector and component, components from 1 by falling
    eigenvalue. Rows with a null vector, or a null, NaN or infinite entry, have none; nor has any row where all vectors are equal, as no
    component exists then. An empty table gives no rows. `deviation` is null where the exact sum passes a long.
    """
    model = fit(vectors, column, most)
    kind = vectors.select(F.col(f"`{key}`")).schema[0].dataType.simpleString()
    if model is None or len(model.values) == 0:
        return vectors.sparkSession.createDataFrame([], f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(vectors, model, column)
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    rows = whitened(vectors, model, column, key).select(key, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(key, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))
