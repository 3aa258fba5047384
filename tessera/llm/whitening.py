"""Whitening of embeddings: an exact mean, a centred covariance, its eigenvectors, one projection.

Entries become whole numbers, x = floor(scale * entry) + offset.  The first pass
sums them exactly, as high and low halves.  The second centres every vector at the
whole number nearest the mean and sums outer products, a GEMM a batch; tasks'
matrices are merged by ``treeAggregate``.  As centred entries are small whole
numbers the sums are exact up to 2**53, hence the same however rows lie in
partitions; what the mean is away from that whole number, a half at most, is
taken out of the sum as one outer product.  LAPACK's symmetric solver gives the
components on the driver, which sees numbers by dimension and never rows.  A third
pass measures the covariance of the whitened vectors, each batch centred at its own
mean and merged with the others' means, and the last writes the vectors with the
projection broadcast: dimensions times components.  Nothing is shuffled.

Defined cases: a vector that is null, empty, or holds a null, a NaN, an infinity
or an entry whose x does not fit in a long is left out; so is one whose length is
not the commonest (of equally common lengths the greatest counts).  Repeated rows
are rows each, a null id is kept, other columns are ignored whatever their names.
A component without variance (up to rounding) can't be whitened and is not there,
so one vector alone, or equal ones, give no rows; an empty table gives none.
A deviation beyond the range of long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.cluster import table, whole_texts

#: Beyond this a scaled entry's whole number does not count.
LARGEST = float(1 << 62)


@dataclass(frozen=True)
class Scale:
    """How an entry becomes a whole number."""

    factor: float = 64.0
    offset: int = 1_000_000

    def numbers(self, column: pa.Array) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
        """Lengths of the usable vectors (0 for the others); by length the rows' places and their whole numbers."""
        length = np.asarray(column.value_lengths().fill_null(0), np.int64)
        owner = np.repeat(np.arange(len(length)), length)
        entries = column.flatten()
        value = np.asarray(entries.cast(pa.float64()).fill_null(np.nan), np.float64) * self.factor
        good = np.isfinite(value) & (np.abs(value) < LARGEST)
        usable = np.bincount(owner[~good], minlength=len(length)) == 0
        length = np.where(usable, length, 0)
        x = np.floor(np.where(good, value, 0)).astype(np.int64) + self.offset
        own = length[owner] > 0
        x, owner = x[own], owner[own]
        return length, {int(n): (np.flatnonzero(length == n), x[length[owner] == n].reshape(-1, n)) for n in np.unique(length[length > 0])}


@dataclass(frozen=True)
class Whitener:
    """Exact sums of the fit list, and its components by falling variance."""

    scale: Scale
    n: int
    sums: list[int]
    values: np.ndarray  # variances of the components
    explained: np.ndarray  # their shares of the whole variance
    weights: np.ndarray  # dimensions x components: eigenvectors over the root of their variance

    @property
    def dimensions(self) -> int:
        return len(self.sums)

    def centre(self) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """The whole numbers nearest the mean, how far the mean is from them, and that times n, exactly."""
        near = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        rest = [s - self.n * m for s, m in zip(self.sums, near)]
        return np.array(near, np.int64), np.array([r / self.n for r in rest]), rest

    def whiten(self, x: np.ndarray) -> np.ndarray:
        near, off, _ = self.centre()
        return ((x - near).astype(float) - off) @ self.weights

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n x - sum)**2, exactly."""
        near, _, rest = self.centre()
        y = x - near
        largest = int(max(y.max(initial=0), -y.min(initial=0)))
        if (self.n * (largest + 1)) ** 2 * self.dimensions < 1 << 63:
            d = self.n * y - np.array(rest, np.int64)
            return (d * d).sum(1).tolist()
        exact = [sum((self.n * v - r) ** 2 for v, r in zip(row, rest)) for row in y.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def _sums(df: DataFrame, scale: Scale) -> tuple[int, list[int]]:
    """Rows of the commonest length, and the exact sum of each dimension."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for size, (rows, x) in scale.numbers(batch.column(0))[1].items():
                parts = [np.full(size, size), np.arange(size), np.full(size, len(rows)), (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)]
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()) for p in parts], names=["size", "i", "n", "high", "low"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    parts = whole_texts(df).mapInArrow(run, "size bigint, i bigint, n bigint, high bigint, low bigint")
    summed = table(parts.groupBy("size", "i").agg(F.sum("n").alias("n"), wide("high"), wide("low")))  # one scan of the vectors
    counted = summed.where("i = 0").orderBy(F.desc("n"), F.desc("size")).first()
    if counted is None:
        return 0, []
    rows = summed.where(F.col("size") == counted["size"]).collect()  # a row a dimension
    sums = [0] * counted["size"]
    for r in rows:
        sums[r["i"]] = (int(r["high"]) << 32) + int(r["low"])
    return counted["n"], sums


def _moments(df: DataFrame, model: Whitener, of) -> tuple[int, np.ndarray, np.ndarray] | None:
    """Merged (rows, mean, sum of centred outer products) of ``of`` over the batches' whole numbers."""
    size = model.dimensions

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in source:
            found = model.scale.numbers(batch.column(0))[1].get(size)
            if found is not None:
                state = _merged(state, of(found[1]))
        if state is not None:
            n, mean, products = state
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([mean.tobytes()], pa.binary()), pa.array([products.tobytes()], pa.binary())], names=["n", "mean", "products"])

    def add(state, row):
        mean = np.frombuffer(row["mean"])
        return _merged(state, (row["n"], mean, np.frombuffer(row["products"]).reshape(len(mean), -1)))

    parts = whole_texts(df).mapInArrow(run, "n bigint, mean binary, products binary")
    return parts.rdd.treeAggregate(None, add, _merged, 2)


def _merged(a, b):
    """Of two parts' (rows, mean, centred products) the whole's."""
    if a is None or b is None:
        return a if b is None else b
    n, off = a[0] + b[0], b[1] - a[1]
    return n, a[1] + off * (b[0] / n), a[2] + b[2] + np.outer(off, off) * (a[0] * b[0] / n)


def fit(df: DataFrame, vector: str = "embedding", components: int = 32, scale: Scale = Scale()) -> Whitener | None:
    """Learns from all usable vectors of ``df``; None where there is none."""
    vectors = df.select(df[vector].alias("v"))
    n, sums = _sums(vectors, scale)
    if not n:
        return None
    empty = np.zeros(0)
    start = Whitener(scale, n, sums, empty, empty, np.zeros((len(sums), 0)))
    near, off, _ = start.centre()

    def products(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        y = (x - near).astype(float)  # small whole numbers: exact, also as sums; all parts have the same centre
        return len(y), np.zeros(len(near)), y.T @ y

    _, _, total = _moments(vectors, start, products)
    covariance = total / n - np.outer(off, off)
    values, vectors_ = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    trace = float(np.trace(covariance))
    kept = int((values > max(len(sums) * np.finfo(float).eps * max(values[0], 0), 0)).sum()) if trace > 0 else 0
    kept = min(kept, components)
    values, vectors_ = values[:kept], vectors_[:, :kept]
    vectors_ = vectors_ * np.where(vectors_[np.abs(vectors_).argmax(0), np.arange(kept)] < 0, -1.0, 1.0)  # the largest entry is positive
    return Whitener(scale, n, sums, values, values / trace if kept else empty, vectors_ / np.sqrt(values))


def identity_error(df: DataFrame, model: Whitener, vector: str = "embedding") -> float:
    """The largest absolute entry of the whitened vectors' covariance, measured over all of them, minus the identity."""

    def centred(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        w = model.whiten(x)
        mean = w.mean(0)
        return len(w), mean, (w - mean).T @ (w - mean)

    if not len(model.values):
        return 0.0
    n, _, total = _moments(df.select(df[vector].alias("v")), model, centred)
    return float(np.abs(total / n - np.eye(len(model.values))).max())


def transform(df: DataFrame, model: Whitener | None, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, deviation and whitened (an entry a component) of each usable vector."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in source:
            found = model and model.scale.numbers(batch.column(1))[1].get(model.dimensions)
            if found:
                rows, x = found
                whitened = pa.FixedSizeListArray.from_arrays(pa.array(model.whiten(x).ravel()), len(model.values)) if len(model.values) else pa.array([[]] * len(rows), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(model.deviations(x), pa.int64()), whitened.cast(pa.list_(pa.float64()))], names=["vec_id", "deviation", "whitened"])

    return whole_texts(df).select(df[vec_id].cast("bigint").alias("vec_id"), df[vector].alias("v")).mapInArrow(run, "vec_id bigint, deviation bigint, whitened array<double>")
