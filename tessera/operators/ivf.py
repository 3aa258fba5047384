"""Approximate search over inverted-file cells.

Centroids are trained by k-means on a bounded sample; every row is put in the
cell of its nearest centroid and the cells are written as partitions.  A search
ranks the centroids, a table of fixed size, reads the nearest ``probe`` cells
only (partition pruning) and ranks their rows exactly.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.knn import ROWS, Nearest, knn, knn_batch, pair_distances, squares
from tessera.operators.relational import materialize


@dataclass(frozen=True)
class Ivf:
    path: str
    centroids: np.ndarray
    id_column: str
    vector: str
    keep: Callable[[DataFrame], DataFrame] | None = None  # of the rows in the cells, those that count

    @property
    def batches(self) -> str:
        """Where numbered batches of a stream are."""
        return f"{self.path.rstrip('/')}-batches"

    def rows(self, spark) -> DataFrame:
        base, path = spark.read.parquet(self.path), spark._jvm.org.apache.hadoop.fs.Path(self.batches)
        if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            return self.keep(base) if self.keep else base
        both = base.unionByName(spark.read.parquet(self.batches).drop("batch"))
        return self.keep(both) if self.keep else both

    def cells_near(self, queries: np.ndarray, probe: int) -> np.ndarray:
        """For each query its ``probe`` nearest cells."""
        return np.argsort(pair_distances(self.centroids, np.asarray(queries, float), "euclidean"), axis=0, kind="stable")[:probe].T


#: Tasks that train on the sample, each with one sum a cell, and the most passes over it.
TASKS, PASSES = 16, 20


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


def _nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each of some rows, in portions of bounded size."""
    out = np.zeros(len(rows), np.int64)
    for at in range(0, len(rows), ROWS):
        out[at : at + ROWS] = squares(rows[at : at + ROWS], centroids)[0].argmin(1)
    return out


def train(df: DataFrame, cells: int = 16, sample: int = 100_000, seed: int = 7, id_column: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """Centroids from ``sample`` rows at most, those of the least hashed ids.

    Lloyd's passes from distinct rows of the sample, drawn by ``seed``: tasks sum their rows by nearest
    centroid in matrix products, the driver adds a sum a cell of each of TASKS tasks.
    """
    # about twice the wanted rows are drawn by hash, so that no more are sorted in one place
    drawn = F.pmod(F.xxhash64(id_column), F.lit(1 << 30))
    some = df.where(drawn <= min(1.0, 2 * sample / max(df.count(), 1)) * (1 << 30)).orderBy(drawn, id_column).limit(sample).select(F.col(vector).cast("array<double>").alias("v"))
    some = materialize(some.repartition(TASKS, "v"))
    few = some.distinct().orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(cells + 1).collect()
    centroids = np.array([r.v for r in few[:cells]])
    if len(few) <= cells:  # each its own centroid
        return centroids
    for _ in range(PASSES):

        def sums(source: Iterator[pa.RecordBatch], centroids=centroids) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(len(centroids)), np.zeros(centroids.shape)
            for batch in source:
                if batch.num_rows:
                    x = _matrix(batch.column(0), batch.num_rows)
                    cell = _nearest(x, centroids)
                    n += np.bincount(cell, minlength=len(n))
                    order = np.argsort(cell, kind="stable")
                    own, first = np.unique(cell[order], return_index=True)
                    total[own] += np.add.reduceat(x[order], first, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()]), pa.array([total.tobytes()])], names=["n", "total"])

        found = some.mapInArrow(sums, "n binary, total binary").collect()  # TASKS rows
        n, total = sum(np.frombuffer(r.n) for r in found), sum(np.frombuffer(r.total) for r in found).reshape(centroids.shape)
        moved = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centroids)
        still = np.square(moved - centroids).sum(1).max() <= 1e-8
        centroids = moved
        if still:
            break
    return centroids


def assigned(df: DataFrame, centroids: np.ndarray, vector: str = "embedding") -> DataFrame:
    """The rows with the cell of each and how far they are from its centroid; a zero-size batch of any partition is fine."""
    schema = T.StructType([*df.schema.fields, T.StructField("far", T.DoubleType()), T.StructField("cell", T.IntegerType())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            base = batch.column(batch.schema.get_field_index(vector)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, centroids.shape[1])
            cell = _nearest(base, centroids)
            off = base - centroids[cell]
            far = np.sqrt(np.einsum("ij,ij->i", off, off))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far), pa.array(cell.astype(np.int32))], names=[*batch.schema.names, "far", "cell"])

    return df.mapInArrow(run, schema)


def build(df: DataFrame, path: str | None = None, cells: int = 16, id_column: str = "vec_id", vector: str = "embedding", **training: int) -> Ivf:
    """Trains, and writes every row to its cell; rows of a cell may be split over files, as large cells must be."""
    from tessera.sources.files import scratch

    path = path or f"{scratch(df.sparkSession)}/ivf-{uuid.uuid4().hex}"
    index = Ivf(path, train(df, cells, id_column=id_column, vector=vector, **training), id_column, vector)
    append(df, index)
    return index


#: Rows of a cell in a file.
FILE_ROWS = 100_000


def _files(df: DataFrame, index: Ivf) -> DataFrame:
    """The rows with their cells, dealt so that a cell has a file, or one for each FILE_ROWS of an average cell's rows."""
    pieces = max(1, df.count() // len(index.centroids) // FILE_ROWS)
    return assigned(df, index.centroids, index.vector).repartition("cell", F.pmod(F.xxhash64(index.id_column), F.lit(pieces)))


def append(df: DataFrame, index: Ivf) -> None:
    """New rows go to the cells of the centroids there are."""
    _files(df, index).write.mode("append").partitionBy("cell").parquet(index.path)


def append_batch(df: DataFrame, index: Ivf, number: int) -> None:
    """As append, of a numbered batch: done again it replaces what it wrote before."""
    path = f"{index.batches}/batch={number}"
    _files(df, index).write.mode("overwrite").partitionBy("cell").parquet(path)


def search(spark, index: Ivf, query: Sequence[float], k: int = 20, probe: int = 8, distance: str = "euclidean") -> DataFrame:
    cells = index.cells_near(np.array([query], float), probe)[0]
    return knn(index.rows(spark).where(F.col("cell").isin([int(c) for c in cells])), query, k, distance, index.id_column, index.vector)


#: Queries of a list that meets a piece of a cell, on average, and queries that are ranked against all centroids at once.
LIST, ASKED = 512, 256


def search_batch(spark, index: Ivf, queries: DataFrame, k: int = 20, probe: int = 8, query_id: str = "vec_id", sizes: dict[int, int] | None = None) -> DataFrame:
    """As knn_batch, each query against its own nearest cells; one join on the cell.

    With ``sizes``, the rows of each cell, a query reads more than ``probe`` cells where those have fewer than k rows.
    """
    centroids = index.centroids
    held = None if sizes is None else np.array([sizes.get(c, 0) for c in range(len(centroids))])

    def probes(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in source:
            for at in range(0, whole.num_rows, ASKED):
                batch = whole.slice(at, ASKED)
                order = np.argsort(pair_distances(centroids, _matrix(batch.column(1), batch.num_rows), "euclidean"), axis=0, kind="stable").T
                n = np.full(len(order), min(probe, len(centroids)))
                if held is not None:
                    n = np.minimum(np.maximum(n, (np.cumsum(held[order], axis=1) < k).sum(1) + 1), len(centroids))
                owner = pa.array(np.repeat(np.arange(len(order)), n))
                near = np.concatenate([o[:m] for o, m in zip(order, n)])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), pa.array(near.astype(np.int32))], names=["query_id", "q", "cell"])

    asked = queries.select(F.col(query_id).cast("bigint").alias("query_id"), F.col(index.vector).cast("array<double>").alias("q")).mapInArrow(probes, "query_id bigint, q array<double>, cell int")
    # a cell's queries in bounded lists meet pieces of the cell's rows: whole matrices, and no key has all of a large cell
    parts = max(1, queries.count() * min(probe, len(centroids)) // len(centroids) // LIST)
    lists = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts))).groupBy("cell", "part").agg(F.collect_list(F.struct("query_id", "q")).alias("qs"))
    rows = index.rows(spark).select(F.col(index.id_column).cast("bigint").alias("id"), F.col(index.vector).cast("array<double>").alias("v"), "cell", F.pmod(F.xxhash64(index.id_column), F.lit(max(1, index.rows(spark).count() // len(centroids) // 1024))).alias("piece"))  # some 1,000 rows a piece
    pieces = rows.groupBy("cell", "piece").agg(F.collect_list(F.struct("id", "v")).alias("vs"))

    def meet(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for r in range(batch.num_rows):
                vs, qs = (batch.column(c).slice(r, 1).flatten() for c in (0, 1))
                near = Nearest(_matrix(qs.field(1), len(qs)), k)
                near.add(vs.field(0).to_numpy(), _matrix(vs.field(1), len(vs)))
                yield pa.RecordBatch.from_arrays([pa.array(qs.field(0).to_numpy()[near.query], pa.int64()), pa.array(near.ids, pa.int64()), pa.array(near.distances)], names=["query_id", "id", "distance"])

    met = pieces.join(lists, "cell").select("vs", "qs").mapInArrow(meet, "query_id bigint, id bigint, distance double")
    w = Window.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), "id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def probe_for(spark, index: Ivf, df: DataFrame, queries: DataFrame, k: int = 20, least: float = 0.9, query_id: str = "vec_id") -> tuple[int, float]:
    """The fewest cells to probe for a recall of ``least`` against brute force, and that recall.

    A true neighbour is found with as many cells as are nearer to the query than
    its own, and that: one pass says the recall of every number of cells.
    """
    exact = knn_batch(df, queries, k, "euclidean", index.id_column, index.vector, query_id).select("query_id", "id")
    where = exact.join(index.rows(spark).select(F.col(index.id_column).cast("bigint").alias("id"), "cell"), "id")
    own = where.groupBy("query_id").agg(F.collect_list("cell").alias("cells"))  # k at most
    asked = own.join(queries.select(F.col(query_id).cast("bigint").alias("query_id"), F.col(index.vector).cast("array<double>").alias("q")), "query_id").select("query_id", "cells", "q")
    centroids = index.centroids

    def needed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in source:
            for at in range(0, whole.num_rows, ASKED):
                batch = whole.slice(at, ASKED)
                order = pair_distances(centroids, _matrix(batch.column(2), batch.num_rows), "euclidean").argsort(0, kind="stable")
                rank = np.empty_like(order)
                np.put_along_axis(rank, order, np.arange(len(order))[:, None], 0)
                of = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(1)).to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array((rank[batch.column(1).flatten().to_numpy(), of] + 1).astype(np.int32))], names=["query_id", "probes"])

    counts = {r.probes: r.n for r in asked.mapInArrow(needed, "query_id bigint, probes int").groupBy("probes").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a cell at most
    total, held = sum(counts.values()), 0
    for probe in range(1, len(centroids) + 1):
        held += counts.get(probe, 0)
        if total and held >= least * total:
            return probe, held / total
    return len(centroids), 1.0 if total else 0.0
