"""Exact nearest neighbours.

One query is an ordering by a distance column and a limit, which Spark runs as a
bounded heap a task.  Many queries meet all rows in blocks of bounded size: each
task multiplies its vectors with a block's and keeps k a query.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors


def knn(df: DataFrame, query: Sequence[float], k: int = 20, distance: str = "euclidean", id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows nearest to the query, ties by id, with their distance and rank (from 1)."""
    near = df.withColumn("distance", vectors.distance(distance, F.col(vector), vectors.literal(query))).select(id_column, "distance").orderBy("distance", id_column).limit(k)
    # k rows, so one task is enough for their ranks
    return near.withColumn("rank", F.row_number().over(Window.orderBy("distance", id_column)))


def _blocks(queries: DataFrame, id_column: str, vector: str, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The queries, ``rows`` at a time: the driver holds one block."""
    ids, held = [], []
    for r in queries.select(id_column, vector).toLocalIterator():
        ids.append(r[0])
        held.append(r[1])
        if len(ids) == rows:
            yield np.array(ids), np.array(held, float)
            ids, held = [], []
    if ids:
        yield np.array(ids), np.array(held, float)


def pair_distances(base: np.ndarray, queries: np.ndarray, distance: str) -> np.ndarray:
    """rows x queries distances in double precision, a query at a time: exact, unlike the expanded square."""
    out = np.empty((len(base), len(queries)))
    if distance == "euclidean":
        for j, q in enumerate(queries):
            d = base - q
            out[:, j] = np.sqrt(np.einsum("ij,ij->i", d, d))
        return out
    lengths = np.linalg.norm(base, axis=1)[:, None] * np.linalg.norm(queries, axis=1)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        similarity = np.where(lengths == 0, np.nan, base @ queries.T / lengths)
    return similarity if distance == "cosine_similarity" else 1 - similarity


def smallest(distances: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k least (distance, id), NaN last."""
    d = np.where(np.isnan(distances), np.inf, distances)
    if len(d) > k:
        bound = np.partition(d, k - 1)[k - 1]
        near = np.flatnonzero(d <= bound)
    else:
        near = np.arange(len(d))
    return near[np.lexsort((ids[near], d[near]))[:k]]


#: Rows that meet all queries of a block at once, which bounds a task's matrices.
ROWS = 1024


def squares(base: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """rows x queries squared distances by the expanded square, and for each query how far they can be off; not finite where it overflows."""
    with np.errstate(over="ignore", invalid="ignore"):
        b, q = np.einsum("ij,ij->i", base, base), np.einsum("ij,ij->i", queries, queries)
        return b[:, None] + q - 2 * (base @ queries.T), 4 * (base.shape[1] + 8) * np.finfo(float).eps * (b.max(initial=0) + q)


class Nearest:
    """The k nearest rows of each query by Euclidean distance, ties by id, from rows that come in any portions.

    Expanded squares, one matrix product, say which rows can be among them; of those
    alone distances are taken as ``pair_distances`` does, so the result is the same.
    """

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.queries, self.k = queries, k
        self.query, self.ids, self.distances = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.worst = np.full(len(queries), np.inf)  # a query's k-th distance so far

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        for at in range(0, len(rows), ROWS):
            self._add(ids[at : at + ROWS], rows[at : at + ROWS])

    def _add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        a, off = squares(rows, self.queries)
        if np.isfinite(a).all():
            bound = self.worst**2 * (1 + 1e-12) + off
            new = np.isinf(bound)
            if new.any() and len(rows) > self.k:
                bound[new] = np.partition(a[:, new], self.k - 1, axis=0)[self.k - 1] + 2 * off[new]
            row, query = np.nonzero(a <= bound)
            d = rows[row] - self.queries[query]
            d = np.sqrt(np.einsum("ij,ij->i", d, d))
        else:
            every = pair_distances(rows, self.queries, "euclidean")
            keep = [smallest(every[:, j], ids, self.k) for j in range(len(self.queries))]
            row, query = np.concatenate(keep), np.repeat(np.arange(len(keep)), [len(x) for x in keep])
            d = every[row, query]
        query, ids, d = np.concatenate([self.query, query]), np.concatenate([self.ids, ids[row]]), np.concatenate([self.distances, d])
        order = np.lexsort((ids, np.where(np.isnan(d), np.inf, d), query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        order, query, place = order[place < self.k], query[place < self.k], place[place < self.k]
        self.query, self.ids, self.distances = query, ids[order], d[order]
        last = place == self.k - 1
        self.worst[query[last]] = np.where(np.isnan(self.distances[last]), np.inf, self.distances[last])


def knn_batch(df: DataFrame, queries: DataFrame, k: int = 20, distance: str = "euclidean", id_column: str = "vec_id", vector: str = "embedding", query_id: str = "vec_id", block: int = 2048) -> DataFrame:
    """query_id, id, distance and rank of the k nearest rows of each query, ties by id."""
    sc = df.sparkSession.sparkContext
    rows = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    found = None
    for ids, matrix in _blocks(queries, query_id, vector, block):
        sent = sc.broadcast((ids, matrix))  # block rows at most

        def run(source: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, matrix = sent.value
            if distance == "euclidean":
                near = Nearest(matrix, k)
                for batch in source:
                    if batch.num_rows:
                        near.add(batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                if len(near.ids):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[near.query], pa.int64()), pa.array(near.ids, pa.int64()), pa.array(near.distances, pa.float64())], names=["query_id", "id", "distance"])
                return
            best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
            for batch in source:
                if not batch.num_rows:
                    continue
                own = batch.column(0).to_numpy()
                values = batch.column(1)
                base = values.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                for at in range(0, len(ids), 64):
                    d = pair_distances(base, matrix[at : at + 64], distance)
                    for j in range(d.shape[1]):
                        keep = smallest(d[:, j], own, k)
                        dd, ii = np.concatenate([best[at + j][0], d[keep, j]]), np.concatenate([best[at + j][1], own[keep]])
                        keep = smallest(dd, ii, k)
                        best[at + j] = dd[keep], ii[keep]
            n = [len(b[1]) for b in best]
            if sum(n):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n), pa.int64()), pa.array(np.concatenate([b[1] for b in best]), pa.int64()), pa.array(np.concatenate([b[0] for b in best]), pa.float64())], names=["query_id", "id", "distance"])

        part = rows.mapInArrow(run, "query_id bigint, id bigint, distance double")
        found = part if found is None else found.union(part)
    if found is None:
        return df.sparkSession.createDataFrame([], "query_id bigint, id bigint, distance double, rank int")
    w = Window.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_heap(df: DataFrame, query: Sequence[float], k: int = 20, distance: str = "euclidean", id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """As knn, by a bounded selection in each task and a merge of those."""
    one = df.sparkSession.createDataFrame([(0, [float(v) for v in query])], "q bigint, v array<double>")
    return knn_batch(df, one.withColumnRenamed("v", vector), k, distance, id_column, vector, "q").select(F.col("id").alias(id_column), "distance", "rank")


def recall(approximate: DataFrame, exact: DataFrame, query_id: str = "query_id", id_column: str = "id") -> DataFrame:
    """One row, recall: the mean over queries of the share of the exact neighbours found."""
    truth = exact.select(query_id, id_column).distinct()
    hits = truth.join(approximate.select(query_id, id_column).distinct().withColumn("hit", F.lit(1)), [query_id, id_column], "left")
    each = hits.groupBy(query_id).agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("r"))
    return each.agg(F.avg("r").alias("recall"))


def visible(base: DataFrame, inserts: DataFrame, query_seq: int, seq: str = "seq") -> DataFrame:
    """The base rows and those inserted up to a query's place in the history."""
    return base.unionByName(inserts.where(F.col(seq) <= query_seq).drop(seq))
