"""Nearest neighbours as of places in a history, for many queries at once.

Rows have a place, ``seq``, and a query asked at a place sees the rows up to it.  Quantiles
of the places cut the history into slices.  The k nearest rows of a slice are
found once for each query, whatever the places it is asked at, and merge: a question
takes those of all slices before its own, and, of its own slice, compares the rows up
to its place.  Rows and queries of a slice meet as matrices, in lists of bounded
size dealt by hash, so a slice is spread over tasks and no one task has a hot place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.knn import pair_distances, smallest

#: Rows in a list, queries in a list, rows in a slice where there is more than one, and the most slices.
ROWS, QUERIES, SLICE, SLICES = 1024, 256, 50_000, 256


def _lists(df: DataFrame, by: str, size: int, name: str) -> DataFrame:
    """slice and lists of rows of about ``size`` each."""
    counted = F.broadcast(df.groupBy("slice").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size)).alias("_pieces")))  # a row a slice
    dealt = df.join(counted, "slice").withColumn("_piece", F.pmod(F.xxhash64(by), F.col("_pieces"))).drop("_pieces")
    columns = [c for c in df.columns if c != "slice"]
    return dealt.groupBy("slice", "_piece").agg(F.collect_list(F.struct(*columns)).alias(name)).drop("_piece")


def _met(rows: DataFrame, asked: DataFrame, k: int, distance: str) -> DataFrame:
    """query_id, seq, slice, id, distance: the k nearest rows of each list to each question of its slice, of those up to its place."""
    left = _lists(rows, "id", ROWS, "r").select("slice", "r.id", F.flatten("r.v").alias("v"), F.col("r.at").alias("at"))
    right = _lists(asked, "query_id", QUERIES, "a").select("slice", "a.query_id", F.flatten("a.q").alias("q"), F.col("a.seq").alias("seq"))

    def meet(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for r in range(batch.num_rows):
                ids, v, at, wanted, q, seq = (batch.column(c).slice(r, 1).flatten().to_numpy(zero_copy_only=False) for c in range(1, 7))
                d = pair_distances(v.reshape(len(ids), -1), q.reshape(len(wanted), -1), distance)
                out = []
                for j in range(len(wanted)):
                    seen = np.flatnonzero(at <= seq[j])
                    near = seen[smallest(d[seen, j], ids[seen], k)]
                    out.append((np.full(len(near), wanted[j]), np.full(len(near), seq[j]), np.full(len(near), batch.column(0)[r].as_py(), np.int32), ids[near], d[near, j]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["query_id", "seq", "slice", "id", "distance"])

    return left.join(right, "slice").mapInArrow(meet, "query_id bigint, seq bigint, slice int, id bigint, distance double")


def _least(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("distance").asc_nulls_last(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn_as_of(history: DataFrame, asked: DataFrame, k: int = 20, distance: str = "euclidean", id_column: str = "vec_id", vector: str = "embedding", seq: str = "seq", query_id: str = "query_id") -> DataFrame:
    """query_id, seq, id, distance, rank: for each question (query_id, vector, seq) the k nearest rows of ``history`` whose seq is not larger.

    Rows of a null place are not seen, questions at a null place see nothing; the same
    question asked twice is one.  Equal query ids are equal vectors.
    """
    rows = history.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(seq).cast("bigint").alias("at")).where("v is not null and at is not null")
    n = rows.count()
    slices = max(1, min(SLICES, n // SLICE))
    bounds = sorted(set(rows.approxQuantile("at", [i / slices for i in range(1, slices)], 0.1 / slices))) if slices > 1 else []
    number: Column = F.lit(0)
    for b in bounds:
        number = number + F.when(F.col("at") >= b, 1).otherwise(0)
    placed = lambda df, column: df.withColumn("at", F.col(column)).withColumn("slice", number.cast("int"))
    rows = rows.withColumn("slice", number.cast("int"))
    questions = asked.select(F.col(query_id).cast("bigint").alias("query_id"), F.col(vector).cast("array<double>").alias("q"), F.col(seq).cast("bigint").alias("seq")).where("seq is not null and q is not null").dropDuplicates(["query_id", "seq"])
    questions = placed(questions, "seq").drop("at")
    found = _met(rows, questions, k, distance).select("query_id", "seq", "id", "distance")
    if bounds:
        # each query once, against all slices before the last one it is asked in
        once = questions.groupBy("query_id").agg(F.max("slice").alias("last"), F.first("q").alias("q")).where("last > 0")
        whole = once.select("query_id", "q", F.lit((1 << 63) - 1).alias("seq"), F.explode(F.sequence(F.lit(0), F.col("last") - 1)).alias("slice"))
        best = _least(_met(rows, whole, k, distance), k, "query_id", "slice").select("query_id", F.col("slice").alias("of"), "id", "distance")
        before = questions.select("query_id", "seq", "slice").join(best, "query_id").where("of < slice").select("query_id", "seq", "id", "distance")
        found = found.unionByName(before)
    return _least(found, k, "query_id", "seq").select("query_id", "seq", "id", "distance", "rank")


def recall_as_of(found: DataFrame, history: DataFrame, asked: DataFrame, k: int = 20, **columns: str) -> DataFrame:
    """query_id, seq and recall: the share of the true neighbours at its place that each question found (query_id, seq, id)."""
    truth = knn_as_of(history, asked, k, **columns).select("query_id", "seq", "id")
    hits = truth.join(found.select("query_id", "seq", "id").distinct().withColumn("hit", F.lit(1)), ["query_id", "seq", "id"], "left")
    return hits.groupBy("query_id", "seq").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"))
