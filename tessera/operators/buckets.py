"""Locality-sensitive buckets that prune: a join on buckets, several probes a table, exact ranking.

A table of a family has ``directions`` pseudo-random directions, in the whole space or in one
of ``bands`` slices of it; a vector's bucket there is the direction it points along
the most.  A query probes the ``probes`` directions it points along the most in
each table, so few tables do where one probe each would need hundreds.

Rows and queries meet by a join on (table, bucket).  Buckets are split into pieces of
some ``PIECE`` rows by hash, so that no task has all of a hot one, and both
sides travel as matrices.  A pair that shares several buckets is compared in the
first table where it meets, which both sides' codes tell, so it is compared once
without a shuffle of pairs.  Each list keeps k a query; those are merged.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.knn import pair_distances, smallest
from tessera.sources.files import scratch

#: Rows, and queries, of a bucket that travel together.
PIECE = 1024
PRIME = 2_147_483_647


def uniform(n: int) -> np.ndarray:
    """n numbers between -1 and 1 by whole-number arithmetic that any engine can repeat."""
    x = (np.arange(n, dtype=np.int64) * 2_654_435_761 + 12_345) % PRIME
    for _ in range(2):
        x = ((x * x % PRIME) * x + 7919) % PRIME
    return x / 1_073_741_823.5 - 1


@dataclass(frozen=True)
class Family:
    dimension: int
    tables: int = 12
    directions: int = 256
    bands: int = 1

    def matrix(self) -> np.ndarray:
        """tables x directions x dimension."""
        out = uniform(self.tables * self.directions * self.dimension).reshape(self.tables, self.directions, self.dimension)
        if self.bands > 1:
            size = -(-self.dimension // self.bands)
            slice_of = np.arange(self.dimension) // size
            out = out * (slice_of[None, :] == (np.arange(self.tables) % self.bands)[:, None])[:, None, :]
        return out

    def along(self, rows: np.ndarray, made: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """How far the rows point along each direction, some hundreds of rows at a time."""
        flat = made.reshape(-1, self.dimension).T
        for at in range(0, len(rows), 256):
            yield at, (rows[at : at + 256] @ flat).reshape(-1, self.tables, self.directions)

    def codes(self, rows: np.ndarray, made: np.ndarray) -> np.ndarray:
        """rows x tables: each row's bucket."""
        out = np.empty((len(rows), self.tables), np.int32)
        for at, score in self.along(rows, made):
            out[at : at + len(score)] = score.argmax(2)
        return out

    def probes(self, rows: np.ndarray, made: np.ndarray, most: int) -> np.ndarray:
        """rows x tables x most: buckets, best first."""
        out = np.empty((len(rows), self.tables, min(most, self.directions)), np.int32)
        for at, score in self.along(rows, made):
            out[at : at + len(score)] = np.argsort(-score, axis=2, kind="stable")[:, :, :most]
        return out


@dataclass(frozen=True)
class Index:
    path: str
    family: Family
    id_column: str
    vector: str

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("id bigint, v array<float>, codes array<int>").parquet(self.path)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _lists(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], pa.array(values.ravel()))


def build(df: DataFrame, family: Family, id_column: str = "vec_id", vector: str = "embedding") -> Index:
    """Writes every row with a vector, and its buckets; one pass, nothing is shuffled."""
    index = Index(f"{scratch(df.sparkSession)}/buckets-{uuid.uuid4().hex}", family, id_column, vector)
    append(df, index)
    return index


def append(df: DataFrame, index: Index) -> None:
    family = index.family

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = family.matrix()
        for batch in source:
            if batch.num_rows:
                codes = family.codes(_matrix(batch.column(1), batch.num_rows).astype(float), made)
                yield pa.RecordBatch.from_arrays([*batch.columns, _lists(codes)], names=["id", "v", "codes"])

    rows = df.select(F.col(index.id_column).cast("bigint").alias("id"), F.col(index.vector).cast("array<float>").alias("v")).where(F.size("v") == family.dimension)
    rows.mapInArrow(run, "id bigint, v array<float>, codes array<int>").write.mode("append").parquet(index.path)


def probes_for(spark: SparkSession, index: Index, queries: DataFrame, exact: DataFrame, least: float = 0.9, query_id: str = "vec_id") -> tuple[int, float]:
    """The fewest probes a table with which ``least`` of the exact neighbours (query_id, id) are met, and their share.

    A neighbour is met from as many probes on as its bucket's place among the
    query's, in the table where that is best: one pass says it for every number.
    """
    family = index.family
    asked = queries.select(F.col(query_id).cast("bigint").alias("query_id"), F.col(index.vector).cast("array<double>").alias("q"))
    pairs = exact.select("query_id", "id").join(index.rows(spark).select("id", "codes"), "id").join(asked, "query_id").select("codes", "q")

    def needed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = family.matrix()
        for batch in source:
            if not batch.num_rows:
                continue
            codes, out = _matrix(batch.column(0), batch.num_rows), []
            for at, score in family.along(_matrix(batch.column(1), batch.num_rows), made):
                own = np.take_along_axis(score, codes[at : at + len(score), :, None], 2)
                out.append((score > own).sum(2).min(1) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).astype(np.int32))], names=["probes"])

    counts = {r.probes: r.n for r in pairs.mapInArrow(needed, "probes int").groupBy("probes").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a direction at most
    total, held = sum(counts.values()), 0
    for probes in range(1, family.directions + 1):
        held += counts.get(probes, 0)
        if total and held >= least * total:
            return probes, held / total
    return family.directions, 1.0 if total else 0.0


def _pieces(copies: DataFrame, sizes: DataFrame, by: str) -> DataFrame:
    """Copies with a piece number within their bucket; ``sizes`` has a row a bucket: tables times directions."""
    pieces = F.greatest(F.lit(1), F.ceil(F.col("n") / PIECE))
    return copies.join(F.broadcast(sizes), ["at", "bucket"]).withColumn("piece", F.pmod(F.xxhash64(by), pieces)).drop("n")


def search_batch(spark: SparkSession, index: Index, queries: DataFrame, k: int = 20, probes: int = 8, distance: str = "euclidean", query_id: str = "vec_id") -> DataFrame:
    """query_id, id, distance, rank of the k nearest rows met by each query, and compared: how many rows were compared with it."""
    family = index.family
    rows = index.rows(spark).select("id", "v", "codes", F.posexplode("codes").alias("at", "bucket"))

    def probed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = family.matrix()
        for batch in source:
            if batch.num_rows:
                found = family.probes(_matrix(batch.column(1), batch.num_rows), made, probes)
                yield pa.RecordBatch.from_arrays([*batch.columns, _lists(found.reshape(batch.num_rows, -1))], names=["query_id", "q", "probed"])

    asked = queries.select(F.col(query_id).cast("bigint").alias("query_id"), F.col(index.vector).cast("array<double>").alias("q")).where(F.size("q") == family.dimension)
    asked = asked.mapInArrow(probed, "query_id bigint, q array<double>, probed array<int>")
    width = min(probes, family.directions)
    asked = asked.select("query_id", "q", "probed", F.posexplode("probed").alias("place", "bucket")).withColumn("at", F.floor(F.col("place") / width).cast("int")).drop("place")
    count = lambda df: df.groupBy("at", "bucket").agg(F.count(F.lit(1)).alias("n"))
    base = _pieces(rows, count(rows), "id").groupBy("at", "bucket", "piece").agg(F.collect_list(F.struct("id", "v", "codes")).alias("b"))
    lists = _pieces(asked, count(asked), "query_id").groupBy("at", "bucket", "piece").agg(F.collect_list(F.struct("query_id", "q", "probed")).alias("l"))
    met = base.drop("piece").join(lists.drop("piece"), ["at", "bucket"])
    met = met.select("at", "b.id", F.flatten("b.v").alias("v"), F.flatten("b.codes").alias("codes"), "l.query_id", F.flatten("l.q").alias("q"), F.flatten("l.probed").alias("probed"))

    def meet(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for r in range(batch.num_rows):
                own = [batch.column(c).slice(r, 1).flatten().to_numpy(zero_copy_only=False) for c in range(1, 7)]
                at, ids, wanted = batch.column(0)[r].as_py(), own[0], own[3]
                base, codes = own[1].reshape(len(ids), -1).astype(float), own[2].reshape(len(ids), -1)
                asked, probed = own[4].reshape(len(wanted), -1), own[5].reshape(len(wanted), family.tables, -1)
                d = pair_distances(base, asked, distance)
                out = []
                for j in range(len(wanted)):
                    earlier = np.zeros((at, family.directions), bool)
                    earlier[np.arange(at)[:, None], probed[j, :at]] = True
                    new = np.flatnonzero(~earlier[np.arange(at)[None, :], codes[:, :at]].any(1)) if at else np.arange(len(ids))
                    if len(new):
                        near = new[smallest(d[new, j], ids[new], k)]
                        out.append((np.full(len(near), wanted[j]), ids[near], d[near, j], np.eye(1, len(near), dtype=np.int64)[0] * len(new)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["query_id", "id", "distance", "compared"])

    found = met.mapInArrow(meet, "query_id bigint, id bigint, distance double, compared bigint")
    each = Window.partitionBy("query_id")
    ranked = found.withColumn("rank", F.row_number().over(each.orderBy(F.col("distance").asc_nulls_last(), "id"))).withColumn("compared", F.sum("compared").over(each))
    return ranked.where(F.col("rank") <= k).select("query_id", "id", "distance", "rank", "compared")
