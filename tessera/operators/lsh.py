"""Candidates of one query by locality-sensitive hashes, as filters on a scan; ``buckets`` joins many queries with many rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors
from tessera.operators.knn import knn


def _planes(dimension: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables, bits, dimension)).astype("float32")


def signs(vector: Column, dimension: int, bits: int, tables: int, seed: int = 11) -> Column:
    """For each table a number whose bits are the sides of random hyperplanes the vector is on."""
    planes = _planes(dimension, bits, tables, seed).tolist()
    known = F.from_json(F.lit(str(planes)), "array<array<array<double>>>")  # folded into a literal

    def side(plane: Column) -> Column:
        return F.when(F.aggregate(F.zip_with(vector, plane, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x) >= 0, 1).otherwise(0)

    return F.transform(known, lambda table: F.aggregate(table, F.lit(0), lambda n, plane: n * 2 + side(plane)))


def candidates(df: DataFrame, query: Sequence[float], bits: int = 4, tables: int = 12, vector: str = "embedding") -> DataFrame:
    """The rows that share a bucket with the query in one table at least."""
    own = signs(F.col(vector).cast("array<double>"), len(query), bits, tables)
    asked = signs(vectors.literal(query), len(query), bits, tables)
    return df.where(F.exists(F.zip_with(own, asked, lambda a, b: a == b), lambda same: same))


def search(df: DataFrame, query: Sequence[float], k: int = 20, bits: int = 4, tables: int = 12, distance: str = "euclidean", id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    return knn(candidates(df, query, bits, tables, vector), query, k, distance, id_column, vector)


def band_candidates(df: DataFrame, query: Sequence[float], bands: int = 8, buckets: int = 97, step: float = 0.25, vector: str = "embedding") -> DataFrame:
    """The rows whose rounded slice equals the query's in one band at least."""
    own = vectors.bands(F.col(vector), bands, buckets, step)
    asked = vectors.bands(vectors.literal(query), bands, buckets, step)
    return df.where(F.exists(F.zip_with(own, asked, lambda a, b: a == b), lambda same: same))
