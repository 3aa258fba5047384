"""Tables from files, folders for our own, and result and report sinks."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import vectors


def scratch(spark: SparkSession) -> str:
    """A folder all executors see: spark.checkpoint.dir, or, in one process only, a temporary one where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("a cluster needs a folder that all executors share in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_vectors(spark: SparkSession, path: str, first_id: int = 0) -> DataFrame:
    """vec_id and embedding from one vector a line, numbered in file order: files by name, lines within them.

    Line numbers come from counts of the pieces that files are read in, so no task sees all
    lines.  Spark deals pieces to tasks by size, so a task's number says nothing of their order.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    pieces = lines.groupBy("_file", "_start").agg(F.min("_at").alias("least"), F.count(F.lit(1)).alias("n")).collect()  # a row a piece
    base, before = [], first_id
    for p in sorted(pieces):
        base.append((p._file, p._start, before - p.least))
        before += p.n
    offsets = spark.createDataFrame(base, "_file string, _start bigint, base bigint")
    numbered = lines.join(F.broadcast(offsets), ["_file", "_start"])  # a row a piece
    return numbered.select((F.col("base") + F.col("_at")).alias("vec_id"), vectors.from_text(F.col("value")).alias("embedding"))


def piped(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Flat files with fields between vertical bars."""
    return spark.read.schema(schema).csv(path, sep="|")


def random_vectors(spark: SparkSession, rows: int, dimension: int, seed: int = 1, first_id: int = 1) -> DataFrame:
    """vec_id, embedding of whole numbers 0..9998, name."""
    return spark.range(first_id, first_id + rows).select(F.col("id").alias("vec_id"), vectors.uniform(dimension, seed).alias("embedding"), F.concat(F.lit("item"), F.col("id").cast("string")).alias("name"))


def results(df: DataFrame) -> Iterator[Row]:
    """Rows one after another, a partition at a time on the driver."""
    return df.toLocalIterator()


def timeline(calls: DataFrame, slot_ms: int = 1000, at: str = "ended_ms", latency: str = "latency_ms", committed: str = "committed") -> DataFrame:
    """Calls by time slot: count, mean, least, greatest and quartiles of the latency of committed ones."""
    slot = F.floor(F.col(at) / slot_ms).alias("slot")
    q = lambda p: F.percentile(latency, p)
    return calls.where(committed).groupBy(slot).agg(F.count(F.lit(1)).alias("n"), F.avg(latency).alias("mean"), F.min(latency).alias("least"), F.max(latency).alias("greatest"), q(0.25).alias("q25"), q(0.5).alias("median"), q(0.75).alias("q75"))


def report(calls: DataFrame, path: str, **columns: str) -> None:
    """The timeline as CSV files with a header."""
    timeline(calls, **columns).orderBy("slot").write.mode("overwrite").csv(path, header=True)


def missing_ids(df: DataFrame, column: str, first: int, last: int) -> DataFrame:
    """The ids of a range that no row has."""
    return df.sparkSession.range(first, last + 1).withColumnRenamed("id", column).join(df.select(F.col(column).cast("bigint").alias(column)), column, "left_anti")


def repeated_ids(df: DataFrame, *columns: str) -> DataFrame:
    """Keys that more than one row has, and how many."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def ranked(df: DataFrame, by: list[Column | str], within: list[str]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(*by)))
