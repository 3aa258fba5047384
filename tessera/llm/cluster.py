"""What the operators of this subpackage need from a cluster."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, in one process only, one of our own where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("a cluster needs a folder that all executors share in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def table(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder, read again.

    This cuts the lineage: lost executors do not bring back the work before it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes a table made by ``table`` that nothing lazy reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/tessera-" in f}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What a batch of whole texts may hold where a session has Spark's default (10,000 rows, 64 MB); a longer text comes alone.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4194304")}


def whole_texts(df: DataFrame) -> DataFrame:
    """``df``, which is about to send whole texts to Python, in batches bounded by rows and by bytes."""
    conf = df.sparkSession.conf
    for key, (default, ours) in BATCH.items():
        if conf.get(key) == default:
            conf.set(key, ours)
    return df


#: Bits of a block of a sieve, and the most blocks: 64 MB in all.
SIEVE_BITS, SIEVE_BLOCKS = 1 << 20, 512


class Sieve:
    """A blocked Bloom filter of a table's keys (a bigint column), tested in the JVM.

    It says which rows can have a partner before they, with their texts, are
    shuffled to a join: about 1.4 % of the others pass too, none that has one
    is lost.  It is sized by the number of keys, 16 bits each, and broadcast.
    Beyond the keys that SIEVE_BLOCKS hold it lets all rows pass.
    """

    def __init__(self, keys: DataFrame, key: str) -> None:
        n = keys.count()
        self.blocks = -(-16 * max(n, 1) // SIEVE_BITS)
        self.bits = None
        if self.blocks > SIEVE_BLOCKS:
            return

        def build(group: pa.Table) -> pa.Table:
            flags = np.zeros(SIEVE_BITS, np.uint8)
            for c in ("one", "two"):
                flags[group.column(c).to_numpy()] = 1
            words = np.packbits(flags, bitorder="little").view("<i8")
            return pa.table({"_block": group.column("_block")[:1], "_bits": pa.array([words.tolist()], pa.list_(pa.int64()))})

        placed = keys.select(*(c.alias(n) for c, n in zip(self._places(F.col(key)), ("_block", "one", "two"))))
        self.bits = table(placed.groupBy("_block").applyInArrow(build, "_block int, _bits array<bigint>"))

    def _places(self, key: Column) -> tuple[Column, Column, Column]:
        h = F.xxhash64(F.lit(17), key)
        block = F.pmod(F.xxhash64(F.lit(29), key), F.lit(self.blocks)).cast("int")
        return block, h.bitwiseAND(F.lit(SIEVE_BITS - 1)).cast("int"), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(SIEVE_BITS - 1)).cast("int")

    def _join(self, df: DataFrame, key: Column, how: str) -> DataFrame:
        block, one, two = self._places(key)
        bits = F.broadcast(self.bits)  # at most SIEVE_BLOCKS rows
        at = lambda place: F.call_function("getbit", F.get(bits["_bits"], F.shiftright(place, 6)), place.bitwiseAND(F.lit(63))) == 1
        return df.join(bits, (block == bits["_block"]) & at(one) & at(two), how)

    def passed(self, df: DataFrame, key: Column) -> DataFrame:
        """The rows whose key may be one of the table's."""
        return df if self.bits is None else self._join(df, key, "left_semi")

    def left(self, df: DataFrame, key: Column) -> DataFrame | None:
        """The other rows; None where all pass."""
        return None if self.bits is None else self._join(df, key, "left_anti")


def with_found(rows: DataFrame, found: DataFrame, key: str, on: list[str]) -> DataFrame:
    """``rows`` with the last column of ``found``, null for none; rows that have none are sieved out before texts are shuffled.

    ``found`` is a written table with a row for each value of ``on``, of which ``key``, a bigint, is the last.
    """
    name, sieve = found.columns[-1], Sieve(found, key)
    met = sieve.passed(rows, F.col(key)).join(found, on, "left")
    rest = sieve.left(rows, F.col(key))
    return met if rest is None else met.unionByName(rest.withColumn(name, F.lit(None).cast(found.schema[name].dataType)))


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``rows``, columns as they are, without those whose ``key``, a bigint, is in the written table ``gone``; most rows are not shuffled."""
    sieve = Sieve(gone, key)
    columns = [F.col(f"`{c}`") for c in rows.columns]
    kept = sieve.passed(rows, F.col(key)).join(gone, key, "left_anti").select(*columns)
    rest = sieve.left(rows, F.col(key))
    return kept if rest is None else kept.union(rest.select(*columns))
