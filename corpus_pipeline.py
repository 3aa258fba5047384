"""A corpus pipeline of five stages; each takes the documents its predecessor kept.

Every stage is written as Parquet and read again as the next one's documents.
All but the last return the columns of ``documents``.

Defined cases, all stages: an empty table gives no rows; other columns stay as they
are, whatever their names; very long texts are taken whole.  A null or empty text
has a quality score like others, links with nothing, has nothing to cut and is one
token.  Rows that share an id are one document to near_dedup and stay or go
together; repeated rows (id and text) are one document to suffix_dedup as well, so
neither loses its text to the other.  A null id is a document like others.  Of
equal documents the one of the smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, neardup, packing, quality, suffixdup
from tessera.llm.cluster import drop, table, without
from tessera.llm.queries import read, sampled_model


def _counted(before: DataFrame, after: DataFrame) -> DataFrame:
    """Texts have changed, and so has their length where the table has it."""
    return after.withColumn("n_chars", F.char_length("text").cast(before.schema["n_chars"].dataType)) if "n_chars" in before.columns else after


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are likelier of low quality than of high; 20,000 labelled documents at most train."""
    return quality.keep(docs, sampled_model(docs, read(spark, sf_dir, "labels")), 0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of five-word-shingle similarity 0.8 or more."""
    gone = table(neardup.near_duplicates(docs, shingle=5, percent=80).where("not kept").select("doc_id"))
    return without(docs, gone, "doc_id")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later copies of strings of 200 bytes and more; the first stays."""
    return _counted(docs, suffixdup.clean(docs, length=200))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages of ten words and more, or whole items; drops documents that hold little else."""
    return _counted(docs, decontamination.clean(docs, read(spark, sf_dir, "benchmark"), window=10, coverage=0.8))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        pieces = packing.pack(docs, file.read())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", classify), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("decontamination", decontaminate), ("packing", pack)]

#: The classifier and the packing's order can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir))
        if before:
            drop(before)  # a written stage needs nothing of the one before it
        before = docs
    return docs
