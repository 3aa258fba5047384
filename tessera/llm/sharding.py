"""Sharding by longest-processing-time scheduling.

Equal texts form a group that stays together.  Groups of at least 1/``grain``
of a shard's fair share are scheduled one by one: there are at most shards x
grain of them, whatever the corpus.  All other groups are bundled by hash into
a fixed number of bundles, each far smaller than a shard, which are scheduled
as groups.  Sorted by size, each goes to the least-loaded shard through a heap.
Slots come from counts of a fixed number of blocks a shard, so rows are
numbered in many small windows and a hot group is spread over blocks.

Defined cases: a null text has size 1 and forms one group with empty texts;
repeated rows have slots of their own; an empty table gives no rows; null ids
are numbered like others; other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.cluster import table


def schedule(sizes: dict[object, int], shards: int) -> dict[object, int]:
    """The shard of each item: the longest first, each to the least-loaded shard (ties: the lowest number)."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for item, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out[item] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def assign(df: DataFrame, group: Column, size: Column, order: Column, shards: int = 16, grain: int = 64, bundles: int = 1 << 15, blocks: int = 1 << 9) -> DataFrame:
    """``df`` with shard and slot; equal ``group`` values share a shard, ``order`` ranks rows of a block.

    The driver sees at most shards x grain heavy groups, ``bundles`` bundle
    sizes and shards x blocks counts.
    """
    spark = df.sparkSession
    rows = df.withColumns({"_g1": F.xxhash64(group), "_g2": F.xxhash64(F.lit(1), group), "_size": size, "_order": F.xxhash64(order)})
    rows = rows.withColumn("_bundle", F.pmod("_g1", F.lit(bundles)).cast("int"))
    groups = table(rows.groupBy("_g1", "_g2").agg(F.sum("_size").alias("size")))
    total = groups.agg(F.sum("size")).first()[0] or 0
    threshold = max(1, -(-total // (shards * grain)))
    heavy = groups.where(F.col("size") >= threshold)
    large = {(r["_g1"], r["_g2"]): r["size"] for r in heavy.collect()}  # at most shards x grain
    light = groups.where(F.col("size") < threshold).groupBy(F.pmod("_g1", F.lit(bundles)).cast("int").alias("b")).agg(F.sum("size").alias("size"))
    sizes: dict[object, int] = {(0, r["b"], 0): r["size"] for r in light.collect()}  # at most bundles
    sizes |= {(1, *k): v for k, v in large.items()}
    where = schedule(sizes, shards)
    bundled = spark.createDataFrame([(k[1], s) for k, s in where.items() if not k[0]], "_bundle int, _shard_b int")
    alone = spark.createDataFrame([(k[1], k[2], s) for k, s in where.items() if k[0]], "_g1 bigint, _g2 bigint, _shard_g int")
    placed = rows.join(F.broadcast(bundled), "_bundle", "left").join(F.broadcast(alone), ["_g1", "_g2"], "left")  # both of bounded size
    placed = placed.withColumns({"shard": F.coalesce("_shard_g", "_shard_b"), "_block": F.pmod("_order", F.lit(blocks)).cast("int")})
    counts = sorted(((r["shard"], r["_block"]), r["n"]) for r in placed.groupBy("shard", "_block").agg(F.count("*").alias("n")).collect())  # shards x blocks
    base, begun = [], {}
    for (shard, block), n in counts:
        base.append((shard, block, begun.get(shard, 0)))
        begun[shard] = begun.get(shard, 0) + n
    offsets = spark.createDataFrame(base, "shard int, _block int, _base bigint")
    within = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("_order", *df.columns))
    numbered = placed.withColumn("_row", within).join(F.broadcast(offsets), ["shard", "_block"])  # of bounded size
    return numbered.withColumn("slot", F.col("_base") + F.col("_row") - 1).select(*df.columns, "shard", "slot")


def by_text(df: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row; the size is the text's UTF-8 bytes plus 1."""
    body = F.coalesce(df[text], F.lit(""))
    rows = df.select(df[doc_id].alias("doc_id"), (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(2), body).alias("h2"))
    out = assign(rows, F.struct("h1", "h2", "size"), F.col("size"), F.struct("doc_id", "h1"), shards, **limits)
    return out.drop("h1", "h2")
