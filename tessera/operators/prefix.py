"""Running totals and positions over an order of a whole table, with no task that has all of a key.

Rows are dealt to ranges of (keys, order), ties by a hash of the row, so a value or a key that
many rows share is cut over ranges; sorted within them they are written once.  A
range's totals by key are few numbers; their sums before each range, added to the sums
within it, are the running totals.  Windows see one range's rows of a key, or
one row a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.relational import materialize

Key = tuple[str, bool]  # column, ascending


def _sorted(order: Sequence[Key]) -> list[Column]:
    return [F.col(f"`{c}`").asc_nulls_first() if up else F.col(f"`{c}`").desc_nulls_last() for c, up in order]


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Key], totals: dict[str, Column]) -> DataFrame:
    """``df`` with the running total, its own row included, of each column of ``totals`` among the rows of its keys.

    Rows that the order does not tell apart follow each other by a hash of all their columns.
    """
    by = _sorted([*((k, True) for k in keys), *order])
    tie = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns if df.schema[c].dataType.typeName() not in ("map", "variant")))
    named = df.withColumns({f"_t{i}": F.coalesce(c, F.lit(0)) for i, c in enumerate(totals.values())}).withColumn("_tie", tie)
    dealt = materialize(named.repartitionByRange(*by, F.col("_tie")).withColumn("_range", F.spark_partition_id()))
    place = [F.col(f"`{k}`") for k in keys]
    sums = [F.sum(f"_t{i}").alias(f"_s{i}") for i in range(len(totals))]
    before = Window.partitionBy(*place).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range that the key is in
    each = dealt.groupBy(*place, "_range").agg(*sums)
    starts = each.select(*(p.alias(f"_k{i}") for i, p in enumerate(place)), F.col("_range").alias("_at"), *(F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in range(len(totals))))
    met = [F.col("_range") == F.col("_at"), *(p.eqNullSafe(F.col(f"_k{i}")) for i, p in enumerate(place))]
    within = Window.partitionBy("_range", *place).orderBy(*_sorted(order), "_tie").rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumns({f"_w{i}": F.sum(f"_t{i}").over(within) for i in range(len(totals))}).join(starts, met)
    return out.select(*(F.col(f"`{c}`") for c in df.columns), *((F.col(f"_b{i}") + F.col(f"_w{i}")).alias(name) for i, name in enumerate(totals)))


def positions(df: DataFrame, order: Sequence[Key], name: str = "position") -> DataFrame:
    """``df`` with each row's place, from 1, in an order of the whole table."""
    return running(df, [], order, {name: F.lit(1).cast("bigint")})
