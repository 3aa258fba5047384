"""Histograms of many columns from one pass over a table.

A state holds, for each column, a KLL sketch of its values as doubles, a table of its
most frequent values, a sketch of its distinct values, and its least and greatest.
Its size is bounded whatever the rows.  Tasks make states of their rows, tasks by groups
merge these, and one merges the groups', so values are never shuffled.  States are rows:
they can be stored, and merged with the states of rows that came later.

Nulls and NaN are left out and counted; a column without other values has no buckets.
Columns are numbers, dates, timestamps or booleans.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.predicates import Range

#: Items a KLL level holds (ranks are within 0.2 % or so), values whose frequencies are tracked, log2 of the registers for distinct values.
LEVEL, TRACKED, REGISTERS = 2000, 10_000, 14
#: Groups of tasks whose states are merged first.
GROUPS = 64

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.BooleanType)


@dataclass(frozen=True)
class Bucket:
    range: Range
    frequency: float
    distinct: float
    percentiles: tuple[float, ...] = ()


def able(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.NumericType, T.DateType, T.TimestampType, T.BooleanType))


def _double(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(field.dataType, T.TimestampType):
        return F.unix_micros(c) / 1e6
    c = c.cast("double") + F.lit(0.0)  # one zero
    return F.when(~F.isnan(c), c)


def states(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A row of states, of all rows; column names carry the columns' positions."""
    fields = [df.schema[c] for c in columns] if columns else [f for f in df.schema if able(f)]
    values = df.select(*(_double(f).alias(f"v{i}") for i, f in enumerate(fields)), F.lit(True).alias("_row"))
    # a row of nulls, not counted, as an empty table has no states to merge
    values = values.union(df.sparkSession.range(1).select(*(F.lit(None).cast("double") for _ in fields), F.lit(False)))
    made = [x for i in range(len(fields)) for x in (
        F.kll_sketch_agg_double(f"v{i}", F.lit(LEVEL)).alias(f"q{i}"), F.expr(f"approx_top_k_accumulate(v{i}, {TRACKED})").alias(f"t{i}"),
        F.hll_sketch_agg(F.when(F.col(f"v{i}").isNotNull(), F.xxhash64(f"v{i}")), F.lit(REGISTERS)).alias(f"d{i}"), F.min(f"v{i}").alias(f"l{i}"), F.max(f"v{i}").alias(f"h{i}"),
    )]
    group = F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("_group")
    return merged(values.groupBy(group).agg(F.count_if("_row").alias("n"), *made), len(fields))


def merged(rows: DataFrame, columns: int) -> DataFrame:
    """States of the same columns as one: those of parts of a table are the table's."""
    out = [x for i in range(columns) for x in (
        F.kll_merge_agg_double(f"q{i}", F.lit(LEVEL)).alias(f"q{i}"), F.expr(f"approx_top_k_combine(t{i}, {TRACKED})").alias(f"t{i}"),
        F.hll_union_agg(f"d{i}").alias(f"d{i}"), F.min(f"l{i}").alias(f"l{i}"), F.max(f"h{i}").alias(f"h{i}"),
    )]
    # by a constant, so that partitions without rows have no state
    return rows.groupBy(F.lit(0).alias("_all")).agg(F.sum("n").alias("n"), *out).drop("_all")


def histograms(state: DataFrame, fields: Sequence[T.StructField], buckets: int = 20) -> dict[str, list[Bucket]]:
    """Buckets of each column: one for every value with at least a bucket's share of the rows, others of about equal depth.

    Frequencies of the former are off by at most the table's error, far under a bucket's
    share; borders of the latter are quantiles.  Distinct values, but for the frequent
    ones, are taken to lie as the rows do; a bucket of whole numbers has no more than these.
    """
    steps = [i / buckets for i in range(1, buckets)]
    held = [F.kll_sketch_get_n_double(f"q{i}") for i in range(len(fields))]
    first = state.select(*(x for i, n in enumerate(held) for x in (
        n.alias(f"n{i}"), F.when(n > 0, F.kll_sketch_get_quantile_double(f"q{i}", F.lit(steps))).alias(f"e{i}"),
        F.expr(f"approx_top_k_estimate(t{i}, {4 * buckets})").alias(f"t{i}"), F.hll_sketch_estimate(f"d{i}").alias(f"d{i}"), f"l{i}", f"h{i}",
    ))).first()
    plans = [_edges(first, i, buckets) for i in range(len(fields))]
    asked = [F.array(*(F.kll_sketch_get_rank_double(f"q{i}", F.lit(e)) for e in edges)).alias(f"r{i}") if edges else F.lit(None).alias(f"r{i}") for i, (edges, _) in enumerate(plans)]
    ranks = state.select(*asked).first()  # a number a border
    return {f.name: _buckets(first, i, *plans[i], ranks[f"r{i}"], isinstance(f.dataType, _WHOLE)) for i, f in enumerate(fields)}


def _edges(row: Row, i: int, buckets: int) -> tuple[list[float], dict[float, float]]:
    """Upper borders, the greatest value the last, and the frequent values with their frequencies."""
    n = row[f"n{i}"]
    if not n:
        return [], {}
    frequent = {t["item"]: float(t["count"]) for t in row[f"t{i}"] if t["item"] is not None and t["count"] * buckets >= n}
    return sorted({*row[f"e{i}"], row[f"h{i}"]}), frequent


def _buckets(row: Row, i: int, edges: list[float], frequent: dict[float, float], ranks: list[float] | None, whole: bool) -> list[Bucket]:
    """The frequent values' buckets, and those between borders with what rows are left there."""
    if not edges:
        return []
    out = [Bucket(Range(v, v), f, 1.0) for v, f in sorted(frequent.items())]
    left, distinct = row[f"n{i}"] - sum(frequent.values()), row[f"d{i}"] - len(frequent)
    rest, low, below = [], row[f"l{i}"], 0.0
    for j, (edge, rank) in enumerate(zip(edges, [*ranks[:-1], 1.0])):
        r = Range(low, edge, j > 0)
        held = [v for v in frequent if r.contains(v)]
        rest.append((r, max(0.0, row[f"n{i}"] * (rank - below) - sum(frequent[v] for v in held)), len(held)))
        low, below = edge, rank
    total = sum(f for _, f, _ in rest)
    if left < 0.5 or distinct < 0.5 or not total:
        return out
    for r, f, held in rest:
        f *= left / total
        most = r.high - r.low + (not r.low_open) - held if whole else f
        if f > 0.5 and most > 0:
            out.append(Bucket(r, f, max(1.0, min(distinct * f / left, f, most))))
    return sorted(out, key=lambda b: (b.range.high, b.range.low))


def one_pass(df: DataFrame, columns: Sequence[str] | None = None, buckets: int = 20) -> dict[str, list[Bucket]]:
    """Histograms of the columns, all that can have one by default; the table is read once."""
    fields = [df.schema[c] for c in columns] if columns else [f for f in df.schema if able(f)]
    return histograms(held(states(df, [f.name for f in fields])), fields, buckets) if fields else {}


def held(state: DataFrame) -> DataFrame:
    """A state of its own, that is not made again when read again: one row of bounded size."""
    return state.sparkSession.createDataFrame(state.collect(), state.schema)
