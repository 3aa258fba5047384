"""Relational operators as DataFrame transformations; Catalyst and AQE choose how they run."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import BadSemantics
from tessera.operators.aggregates import Mergeable
from tessera.operators.aggregates import aggregate as mergeable
from tessera.operators.inequality import TURNED, inequality_join
from tessera.operators.predicates import Name, Predicate, Term

AGGREGATES = {
    "avg": ("avgof", lambda c: F.avg(c.cast("double"))),
    "count": ("countof", F.count),
    "count_distinct": ("dstcountof", F.count_distinct),
    "max": ("maxof", F.max),
    "min": ("minof", F.min),
    "sum": ("sumof", lambda c: F.sum(c.cast("double"))),
}

#: Aggregates of numbers only.
NUMERIC = {"avg", "sum"}


def register_aggregate(name: str, prefix: str, make: Callable[[Column], Column], numeric: bool = False) -> None:
    """A new aggregate function: its name in statements, its output's prefix, and what it makes of a column."""
    if name in AGGREGATES:
        raise BadSemantics(f"{name} is there already")
    AGGREGATES[name] = (prefix, make)
    if numeric:
        NUMERIC.add(name)


#: Aggregates of the form init, update, merge, finish, by name.
MERGEABLE: dict[str, Mergeable] = {}


def register_mergeable(name: str, prefix: str, aggregate: Mergeable) -> None:
    """A new aggregate whose states are merged, so no group is in one task; see ``aggregates``."""
    register_aggregate(name, prefix, lambda c: F.raise_error(F.lit(f"{name} is merged, not expressed")), aggregate.numeric)
    MERGEABLE[name] = aggregate


HINTS = {"merge": "merge", "hash": "shuffle_hash", "broadcast": "broadcast", "nested_loop": "shuffle_replicate_nl"}


def project(df: DataFrame, columns: Sequence[str], alphabetical: bool = False) -> DataFrame:
    """Each named column once, in the given order or alphabetically."""
    once = list(dict.fromkeys(columns))
    return df.select(*(f"`{c}`" for c in (sorted(once) if alphabetical else once)))


def select(df: DataFrame, predicate: Predicate | Column) -> DataFrame:
    return df.where(predicate.column() if isinstance(predicate, Predicate) else predicate)


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every pair of rows: only where a query has nothing to join on."""
    return left.crossJoin(right)


#: The largest side that is broadcast, however it was asked for, in bytes of its rows in memory; and what a row takes beside its columns there.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 64


def known_bytes(df: DataFrame) -> int:
    """What Spark's statistics say of the rows' size, files' sizes at the least; joins and unknowns count as their products."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def fits_broadcast(df: DataFrame) -> bool:
    """Whether all rows are within BROADCAST_BYTES as the driver and every executor would hold them.

    Files hold a row in a few bits where values repeat, so what statistics say passes only
    where one count of the rows and of their texts' bytes does as well.
    """
    if known_bytes(df) > BROADCAST_BYTES:
        return False
    texts = [f.name for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    width = df._jdf.schema().defaultSize() + ROW_BYTES
    r = df.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.octet_length(f"`{c}`")).alias(f"_b{i}") for i, c in enumerate(texts))).first()
    return r.n * width + sum(b or 0 for b in r[1:]) <= BROADCAST_BYTES


def _inequalities(left: DataFrame, right: DataFrame, predicate: Predicate) -> list[tuple[str, str, str]] | None:
    """The terms as (left column, comparison, right column), if they are inequalities only and neither side is small enough to broadcast."""
    out = []
    for t in predicate.terms:
        a, b = t.left, t.right
        if not (isinstance(a, Name) and isinstance(b, Name)) or t.op not in TURNED or {f.dataType.typeName() for d, n in ((left, a), (right, b), (left, b), (right, a)) for f in d.schema if f.name == n.name} & {"array"}:
            return None
        out.append((a.name, t.op, b.name) if a.name in left.columns else (b.name, TURNED[t.op], a.name))
    limit = spark_bytes(left.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    return out if out and min(known_bytes(left), known_bytes(right)) > limit else None


def spark_bytes(text: str) -> int:
    """A size of Spark's settings: a number with b, k, m or g behind it, or none."""
    number, unit = text.strip().lower().rstrip("b"), 1
    for letter, by in (("k", 1 << 10), ("m", 1 << 20), ("g", 1 << 30)):
        if number.endswith(letter):
            number, unit = number[:-1], by
    return int(number) * unit


def theta_join(left: DataFrame, right: DataFrame, predicate: Predicate, strategy: str | None = None) -> DataFrame:
    """Pairs of rows for which all terms hold, whatever their comparisons.

    Inequalities alone, between sides that Spark would not broadcast, go by ranges; see ``inequality``.
    """
    if strategy == "broadcast" and not fits_broadcast(right):
        strategy = None  # Spark chooses
    inequalities = None if strategy else _inequalities(left, right, predicate)
    if inequalities:
        return inequality_join(left, right, inequalities)
    right = right.hint(HINTS[strategy]) if strategy else right
    return left.join(right, predicate.column(), "inner") if predicate.terms else product(left, right)


def equi_join(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], strategy: str | None = None) -> DataFrame:
    """Inner join on equal columns; ``strategy`` is merge, hash, broadcast or None for Spark's choice.

    A side of over BROADCAST_BYTES is not broadcast even if asked for; by itself
    Spark broadcasts under spark.sql.autoBroadcastJoinThreshold.
    """
    return theta_join(left, right, Predicate(tuple(Term(Name(a), "=", Name(b)) for a, b in pairs)), strategy)


def aggregate_name(fn: str, column: str) -> str:
    return AGGREGATES[fn][0] + column


def _merged(df: DataFrame, keys: list[str], aggregates: list[tuple[str, str]], strict_empty: bool) -> DataFrame:
    """Merged aggregates beside the others, met by their keys."""
    own = [(aggregate_name(fn, c), MERGEABLE[fn], c) for fn, c in aggregates if fn in MERGEABLE]
    found = mergeable(df, keys, own)
    rest = [a for a in aggregates if a[0] not in MERGEABLE]
    columns = [*keys, *(aggregate_name(fn, c) for fn, c in aggregates)]
    if not keys:
        if strict_empty and df.isEmpty():
            return found.where("false").select(*(n for n, _, _ in own)) if not rest else found.crossJoin(group_by(df, [], rest)).where("false").select(*columns)
        return (found.crossJoin(group_by(df, [], rest)) if rest else found).select(*columns)  # one row each
    if not rest:
        return found.select(*columns)
    names = {k: f"_key{i}" for i, k in enumerate(keys)}
    found = found.withColumnsRenamed(names)
    met = group_by(df, keys, rest).join(found, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return met.select(*columns)


def group_by(df: DataFrame, keys: Sequence[str], aggregates: Sequence[tuple[str, str]], strict_empty: bool = False) -> DataFrame:
    """Keys and aggregates, named by their function and column.

    Without aggregates the distinct keys.  Without keys one row, or with
    ``strict_empty`` no row for an empty input.
    """
    keys, aggregates = list(dict.fromkeys(keys)), list(dict.fromkeys(aggregates))
    if any(fn in MERGEABLE for fn, _ in aggregates):
        return _merged(df, keys, aggregates, strict_empty)
    made = [AGGREGATES[fn][1](F.col(c)).alias(aggregate_name(fn, c)) for fn, c in dict.fromkeys(aggregates)]
    if keys:
        return df.groupBy(*keys).agg(*made) if made else df.select(*keys).distinct()
    if not made:
        raise BadSemantics("nothing to group by and nothing to aggregate")
    if not strict_empty:
        return df.agg(*made)
    names = [aggregate_name(fn, c) for fn, c in dict.fromkeys(aggregates)]
    return df.agg(*made, F.count(F.lit(1)).alias("_rows")).where("_rows > 0").select(*names)


def order(df: DataFrame, keys: Sequence[tuple[str | Column, bool]]) -> DataFrame:
    """By keys of (column, ascending)."""
    as_column = lambda c: F.col(f"`{c}`") if isinstance(c, str) else c
    return df.orderBy(*(as_column(c).asc() if up else as_column(c).desc() for c, up in keys))


def top(df: DataFrame, keys: Sequence[tuple[str | Column, bool]], n: int) -> DataFrame:
    """The first n rows of an order; Spark keeps n rows a task and merges those."""
    return order(df, keys).limit(n)


def materialize(df: DataFrame) -> DataFrame:
    """A reliable copy in the checkpoint folder, which outlives executors; the lineage ends there."""
    from tessera.sources.files import scratch

    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(scratch(df.sparkSession))
    return df.checkpoint()


def explain(df: DataFrame, count: bool = True) -> DataFrame:
    """One row, query_plan: Spark's formatted plan and, as the query is run, the number of its rows."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    text = f"{plan}\nrows: {df.count()}" if count else plan
    return df.sparkSession.createDataFrame([(text,)], "query_plan string")
