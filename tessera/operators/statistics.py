"""Table statistics, histograms and the cardinality estimates made from them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import sketches
from tessera.operators.predicates import Predicate, Range
from tessera.operators.sketches import Bucket


def table_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, rows, distinct values, least and greatest (as text) of each column, in one pass."""
    columns = list(columns or df.columns)
    made = [x for i, c in enumerate(columns) for x in (F.count_distinct(c).alias(f"d{i}"), F.min(c).cast("string").alias(f"l{i}"), F.max(c).cast("string").alias(f"h{i}"))]
    one = df.agg(F.count(F.lit(1)).alias("n"), *made)
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.col(f"d{i}").alias("n_distinct"), F.col(f"l{i}").alias("least"), F.col(f"h{i}").alias("greatest")) for i, c in enumerate(columns)))
    return one.select(F.inline(rows))


def equal_depth(df: DataFrame, column: str, buckets: int = 20) -> DataFrame:
    """bucket, low, high, frequency and distinct values of buckets of about equal frequency.

    Bounds are percentiles, so values that are equal share a bucket.
    """
    cuts = df.agg(F.percentile_approx(column, [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    edges = sorted(set(cuts))
    place = sum((F.when(F.col(column) > F.lit(e), 1).otherwise(0) for e in edges), F.lit(0))
    return df.where(F.col(column).isNotNull()).groupBy(place.cast("int").alias("bucket")).agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count(F.lit(1)).alias("frequency"), F.count_distinct(column).alias("n_distinct"))


def max_diff(df: DataFrame, column: str, buckets: int = 20, percentiles: int = 5, by: str = "area") -> list[Bucket]:
    """MaxDiff histogram: bucket borders are the largest jumps in frequency, or in frequency times spread.

    Frequencies of all rows are aggregated first; only the ``buckets`` largest
    jumps reach the driver.  The neighbour of a value is found within ranges of
    values, as one window over all of them would be one task.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("f"))
    parts = 64
    cuts = counts.agg(F.percentile_approx("v", [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    place = sum((F.when(F.col("v") > F.lit(e), 1).otherwise(0) for e in sorted(set(cuts))), F.lit(0))
    ranged = counts.withColumn("part", place.cast("int"))
    firsts = ranged.groupBy("part").agg(F.min(F.struct("v", "f")).alias("next")).select((F.col("part") - 1).alias("part"), "next")  # a row a part
    w = Window.partitionBy("part").orderBy("v")
    # parts without values have no row: the next part that has some is looked up among the few
    heads = sorted((r.part + 1, r.next.v, r.next.f) for r in firsts.collect())
    following = {a[0]: b for a, b in zip(heads, heads[1:])}
    known = F.create_map(*(x for p, (_, v, f) in following.items() for x in (F.lit(p), F.struct(F.lit(v).alias("v"), F.lit(f).alias("f"))))) if following else None
    ahead = F.lead(F.struct("v", "f")).over(w)
    if known is not None:
        ahead = F.coalesce(ahead, F.try_element_at(known, F.col("part")))
    jumps = ranged.withColumn("next", ahead)
    jump = F.abs(F.col("next.f") - F.col("f"))
    if by == "area":
        jump = jump * (F.col("next.v") - F.col("v"))
    borders = sorted(r.v for r in jumps.where("next is not null").select("v", jump.alias("j")).orderBy(F.desc("j"), "v").limit(buckets - 1).collect())
    at = sum((F.when(F.col("v") > F.lit(b), 1).otherwise(0) for b in borders), F.lit(0))
    steps = [i / percentiles for i in range(1, percentiles)]
    rows = counts.groupBy(at.cast("int").alias("b")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("f").alias("f"), F.count(F.lit(1)).alias("d"), F.percentile_approx("v", steps, 1000).alias("p")).orderBy("b").collect()
    return [Bucket(Range(r.low, r.high), float(r.f), float(r.d), tuple(r.p or ())) for r in rows]


def selectivity(histogram: Sequence[Bucket], wanted: Range | None) -> float:
    """The share of rows in a range: whole buckets, and parts of buckets by length or by one distinct value."""
    total = sum(b.frequency for b in histogram)
    if wanted is None or not total:
        return 0.0
    rows = 0.0
    for b in histogram:
        both = b.range.intersect(wanted)
        if not both.valid():
            continue
        if both.low == both.high:
            rows += b.frequency / max(b.distinct, 1)
        elif b.range.length() > 0:
            rows += b.frequency * both.length() / b.range.length()
        else:
            rows += b.frequency
    return min(1.0, rows / total)


def predicate_selectivity(histograms: dict[str, Sequence[Bucket]], predicate: Predicate) -> float:
    """Columns taken as independent."""
    out = 1.0
    for name in sorted(predicate.names() & histograms.keys()):
        if any(t.bound(name) for t in predicate.terms):
            out *= selectivity(histograms[name], predicate.range_of(name))
    return out


def join_rows(left: Sequence[Bucket], right: Sequence[Bucket]) -> float:
    """Rows of an equi join: buckets that overlap, each value of the rarer side within the other's."""
    rows = 0.0
    for a in left:
        for b in right:
            both = a.range.intersect(b.range)
            if not both.valid():
                continue
            share = lambda x, both=both: 1.0 if x.range.length() <= 0 else max(both.length() / x.range.length(), 1 / max(x.distinct, 1))
            fa, fb = a.frequency * share(a), b.frequency * share(b)
            rows += fa * fb / max(a.distinct * share(a), b.distinct * share(b), 1.0)
    return rows


def group_rows(distinct: Sequence[float], rows: float) -> float:
    """Groups that rows over keys of so many distinct values form, by Cardenas' formula."""
    space = 1.0
    for d in distinct:
        space *= max(d, 1.0)
    return space * (1 - (1 - 1 / space) ** rows) if space < 1e15 else rows


class Manager:
    """Statistics of tables by name, made when first asked for and again after over ``changes`` changed rows."""

    def __init__(self, table: Callable[[str], DataFrame], changes: int = 100) -> None:
        self.table, self.most = table, changes
        self.held: dict[str, list] = {}
        self.counts: dict[str, int] = {}
        self.states: dict[str, tuple[list, DataFrame]] = {}

    def changed(self, name: str, rows: int) -> None:
        """Rows were changed or taken out, so histograms are made anew when next asked for."""
        self.counts[name] = self.counts.get(name, 0) + rows
        self.states.pop(name, None)

    def added(self, name: str, df: DataFrame, rows: int) -> None:
        """Only rows that came are read: their state is merged with the one there is."""
        self.counts[name] = self.counts.get(name, 0) + rows
        if name in self.states:
            fields, state = self.states[name]
            new = sketches.states(df, [f.name for f in fields])
            self.states[name] = fields, sketches.held(sketches.merged(state.unionByName(new), len(fields)))

    def histograms(self, name: str, buckets: int = 20) -> dict[str, list[Bucket]]:
        """Of all columns that can have one, from one pass; after inserts from the rows that came."""
        if name not in self.states:
            df = self.table(name)
            fields = [f for f in df.schema if sketches.able(f)]
            if not fields:
                return {}
            self.states[name] = fields, sketches.held(sketches.states(df, [f.name for f in fields]))
        fields, state = self.states[name]
        return sketches.histograms(state, fields, buckets)

    def rows(self, name: str, predicate: Predicate) -> float:
        """How many rows of a table are estimated to meet a predicate."""
        made = self.histograms(name)
        return (self.states[name][1].first().n if made else 0) * predicate_selectivity(made, predicate)

    def stats(self, name: str) -> list:
        """A row a column, as ``table_stats``; as old as the changes since allow."""
        if name not in self.held or self.counts.get(name, 0) > self.most:
            self.refresh(name)
        return self.held[name]

    def refresh(self, name: str) -> None:
        df = self.table(name)
        plain = [f.name for f in df.schema if f.dataType.typeName() not in ("array", "map", "struct")]
        self.held[name], self.counts[name] = table_stats(df, plain).collect(), 0  # a row a column


def synced(histograms: dict[str, Sequence[Bucket]]) -> dict[str, list[Bucket]]:
    """Histograms of one table's columns with as many rows each: those of the column with the fewest."""
    totals = {c: sum(b.frequency for b in h) for c, h in histograms.items()}
    least = min(totals.values(), default=0.0)
    scaled = lambda b, t: replace(b, frequency=b.frequency * least / t, distinct=min(b.distinct, b.frequency * least / t))
    return {c: [scaled(b, totals[c]) for b in h] if totals[c] > least else list(h) for c, h in histograms.items()}
