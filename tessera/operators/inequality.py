"""Inner joins on one or two inequalities without looking at all pairs.

One side is a point, the other an interval that is open to one side if there is
one inequality only.  Quantiles of a bounded sample of the points cut their range into
parts; a point is in one part, an interval is copied to the parts that it overlaps, so rows
meet by an equality of parts, every pair at most once.  A part's points and intervals travel in
lists of some ``PIECE`` rows dealt by a hash of the whole row, so a
value that many rows share is spread over tasks, the same way if a task is run again.  Where two lists meet, the points are sorted and each interval's first
and last point are found by binary search: only pairs that match are made, a bounded
batch at a time.  Where intervals cover parts whole, all points of those match: such
pairs, nearly all where intervals are wide, come from Spark's own join and never pass
through Python.  There the parts are leaves of a tree, so that a row is copied for few of its nodes
and not for each part.  Two inequalities on different columns of the points' side:
the first is joined on, the second filters.

Where only counts and sums of the pairs are asked for, ``inequality_totals`` makes no
pairs: both sides are put in one order and totals run along it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE = 4096
#: The most parts, how many points one has at least, and how many sampled points there are for each.
PARTS, LEAST, SAMPLED = 1024, 512, 20
#: Intervals whose share that covers parts whole is counted.
TRIED = 20_000
#: Blocks that pairs of intervals and the parts they cover are cut into, and the most rows of a side of one, in PIECEs.
BLOCKS, LONGEST = 512, 8
#: Pairs in a batch of the result.
BATCH = 1 << 16

TURNED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
COMPARE = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
Inequality = tuple[str, str, str]  # left column, comparison, right column


def _common(a: T.DataType, b: T.DataType) -> T.DataType:
    """A type in which both compare as they do in Spark."""
    if a == b:
        return a
    if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType):
        return T.LongType()
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    raise ValueError(f"{a.simpleString()} and {b.simpleString()} don't compare")


def _quantiles(points: DataFrame, parts: int, n: int) -> list:
    """Bounds between parts, from about SAMPLED values for each."""
    drawn = points.where(F.rand(7) < min(1.0, SAMPLED * parts / max(n, 1))).select("_x")
    values = sorted(r[0] for r in drawn.limit(2 * SAMPLED * parts).collect())
    return sorted({values[i * len(values) // parts] for i in range(1, parts)}) if values else []


def _part(x: Column, bounds: Column, parts: int) -> Column:
    """The number of bounds up to x, by binary search."""
    steps = F.array(*(F.lit(1 << s) for s in reversed(range(max(1, parts.bit_length())))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= x, at + step).otherwise(at))


def _lists(rows: DataFrame, columns: list[str], keys: list[str], pieces: int) -> DataFrame:
    """_part, keys and rows of each piece of a part, in lists."""
    sizes = F.broadcast(rows.groupBy("_part").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / pieces)).alias("_pieces")))  # a row a part
    dealt = rows.join(sizes, "_part").withColumn("_piece", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in columns)), F.col("_pieces")))
    return dealt.groupBy("_part", "_piece").agg(F.collect_list(F.struct(*keys, F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"))).alias("list"))


def _tasks(df: DataFrame, keys: int) -> int:
    """A number of tasks by the pairs that keys make and not by their bytes, which are few."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(keys, 4096))


def _nodes(first: Column, last: Column, leaves: int) -> Column:
    """The fewest nodes of a binary tree (1 its root, 2n and 2n + 1 below n, part p at leaves + p) whose leaves are parts first to last, and nulls."""
    made = []
    for level in range(leaves.bit_length()):
        low, high = F.shiftright(first + leaves + ((1 << level) - 1), level), F.shiftright(last + 1 + leaves, level)
        made += [F.when((low < high) & (low % 2 == 1), low), F.when((low < high) & (high % 2 == 1), high - 1)]
    return F.array(*made)


def _blocks(points: dict[int, int], intervals: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """node, pieces of its points, deals of its intervals and number of its first block, for the nodes that have both.

    A block has up to ``side`` points and some ``side`` intervals.  About BLOCKS of them as long as they aren't
    too long for memory, so the copies of rows grow with the rows and not with their pairs.
    """
    both = {k: (points[k], n) for k, n in sorted(intervals.items()) if points.get(k)}
    side = max(1, PIECE // 4, min(LONGEST * PIECE, int((sum(p * i for p, i in both.values()) / BLOCKS) ** 0.5)))
    out, at = [], 0
    for k, (p, i) in both.items():
        out.append((k, -(-p // side), -(-i // side), at))
        at += out[-1][1] * out[-1][2]
    return out


def _covered(points: DataFrame, counted: dict[int, int], intervals: DataFrame, parts: int, order: str | None) -> DataFrame:
    """Points, lists of them by part, and the intervals that cover their part (_first to _last): all of their pairs.

    Parts are leaves of a tree: an interval goes to the few nodes that make up its parts, a list to those above its
    part, and what meets in a node is cut into blocks.  An interval is held against a block's lists one after another.
    """
    leaves = 1 << (parts - 1).bit_length()
    above = lambda p: [(p + leaves) >> level for level in range(leaves.bit_length())]
    held: dict[int, int] = {}
    for p, n in counted.items():
        for k in above(p):
            held[k] = held.get(k, 0) + n
    # a row a node
    placed = intervals.where("_first <= _last").withColumn("_node", F.explode(_nodes(F.col("_first"), F.col("_last"), leaves))).where("_node is not null").drop("_first", "_last")
    blocks = _blocks(held, {k: n for k, n in placed.groupBy("_node").agg(F.count(F.lit(1))).collect()})
    sizes = F.broadcast(points.sparkSession.createDataFrame(blocks, "_node int, _pieces bigint, _deals bigint, _base bigint"))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(k) - 1))
    block = lambda piece, deal: (F.col("_base") + piece * F.col("_deals") + deal).alias("_block")
    names = [f"`{c}`" for c in intervals.columns if c not in ("_first", "_last")]
    left = placed.join(sizes, "_node").withColumn("_piece", every("_pieces")).select(*names, block(F.col("_piece"), F.pmod(F.xxhash64(*names), F.col("_deals"))))
    rows = F.col("list")["row"]
    if order:  # those that a second inequality drops lie together
        rows = F.sort_array(F.transform("list", lambda e: F.struct(e["row"][order].alias("by"), e["row"].alias("row"))))["row"]
    # lists of a node's parts, or of one part that many share, in turn to its pieces
    right = points.select("_part", F.col("_piece").alias("_of"), rows.alias("_rows")).withColumn("_node", F.explode(F.array(*(F.shiftright(F.col("_part") + leaves, level) for level in range(leaves.bit_length())))))
    right = right.join(sizes, "_node").withColumn("_deal", every("_deals")).select("_rows", block(F.pmod(F.col("_part") + F.col("_of"), F.col("_pieces")), F.col("_deal")))
    tasks = _tasks(points, sum(pieces * deals for _, pieces, deals, _ in blocks))
    return left.repartition(tasks, "_block").join(right.repartition(tasks, "_block").hint("merge"), "_block").select(*names, F.inline("_rows"))


def _numbers(column: pa.Array) -> np.ndarray:
    """Values that NumPy sorts as Spark does: NaN last, texts by code points."""
    if pa.types.is_temporal(column.type):
        column = column.cast(pa.int64() if not pa.types.is_date32(column.type) else pa.int32())
    return np.array(column.to_pylist(), object) if pa.types.is_string(column.type) or pa.types.is_decimal(column.type) else column.to_numpy(zero_copy_only=False)


def _interval_join(points: DataFrame, x: str, intervals: DataFrame, low: tuple[str, str] | None, high: tuple[str, str] | None, order: str | None = None) -> DataFrame:
    """Points and intervals, their columns side by side, where x is over ``low`` and under ``high``: (comparison of x with it, column).

    ``order``: a column of the points that a further inequality compares.
    """
    kind = points.schema[x].dataType
    for bound in (low, high):
        if bound:
            kind = _common(kind, intervals.schema[bound[1]].dataType)
    own = points.withColumn("_x", F.col(f"`{x}`").cast(kind)).where("_x is not null")
    # points in time go through the driver as numbers or texts, which hang on no time zone
    sent = lambda c: F.unix_micros(c) if isinstance(kind, T.TimestampType) else c.cast("string") if isinstance(kind, T.TimestampNTZType) else c
    back = lambda v: F.timestamp_micros(F.lit(v).cast("bigint")) if isinstance(kind, T.TimestampType) else F.lit(v).cast(kind)
    keys = {"_low": low, "_high": high}
    held = [k for k, b in keys.items() if b]
    other = intervals.withColumns({k: F.col(f"`{b[1]}`").cast(kind) for k, b in keys.items() if b}).where(" and ".join(f"{k} is not null" for k in held))
    # points beyond all intervals, and intervals beyond all points, which would crowd the first and last part, meet nothing
    n_other, *ends = other.agg(F.count(F.lit(1)), *(sent(F.min(k) if k == "_low" else F.max(k)) for k in held)).first()
    for k, end in zip(held, ends):
        own = own.where(COMPARE[keys[k][0]](F.col("_x"), back(end)))
    n, least, most = own.agg(F.count(F.lit(1)), sent(F.min("_x")), sent(F.max("_x"))).first()
    parts = max(1, min(PARTS, n // min(LEAST, PIECE)))
    bounds = _quantiles(own, parts, n) if parts > 1 else []
    known = F.array(*(F.lit(b) for b in bounds)).cast(T.ArrayType(kind))
    last = len(bounds)
    if low:
        other = other.where(COMPARE[TURNED[low[0]]](F.col("_low"), back(most)))
    if high:
        other = other.where(COMPARE[TURNED[high[0]]](F.col("_high"), back(least)))
    place = lambda k, default: _part(F.col(k), known, parts) if keys[k] else F.lit(default)
    placed = lambda df: df.withColumn("_from", place("_low", 0)).withColumn("_to", place("_high", last)).where("_from <= _to")
    first, final = F.col("_from") + (1 if low else 0), F.col("_to") - (1 if high else 0)
    tried = min(1.0, TRIED / max(n_other, 1))
    copies = placed(other.where(F.rand(11) < tried)).agg(F.sum(F.greatest(final - first + 1, F.lit(0)))).first()[0] if bounds else 0
    # worth while if the points that are read once more are fewer than the pairs that this makes
    covering = (copies or 0) / tried > len(bounds)
    other = placed(other)
    whole = other.select(*(F.col(f"`{c}`") for c in intervals.columns), first.alias("_first"), final.alias("_last"))
    edges = F.array_distinct(F.array(*([F.col("_from")] if low else []), *([F.col("_to")] if high else [])))
    other = other.withColumn("_part", F.explode(edges if covering else F.sequence("_from", "_to")))
    dealt = own.withColumn("_part", _part(F.col("_x"), known, parts))
    lists = _lists(dealt, points.columns, ["_x"], PIECE)
    left = lists.select("_part", F.col("list").alias("points"))
    right = _lists(other, intervals.columns, held, PIECE).select("_part", F.col("list").alias("intervals"))
    n_left = len(points.columns)
    schema = T.StructType([*points.schema.fields, *intervals.schema.fields])

    def meet(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for r in range(batch.num_rows):
                a, b = (batch.column(c).slice(r, 1).flatten() for c in (0, 1))
                value = _numbers(a.field(0))
                order = np.argsort(value, kind="stable")
                value = value[order]
                start, stop = np.zeros(len(b), np.int64), np.full(len(b), len(a), np.int64)
                if low:
                    start = np.searchsorted(value, _numbers(b.field(held.index("_low"))), "left" if low[0] == ">=" else "right")
                if high:
                    stop = np.searchsorted(value, _numbers(b.field(held.index("_high"))), "right" if high[0] == "<=" else "left")
                count = np.maximum(stop - start, 0)
                total = np.concatenate([[0], np.cumsum(count)])
                rows_a, rows_b = a.field(1), b.field(len(held))
                for at in range(0, int(total[-1]), BATCH):  # some of the pairs, by their numbers
                    pair = np.arange(at, min(at + BATCH, int(total[-1])))
                    of = np.searchsorted(total, pair, "right") - 1
                    one = rows_a.take(pa.array(order[start[of] + pair - total[of]])).flatten()
                    two = rows_b.take(pa.array(of)).flatten()
                    yield pa.RecordBatch.from_arrays([*one, *two], names=[f"c{i}" for i in range(n_left + len(two))])

    made = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    if covering:
        left, right = (side.repartition(_tasks(own, parts), "_part") for side in (left, right))
    joined = left.join(right, "_part").select("points", "intervals").mapInArrow(meet, made).toDF(*schema.names)
    if not covering:
        return joined
    counted = dict(dealt.groupBy("_part").agg(F.count(F.lit(1))).collect())  # a row a part
    inner = _covered(lists, counted, whole, last + 1, order)
    return joined.union(inner.select(*(F.col(f"`{c}`") for c in schema.names)))


def _merge(terms: Sequence[Inequality]) -> tuple[tuple[str, str] | None, tuple[str, str] | None] | None:
    """The bounds (comparison, column) of one point column, or None where they are not one below and one above."""
    low = [(op, c) for _, op, c in terms if op in (">", ">=")]
    high = [(op, c) for _, op, c in terms if op in ("<", "<=")]
    if len({p for p, _, _ in terms}) > 1 or len(low) > 1 or len(high) > 1:
        return None
    return (low[0] if low else None), (high[0] if high else None)


def inequality_join(left: DataFrame, right: DataFrame, terms: Sequence[Inequality]) -> DataFrame:
    """Pairs of rows for which all ``terms`` hold; column names of the two sides differ.

    Nulls meet nothing.  Terms beyond a lower and an upper bound of one column filter the pairs.
    """
    if not terms or any(op not in TURNED for _, op, _ in terms):
        raise ValueError("one comparison or more by <, <=, > or >=")
    turned = [(r, TURNED[op], lf) for lf, op, r in terms]
    n = len(terms) if len(terms) <= 2 and (_merge(terms) or _merge(turned)) else 2 if len(terms) > 2 and (_merge(terms[:2]) or _merge(turned[:2])) else 1
    rest = terms[n:]
    bounds = _merge(terms[:n])
    if bounds:
        joined = _interval_join(left, terms[0][0], right, *bounds, rest[0][0] if rest else None)
    else:
        joined = _interval_join(right, turned[0][0], left, *_merge(turned[:n]), rest[0][2] if rest else None).select(*(f"`{c}`" for c in [*left.columns, *right.columns]))
    for a, op, b in rest:
        joined = joined.where(COMPARE[op](F.col(f"`{a}`"), F.col(f"`{b}`")))
    return joined


def inequality_totals(left: DataFrame, right: DataFrame, term: Inequality, totals: dict[str, str], count: str = "n") -> DataFrame:
    """Rows of ``left`` that meet any of ``right``, with the number of those and, for each of ``totals``, the sum of a column of theirs.

    As the pairs of ``inequality_join`` grouped by left row; the rows of both sides are ordered once, so the
    work grows with their number and not with that of the pairs.  Nulls meet nothing; a sum of nulls alone is null.
    """
    from tessera.operators.prefix import running

    mine, op, other = term
    if op not in TURNED:
        raise ValueError("one comparison by <, <=, > or >=")
    kind = _common(left.schema[mine].dataType, right.schema[other].dataType)
    # of equal values, those of the right go before where equal ones meet
    first = op in ("<=", ">=")
    sums = {f"_v{i}": F.col(f"`{c}`") for i, c in enumerate(totals.values())}
    asked = left.select(F.col(f"`{mine}`").cast(kind).alias("_x"), F.lit(1 if first else 0).alias("_side"), F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("_row"))
    given = right.select(F.col(f"`{other}`").cast(kind).alias("_x"), F.lit(0 if first else 1).alias("_side"), *(c.alias(k) for k, c in sums.items()), F.lit(1).cast("bigint").alias("_n"))
    both = asked.unionByName(given, allowMissingColumns=True).where("_x is not null")
    wide = {k: T.LongType() if isinstance(given.schema[k].dataType, T.IntegralType) else given.schema[k].dataType for k in sums}
    made = {"_n": F.col("_n")} | {k: F.col(k).cast(t) for k, t in wide.items()} | {f"{k}n": F.col(k).isNotNull().cast("bigint") for k in sums}
    run = running(both, [], [("_x", op in (">", ">=")), ("_side", True)], {f"_all{k}": c for k, c in made.items()})
    return run.where("_row is not null and _all_n > 0").select("_row.*", F.col("_all_n").alias(count), *(F.when(F.col(f"_all{k}n") > 0, F.col(f"_all{k}")).alias(name) for k, name in zip(sums, totals)))
