"""Joins on inequalities against all pairs in Python."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import inequality, relational
from tessera.operators.predicates import Name, Predicate, Term

OPS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


@pytest.fixture(scope="module")
def sides(spark):
    r = random.Random(6)
    left = [(i, r.choice([7, r.randint(0, 60), None]), r.uniform(0, 9)) for i in range(150)]
    right = [(i, (lo := r.choice([7, r.randint(0, 60), None])), None if lo is None else lo + r.randint(-3, 12), r.uniform(0, 9)) for i in range(120)]
    return left, right, spark.createDataFrame(left, "i int, x int, u double").repartition(4), spark.createDataFrame(right, "j int, lo long, hi int, v double").repartition(3)


@pytest.mark.parametrize(
    "terms",
    [
        [("x", "<", "lo")], [("x", ">=", "hi")], [("x", ">=", "lo"), ("x", "<", "hi")], [("x", ">", "lo"), ("x", "<=", "hi")],
        [("x", "<=", "lo"), ("u", ">", "lo")], [("x", "<", "lo"), ("u", ">", "v")], [("x", ">=", "lo"), ("x", "<=", "hi"), ("u", "<", "v")], [("u", ">", "lo"), ("u", "<", "v"), ("x", "<", "hi")],
    ],
)
@pytest.mark.parametrize("piece", [4096, 8])
def test_pairs(spark, sides, terms, piece, monkeypatch):
    left, right, a, b = sides
    monkeypatch.setattr(inequality, "PIECE", piece)
    monkeypatch.setattr(inequality, "BATCH", 50)
    joined = inequality.inequality_join(a, b, terms)
    assert joined.columns == ["i", "x", "u", "j", "lo", "hi", "v"]
    where = {"i": 0, "x": 1, "u": 2}, {"j": 0, "lo": 1, "hi": 2, "v": 3}
    want = [(*p, *q) for p in left for q in right if all(None not in (p[where[0][l]], q[where[1][r]]) and OPS[op](p[where[0][l]], q[where[1][r]]) for l, op, r in terms)]
    assert sorted(map(str, map(tuple, joined.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("kind, values", [("string", ["a", "B", "é", "aa", "", None]), ("timestamp_ntz", [datetime.datetime(2020, 1, d) for d in (1, 2, 3)] + [None]), ("double", [float("nan"), 1.0, -0.0, 0.0, float("inf"), None]), ("date", [datetime.date(2020, 1, d) for d in (1, 5)])])
def test_types(spark, kind, values):
    a = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    b = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"j int, y {kind}")
    for op in OPS:
        got = inequality.inequality_join(a, b, [("x", op, "y")]).select("i", "j").collect()
        assert sorted(map(tuple, got)) == sorted((r.i, r.j) for r in a.crossJoin(b).where(f"x {op} y").collect())


@pytest.mark.parametrize("op", OPS)
@pytest.mark.parametrize("x, y", [("x", "lo"), ("u", "v"), ("x", "v")])
def test_totals(spark, sides, op, x, y):
    """Counts and sums by left row as of all pairs, with copies of rows, nulls and ties, and no pairs made."""
    *_, a, b = sides
    a, b = a.unionByName(a.where("i < 5")), b.withColumn("w", F.when(F.col("j") % 3 > 0, F.col("hi")))
    made = inequality.inequality_totals(a, b, (x, op, y), {"s": "w"})
    assert made.columns == ["i", "x", "u", "n", "s"] and made.schema["s"].dataType.simpleString() == "bigint"
    assert "MapInArrow" not in made._jdf.queryExecution().toString()
    got = made.groupBy("i").agg(F.sum("n"), F.sum("s")).collect()
    want = a.join(b, F.expr(f"{x} {op} {y}")).groupBy("i").agg(F.count(F.lit(1)), F.sum("w")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_totals_of_nothing(spark):
    a, b = spark.createDataFrame([(1, float("nan")), (2, 0.0), (3, None)], "i int, x double"), spark.createDataFrame([(-0.0, None), (float("nan"), 5)], "y double, w int")
    got = lambda op: sorted(map(tuple, inequality.inequality_totals(a, b, ("x", op, "y"), {"s": "w"}).select("i", "n", "s").collect()))
    assert got(">") == [(1, 1, None)] and got(">=") == [(1, 2, 5), (2, 1, None)] and got("<") == [(2, 1, 5)]
    assert inequality.inequality_totals(a, b.where("false"), ("x", "<", "y"), {"s": "w"}).collect() == []


@pytest.mark.parametrize("terms", [[("x", ">", "lo")], [("x", "<=", "hi")], [("x", ">=", "lo"), ("x", "<", "hi")]])
def test_intervals_beyond_the_points_are_not_moved(spark, terms, monkeypatch):
    """Intervals that no point reaches are in no list, so they can't crowd the first or last part."""
    moved, lists = [], inequality._lists
    monkeypatch.setattr(inequality, "_lists", lambda rows, *a: (moved.append(rows.count()), lists(rows, *a))[1])
    a = spark.range(50).selectExpr("id x")
    b = spark.range(3000).selectExpr("id j", "case when id < 1000 then 100 + id when id < 2000 then -100 - id else id % 50 end lo").selectExpr("j", "lo", "lo + 1 hi")
    got = inequality.inequality_join(a, b, terms).count()
    assert got == a.join(b, F.expr(" and ".join(f"{x} {op} {y}" for x, op, y in terms))).count()
    assert moved[0] == 50 and moved[1] <= (1100 if len(terms) == 2 else 2100)


def test_empty_and_wrong(spark, sides):
    *_, a, b = sides
    assert inequality.inequality_join(a.where("false"), b, [("x", "<", "lo")]).collect() == []
    assert inequality.inequality_join(a, b.where("false"), [("x", "<", "lo")]).collect() == []
    with pytest.raises(ValueError):
        inequality.inequality_join(a, b, [])
    with pytest.raises(ValueError):
        inequality.inequality_join(a, b, [("x", "=", "lo")])


def test_plan(spark, sides, tmp_path):
    """Sides beyond what Spark broadcasts are never paired row by row, in statements as well."""
    *_, a, b = sides
    a.write.parquet(f"{tmp_path}/a")
    b.write.parquet(f"{tmp_path}/b")
    a, b = spark.read.parquet(f"{tmp_path}/a"), spark.read.parquet(f"{tmp_path}/b")
    p = Predicate((Term(Name("lo"), "<=", Name("x")), Term(Name("hi"), ">", Name("x"))))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10b")
    try:
        joined = relational.theta_join(a, b, p)
        plan = joined._jdf.queryExecution().toString()
        got = sorted(map(str, joined.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "MapInArrow" in plan
    assert got == sorted(map(str, a.join(b, p.column()).collect()))


def test_sizes():
    assert [relational.spark_bytes(t) for t in ("10485760b", "256k", "-1", "10m", "10MB", "1g", "7")] == [10485760, 262144, -1, 10 << 20, 10 << 20, 1 << 30, 7]


@pytest.mark.parametrize("piece", [4096, 40])
def test_covered_parts_pass_no_python(spark, monkeypatch, piece):
    """Pairs of intervals and the parts that they cover whole come from a join of Spark's; only those at an interval's ends are searched."""
    monkeypatch.setattr(inequality, "LEAST", 50)
    monkeypatch.setattr(inequality, "PIECE", piece)
    made, lists = [], inequality._lists
    monkeypatch.setattr(inequality, "_lists", lambda rows, *a: (made.append(rows.groupBy("_part").count()), lists(rows, *a))[1])
    a = spark.range(2000).selectExpr("id i", "case when id % 4 = 0 then 700 else id end x", "id % 97 u")
    b = spark.range(300).selectExpr("id j", "id * 5 lo", "id * 5 + (id % 7) * 100 hi", "id % 89 v")
    for terms in ([("x", ">", "lo"), ("u", "<", "v")], [("x", "<=", "hi")], [("x", ">=", "lo"), ("x", "<", "hi")]):
        made.clear()
        joined = inequality.inequality_join(a, b, terms)
        want = a.join(b, F.expr(" and ".join(f"{x} {op} {y}" for x, op, y in terms)))
        assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, want.collect()))
        assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
        points, intervals = made
        searched = points.join(intervals.withColumnRenamed("count", "n"), "_part").agg(F.sum(F.col("count") * F.col("n"))).first()[0]
        assert searched < 0.5 * a.join(b, F.expr(" and ".join(f"{x} {op} {y}" for x, op, y in terms if x == "x"))).count() or piece == 40


def test_covered_pairs_copy_few_rows(spark, monkeypatch):
    """Rows are copied for the nodes of a tree and the blocks, not for each part that an interval covers."""
    made = inequality._nodes(F.col("first"), F.col("last"), 16)
    for first, last, nodes in spark.range(121).selectExpr("int(id div 11) first", "int(id % 11) last").where("first <= last").select("first", "last", made).collect():
        reached = [p for p in range(16) for level in range(5) if (p + 16) >> level in nodes]
        assert reached == list(range(first, last + 1)) and sum(k is not None for k in nodes) <= 6
    monkeypatch.setattr(inequality, "LEAST", 5)
    a, b = spark.range(4000).selectExpr("id i", "id x", "id % 97 u"), spark.range(600).selectExpr("id j", "id * 6 lo", "id % 89 v")
    copied, repartition = [], type(a).repartition
    count = lambda df: df.agg(F.sum(F.size(*(c for c in df.columns if c == "_rows"))) if "_rows" in df.columns else F.count(F.lit(1))).first()[0]
    monkeypatch.setattr(type(a), "repartition", lambda df, *k: (copied.append(0 if "points" in df.columns or "intervals" in df.columns else count(df)), repartition(df, *k))[1])
    for terms in ([("x", "<", "lo")], [("x", ">=", "lo"), ("u", ">", "v")]):
        copied.clear()
        got = inequality.inequality_join(a, b, terms).agg(F.count(F.lit(1)), F.sum(F.hash("i", "j"))).first()
        assert got == a.join(b, F.expr(" and ".join(f"{x} {op} {y}" for x, op, y in terms))).agg(F.count(F.lit(1)), F.sum(F.hash("i", "j"))).first()
        assert 0 < sum(copied) < 12 * 4600
