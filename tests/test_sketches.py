"""Histograms from one pass: borders, frequent values, estimates, merging and awkward columns."""

import numpy as np
import pytest

from tessera.operators import sketches, statistics
from tessera.operators.predicates import Constant, Name, Predicate, Term
from tessera.plans.engine import Engine


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), float(x), 7 if i % 3 == 0 else int(i) % 1000, None if i % 2 else float("nan"), "t") for i, x in enumerate(rng.exponential(10, 30_000))]
    return spark.createDataFrame(rows, "i bigint, x double, hot int, gone double, s string").repartition(7)


def test_borders_have_their_ranks(table):
    made = sketches.one_pass(table)
    assert set(made) == {"i", "x", "hot", "gone"} and made["gone"] == []
    for c in ("i", "x", "hot"):
        values, below = np.sort([r[0] for r in table.select(c).collect()]), 0.0
        assert sum(b.frequency for b in made[c]) == pytest.approx(len(values))
        for e in sorted({b.range.high for b in made[c]}):
            below = sum(b.frequency for b in made[c] if b.range.high <= e)
            assert abs(below - np.searchsorted(values, e, "right")) <= 0.01 * len(values)
        assert made[c][-1].range.high == values[-1] and min(b.range.low for b in made[c]) == values[0]


def test_frequent_values_have_buckets_of_their_own(table):
    hot = sketches.one_pass(table, ["hot"])["hot"]
    seven = next(b for b in hot if b.range.low == b.range.high == 7)
    assert abs(seven.frequency - 10_020) <= 30 and seven.distinct == 1
    assert abs(sum(b.distinct for b in hot) - 1000) < 60
    few = sketches.one_pass(table.selectExpr("i % 4 k"), ["k"])["k"]
    assert [(b.range.low, b.frequency) for b in few] == [(k, 7500.0) for k in range(4)]


def test_estimates(table):
    made = sketches.one_pass(table)
    for c, op, v in (("x", "<", 5.0), ("i", ">=", 20_000), ("hot", "=", 7), ("hot", "<", 500)):
        p = Predicate((Term(Name(c), op, Constant(v)),))
        assert abs(statistics.predicate_selectivity(made, p) - table.where(p.column()).count() / 30_000) < 0.02


def test_merged_states_are_those_of_the_whole(table):
    parts = [sketches.states(table.where(f"i % 3 = {k}"), ["i", "hot"]) for k in range(3)]
    whole = sketches.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]), 2)
    fields = [table.schema[c] for c in ("i", "hot")]
    a, b = sketches.histograms(sketches.held(whole), fields), sketches.one_pass(table, ["i", "hot"])
    assert whole.first().n == 30_000
    for c in ("i", "hot"):
        assert max(abs(x.range.high - y.range.high) for x, y in zip(a[c], b[c])) <= (600 if c == "i" else 20)


def test_empty_dates_and_one_value(spark, table):
    assert sketches.one_pass(table.where("i < 0"), ["i", "x"]) == {"i": [], "x": []}
    assert sketches.one_pass(table.select("s")) == {}
    df = spark.sql("select date'2020-01-01' + cast(id as int) d, timestamp'2020-01-01 00:00:00' t, true b from range(100)")
    zeros = sketches.one_pass(spark.createDataFrame([(0.0,), (-0.0,), (float("inf"),)], "z double"))["z"]
    assert [(b.range.low, b.frequency) for b in zeros] == [(0.0, 2.0), (float("inf"), 1.0)]
    made = sketches.one_pass(df)
    assert made["d"][-1].range.high - made["d"][0].range.low == 99
    assert [(b.range.low, b.frequency) for b in made["t"]] == [(1577836800.0, 100.0)] and [(b.range.low, b.frequency) for b in made["b"]] == [(1.0, 100.0)]


def test_values_are_not_shuffled(table):
    plan = sketches.states(table.select("i"), ["i"])._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate(keys=[_group" in plan or "partial_kll_sketch_agg_double" in plan
    # the only exchanges are of states: by group, and of the groups' states
    assert plan.count("partial_kll_sketch_agg_double") == 1 and plan.count("partial_kll_merge_agg_double") == 1


def test_statistics_follow_inserts_by_merging(spark, monkeypatch):
    e = Engine(spark)
    e.execute("create table t (i int, s varchar(9))")
    e.insert("t", spark.range(1000).selectExpr("cast(id as int) i", "'x' s"))
    p = Predicate((Term(Name("i"), "<", Constant(500)),))
    assert e.statistics.rows("t", p) == pytest.approx(500, abs=20)
    monkeypatch.setattr(e.statistics, "table", lambda name: pytest.fail("the table was read again"))
    e.insert("t", spark.range(1000).selectExpr("cast(id % 500 as int) i", "'y' s"))
    assert e.statistics.rows("t", p) == pytest.approx(1500, abs=40)
    monkeypatch.undo()
    e.execute("delete from t where i < 500")
    assert e.statistics.rows("t", p) == pytest.approx(0, abs=10)
