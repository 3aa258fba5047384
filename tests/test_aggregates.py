"""Merged aggregates against NumPy, and how many rows reach a merge."""

import numpy as np
import pandas as pd
import pytest

from tessera.operators import aggregates, relational


class Longest(aggregates.Mergeable):
    """The longest text, of equally long ones the least; its state is the text itself."""

    from pyspark.sql.types import StringType

    returns = StringType()

    def init(self):
        return None

    def update(self, state, values):
        for v in values.to_pylist():
            state = self.merge(state, v)
        return state

    def merge(self, a, b):
        return min((x for x in (a, b) if x is not None), key=lambda x: (-len(x), x), default=None)

    def finish(self, state):
        return state


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(1)
    data = [(None if i % 11 == 0 else int(i % 3), ["x", None, "y"][i % 3] if i % 2 else "z", None if i % 7 == 0 else float(r.normal(1e6, 1)), "w" * int(r.integers(0, 9))) for i in range(900)]
    return data, spark.createDataFrame(data, "g int, h string, v double, t string").repartition(7)


def test_groups(spark, rows, monkeypatch):
    data, df = rows
    monkeypatch.setattr(aggregates, "GROUPS", 2)  # states leave early
    monkeypatch.setattr(aggregates, "SPREAD", 2)
    got = {(r.g, r.h): r for r in aggregates.aggregate(df, ["g", "h"], [("var", aggregates.Variance(), "v"), ("ext", aggregates.Extent(), "v"), ("long", Longest(), "t")]).collect()}
    keys = {(g, h) for g, h, _, _ in data}
    assert set(got) == keys
    for key in keys:
        v = np.array([x[2] for x in data if x[:2] == key and x[2] is not None])
        t = [x[3] for x in data if x[:2] == key]
        assert got[key].var == pytest.approx(v.var(), rel=1e-9) and got[key].ext == pytest.approx(np.ptp(v)) and got[key].long == max(t, key=len)


def test_one_group_is_merged_from_a_state_a_task(spark, rows):
    data, df = rows
    v = np.array([x[2] for x in data if x[2] is not None])
    made = aggregates.aggregate(df, [], [("var", aggregates.Variance(), "v")])
    assert made.first().var == pytest.approx(v.var(), rel=1e-9)
    seen = spark.sparkContext.accumulator(0)

    class Counted(aggregates.Variance):
        def load(self, data):
            seen.add(1)
            return super().load(data)

    assert aggregates.aggregate(df, [], [("var", Counted(), "v")]).first().var == pytest.approx(v.var(), rel=1e-9)
    assert seen.value <= 7 + 1  # a state of each of seven tasks, and the one they became


def test_empty_and_null(spark, rows):
    _, df = rows
    nothing = df.where("false")
    assert aggregates.aggregate(nothing, [], [("var", aggregates.Variance(), "v"), ("long", Longest(), "t")]).collect() == [(None, None)]
    assert aggregates.aggregate(nothing, ["g"], [("var", aggregates.Variance(), "v")]).collect() == []
    nulls = spark.createDataFrame([(1, None), (1, None)], "g int, v double")
    assert aggregates.aggregate(nulls, ["g"], [("ext", aggregates.Extent(), "v")]).collect() == [(1, None)]
    zeros = spark.createDataFrame([(0.0, 1.0), (-0.0, 3.0), (float("nan"), 1.0), (float("nan"), 2.0)], "g double, v double")
    got = aggregates.aggregate(zeros, ["g"], [("ext", aggregates.Extent(), "v")]).collect()
    assert sorted(r.ext for r in got) == [1.0, 2.0]


def test_beside_others(spark, rows):
    data, df = rows
    for name, made in (("variance", aggregates.Variance()), ("extent", aggregates.Extent())):
        if name not in relational.AGGREGATES:
            relational.register_mergeable(name, f"{name}of", made)
    got = relational.group_by(df, ["g"], [("count", "v"), ("extent", "v"), ("max", "t")])
    assert got.columns == ["g", "countofv", "extentofv", "maxoft"] and {r.g: r.countofv for r in got.collect()} == {g: sum(x[0] == g and x[2] is not None for x in data) for g in (None, 0, 1, 2)}
    assert relational.group_by(df.where("false"), [], [("extent", "v"), ("count", "v")]).collect() == [(None, 0)]
    assert relational.group_by(df.where("false"), [], [("extent", "v"), ("count", "v")], strict_empty=True).collect() == []


def test_pandas_function_by_parts(spark):
    """A user's pandas function with a way to combine sees parts of a group, and no task a whole one."""
    from pyspark.sql import functions as F

    from tessera import client
    from tessera.plans.engine import Engine

    most = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def cubes(v: pd.Series) -> float:
        most.add(len(v) > 600)
        return float((v**3).sum())

    e = Engine(spark)
    e.register("t", spark.range(0, 4000, 1, 8).selectExpr("cast(id % 2 as int) g", "case when id % 5 > 0 and id < 3999 then cast(id % 7 as double) end v"))
    e.register("none", spark.range(1).selectExpr("cast(id as int) g", "cast(null as double) v"))
    client.register_function(e, "cubes", cubes, "cubesof", lambda a, b: a + b)
    got = {r.g: r.cubesofv for r in e.sql("select g, cubes(v) from t group by g").collect()}
    want = {g: float(sum((i % 7) ** 3 for i in range(3999) if i % 5 and i % 2 == g)) for g in (0, 1)}
    assert got == want and most.value == 0
    assert [r.cubesofv for r in e.sql("select g, cubes(v) from none group by g").collect()] == [None]
