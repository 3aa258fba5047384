"""Bucket joins against brute force over codes and probes."""

import numpy as np
import pytest

from tessera.operators import buckets, knn


@pytest.fixture(scope="module")
def base(spark):
    x = np.random.default_rng(2).standard_normal((400, 12)).astype("float32")
    x[100:300] = x[100]  # one bucket has half of all rows
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>").repartition(5)


def met(family, x, asked, probes):
    """Which rows each query meets, table by table."""
    made = family.matrix()
    codes, probed = family.codes(x.astype(float), made), family.probes(x[asked].astype(float), made, probes)
    return [np.flatnonzero([any(codes[i, t] in probed[j, t] for t in range(family.tables)) for i in range(len(x))]) for j in range(len(asked))]


@pytest.mark.parametrize("family", [buckets.Family(12, 3, 16), buckets.Family(12, 8, 16, 4), buckets.Family(12, 1, 4)])
def test_search_compares_what_meets_once(spark, base, family, monkeypatch):
    x, df = base
    monkeypatch.setattr(buckets, "PIECE", 16)  # many pieces, also of the hot bucket
    asked = [0, 7, 50, 100, 150, 399]
    index = buckets.build(df, family)
    got = buckets.search_batch(spark, index, df.where(df.vec_id.isin(asked)), 10, 3).toPandas()
    for q, rows in zip(asked, met(family, x, asked, 3)):
        own = got[got.query_id == q].sort_values("rank")
        d = np.sqrt(((x[rows].astype(float) - x[q].astype(float)) ** 2).sum(1))
        want = rows[np.lexsort((rows, d))[:10]]
        assert own.id.tolist() == want.tolist() and (own.compared == len(rows)).all()


def test_probes_reach_recall_and_no_fewer_do(spark, base):
    x, df = base
    asked = df.where("vec_id % 20 = 0")
    index = buckets.build(df, buckets.Family(12, 4, 32))
    exact = knn.knn_batch(df, asked, 10)
    probes, share = buckets.probes_for(spark, index, asked, exact)
    found = [knn.recall(buckets.search_batch(spark, index, asked, 10, p), exact).first()[0] for p in (probes, probes - 1) if p]
    assert found[0] == pytest.approx(share) and share >= 0.9 and all(f < 0.9 for f in found[1:])


def test_awkward(spark, base):
    _, df = base
    index = buckets.build(df.where("false"), buckets.Family(12, 2, 8))
    assert buckets.search_batch(spark, index, df, 5, 2).count() == 0
    buckets.append(spark.createDataFrame([(1, [0.0] * 12), (2, None), (3, [1.0])], df.schema), index)
    assert index.rows(spark).count() == 1  # vectors of no or another dimension are in no bucket
    assert buckets.search_batch(spark, index, df.where("false"), 5, 2).count() == 0
    exact = knn.knn_batch(df.where("false"), df.where("vec_id < 3"))
    assert buckets.probes_for(spark, index, df, exact) == (8, 0.0)


def test_plan_has_no_product(spark, base):
    _, df = base
    index = buckets.build(df, buckets.Family(12, 2, 8))
    plan = buckets.search_batch(spark, index, df.where("vec_id < 9"), 5, 2)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
