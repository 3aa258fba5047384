"""Whitening against fractions and plain NumPy."""

from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest

from tessera.llm import queries, whitening

DATA = Path("/root/testdata/sf0.001")


def plain(vectors):
    """x, exact deviations, and components of the covariance by NumPy over fractions' means."""
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, total = len(x), [int(v) for v in x.sum(0)]
    deviation = [sum((n * int(v) - s) ** 2 for v, s in zip(row, total)) for row in x]
    mean = [Fraction(s, n) for s in total]
    z = np.array([[float(int(v) - m) for v, m in zip(row, mean)] for row in x])
    cov = z.T @ z / n
    values, basis = np.linalg.eigh(cov)
    return deviation, z, values[::-1], basis[:, ::-1], cov


def test_query(spark):
    import duckdb

    rows = duckdb.sql(f"select vec_id, embedding from '{DATA}/embeddings.parquet' order by vec_id").fetchall()
    deviation, z, values, basis, cov = plain([v for _, v in rows])
    got = queries.op12_covariance_whitening(spark, str(DATA)).toPandas()
    assert len(got) == 32 * len(rows) and (got.n == len(rows)).all() and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    wide = got.pivot(index="vec_id", columns="component", values="whitened")
    assert list(wide.columns) == list(range(1, 33))
    want = z @ basis[:, :32] / np.sqrt(values[:32])
    signs = np.sign((want * wide.to_numpy()).sum(0))
    assert np.allclose(want * signs, wide.to_numpy(), atol=1e-6)
    assert np.allclose(got.groupby("component").explained.first(), values[:32] / np.trace(cov), rtol=1e-10)
    assert got.groupby("vec_id").deviation.first().tolist() == deviation


def test_same_in_any_partitions(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    a, b = whitening.fit(df.repartition(1)), whitening.fit(df.repartition(7))
    assert a.sums == b.sums and (a.weights == b.weights).all() and (a.values == b.values).all()


def table(spark, rows, schema="vec_id bigint, embedding array<float>, component int"):
    return spark.createDataFrame([(*r, 1) for r in rows], schema).repartition(3)


def test_awkward_rows(spark):
    good = [(i, [float(i % 5), float(i * i % 7), 1.0 / (i + 1)]) for i in range(30)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [1.0, float("inf"), 2.0]), (104, []), (105, [1.0, 2.0]), (106, [1e30, 2.0, 3.0])]
    df = table(spark, [*good, *bad, (None, good[3][1]), good[4]])
    model = whitening.fit(df)
    assert model.n == 32 and model.dimensions == 3
    deviation, z, values, basis, _ = plain([v for _, v in [*good, good[3], good[4]]])
    assert np.allclose(model.values, values)
    rows = whitening.transform(df, model).collect()
    assert sorted((r.vec_id if r.vec_id is not None else -1) for r in rows) == sorted([*range(30), -1, 4])
    assert {r.vec_id: r.deviation for r in rows} == {**dict(enumerate(deviation[:30])), None: deviation[30]}
    assert whitening.identity_error(df, model) < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows, tmp_path):
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.op12_covariance_whitening(spark, str(tmp_path)).collect() == []


def test_fewer_directions_than_dimensions(spark):
    df = table(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)])
    model = whitening.fit(df)
    assert len(model.values) == 1 and abs(model.explained[0] - 1) < 1e-12 and whitening.identity_error(df, model) < 1e-9


def test_deviations_beyond_a_long():
    model = whitening.Whitener(whitening.Scale(), 10**9, [10**15], np.ones(1), np.ones(1), np.ones((1, 1)))
    assert model.deviations(np.array([[10**6], [10**6 + 1], [10**6 + 5]])) == [0, 10**18, None]


def test_large_numbers_sum_exactly(spark):
    df = table(spark, [(i, [2.0**54 + 2.0**32 * i]) for i in range(50)], "vec_id bigint, embedding array<double>, x int")
    model = whitening.fit(df)
    assert model.sums == [sum(64 * (2**54 + 2**32 * i) + 1_000_000 for i in range(50))]
