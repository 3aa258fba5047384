"""Neighbours as of places in a history against sorting what each question sees."""

import numpy as np
import pytest

from tessera.operators import history


@pytest.mark.parametrize("slice_", [50_000, 20])
def test_as_of(spark, monkeypatch, slice_):
    monkeypatch.setattr(history, "SLICE", slice_)
    monkeypatch.setattr(history, "ROWS", 8)
    monkeypatch.setattr(history, "QUERIES", 3)
    r = np.random.default_rng(8)
    x = r.standard_normal((200, 5)).astype("float32")
    x[20:60] = x[20]
    seq = [int(s) for s in r.integers(-5, 40, 200)]
    seq[50:120] = [17] * 70  # a hot place
    rows = spark.createDataFrame([(i, v.tolist(), s) for i, (v, s) in enumerate(zip(x, seq))] + [(900, x[0].tolist(), None), (901, None, 3)], "vec_id bigint, embedding array<float>, seq int").repartition(4)
    asked = [(q, s) for q in (0, 20, 199) for s in (-9, -5, 0, 16, 17, 39, 100)]
    ask = spark.createDataFrame([(q, x[q].tolist(), s) for q, s in asked] + [(5, x[5].tolist(), None), (0, x[0].tolist(), 17)], "query_id bigint, embedding array<float>, seq bigint")
    got = {}
    for g in history.knn_as_of(rows, ask, 7).collect():
        got.setdefault((g.query_id, g.seq), {})[g["rank"]] = g.id
    for q, s in asked:
        seen = [i for i in range(200) if seq[i] <= s]
        d = np.sqrt(((x[seen].astype(float) - x[q].astype(float)) ** 2).sum(1)) if seen else []
        want = [seen[i] for i in np.lexsort((seen, d))[:7]] if seen else []
        assert [got.get((q, s), {})[r] for r in sorted(got.get((q, s), {}))] == want
    assert (5, None) not in got
    found = history.knn_as_of(rows, ask, 7)
    assert {r.recall for r in history.recall_as_of(found, rows, ask, 7).collect()} == {1.0}
    assert {r.recall for r in history.recall_as_of(found.where("false"), rows, ask, 7).collect()} == {0.0}
    assert history.knn_as_of(rows.where("false"), ask, 7).collect() == history.knn_as_of(rows, ask.where("false"), 7).collect() == []
