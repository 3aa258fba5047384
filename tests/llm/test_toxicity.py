"""Toxic passages: the scan against its definition, the model against plain counts, held-out labels."""

import math
import re
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import queries, toxicity
from tessera.llm.textkit import HashTable

DATA = Path("/root/testdata/sf0.01")


def defined(score):
    """All maximal scoring segments by their definition: the best of what is left, first and shortest, then both sides of it."""
    if not any(s > 0 for s in score):
        return []
    total = np.concatenate([[0], np.cumsum(score)])
    best = max(((total[b] - total[a], -(b - a), -a) for a in range(len(score)) for b in range(a + 1, len(score) + 1)))
    a = -best[2]
    b = a - best[1]
    right = [(s, x + b, y + b) for s, x, y in defined(score[b:])]
    return [*defined(score[:a]), (float(best[0]), a, b), *right]


@given(st.lists(st.integers(-5, 6), max_size=25))
@settings(max_examples=200, deadline=None)
def test_maximal_segments(score):
    score = [s + 0.001 * ((7 * i * i) % 13) for i, s in enumerate(score)]  # no ties
    total = np.concatenate([[0], np.cumsum(score)])
    positive = [i for i, s in enumerate(score) if s > 0]
    got = [(s, positive[x], positive[y] + 1) for s, x, y in toxicity.maximal_segments([total[i] for i in positive], [total[i + 1] for i in positive])]
    want = defined(score)
    assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in want] and np.allclose([s for s, *_ in got], [s for s, *_ in want])


CLEAN = ["the cat sat on the mat", "a dog ran over the hill", "the hill is far", "cats and dogs are friends", "a mat on the hill", "nothing to see over there"] * 6
TOXIC = ["you are a vilefool and the mat", "the vilefool and a vilebeast sat", "vilefool vilefool on the hill", "a vilebeast ran"] * 5


def labelled(spark):
    return spark.createDataFrame([(t, 0) for t in CLEAN] + [(t, 1) for t in TOXIC] + [(None, 0), ("", 0), ("who", 7), ("what", None)], "text string, label int").repartition(3)


def plain_score(word, docs, root, prior=3.0, drift=0.3):
    """The chain by sets of documents."""
    split = [(set(re.findall(r"[a-z]+", t)), y) for t, y in docs]
    nodes = [word[:k] for k in toxicity.PREFIXES if len(word) > k]
    having = [[i for i, (ws, _) in enumerate(split) if any(w[: len(p)] == p and len(w) > len(p) for w in ws)] for p in nodes] + [[i for i, (ws, _) in enumerate(split) if word in ws]]
    having = [h if len(h) >= 2 else [] for h in having]
    rate, a, b = root, prior * root, prior * (1 - root)
    for k, own in enumerate(having):
        counts = [sum(split[i][1] == y for i in own) for y in (0, 1)]
        if k + 1 < len(having):
            counts = [max(c - sum(split[i][1] == y for i in having[k + 1]), 0) for y, c in enumerate(counts)]
        a, b = counts[1] + prior * rate, counts[0] + prior * (1 - rate)
        rate = min(max(a / (a + b), 1e-9), 1 - 1e-9)
    odds = math.log(rate / (1 - rate)) - math.log(root / (1 - root))
    return math.copysign(max(abs(odds) - math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)), 0), odds) - drift


def test_scores_of_words(spark):
    model = toxicity.fit(labelled(spark))
    docs = [(t, 0) for t in CLEAN] + [(t, 1) for t in TOXIC] + [("", 0)] * 2
    root = len(TOXIC) / len(docs)
    assert abs(model.lexicon.root - root) < 1e-12
    find = HashTable(model.lexicon.keys)
    for word in ("vilefool", "vilebeast", "vilething", "the", "cat", "unseen", "hill"):
        words = toxicity.Words([word.encode()], toxicity.BY_ALNUM)
        got = model.lexicon.scores(words, np.array([0]), find)[0]
        assert abs(got - plain_score(word, docs, root)) < 1e-9, word
    # with a document's own counts out, the others' remain
    got = model.lexicon.scores(toxicity.Words([b"vilefool"], toxicity.BY_ALNUM), np.array([0]), find, 1)[0]
    assert got < model.lexicon.scores(toxicity.Words([b"vilefool"], toxicity.BY_ALNUM), np.array([0]), find)[0]


def test_passages(spark):
    model = toxicity.fit(labelled(spark))
    rows = [(1, "the cat sat on the mat", 0), (2, "over the hill see vilefool vilebeast there to see", 0), (2, "over the hill see vilefool vilebeast there to see", 1), (3, None, 0), (4, "", 0), (None, "!! -- ..", 0), (5, "vilefool " * 100_000, 0), (6, "the cat " * 100_000, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score int").repartition(3)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert set(got) == {1, 2, 3, 4, None, 5, 6} and toxicity.score(df, model).count() == 8
    (p,) = got[2].passages
    assert p.text == "vilefool vilebeast" and (p.start, p.stop) == (4, 6) and p.e_value <= model.tail.significance
    assert got[2].score > 0.7 > got[1].score and got[1].passages == [] and got[6].passages == []
    assert got[3].score == got[4].score == got[None].score and got[3].n_words == 0
    assert len(got[5].passages) == 1 and got[5].passages[0].score < 2 * p.score  # repeats are no new evidence
    assert toxicity.score(df.where("false"), model).collect() == []


@pytest.mark.parametrize("keep, want", [("label = 0", 0.0), ("label = 1", 1.0), ("false", 0.5)])
def test_one_class(spark, keep, want):
    model = toxicity.fit(labelled(spark).where(keep))
    df = spark.createDataFrame([(1, "vilefool"), (2, None)], "doc_id bigint, text string")
    assert [r.score for r in toxicity.score(df, model).collect()] == [want, want]


def test_fewer_nodes(spark):
    model = toxicity.fit(labelled(spark), size=5)
    assert len(model.lexicon.keys) <= 5


def test_held_out(spark):
    import duckdb

    got = queries.op13_maximum_segments(spark, str(DATA)).toPandas()  # noqa: F841
    docs = duckdb.sql(f"select count(*) from '{DATA}/documents.parquet'").fetchall()[0][0]
    assert len(got) == docs and got.score.between(0, 1).all() and set(got.predicted) <= {0, 1}
    rows = duckdb.sql(f"select predicted, toxic, count(*) from got join '{DATA}/labels.parquet' using (doc_id) join '{DATA}/documents.parquet' d using (doc_id) where held_out and lang = 'en' group by all").fetchall()
    n = {(p, t): c for p, t, c in rows}
    assert n.get((1, 1), 0) >= 0.85 * (n.get((1, 1), 0) + n.get((0, 1), 0)) and n.get((1, 0), 0) <= 0.02 * n[(0, 0)]
