"""Runs of periodic words against comparing every place for every period."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import periodic, queries

unit = st.lists(st.integers(0, 2), min_size=1, max_size=7)
text_ = st.one_of(st.lists(st.integers(0, 3), max_size=40), st.tuples(st.lists(st.integers(0, 2), max_size=5), unit, st.integers(0, 60), st.lists(st.integers(0, 2), max_size=5)).map(lambda t: t[0] + (t[1] * 60)[: t[2]] + t[3]))


def brute(ids, least=6, exponent=4):
    out, n = [], len(ids)
    for p in range(1, n):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and ids[i] == ids[i + p]:
                i += 1
            if i > s and i + p - s >= max(least, exponent * p):
                own = ids[s : i + p]
                if all(any(own[k] != own[k + q] for k in range(len(own) - q)) for q in range(1, p)):
                    out.append((s, len(own), p))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs(texts, **kw):
    ids = np.array([x for t in texts for x in t], np.int64)
    return [[tuple(r) for r in x.tolist()] for x in periodic.runs_of(ids, np.cumsum([0, *map(len, texts)]), **kw)]


@given(st.lists(text_, max_size=4))
@settings(max_examples=150, deadline=None)
def test_runs(texts):
    assert runs(texts) == [brute(t) for t in texts]


@given(st.lists(text_, max_size=3), st.integers(2, 7), st.integers(2, 5))
@settings(max_examples=80, deadline=None)
def test_other_bounds(texts, least, exponent):
    assert runs(texts, least=least, exponent=exponent) == [brute(t, least, exponent) for t in texts]


@given(text_)
@settings(max_examples=60, deadline=None)
def test_plain_way(text):
    assert [tuple(r) for r in periodic._plain(np.array(text, np.int64), 6, 4).tolist()] == brute(text)


def test_small_pieces_of_the_grid(monkeypatch):
    monkeypatch.setattr(periodic, "PAIRS", 5)
    texts = [[0, 1] * 9, [], [2] * 30, [0, 1, 2, 3] * 5 + [1]]
    assert runs(texts) == [brute(t) for t in texts]


def test_equal_hashes_of_different_words(monkeypatch):
    """Sums that never differ make every stretch too long; comparing words finds that out."""
    monkeypatch.setattr(periodic.Extensions, "_same", lambda self, start, size, period: np.ones(len(start), bool))
    texts = [[0, 1] * 9 + [2, 3, 4, 5, 6, 7, 8, 9], [5] * 8, [0, 1, 2, 3] * 5 + [1]]
    assert runs(texts) == [brute(t) for t in texts]


def test_words_that_polynomials_confuse():
    a = b"a"
    while len(a) < 1024:
        a += a.translate(bytes.maketrans(b"ab", b"ba"))
    b = a.translate(bytes.maketrans(b"ab", b"ba"))
    (words, found), *_ = periodic.found_in([b" ".join([a, b] * 3 + [a] * 7)], 6, 4)
    assert [tuple(r) for r in found.tolist()] == [(6, 7, 1)] or brute([w == a for w in words]) == [tuple(r) for r in found.tolist()]


def test_table(spark):
    rows = [(1, "a b a b a b a b c", 0), (1, "a b a b a b a b c", 1), (2, None, 0), (3, "", 0), (4, " \t\n", 0), (None, "x x x x x x", 0), (5, "É é É é É é É é É", 0), (6, "word " * 200_000, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, runs int").repartition(3)
    got = sorted(((r.doc_id or -1, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(df).collect()))
    assert got == sorted(
        [(1, [(0, 8, 2)], "a b c"), (1, [(0, 8, 2)], "a b c"), (2, [], ""), (3, [], ""), (4, [], ""), (-1, [(0, 6, 1)], "x"), (5, [(0, 9, 2)], "É é"), (6, [(0, 200_000, 1)], "word")]
    )
    assert periodic.periodic_runs(df.where("false")).collect() == []


@pytest.mark.parametrize("runs_, want", [([], None), ([(0, 8, 2), (9, 4, 1), (20, 12, 3)], (0, 8, 2)), ([(0, 9, 2), (9, 5, 1)], (9, 5, 1))])
def test_best(spark, runs_, want):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(runs_,)], f"r array<{periodic.RUN_TYPE}>")
    got = df.select(periodic.best(F.col("r")).alias("b")).first().b
    assert (tuple(got) if got else None) == want


def test_tail():
    import zlib

    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    for d in ids[:10]:
        a, p = periodic.repeated_tail(d, 100)
        g = zlib.crc32(str(d).encode()) // 10
        assert a == g % 100 and p == 1 + (100 - a) // (3 + g % 8)
    assert periodic.repeated_tail(None, 9) == (9, 1) and periodic.repeated_tail(ids[0], 0) == (0, 1)
    assert "op11_harmonic_grid" in queries.oracle_sql()
