"""Words that 64-bit polynomial hashes take for one another: 1,024 letters and their mirror."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import decontamination, hmm, neardup
from tessera.llm.textkit import BY_SPACE, Words, byte_hash, same_bytes

ONE = "a"
while len(ONE) < 1024:
    ONE += ONE.translate(str.maketrans("ab", "ba"))
OTHER = ONE.translate(str.maketrans("ab", "ba"))


def test_hashes_differ():
    h = Words([f"{ONE} {OTHER} {ONE} {ONE[:512]} {OTHER[:512]} {ONE[:500]} {OTHER[:500]}".encode()], BY_SPACE).hashes()
    assert h[0] == h[2] and len(set(h.tolist())) == 6


@given(st.lists(st.binary(max_size=30), min_size=1, max_size=8))
@settings(max_examples=100, deadline=None)
def test_spans(parts):
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    h = byte_hash(data, starts, ends)
    first = np.array([parts.index(p) for p in parts])
    assert (h == h[first]).all() and len(set(h.tolist())) == len(set(parts))
    n = np.minimum(ends - starts, (ends - starts)[::-1])
    same = same_bytes(data, starts, data, starts[::-1], n)
    assert same.tolist() == [a[:k] == b[:k] for a, b, k in zip(parts, parts[::-1], n.tolist())]


def test_long_spans():
    a = np.zeros(3000, np.uint8)
    b = a.copy()
    b[2999] = 1
    at = np.array([0])
    assert same_bytes(a, at, a, at, np.array([3000]))[0] and not same_bytes(a, at, b, at, np.array([3000]))[0]


def test_item_words_of_one_hash(monkeypatch):
    """Bytes decide, whatever the hashes say."""
    monkeypatch.setattr(Words, "hashes", lambda self: np.zeros(len(self.starts), np.uint64))
    monkeypatch.setattr(decontamination, "byte_hash", lambda data, start, end: np.zeros(len(start), np.uint64))
    a = decontamination.Automaton([("1", b"red blue green"), ("2", b"red black")], 3)
    (_, _, hits), (_, _, none) = a.scan([b"x red blue green", b"red bluE gree black"])
    assert hits == [(4, 3, "1")] and none == []


def test_no_item_is_found_in_the_other_word(spark):
    docs = spark.createDataFrame([(1, ONE), (2, OTHER)], "doc_id bigint, text string")
    items = spark.createDataFrame([("i", ONE)], "item_id string, text string")
    assert {r.doc_id: r.n_hit for r in decontamination.scan(docs, items).collect()} == {1: 1, 2: 0}


def test_no_link_between_the_words(spark):
    docs = spark.createDataFrame([(1, f"{ONE} p q r"), (2, f"{OTHER} p q r"), (3, f"{ONE} P q  r")], "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, shingle=4, percent=80).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_the_other_word_is_unknown(spark):
    train = spark.createDataFrame([(f"{ONE} word",)] * 3, "text string")
    docs = spark.createDataFrame([(1, ONE), (2, OTHER)], "doc_id bigint, text string")
    got = {r.doc_id: r.n_known for r in hmm.score(docs, hmm.train(train)).collect()}
    assert got[1] - got[2] == 1
