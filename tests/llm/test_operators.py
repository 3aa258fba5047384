"""Operators on small tables against plain versions, with the awkward cases."""

import collections
import hashlib
import json
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, cluster, decontamination, fingerprint, hmm, html, neardup, packing, quality, sharding, suffixdup

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3000
DOCS = [
    (1, "The quick brown fox jumps over the lazy dog again and again today", "en", "s"), (2, "the QUICK brown fox jumps over the lazy dog again and again today", "en", "s"), (3, None, None, None), (4, "", "en", "s"), (5, "  \n ", "en", "s"),
    (6, LONG, "en", "s"), (7, "été Straße", "fr", "s"), (8, "été  STRASSE", "fr", "s"), (9, "one", "en", "s"), (10, "one", "en", "s"), (10, "one", "en", "s"), (None, "lost words here", "en", "s"), (11, "\U0001f600 smile", "en", "s"),
]


@pytest.fixture(scope="module")
def docs(spark):
    # names that clash with those operators use inside
    df = spark.createDataFrame(DOCS, "doc_id bigint, text string, lang string, source string")
    return df.withColumns({c: F.lit(7) for c in ("d", "k", "n", "key", "node", "shard", "_range", "label", "row", "start", "hash", "x", "component", "size")}).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def rows(df, key="doc_id"):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r[key]].append(r)
    return out


def test_hmm(docs, none):
    train = docs.where("doc_id <> 9 or doc_id is null")
    m = hmm.train(train, states=3, head=6)
    got = hmm.score(docs, m)
    far = hmm.score(docs, m, broadcast_words=0)
    counts = collections.Counter(w for i, t, *_ in DOCS if i != 9 for w in [*(t or "").encode().lower().split(), "end"])
    total, v = sum(counts.values()), len(counts)
    assert (m.lexicon.total, m.lexicon.distinct) == (total, v)
    a, b = rows(got), rows(far)
    for i, t, *_ in DOCS:
        ws = [*(t or "").encode().lower().split(), "end"]
        r = a[i][0]
        assert (r.n_tokens, r.n_known) == (len(ws), sum(counts[w] > 0 for w in ws))
        assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 0.1) / (total + 0.1 * (v + 1))) for w in ws))
        assert len(a[i]) == len(b[i]) == sum(x[0] == i for x in DOCS)
        assert (b[i][0].n_known, b[i][0].base_score, b[i][0].score) == pytest.approx((r.n_known, r.base_score, r.score))
    assert hmm.score(none, m).count() == 0
    nothing = hmm.score(docs, hmm.train(none, states=2, head=4))
    assert nothing.count() == len(DOCS) and nothing.where("isnan(score) or n_known > 0").count() == 0


def test_hmm_is_a_distribution(spark):
    texts = ["a b a c", "b b d", "a e f g h", "c c c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    m = hmm.train(df, states=2, head=3)
    # all one-word texts and the unknown word of each class, plus the end alone: at most 1
    words = sorted({w for t in texts for w in t.split()})
    one = hmm.score(spark.createDataFrame([(i, w) for i, w in enumerate([*words, ""])], "doc_id bigint, text string"), m)
    assert one.agg(F.sum(F.pow(F.lit(10.0), "score"))).first()[0] < 1


def test_hmm_converges_on_all_texts(spark):
    rng = np.random.default_rng(5)
    # a rare language beside a common one
    texts = [" ".join(f"{'r' if i % 25 == 0 else 'c'}{w}" for w in rng.zipf(1.5, 30) % 40) for i in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").cache()
    m = hmm.train(df, states=4, head=200, passes=30)
    sequences = hmm.encoded(df, m.lexicon)
    more = hmm.Hmm.estimate(*hmm.expected_counts(sequences, m.lexicon, m.model)[:3], m.lexicon.unigram(), 0.1)
    was, now = (hmm.score(df, hmm.Trained(m.lexicon, x, m.words)).agg(F.sum("score")).first()[0] for x in (m.model, more))
    assert now - was <= 2e-3 * abs(was)
    assert hmm.expected_counts(sequences, m.lexicon, m.model)[3] == pytest.approx(was * np.log(10), rel=1e-4)


def test_hmm_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(5)
    topics = [[f"{chr(97 + t)}{i}" for i in range(60)] for t in range(4)]
    texts = [(i, " ".join(rng.choice(topics[i % 4], int(rng.integers(1, 60))))) for i in range(1500)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    some, other = ({r.doc_id: r.score for r in hmm.score(df, hmm.train(df.repartition(n), states=5, head=150)).collect()} for n in (3, 7))
    assert max(abs(some[i] - other[i]) for i in some) < 1e-3


def test_fingerprints(docs, none):
    got = {(r.doc_id): r.fingerprint for r in fingerprint.fingerprints(docs).collect()}
    assert got[1] == got[2] and got[3] == got[4] == got[5] and got[7] == got[8] and got[9] == got[10]
    assert len(set(got.values())) == 7
    assert fingerprint.fingerprints(none).count() == 0 and fingerprint.edits(none).count() == 0


def test_clashing_buckets(spark):
    df = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", "a"), ("l", "c")], "key string, canon string")
    found = fingerprint.clashes(df)
    assert [tuple(r) for r in found.collect()] == [("k", "b", 1)]
    assert sorted(r.key for r in fingerprint.numbered(df, found, {"key": "canon"}).collect()) == ["k", "k", "k-1", "l"]


@pytest.mark.parametrize("ranges", [1, 2, 7, 50])
def test_neighbours(spark, ranges):
    ids = [1, 2, 3, 50, 51, 52, 53, 1000, 10**12]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id bigint, text string")
    got = {r.doc_id: r.next_text for r in fingerprint.neighbours(df, "doc_id", ["text"], ranges).collect()}
    down = sorted(ids, reverse=True)
    assert got == {a: f"t{b}" for a, b in zip(down, down[1:] + down[:1])}


def test_edits(spark):
    texts = {1: "abcdef", 2: "xy", 3: None, 9: "éééé\U0001f600q"}
    got = rows(fingerprint.edits(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")))
    down = sorted(texts, reverse=True)
    for a, b in zip(down, down[1:] + down[:1]):
        t, u = texts[a] or "", texts[b] or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + u[:n]
        r = got[a][0]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == float(edited == t)


def test_sharding(docs, none):
    got = sharding.by_text(docs, 4).collect()
    assert len(got) == len(DOCS) and sharding.by_text(none, 4).count() == 0
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    groups = collections.defaultdict(set)
    for r in got:
        groups[r.text_crc32].add(r.shard)
        text = next(t for i, t, *_ in DOCS if i == r.doc_id) or ""
        assert r.size == len(text.encode()) + 1 and r.text_crc32 == zlib.crc32(text.encode())
    assert all(len(g) == 1 for g in groups.values())


def test_sharding_balances(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    same_text = sharding.by_text(df, 8).groupBy("shard").agg(F.sum("size")).collect()
    assert max(r[1] for r in same_text) < 1.1 * min(r[1] for r in same_text)
    other = df.withColumn("text", F.concat("text", F.col("doc_id").cast("string")))
    loads = [r[1] for r in sharding.by_text(other, 8, bundles=256).groupBy("shard").agg(F.sum("size")).collect()]
    assert max(loads) < 1.02 * min(loads)


def test_html(spark):
    pages = [(i, f"https://h.example/{i}", f"<nav>n</nav><article><h1>T{i}</h1><p>body {i}</article>") for i in range(300)] + [(None, None, None), (7, "x", ""), (7, "x", "")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("host", F.lit(1)).withColumn("salt", F.lit(2))
    got = rows(html.main_texts(df, set_size=16), "page_id")
    assert sum(map(len, got.values())) == len(pages)
    assert got[5][0].text == "T5\n\nbody 5" and got[5][0].n_chars == len("T5\n\nbody 5") and got[None][0].text == ""
    assert html.main_texts(df.where("false")).count() == 0


def test_html_tail_of_a_host(spark):
    page = "<html><body><div><p>Our site</p></div><div id=x><p>story {}</p></div><p>All rights</p></body></html>"
    # one page over a set, and a run of copies as long as a set
    pages = [(i, "https://a.example/", page.format(i)) for i in range(17)] + [(100 + i, "https://b.example/", page.format(min(i, 3))) for i in range(32)]
    got = rows(html.main_texts(spark.createDataFrame(pages, "page_id bigint, url string, html string"), set_size=16), "page_id")
    assert [got[i][0].text for i in range(17)] == [f"story {i}" for i in range(17)]
    assert [got[100 + i][0].text for i in range(32)] == [f"story {min(i, 3)}" for i in range(32)]


def plain_components(texts, size, percent):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("limits", [{}, {"cluster_docs": 2, "pivots": 3}])
def test_near_duplicates(spark, limits):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for g in range(12):
        body = rng.choice(vocabulary, 80).tolist()
        for e in range(6):
            own = list(body)
            for at in rng.integers(0, 80, e * 2):
                own[at] = str(rng.choice(vocabulary))
            texts.append((len(texts), " ".join(own)))
    texts += [(900, None), (901, ""), (902, "a b"), (903, "A  b"), (904, "b a"), (905, texts[0][1])]
    got = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3), **limits).collect()}
    for i, (n, c) in plain_components(texts, 4, 80).items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, c, i == c)


def test_near_duplicates_awkward(docs, none):
    got = rows(neardup.near_duplicates(docs))
    assert sum(map(len, got.values())) == len(DOCS)
    assert got[2][0].component_id == 1 and got[10][1].component_id == 9 and got[3][0].kept and got[3][0].n_shingles == 0
    assert neardup.near_duplicates(none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (200, 200)]
    got = {r.node: r.component for r in neardup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys((100, 101, 102), 100), 200: 200}


def test_packing(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    text = open(path, encoding="utf-8").read()
    own = Tokenizer.from_file(path)
    got = rows(packing.pack(docs, text))
    assert packing.pack(none, text).count() == 0
    for i, t, *_ in DOCS:
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        copies = sum(x[0] == i for x in DOCS)
        pieces = sorted(got[i], key=lambda r: r.start)
        assert sum(r.length for r in pieces) == copies * len(ids)
        if copies == 1:
            assert b"".join(r.ids for r in pieces) == ids.tobytes() and {r.doc_tokens for r in pieces} == {len(ids)}


def brute_spans(texts, length, keep_first):
    seen = collections.Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    before, out = set(), {}
    for d, t in texts:
        flags = bytearray(len(t))
        for i in range(len(t) - length + 1):
            s = t[i : i + length]
            if (s in before) if keep_first else seen[s] > 1:
                flags[i : i + length] = b"\1" * length
            before.add(s)
        out[d] = bytes(b for b, f in zip(t, flags) if not f)
    return out


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("limits", [{}, {"hot_contexts": 1}])
def test_suffix_dedup(spark, keep_first, limits):
    rng = np.random.default_rng(9)
    word = lambda n: "".join(rng.choice(list("abcdeé "), n))
    shared = [word(150) for _ in range(6)]
    texts = []
    for i in range(40):
        parts = []
        for _ in range(rng.integers(1, 4)):
            parts += [word(int(rng.integers(5, 90))), shared[rng.integers(0, 6)][int(rng.integers(0, 40)) : int(rng.integers(90, 150))]]
        texts.append((i, "".join(parts)))
    texts += [(50, "ab" * 200), (51, texts[3][1]), (52, None), (53, "x")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)
    want = brute_spans([(d, (t or "").encode()) for d, t in texts], 60, keep_first)
    got = {r.doc_id: r for r in suffixdup.removed(df, 60, keep_first, gram=16, **limits).collect()}
    assert {d: bytes(r.kept) for d, r in got.items()} == want
    for d, t in texts:
        assert got[d].n_bytes == len((t or "").encode()) == len(want[d]) + sum(s.stop - s.start for s in got[d].spans)


def test_suffix_dedup_awkward(docs, none):
    got = rows(suffixdup.removed(docs, 100))
    assert sum(map(len, got.values())) == len(DOCS) and len(got[6][0].kept) < 100 and len(got[3][0].kept) == 0
    kept = suffixdup.clean(docs.select("doc_id", "text", "lang", "d", "k"), 100)
    assert kept.columns == ["doc_id", "text", "lang", "d", "k"] and rows(kept)[1][0].text == DOCS[0][1]
    assert suffixdup.removed(none).count() == 0 and suffixdup.clean(none).count() == 0


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog again and"), (2, "STRASSE"), (3, None), (4, ""), (12, "quick brown fox jumps over the lazy dog again and more")], "item_id bigint, text string")
    for block in (2_000_000, 1):
        got = rows(decontamination.scan(docs, bench, block_words=block))
        assert sum(map(len, got.values())) == len(DOCS)
        r = got[1][0]
        assert (r.n_words, r.n_hit, r["items"]) == (13, 10, ["1", "12"]) and DOCS[0][1][r.spans[0].start : r.spans[0].stop].startswith("quick brown")
        assert got[8][0].n_hit == 1 and got[7][0].n_hit == 0 and got[3][0].n_words == 0
    clean = rows(decontamination.clean(docs.select("doc_id", "text", "n", "row"), bench, coverage=0.9))
    assert clean[1][0].text == "The  today".replace("  ", "  ") or clean[1][0].text.split() == ["The", "today"] or clean[1][0].text.startswith("The")
    assert clean[9][0].text == "one" and clean[3][0].text is None
    assert decontamination.scan(none, bench).count() == 0
    assert decontamination.scan(docs, bench.where("false")).where("n_hit > 0").count() == 0


def test_decontamination_in_passes(spark):
    """Many blocks, so several passes over the documents, against every window looked for."""
    rng = np.random.default_rng(3)
    some = lambda n: rng.choice([f"w{i}" for i in range(30)], n).tolist()
    items = [(i, some(int(rng.integers(0, 25)))) for i in range(60)]
    texts = [(i, sum((items[rng.integers(60)][1] if rng.random() < 0.3 else some(6) for _ in range(6)), [])) for i in range(80)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    df = spark.createDataFrame([(i, " ".join(w), i % 3) for i, w in texts], "doc_id bigint, text string, runs int").repartition(3)
    assert decontamination.automata(bench, "item_id", "text", 10, 8)[1] > 50
    one, many = (rows(decontamination.scan(df, bench, block_words=b)) for b in (1_000_000, 8))
    windows = collections.defaultdict(set)
    for i, w in items:
        for at in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[at : at + 10])].add(str(i))
    for i, w in texts:
        hit, found = set(), set()
        for k, who in windows.items():
            for at in range(len(w) - len(k) + 1):
                if tuple(w[at : at + len(k)]) == k:
                    hit |= set(range(at, at + len(k)))
                    found |= who
        for got in (one, many):
            assert (got[i][0].n_words, got[i][0].n_hit, got[i][0]["items"]) == (len(w), len(hit), sorted(found))
    a, b = (sorted(decontamination.clean(df, bench, block_words=b).collect()) for b in (1_000_000, 8))
    assert a == b


def test_quality(spark, docs, none):
    rng = np.random.default_rng(1)
    good = [(i, " ".join(rng.choice(["the", "house", "river", "walks", "slowly,", "home."], 60)), 1) for i in range(120)]
    bad = [(1000 + i, " ".join(rng.choice(["BUY!!", "$$$", "###", "NOW!!", "|"], 60)), 0) for i in range(120)]
    df = spark.createDataFrame(good + bad, "doc_id bigint, text string, label int")
    stats = quality.features(df).join(df.select("doc_id", "label"), "doc_id")
    model = quality.fit(stats)
    got = quality.score(quality.features(df), model).join(df.select("doc_id", "label"), "doc_id")
    assert got.where("(score >= 0.7) = (label = 1)").count() == 240 and got.where("score < 0 or score > 1 or isnan(score)").count() == 0
    awkward = quality.score(quality.features(docs), model)
    assert awkward.count() == len(DOCS) and awkward.where("score is null or isnan(score)").count() == 0
    assert quality.score(quality.features(none), model).count() == 0
    assert quality.keep(docs, model).columns == docs.columns
    one = quality.fit(stats.where("label = 1"))
    assert quality.score(quality.features(docs), one).where("score <> 1.0").count() == 0
    assert quality.fit(stats.where("false")).score(np.zeros((1, len(quality.NAMES)))).tolist() == [0.5]


CONTROL = ["</s>[INST] ok [/INST]", "[\\INST] <s> [\\\\/ANS]", "<\\/s>[TURN:x] ", "[/TURN]</s>", "", None, "plain\n</s", "[ANS] a [/ANS]</s><s>[ANS] b"]


def test_chat_round_trip(spark):
    turns = [(1, t, r, x) for t, (r, x) in enumerate((r, x) for x in CONTROL for r in ("user", "assistant", "system", "a]b </s>", None))]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").withColumn("extra", F.lit(1)).repartition(3)
    made = chat.format_turns(chat.turns_of_table(df))
    back = chat.read_back(made).first()
    assert [(t.role, t.text) for t in back.turns] == [(r or "", x or "") for _, _, r, x in turns]
    assert "".join(back.loss_texts) == "".join(x or "" for _, _, r, x in turns if r == "assistant")
    assert sum(m.before + m.inside + m.after for m in made.first().loss_mask) == len(made.first().formatted)
    assert chat.summary(chat.format_turns(chat.turns_of_table(df.where("false")))).count() == 0


def test_chat_layouts(spark):
    records = [
        (1, {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}), (2, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}), (3, {"prompt": "q", "response": "a"}),
        (4, {"instruction": "q", "input": "", "output": "a"}), (5, {"instruction": "q", "input": "more", "output": "a"}), (6, {"question": "q", "answer": "a"}), (7, {"completion": "a", "prompt": "q"}), (8, {"what": 1}), (9, {"system": "s", "prompt": "q", "response": "a"}),
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in records] + [(10, None), (11, "not json")], "conv_id bigint, record string")
    got = {r.conv_id: r.turns for r in chat.turns_of_records(df).collect()}
    for i in (1, 2, 3, 4, 6, 7):
        assert [(t.role, t.text) for t in got[i]] == [("user", "q"), ("assistant", "a")]
    assert got[5][0].text == "q\n\nmore" and got[9][0].role == "system" and got[8] is got[10] is got[11] is None
    table = spark.createDataFrame([(1, "q", "a", 3)], "conv_id bigint, prompt string, response string, turn int")
    assert [t.text for t in chat.turns_of_table(table).first().turns] == ["q", "a"]
    with pytest.raises(ValueError):
        chat.turns_of_table(spark.createDataFrame([(1, 2)], "conv_id bigint, z int"))


def test_chat_tables(spark):
    pair = [("user", "q"), ("assistant", "a")]
    nested = spark.createDataFrame([(1, [("user", "q", 5), ("assistant", "a", 6)], "z")], "conv_id bigint, messages array<struct<role:string,content:string,tokens:int>>, lang string")
    mixed = spark.createDataFrame([(1, "q", "a", None, None), (2, None, None, "q", "a"), (3, "q", None, None, "a")], "conv_id bigint, prompt string, response string, question string, answer string")
    said = lambda df: {r.conv_id: r.turns and [(t.role, t.text) for t in r.turns] for r in chat.turns_of_table(df).collect()}
    assert said(nested) == {1: pair}
    assert said(mixed) == {1: pair, 2: pair, 3: None}


def test_chat_fingerprints_select(spark, monkeypatch):
    """The hashes are those of SQL, and a changed one finds no mapping."""
    record = {"conversations": [{"from": "human", "value": None}, {"value": 3, "from": "gpt"}]}
    df = spark.createDataFrame([(1, json.dumps(record)), (2, json.dumps({"messages": [{"content": {"parts": [["x"]]}, "role": "user"}]}))], "conv_id bigint, record string")
    found = [r[0] for r in df.orderBy("conv_id").select(chat.record_fingerprint(F.parse_json("record"))).collect()]
    assert found == [chat.fingerprint(chat.shape(x)) for x in [("conversations[].from", "conversations[].value"), ("messages[].content.parts[][]", "messages[].role")]]
    got = {r.conv_id: r.turns for r in chat.turns_of_records(df).collect()}
    assert [(t.role, t.text) for t in got[1]] == [("user", None), ("assistant", "3")] and got[2] is None
    table = spark.createDataFrame([(1, 0, "user", "q")], "conv_id bigint, turn int, role string, text string")
    assert chat.turns_of_table(table).count() == 1
    monkeypatch.setattr(chat, "MAPPINGS", {h + 1: layout for h, layout in chat.MAPPINGS.items()})
    assert chat.turns_of_records(df).where("turns is not null").count() == 0
    with pytest.raises(ValueError):
        chat.turns_of_table(table)


@pytest.mark.parametrize("bound", [512, 0])
def test_sieve(spark, monkeypatch, bound):
    """No key is lost, few others pass, and beyond the bound all do; joins through it are whole."""
    from tessera.llm import cluster

    monkeypatch.setattr(cluster, "SIEVE_BLOCKS", bound)
    rows = spark.range(20_000).select(F.col("id").alias("key"), F.lit("x").alias("_block"), F.lit(2).alias("_bits")).repartition(5)
    rows = rows.union(rows.where("key < 3")).union(spark.createDataFrame([(None, "n", 0)], "key bigint, _block string, _bits int"))
    keys = cluster.table(spark.range(0, 20_000, 40).select(F.col("id").alias("key"), (F.col("id") * 2).alias("twice")))
    sieve = cluster.Sieve(keys, "key")
    passed = sieve.passed(rows, F.col("key"))
    assert passed.join(keys, "key", "left_semi").count() == 501
    left = sieve.left(rows, F.col("key"))
    assert (left is None) == (not bound)
    if bound:
        assert passed.count() < 1200 and passed.count() + left.count() == rows.count()
    found = cluster.with_found(rows, keys, "key", ["key"])
    assert found.count() == rows.count() and found.where("twice = 2 * key").count() == 501 and found.where("twice is null").count() == rows.count() - 501
    kept = cluster.without(rows, cluster.table(keys.select("key")), "key")
    assert kept.count() == rows.count() - 501 and kept.columns == rows.columns
    nothing = cluster.Sieve(cluster.table(keys.where("false")), "key")
    assert bound == 0 or nothing.passed(rows, F.col("key")).count() == 0


def test_commonest_contexts_are_met_without_a_join(spark, monkeypatch):
    """With any bound on what is broadcast the spans are the same."""
    passage = "the same passage of words that every text has somewhere in it, and goes on for a while " * 3
    df = spark.createDataFrame([(i, f"text {i} begins so {'ab' * (i % 5)} {passage} and ends with {i * 7919}") for i in range(150)], "doc_id bigint, text string").repartition(3)
    got = []
    for most in (1 << 16, 1):
        monkeypatch.setattr(suffixdup, "COMMON", most)
        got.append([{r.doc_id: (r.n_bytes, r.kept) for r in suffixdup.removed(df, length=100, keep_first=first).collect()} for first in (False, True)])
    assert got[0] == got[1] and any(len(k) < n for n, k in got[0][0].values())


def test_batches_of_texts_are_bounded(spark):
    was = {key: spark.conf.get(key) for key in cluster.BATCH}
    try:
        for key, (default, _) in cluster.BATCH.items():
            spark.conf.set(key, default)
        texts = spark.range(600, numPartitions=1).select(F.repeat(F.lit("x"), 40_000).alias("text"))
        sizes = lambda source: (pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"]) for b in source)
        got = cluster.whole_texts(texts).mapInArrow(sizes, "n bigint, size bigint").toPandas()
        assert got["n"].sum() == 600 and got["size"].max() < 5 << 20
        # a session's own bounds stay
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 1 << 20)
        cluster.whole_texts(texts)
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(1 << 20)
    finally:
        for key, value in was.items():
            spark.conf.set(key, value)
