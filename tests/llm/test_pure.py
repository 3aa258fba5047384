"""Kernels against plain versions; no Spark."""

import collections
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import html, neardup, packing, quality, sharding, suffixdup
from tessera.llm.decontamination import Automaton, _covered
from tessera.llm.hmm import Hmm
from tessera.llm.textkit import BY_ALNUM, BY_SPACE, HashTable, Words, gathered, slices

words_ = st.lists(st.sampled_from(["a", "b", "cc", "é", "D1"]), max_size=30)


@given(st.lists(st.text(alphabet="aB é\t\n.\0", max_size=40), max_size=6))
@settings(max_examples=60, deadline=None)
def test_words(texts):
    raw = [t.encode() for t in texts]
    for table in (BY_SPACE, BY_ALNUM):
        if not raw:
            continue
        w = Words(raw, table)
        want = [t.translate(table).split(b" ") for t in raw]
        want = [[x for x in ws if x] for ws in want]
        assert w.counts.tolist() == [len(x) for x in want]
        flat = [x for ws in want for x in ws]
        got = w.hashes().tolist()
        same = collections.defaultdict(set)
        for x, h in zip(flat, got):
            same[x].add(h)
        assert all(len(s) == 1 for s in same.values()) and len({next(iter(s)) for s in same.values()}) == len(same)


def test_slices_cover():
    texts = [b"x" * n for n in (5, 0, 100, 3, 3)]
    got = list(slices(texts, 10))
    assert [i for a, b in got for i in range(a, b)] == list(range(5))
    assert list(slices([])) == []


def test_hash_table():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    t = HashTable(keys)
    probe = np.concatenate([keys, rng.integers(0, 2**64, 5000, dtype=np.uint64)])
    want = np.array([np.searchsorted(keys, p) if p in set(keys.tolist()) else -1 for p in probe[:200]])
    assert (t.find(probe)[:200] == want).all() and (t.find(keys) == np.arange(len(keys))).all()
    assert HashTable(keys[:0]).find(probe[:3]).tolist() == [-1, -1, -1]


@given(st.lists(words_, max_size=5), words_, st.integers(2, 5))
@settings(max_examples=150, deadline=None)
def test_automaton(items, doc, window):
    a = Automaton([(str(i), " ".join(x).encode()) for i, x in enumerate(items)], window)
    text = " ".join(doc).encode()
    (words, _, hits), *_ = a.scan([text])
    low = [w.lower() if w.isascii() else w for w in doc]
    hit, found = [False] * len(low), set()
    for i, item in enumerate(items):
        item = [w.lower() if w.isascii() else w for w in item]
        size = min(window, len(item))
        for s in range(len(item) - size + 1 if size else 0):
            for p in range(len(low) - size + 1):
                if low[p : p + size] == item[s : s + size]:
                    hit[p : p + size] = [True] * size
                    found.add(str(i))
    assert _covered(len(low), hits).tolist() == hit and {x for *_, x in hits} == found


def test_packer():
    rng = random.Random(2)
    docs = {d: np.arange(rng.choice([1, 5, 63, 64, 700, 2047, 2048, 2049, 5000]), dtype="<u4") for d in range(300)}
    p = packing.Packer()
    rows = [r for d, ids in docs.items() for r in p.feed(d, ids)] + list(p.finish())
    got = collections.defaultdict(list)
    for doc, start, n, ids, total, seq, off in rows:
        got[doc].append((start, np.frombuffer(ids, "<u4")))
        assert total == len(docs[doc]) and len(ids) == 4 * n
    for d, ids in docs.items():
        assert (np.concatenate([x for _, x in sorted(got[d], key=lambda x: x[0])]) == ids).all()
    by = collections.defaultdict(list)
    for *_, n, _ids, _t, seq, off in rows:
        by[seq].append((off, n))
    padding = 0
    for s in by.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.01 * sum(map(len, docs.values()))


def test_tokenizer_agrees():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    bpe, own = packing.ByteBpe(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    for text in ("", " ", "Hello, wörld!  \n\n x", "<|endoftext|> a<|endoftext|>", "日本 \U0001f600‍", "a" * 5000, " " * 3000 + "x", "It's 12,345 'll\t\r\n"):
        assert bpe.ids(text).tolist() == own.encode(text, add_special_tokens=False).ids


def test_schedule():
    got = sharding.schedule({"a": 7, "b": 5, "c": 4, "d": 3, "e": 1}, 2)
    loads = collections.Counter()
    for k, s in got.items():
        loads[s] += {"a": 7, "b": 5, "c": 4, "d": 3, "e": 1}[k]
    assert sorted(loads.values()) == [10, 10]
    assert sharding.schedule({}, 3) == {}


@given(st.lists(st.binary(max_size=60), max_size=8), st.integers(3, 12))
@settings(max_examples=80, deadline=None)
def test_repeated(contexts, length):
    contexts = [bytes(b % 3 for b in c) for c in contexts]
    begin, earlier, any_ = suffixdup.repeated(contexts, length)
    seen = collections.Counter(c[i : i + length] for c in contexts for i in range(len(c) - length + 1))
    before = set()
    for j, c in enumerate(contexts):
        for i in range(len(c)):
            s = c[i : i + length]
            whole = len(s) == length
            assert any_[begin[j] + i] == (whole and seen[s] > 1)
            assert earlier[begin[j] + i] == (whole and s in before)
            if whole:
                before.add(s)


@given(st.binary(min_size=1, max_size=50), st.integers(1, 33))
@settings(max_examples=60, deadline=None)
def test_ranks(data, depth):
    data = bytes(b % 3 + 1 for b in data)
    got = suffixdup.ranks(np.frombuffer(data, np.uint8), depth)
    keys = [data[i : i + depth] for i in range(len(data))]
    assert got.tolist() == [sorted(set(keys)).index(k) for k in keys]


def test_sliding_minimum():
    x = np.random.default_rng(0).integers(0, 99, 57).astype(np.uint64)
    for w in (1, 2, 7, 57, 58):
        assert suffixdup.sliding_minimum(x, w).tolist() == [x[i : i + w].min() for i in range(57 - w + 1)]


def test_anchors_are_content_defined():
    rng = np.random.default_rng(5)
    core = rng.integers(97, 123, 700, dtype=np.uint8).tobytes()
    a, b = b"x" * 31 + core + b"yy", core + b"z" * 50
    owner, h, c, off, lo, hi = suffixdup.anchors([a, b, b"short"], 100, 16)
    for own, text in ((0, a), (1, b)):
        m = owner == own
        covered = sorted(s for x, y in zip(lo[m], hi[m]) for s in range(x, y + 1))
        assert covered == list(range(len(text) - 100 + 1))
    assert set(owner.tolist()) == {0, 1}
    inner = lambda own, shift: {(g, p - shift) for g, p in zip(h[owner == own].tolist(), (lo + off)[owner == own].tolist())}
    shared = inner(0, 31) & inner(1, 0)
    assert len(shared) > 5


def test_estimate_is_close():
    rng = np.random.default_rng(3)
    for j in (0.3, 0.6, 0.8, 0.95):
        n = 2000
        both = int(2 * n * j / (1 + j))
        pool = rng.integers(0, 2**64, 2 * n, dtype=np.uint64)
        a, b = pool[:n], np.concatenate([pool[:both], pool[n : 2 * n - both]])
        s = neardup.Sketcher(400)
        assert abs(neardup.estimate(s.levels(a), s.levels(b), len(a), len(b)) - j) < 0.12


def test_sketches_merge():
    rng = np.random.default_rng(4)
    a, b = (rng.integers(0, 2**64, 300, dtype=np.uint64) for _ in range(2))
    s = neardup.Sketcher(64)
    assert (np.maximum(s.levels(a), s.levels(b)) == s.levels(np.concatenate([a, b]))).all()


def test_shingles():
    got = neardup.shingles([b"a b c d e", b"A  b\tc d", b"a b", b"", b"b a", b"a b c d a b c d a"], 4)
    assert [len(x) for x in got] == [2, 1, 1, 0, 1, 4]
    assert got[1][0] in got[0] and got[2][0] != got[4][0]


def test_hmm_is_exact():
    rng = np.random.default_rng(6)
    k, v = 3, 5
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    m = Hmm(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((v, k)), 0))
    seqs = [rng.integers(0, v, n) for n in (1, 4, 2, 7)]
    begin = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])

    def plain(s):
        a = m.start * m.emit[s[0]]
        for x in s[1:]:
            a = (a @ m.step) * m.emit[x]
        return np.log(a.sum())

    assert np.allclose(m.forward(np.concatenate(seqs), begin), [plain(s) for s in seqs])
    starts, steps, emitted = m.expect(np.concatenate(seqs), begin)
    assert np.isclose(starts.sum(), 4, rtol=1e-4) and np.isclose(steps.sum(), 10, rtol=1e-4) and np.isclose(emitted.sum(), 14, rtol=1e-4)
    # counts by enumeration of all state paths of the second sequence
    import itertools

    s = seqs[1]
    want, total = np.zeros((v, k)), 0.0
    for path in itertools.product(range(k), repeat=len(s)):
        p = m.start[path[0]] * m.emit[s[0], path[0]]
        for t in range(1, len(s)):
            p *= m.step[path[t - 1], path[t]] * m.emit[s[t], path[t]]
        total += p
        for t, z in enumerate(path):
            want[s[t], z] += p
    one = m.expect(s, np.array([0, len(s)]))[2]
    assert np.allclose(one, want / total, rtol=1e-3)


def test_hmm_long_sequences_by_pieces(monkeypatch):
    from tessera.llm import hmm as module

    rng = np.random.default_rng(7)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    m = Hmm(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((6, 3)), 0))
    seqs = [rng.integers(0, 6, n) for n in (40, 3, 17, 8, 24)]
    symbols, begin = np.concatenate(seqs), np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    like, counts = m.forward(symbols, begin), m.expect(symbols, begin)
    monkeypatch.setattr(module, "LONG", 10)
    monkeypatch.setattr(module, "PIECE", 8)
    assert np.allclose(m.forward(symbols, begin), like)
    for a, b in zip(m.expect(symbols, begin), counts):
        assert np.allclose(a, b, rtol=1e-3, atol=1e-4)


def test_hmm_takes_sequences_side_by_side():
    rng = np.random.default_rng(8)
    k, v, n, size = 12, 5000, 2000, 60
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    m = Hmm(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((v, k)), 0))
    seqs = rng.integers(0, v, (n, size)).astype(np.int32)
    begin = np.arange(n + 1) * size

    def plain():  # a row of states for each sequence
        emit, step = m.emit.astype(np.float32), m.step.astype(np.float32)
        alpha, alphas, scales = np.broadcast_to(m.start.astype(np.float32), (n, k)), [], []
        for t in range(size):
            alpha = (alpha @ step if t else alpha) * emit[seqs[:, t]]
            scales.append(alpha.sum(1, keepdims=True))
            alpha = alpha / scales[-1]
            alphas.append(alpha)
        gamma, beta, steps = np.empty((n, size, k), np.float32), np.ones((n, k), np.float32), np.zeros((k, k))
        for t in range(size - 1, -1, -1):
            if t < size - 1:
                ahead = beta * emit[seqs[:, t + 1]] / scales[t + 1]
                steps += alphas[t].T @ ahead
                beta = ahead @ step.T
            gamma[:, t] = alphas[t] * beta
        emitted = np.stack([np.bincount(seqs.ravel(), gamma[:, :, j].ravel(), v) for j in range(k)], 1)
        return gamma[:, 0].sum(0, dtype=float), steps * m.step, emitted, float(np.log(np.stack(scales)).sum(dtype=float))

    took = {}
    for _ in range(5):
        for name, f in (("plain", plain), ("side by side", lambda: m.expect_and_like(seqs.ravel(), begin))):
            at = time.process_time()
            found = f()
            took[name] = min(took.get(name, np.inf), time.process_time() - at)
            if name == "plain":
                want = found
    for a, b in zip(found, want):
        assert np.allclose(a, b, rtol=1e-3, atol=1e-4)
    assert took["side by side"] < 0.75 * took["plain"]


def test_hmm_keeps_weights_in_range():
    # half of the tokens are next to impossible: weights are scaled before they vanish
    m = Hmm(np.array([1 - 1e-12, 1e-12]), np.array([[1 - 1e-12, 1e-12], [1e-12, 1 - 1e-12]]), np.array([[1e-9, 1e-15], [1e-15, 1e-9], [1 - 1e-9, 1 - 1e-9]]))
    seqs = [np.resize([0, 1, 2, 1], size) for size in (1, 700, 2000, 5000)]
    want = []
    for s in seqs:
        a, like = m.start, 0.0
        for t, x in enumerate(s):
            a = (a @ m.step if t else a) * m.emit[x]
            like, a = like + np.log(a.sum()), a / a.sum()
        want.append(like)
    assert np.allclose(m.forward(np.concatenate(seqs), np.concatenate([[0], np.cumsum([len(s) for s in seqs])])), want, rtol=1e-12)


def test_gathered():
    import pyarrow as pa

    source = [pa.RecordBatch.from_pydict({"x": list(range(i, i + 10))}) for i in range(0, 100, 10)]
    got = list(gathered(source, 250))
    assert [b.num_rows for b in got] == [30, 30, 30, 10] and max(b.nbytes for b in got) <= 250 and [x for b in got for x in b.column(0).to_pylist()] == list(range(100))
    assert [b.num_rows for b in gathered(source[:3], 50)] == [10, 10, 10] and list(gathered([], 250)) == []


def test_statistics_do_not_depend_on_company():
    texts = [b"", b"One two. THREE!! | 4\nfive five five", "Über été".encode(), b"x" * 3000]
    together = quality.statistics(texts)
    assert together.shape == (4, len(quality.NAMES)) and np.isfinite(together).all()
    for t, row in zip(texts, together):
        assert np.allclose(quality.statistics([t])[0], row)


def test_monotone():
    assert quality._monotone(np.array([0.2, 0.1, 0.5, 0.4]), np.ones(4)).tolist() == pytest.approx([0.15, 0.15, 0.45, 0.45])


PAGE = "<html><head><title>t</title><script>if (a<b) x('</p>')</script></head><body><nav><a>menu</a></nav><div class='cookie-notice'>We use</div><article><header><h1>Head &amp; shoulders</h1></header><p>One <b>two<br>three</b><p>four</p><ul><li>x<li>y</ul><div class=comments><p>troll</p></div><form>send</form></article><aside>side</aside><footer>foot</footer>"


def test_extract_named_article():
    assert html.extract([PAGE]) == ["Head & shoulders\n\nOne two three\n\nfour\n\nx\n\ny"]
    assert html.extract(["", "   ", "plain &lt;text&gt;", "<p>a <!-- no --> b"]) [2:] == ["plain <text>", "a b"]


def test_extract_by_wrapper():
    page = lambda body: f"<html><body><div><p>Our site</p></div><div id=x>{body}</div><p>All rights</p></body></html>"
    got = html.extract([page("<p>first story</p><p>more</p>"), page("<p>second tale</p>"), page("<p>third</p><p>x</p><p>y</p>")])
    assert got == ["first story\n\nmore", "second tale", "third\n\nx\n\ny"]


def test_extract_copies_are_kept():
    assert html.extract([PAGE] * 10) == html.extract([PAGE]) * 10


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 7, 8, 30])
def test_extract_constant_in_articles(n):
    """What every article says is article text, however many pages there are; what also stands outside of articles is not."""
    pages = [f"<p>Our menu</p><article><h1>T{i}</h1><p>Body {i}</p><p>Prices are in euros.</p></article>" for i in range(n)]
    assert html.extract(pages) == [f"T{i}\n\nBody {i}\n\nPrices are in euros." for i in range(n)]
    pages = [p.replace("</h1>", "</h1><p>Our menu</p>") for p in pages]
    assert html.extract(pages)[0] == ("T0\n\nBody 0\n\nPrices are in euros." if n > 1 else "T0\n\nOur menu\n\nBody 0\n\nPrices are in euros.")


@pytest.mark.parametrize("odd", [None, "", "<p>cut", "<table><tr><td>another layout</table>", "<html><body><div><p>Our si"])
@pytest.mark.parametrize("first", [True, False])
def test_extract_in_odd_company(odd, first):
    pages = [f"<html><body><div><p>Our site</p></div><div id=x><p>story {i}</p></div><p>All rights</p></body></html>" for i in range(6)]
    got = html.extract([odd, *pages] if first else [*pages, odd])
    assert (got[1:] if first else got[:-1]) == [f"story {i}" for i in range(6)]


def test_extract_two_layouts():
    one = [f"<body><div id=a><p>Site one</p></div><div id=b><p>news {i}</p></div></body>" for i in range(4)]
    two = [f"<body><table class=t><tr><td>Shop</td></tr></table><section id=c><h2>thing {i}</h2></section></body>" for i in range(3)]
    assert html.extract([two[0], *one, *two[1:]]) == ["thing 0", *(f"news {i}" for i in range(4)), "thing 1", "thing 2"]


def unnamed_pages(n=12):
    """Pages without a telling tag or class; menus, adverts and footers vary like articles do."""
    rng = random.Random(4)
    some = lambda k: " ".join(rng.choice(["ba", "ce", "du", "fo", "ge"]) + str(rng.randrange(99)) for _ in range(k))
    pages, want = [], []
    for _ in range(n):
        parts = [some(4), *(some(rng.randrange(15, 60)) for _ in range(rng.randrange(1, 6)))]
        menu = "".join(f"<li><a href=/{i}>{some(1)}</a></li>" for i in range(6))
        pages.append(f"<body><div><ul>{menu}</ul></div><div>{some(6)}</div><div><h1>{parts[0]}</h1>" + "".join(f"<p>{x}</p>" for x in parts[1:]) + f"<div>All about it</div></div><div>{some(7)}</div></body>")
        want.append("\n\n".join(parts))
    return pages, want


def test_extract_is_decided_by_alignment(monkeypatch):
    pages, want = unnamed_pages()
    assert html.extract(pages) == want
    # tags that name the article agree with what alignment finds without them
    named = [re.sub(r"<div>(<h1>.*</div>)</div><div>", r"<article>\1</article><div>", p) for p in pages]
    assert all("<article>" in p for p in named) and html.extract(named) == [f"{w}\n\nAll about it" for w in want]  # a named article keeps what all articles say
    monkeypatch.setattr(html, "match", lambda a, b, pairs: 0)
    assert not any(x == y for x, y in zip(html.extract(pages), want))


def test_extract_names_need_a_slot():
    body = "<article><h1>{0}</h1><p>story {0}</p>{1}</article>"
    box = "<div class='share box'><p>tell {}</p></div>"
    pages = [body.format(i, box.format(i)) for i in range(8)]
    assert html.extract(pages)[2] == "2\n\nstory 2"
    one = [body.format(i, "<div class=discussion>talk</div><p class='share-price'>9</p>" if i == 3 else "") for i in range(8)]
    assert html.extract(one)[3] == "3\n\nstory 3\n\ntalk\n\n9"


def test_extract_leaks_no_markup():
    assert html.extract(["<article><p title=it's>One</p><math><mi>x</mi></math></article>"]) == ["One\n\nx"]
    assert html.extract(["<p><a href=\"x>y\" b='c>d'>in</a> out <i"]) == ["in out"]


def test_extract_many_siblings():
    rng = random.Random(2)
    kinds = ["<p>{}</p>", "<ul><li>{}</li></ul>", "<h4>{}</h4>", "<p><b>{}</b></p>"]
    numbers = [[rng.random() for _ in range(20_000)] for _ in range(2)]
    pages = ["<body><article>" + "".join(rng.choice(kinds).format(x) for x in xs) + "</article></body>" for xs in numbers]
    began = time.process_time()
    assert html.extract(pages) == ["\n\n".join(map(str, xs)) for xs in numbers]
    assert time.process_time() - began < 30


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 128, 129, 200, 1000])
def test_even_sets(n):
    pages = [(i, k, f"p{i}") for i in range(n) for k in range(2)]
    sets = list(html.even_sets(iter(pages), 64))
    assert [(*r, p) for s in sets for p, copies in s for r in copies] == pages
    assert all(min(n, 32) <= len(s) <= 64 for s in sets)


def test_deep_page():
    assert html.extract(["<div>" * 3000 + "deep" + "</div>" * 3000]) == ["deep"]


def test_tree_matching():
    a, b = html.parse("<ul><li>1<li>2<li>3</ul><p>x</p>"), html.parse("<ul><li>1<li>2</ul><h1>t</h1><p>x</p>")
    pairs = []
    assert html.match(a, b, pairs) == 5 == len(pairs)


@pytest.mark.parametrize("cells", [1, 1 << 22])
def test_siblings_are_matched_alike_at_any_number(cells, monkeypatch):
    """The greatest matching, as by the plain table of all pairs, also of more siblings than a band around the diagonal holds."""
    monkeypatch.setattr(html, "CELLS", cells)
    r = random.Random(4)
    kinds = ["<p>a</p>", "<div>a<i>b</i></div>", "<div><b>c</b><i>d</i></div>", "<h2>e</h2>", "<ul><li>f</li><li>g<b>h</b></li></ul>"]

    def plain(a, b):
        if a.key != b.key:
            return 0
        x, y = html.elements(a), html.elements(b)
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, c in enumerate(x):
            for j, d in enumerate(y):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + plain(c, d))
        return 1 + best[-1][-1]

    for n, m in ((3, 5), (30, 41), (160, 230)):
        texts = ["".join(r.choices(kinds, k=k)) for k in (n, m)]
        # what is alike lies far from the diagonal
        a, b = html.parse("<body>" + texts[0] + "<h3>z</h3>" * 3), html.parse("<body>" + texts[1] * 2 + texts[0] + "<h2>y</h2>" * 3)
        pairs = []
        assert html.match(a, b, pairs) == plain(a, b) == len(pairs)
        assert len({id(c) for c, _ in pairs}) == len(pairs) == len({id(d) for _, d in pairs})
