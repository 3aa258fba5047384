"""Benchmark decontamination with generalised suffix automata.

Benchmark items, as sequences of word numbers, are dealt by hash to blocks of
about ``block_words`` words.  Tasks build one suffix automaton a block, which is
written.  A training document's words stream through it, which gives the longest
item substring that ends at each word; a match of ``window`` words, or a whole
item shorter than that, marks its words.  Only runs of item words can match, so
the words outside are skipped at C speed.

``TOGETHER`` blocks at most are on the driver and broadcast at a time.  A benchmark
of more is taken in several passes over the documents, each task loading a block
once; the passes write what they find, which then meets the documents by key.

Defined cases: a null or empty text has no words; an item without words matches
nothing; repeated items are items each, repeated documents rows each; an empty
benchmark leaves documents as they are, an empty table gives no rows; a null item
id is the empty text; other columns are ignored or, by ``clean``, kept, whatever
their names; very long texts are scanned a slice of texts at a time.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.cluster import table, whole_texts, with_found
from tessera.llm.textkit import BY_ALNUM, Words, batches, byte_hash, same_bytes, slices, texts_of


class Automaton:
    """Generalised suffix automaton over the items' words."""

    def __init__(self, items: list[tuple[object, bytes]], window: int) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.words: dict[bytes, int] = {}
        ends: dict[int, set] = {}
        short: dict[int, list[tuple[int, object]]] = {}
        sequences = []
        for item, text in items:
            words = text.translate(BY_ALNUM).split()
            if words:
                sequences.append((item, [self.words.setdefault(w, len(self.words)) for w in words]))
        for item, seq in sequences:
            last = 0
            for word in seq:
                last = self._extend(last, word)
        for item, seq in sequences:
            state = 0
            for at, word in enumerate(seq):
                state = self.next[state][word]
                if at + 1 >= window:
                    # the state of this prefix's last `window` words
                    s = state
                    while self.length[self.link[s]] >= window:
                        s = self.link[s]
                    ends.setdefault(s, set()).add(item)
                elif at + 1 == len(seq):
                    short.setdefault(state, []).append((len(seq), item))
        self.items = {s: frozenset(x) for s, x in ends.items()}
        self.short = short
        # the nearest suffix that ends a short item, so that most steps look at one entry
        self.short_link = [-1] * len(self.link)
        for s in sorted(range(len(self.link)), key=self.length.__getitem__):
            self.short_link[s] = s if s in short else self.short_link[self.link[s]] if s else -1
        self.least = min([window, *(n for x in short.values() for n, _ in x)])
        self.spelt = np.frombuffer(b"".join(self.words), np.uint8)
        self.ends = np.cumsum(np.fromiter((len(w) for w in self.words), np.int64, len(self.words)))
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64) if self.words else self.ends
        hashes = byte_hash(self.spelt, self.starts, self.ends)
        order = np.argsort(hashes, kind="stable")
        self.keys, self.numbers = hashes[order], order.astype(np.int64)

    def _extend(self, last: int, word: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if word in nxt[last]:
            q = nxt[last][word]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, q, word)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p != -1:
            q = nxt[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, word)
        return new

    def _clone(self, p: int, q: int, word: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p != -1 and nxt[p].get(word) == q:
            nxt[p][word] = clone
            p = link[p]
        return clone

    def numbered(self, words: Words) -> np.ndarray:
        """Item-word numbers, -1 for other words; hashes find them, bytes decide."""
        hashes, length = words.hashes(), words.ends - words.starts
        out = np.full(len(hashes), -1)
        at, todo = np.searchsorted(self.keys, hashes), np.arange(len(hashes))
        while len(todo):  # a second time round only where item words share a hash
            inside = at < len(self.keys)
            todo, at = todo[inside], at[inside]
            hit = self.keys[at] == hashes[todo]
            todo, at = todo[hit], at[hit]
            number = self.numbers[at]
            same = self.ends[number] - self.starts[number] == length[todo]
            same[same] = same_bytes(words.data, words.starts[todo[same]], self.spelt, self.starts[number[same]], length[todo[same]])
            out[todo[same]] = number[same]
            todo, at = todo[~same], at[~same] + 1
        return out

    def stream(self, numbers: list[int]) -> Iterator[tuple[int, int, object]]:
        """(end, words, item) of each window that ends in this run of item words."""
        state, n, window = 0, 0, self.window
        for at, word in enumerate(numbers):
            while state and word not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if word in self.next[state]:
                state, n = self.next[state][word], n + 1
            if n >= self.least:
                if n >= window:
                    s = state
                    while self.length[self.link[s]] >= window:
                        s = self.link[s]
                    for item in self.items.get(s, ()):
                        yield at + 1, window, item
                s = self.short_link[state]
                while s > 0:
                    for size, item in self.short[s]:
                        if size <= n:
                            yield at + 1, size, item
                    s = self.short_link[self.link[s]]

    def scan(self, texts: list[bytes]) -> Iterator[tuple[Words, int, list[tuple[int, int, object]]]]:
        """For each text: its slice's words, its place in the slice, its hits (end, words, item)."""
        for a, b in slices(texts):
            words = Words(texts[a:b], BY_ALNUM)
            # a stranger between any two texts, so that no run crosses
            numbers = np.insert(self.numbered(words), words.first[1:-1], -1)
            begin = words.first[:-1] + np.arange(b - a)
            inside = np.zeros(len(numbers) + 2, np.int8)
            inside[1:-1] = numbers >= 0
            edges = np.flatnonzero(np.diff(inside))
            starts, ends = edges[0::2], edges[1::2]
            long = ends - starts >= self.least
            hits: list[list] = [[] for _ in range(b - a)]
            for s, e in zip(starts[long].tolist(), ends[long].tolist()):
                i = int(np.searchsorted(begin, s, "right")) - 1
                base = s - int(begin[i])
                hits[i] += [(base + end, size, item) for end, size, item in self.stream(numbers[s:e].tolist())]
            for i in range(b - a):
                yield words, i, hits[i]


#: Blocks that are broadcast together.
TOGETHER = 4

Runs = list[tuple[int, int]]


def automata(benchmark: DataFrame, item_id: str, text: str, window: int, block_words: int) -> tuple[DataFrame, int]:
    """block and automaton, pickled (written), and the number of blocks; only a sum reaches the driver."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (6 * block_words)))

    def build(group: pa.Table) -> pa.Table:
        listed = list(zip(group.column("item").to_pylist(), texts_of(group.column("text"))))
        return pa.table({"block": group.column("block")[:1], "automaton": pa.array([pickle.dumps(Automaton(listed, window))], pa.binary())})

    dealt = items.select(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)).cast("int").alias("block"), "item", "text")
    return table(dealt.groupBy("block").applyInArrow(build, "block int, automaton binary")), blocks


def _covered(n: int, hits: list[tuple[int, int, object]]) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for end, size, _ in hits:
        edge[end - size] += 1
        edge[end] -= 1
    return np.cumsum(edge)[:n] > 0


def _runs(flags: np.ndarray) -> Runs:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist()))


class Scanner:
    """Looks texts up in some blocks, each unpickled once a task."""

    def __init__(self, sent) -> None:
        self.sent, self.loaded = sent, None

    def __call__(self, texts: list[bytes]) -> list[tuple[Runs, list]]:
        """For each text the runs of words that are hit, and the items."""
        if self.loaded is None:
            self.loaded = [pickle.loads(b) for b in self.sent.value]
        hit: list[np.ndarray | None] = [None] * len(texts)
        items: list[set] = [set() for _ in texts]
        for one in self.loaded:
            for r, (words, i, hits) in enumerate(one.scan(texts)):
                if hits:
                    own = _covered(int(words.first[i + 1]) - int(words.first[i]), hits)
                    hit[r] = own if hit[r] is None else hit[r] | own
                    items[r] |= {item for _, _, item in hits}
        return [(_runs(h) if h is not None else [], sorted(x)) for h, x in zip(hit, items)]


FOUND = "struct<runs:array<struct<start:int,stop:int>>,items:array<string>>"


def _looked_up(df: DataFrame, benchmark: DataFrame, window: int, block_words: int, doc_id: str, text: str, item_id: str, item_text: str) -> tuple[DataFrame, object]:
    """``df`` and a scanner of all blocks; or, where there are several groups of them, ``df`` with __found, what all passes found, and None."""
    sc = df.sparkSession.sparkContext
    made, blocks = automata(benchmark, item_id, item_text, window, block_words)

    def send(at: int):
        return sc.broadcast([r.automaton for r in made.where(F.col("block").between(at, at + TOGETHER - 1)).toLocalIterator()])  # TOGETHER blocks of bounded size

    if blocks <= TOGETHER:
        return whole_texts(df), Scanner(send(0))
    d, k = "__clean_d", "__clean_k"  # beside any columns of the documents
    named = whole_texts(df).withColumns({d: F.coalesce(df[doc_id].cast("bigint"), F.lit(-(1 << 63))), k: F.xxhash64(df[doc_id].cast("bigint"), df[text])})
    passes = []
    for at in range(0, blocks, TOGETHER):
        sent = send(at)
        scanner = Scanner(sent)

        def run(source: Iterator[pa.RecordBatch], scanner=scanner) -> Iterator[pa.RecordBatch]:
            kind = pa.struct([("runs", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("items", pa.list_(pa.string()))])
            for batch in batches(source):
                found = scanner(texts_of(batch.column(2)))
                some = pa.array([i for i, (runs, _) in enumerate(found) if runs], pa.int64())
                rows = [{"runs": [{"start": a, "stop": b} for a, b in runs], "items": items} for runs, items in found if runs]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), pa.array(rows, kind)], names=["d", "k", "f"])

        passes.append(table(named.select(d, k, F.col(text).alias("text")).mapInArrow(run, f"d bigint, k bigint, f {FOUND}")))
        sent.destroy()
    hits = passes[0]
    for other in passes[1:]:
        hits = hits.union(other)
    every = lambda name: F.flatten(F.collect_list(F.col(f"f.{name}"))).alias(name)
    joined = hits.groupBy(F.col("d").alias(d), F.col("k").alias(k)).agg(every("runs"), every("items")).select(d, k, F.struct("runs", "items").alias("__found"))
    return with_found(named, table(joined), k, [d, k]).select(*(F.col(f"`{c}`") for c in df.columns), "__found"), None


def _found_in(column: pa.Array) -> list[tuple[Runs, list]]:
    """The runs and items of joined passes."""
    out = []
    for f in column.to_pylist():
        runs: Runs = []
        for a, b in sorted((r["start"], r["stop"]) for r in f["runs"]) if f else []:
            if runs and a <= runs[-1][1]:
                runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
            else:
                runs.append((a, b))
        out.append((runs, sorted(set(f["items"])) if f else []))
    return out


def _placed(texts: list[bytes], found: list[tuple[Runs, list]]) -> Iterator[tuple[int, Runs]]:
    """For each text its number of words, and its hit runs of words as ranges of bytes."""
    for a, b in slices(texts):
        words = Words(texts[a:b], BY_ALNUM)
        for i in range(b - a):
            first, origin = int(words.first[i]), int(words.begin[i])
            yield int(words.counts[i]), [(int(words.starts[first + s]) - origin, int(words.ends[first + e - 1]) - origin) for s, e in found[a + i][0]]


def scan(df: DataFrame, benchmark: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = 200_000) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (sorted, distinct), spans (byte ranges of hit words)."""
    own = df.select(df[doc_id].cast("bigint").alias("doc_id"), df[text].alias("text"))
    rows, scanner = _looked_up(own, benchmark, window, block_words, "doc_id", "text", item_id, item_text)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            texts = texts_of(batch.column(1))
            found = scanner(texts) if scanner else _found_in(batch.column(2))
            placed = list(_placed(texts, found))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, _ in placed], pa.int64()),
                    pa.array([sum(b - a for a, b in runs) for runs, _ in found], pa.int64()),
                    pa.array([items for _, items in found], pa.list_(pa.string())),
                    pa.array([[{"start": a, "stop": b} for a, b in spans] for _, spans in placed], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                ],
                names=["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,stop:bigint>>")


def clean(df: DataFrame, benchmark: DataFrame, window: int = 10, coverage: float = 0.8, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = 200_000) -> DataFrame:
    """The documents with the hit spans cut out; those hit in ``coverage`` of their words or more go.

    Each document keeps all its columns; a document without a hit keeps its text as it is.
    """
    rows, scanner = _looked_up(df, benchmark, window, block_words, doc_id, text, item_id, item_text)
    width = len(df.columns)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            at = batch.schema.get_field_index(text)
            texts = texts_of(batch.column(at))
            found = scanner(texts) if scanner else _found_in(batch.column(width))
            column, keep = batch.column(at), np.ones(len(texts), bool)
            if any(runs for runs, _ in found):
                changed = column.to_pylist()
                for r, (n, spans) in enumerate(_placed(texts, found)):
                    if spans:
                        edges = [0, *(x for s in spans for x in s), len(texts[r])]
                        changed[r] = b"".join(texts[r][a:b] for a, b in zip(edges[0::2], edges[1::2])).decode()
                        keep[r] = sum(b - a for a, b in found[r][0]) < coverage * n and bool(changed[r].strip())
                column = pa.array(changed, column.type)
            columns = [column if i == at else c for i, c in enumerate(batch.columns[:width])]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:width]).filter(pa.array(keep))

    return rows.mapInArrow(run, df.schema)
