"""Hidden Markov language model.

Symbols are the most frequent ``head`` words, one class for each ending of all
other words, and the text's end.  Baum-Welch takes ``alone`` passes and then
others until the log likelihood gains next to nothing, each over all training texts: tasks add up their expected
counts, blocks of symbols are summed across partitions, and the driver gets one
states x symbols matrix of fixed size.  In the first passes steps between states
are held at none, so a text is in one state and its likelihood is a product;
they start from fixed random emissions, nothing is sampled, and how rows lie in
partitions changes no more than roundings.  A text's likelihood is the scaled
forward recursion over all its tokens, times, for each word outside the head,
its share of its class.

Every known word gives up the same discount (that of singletons and pairs) to
words never seen, which are one unknown word a class, likelier where more words
were seen once.  So the model is a proper distribution.

The table of word counts grows with the corpus.  It is broadcast only up to
``broadcast_words`` rows; beyond, documents meet it in a join on the word's hash.

Defined cases: a null text counts as empty and has the end token only; repeated
rows are scored each; an empty table, or one with nothing to train on, gives the
uniform model over the unknown words; other columns are ignored.  Words of equal
count at the head's edge are taken by their hash.  A text of n tokens needs some
40 n x states bytes while it is learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.cluster import drop, table, whole_texts
from tessera.llm.textkit import BY_SPACE, HashTable, Words, batches, gathered, mix, slices, texts_of

ENDINGS = 1024


def endings(words: Words, which: np.ndarray | slice = slice(None)) -> np.ndarray:
    """The class of each word, or of some: a hash of its last three bytes."""
    starts, ends = words.starts[which], words.ends[which]
    last = np.zeros(len(starts), np.uint64)
    for k in range(1, 4):
        at = ends - k
        byte = np.where(at >= starts, words.data[np.maximum(at, 0)], 0).astype(np.uint64)
        last = last * np.uint64(256) + byte
    return (mix(last) % np.uint64(ENDINGS)).astype(np.int64)


def word_counts(df: DataFrame, text: str = "text", held: int = 1_000_000) -> DataFrame:
    """hash, ending, n of each distinct word of the texts; a task holds at most about ``held`` words."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []

        def merged() -> tuple:
            h, e, n = (np.concatenate(x) for x in zip(*parts))
            keys, at, back = np.unique(h, return_index=True, return_inverse=True)
            return keys, e[at], np.bincount(back, n, len(keys)).astype(np.int64)

        def out(x: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1].astype(np.int32)), pa.array(x[2])], names=["hash", "ending", "n"])

        size = 0
        for batch in batches(source):
            texts = texts_of(batch.column(0))
            for a, b in slices(texts):
                words = Words(texts[a:b], BY_SPACE)
                if len(words.starts):
                    keys, at, n = np.unique(words.hashes(), return_index=True, return_counts=True)
                    parts.append((keys, endings(words, at), n))
                    size += len(keys)
                if size > held:
                    parts[:] = [merged()]
                    size = len(parts[0][0])
                    if size > held // 2:
                        yield out(parts.pop())
                        size = 0
        if parts:
            yield out(merged())

    counted = whole_texts(df).select(df[text].alias("text")).mapInArrow(run, "hash bigint, ending int, n bigint")
    return counted.groupBy("hash").agg(F.max("ending").alias("ending"), F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """Head words and the sizes of the classes; all bounded."""

    head: np.ndarray  # sorted hashes
    head_n: np.ndarray
    class_n: np.ndarray  # tokens of tail words
    class_once: np.ndarray  # tail words seen once
    once: np.ndarray  # all words seen once, by class
    twice: int
    total: int  # training tokens, ends included
    distinct: int  # distinct training tokens, the end included
    texts: int

    @property
    def symbols(self) -> int:
        return len(self.head) + ENDINGS + 1

    @property
    def discount(self) -> float:
        n = float(self.once.sum())
        return n / (n + 2 * self.twice + 1)

    def freed(self) -> np.ndarray:
        """What the head's words give up, dealt to the classes."""
        share = self.once + 1.0
        return (self.discount * len(self.head) + 0.1) * share / share.sum()

    def unknown(self) -> np.ndarray:
        """The share of each class that its unknown word has."""
        freed = self.freed()
        return (self.discount * self.class_once + freed) / (self.class_n + freed)

    def unigram(self) -> np.ndarray:
        p = np.concatenate([self.head_n - self.discount, self.class_n + self.freed(), [self.texts + 0.1]])
        return p / p.sum()

    def sequences(self, texts: list[bytes], find: HashTable) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """words, their hashes, places in the head (-1: outside); symbols of all texts with their ends; where each text begins."""
        words = Words(texts, BY_SPACE)
        hashes = words.hashes()
        at = find.find(hashes)
        symbols = at.astype(np.int32)
        tail = np.flatnonzero(at < 0)
        symbols[tail] = len(self.head) + endings(words, tail)
        return words, hashes, at, np.insert(symbols, words.first[1:], self.symbols - 1), words.first + np.arange(len(words.first))


#: Sequences of over LONG tokens are taken in pieces of PIECE tokens, side by side.
LONG, PIECE = 2048, 512


def _abreast(symbols: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[list[int], list[int], np.ndarray]:
    """Sequences in descending length, side by side: how many have a token at each place, where the place's tokens begin, and the tokens' symbols, place by place."""
    live = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")
    at = np.concatenate([[0], np.cumsum(live)])
    which = np.arange(at[-1]) - np.repeat(at[:-1], live)
    return live.tolist(), at.tolist(), symbols[first[which] + np.repeat(np.arange(len(live)), live)].astype(np.intp)


@dataclass
class Hmm:
    """Weights of states are kept as states x sequences, so that each step is a few operations along many sequences."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # symbols x states

    @cached_property
    def by_state(self) -> np.ndarray:
        return np.ascontiguousarray(self.emit.T)

    @cached_property
    def every(self) -> int:
        """Double precision holds the weights of so many tokens unscaled: their sum keeps ``low`` of itself at least with each token."""
        low = np.vstack([self.step, self.start]).dot(self.by_state).min()
        return max(1, int(400 / max(1.0, -np.log(low)))) if low > 0 else 1

    def _transfers(self, symbols: np.ndarray, first: np.ndarray, length: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each piece, in descending length: the matrix its tokens take state weights through, and its scale's logarithm."""
        k, n = len(self.start), len(first)
        live, at, tokens = _abreast(symbols, first, length)
        m, logs = np.empty((k, k, n)), np.zeros(n)  # to, from, piece
        # a sequence's first token follows no step
        now = np.where(head, np.eye(k)[:, :, None], self.step.T[:, :, None])
        for t, d in enumerate(live):
            if t:
                now = (self.step.T @ now[:, :, :d].reshape(k, k * d)).reshape(k, k, d)
            now *= self.by_state.take(tokens[at[t] : at[t + 1]], axis=1)[:, None, :]
            if (t + 1) % self.every == 0:
                scale = now.max((0, 1))
                now /= scale
                logs[:d] += np.log(scale)
            stay = live[t + 1] if t + 1 < len(live) else 0
            m[:, :, stay:d] = now[:, :, stay:]
        scale = m.max((0, 1))
        return (m / scale).transpose(2, 1, 0), logs + np.log(scale)

    def _boundaries(self, symbols: np.ndarray, begin: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pieces of the long sequences: first token, length, sequence, the state weights that enter and, up to scale, those that follow."""
        k = len(self.start)
        n = -(-(begin[which + 1] - begin[which]) // PIECE)
        owner = np.repeat(which, n)
        part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first = begin[owner] + part * PIECE
        length = np.minimum(PIECE, begin[owner + 1] - first)
        order = np.argsort(-length, kind="stable")
        m, logs = np.empty((len(first), k, k)), np.empty(len(first))
        m[order], logs[order] = self._transfers(symbols, first[order], length[order], part[order] == 0)
        enter, follow, like = np.empty((len(first), k)), np.ones((len(first), k)), np.zeros(len(which))
        for i, (a, b) in enumerate(zip(np.cumsum(n) - n, np.cumsum(n))):
            v = self.start
            for p in range(a, b):
                enter[p] = v
                v = v @ m[p]
                total = v.sum()
                like[i] += np.log(total) + logs[p]
                v = v / total
            w = np.ones(k)
            for p in range(b - 1, a - 1, -1):
                follow[p] = w
                w = m[p] @ w
                w = w / w.max()
        return first, length, part, enter, follow, like

    def forward(self, symbols: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Natural log likelihood of each sequence symbols[begin[i]:begin[i + 1]]."""
        size = np.diff(begin)
        result = np.empty(len(size))
        far = np.flatnonzero(size > LONG)
        if len(far):
            result[far] = self._boundaries(symbols, begin, far)[5]
        near = np.flatnonzero(size <= LONG)
        order = near[np.argsort(-size[near], kind="stable")]
        live, at, tokens = _abreast(symbols, begin[order], size[order])
        out, last = np.zeros(len(order)), np.full((len(self.start), len(order)), 1 / len(self.start))
        alpha = np.empty(0)
        for t, d in enumerate(live):
            emit = self.by_state.take(tokens[at[t] : at[t + 1]], axis=1)
            alpha = (self.step.T @ alpha[:, :d] if t else self.start[:, None]) * emit
            if (t + 1) % self.every == 0:
                scale = alpha.sum(0)
                alpha /= scale
                out[:d] += np.log(scale)
            stay = live[t + 1] if t + 1 < len(live) else 0
            if stay < d:
                last[:, stay:d] = alpha[:, stay:]
        out += np.log(last.sum(0))
        result[order] = out
        return result

    def expect(self, symbols: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, steps and emissions: one E step of Baum-Welch."""
        return self.expect_and_like(symbols, begin)[:3]

    def expect_and_like(self, symbols: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """As expect, and the natural log likelihood of all sequences together.

        Long sequences come as pieces with what enters and what follows them,
        so the counts are those of whole sequences.
        """
        k, step = len(self.start), self.step.astype(np.float32)
        size = np.diff(begin)
        near, far = np.flatnonzero(size <= LONG), np.flatnonzero(size > LONG)
        first, length, head = begin[near], size[near], np.ones(len(near), bool)
        enter, follow = np.broadcast_to(self.start, (len(near), k)), np.ones((len(near), k))
        if len(far):
            f, n, part, e, w, _ = self._boundaries(symbols, begin, far)
            first, length, head = np.concatenate([first, f]), np.concatenate([length, n]), np.concatenate([head, part == 0])
            enter, follow = np.concatenate([enter, e]), np.concatenate([follow, w])
        order = np.argsort(-length, kind="stable")
        live, at, tokens = _abreast(symbols, first[order], length[order])
        n, head = len(order), head[order]
        before, follow = enter[order].T.astype(np.float32), follow[order].T.astype(np.float32)
        ahead = self.by_state.astype(np.float32).take(tokens, axis=1)
        gamma, scales, last = np.empty_like(ahead), np.empty(len(tokens), np.float32), np.empty((k, n), np.float32)
        alpha = np.empty(0)
        for t, d in enumerate(live):
            here, scale = gamma[:, at[t] : at[t + 1]], scales[at[t] : at[t + 1]]
            then = ahead[:, at[t] : at[t + 1]]
            moved = step.T @ alpha[:, :d] if t else np.where(head, before, step.T @ before)
            np.add.reduce(moved * then, 0, out=scale)
            then /= scale
            alpha = np.multiply(moved, then, out=here)
            stay = live[t + 1] if t + 1 < len(live) else 0
            if stay < d:
                last[:, stay:d] = here[:, stay:]
        steps = np.zeros((k, k))
        beta = follow / (last * follow).sum(0)  # of each sequence's end, then of each place of those that reach it
        for t in range(len(live) - 1, -1, -1):
            here, then = gamma[:, at[t] : at[t + 1]], ahead[:, at[t] : at[t + 1]]
            if t + 1 < len(live):
                was = live[t + 1]
                after = ahead[:, at[t + 1] : at[t + 2]]
                steps += here[:, :was] @ after.T
                beta[:, :was] = step @ after
            then *= beta[:, : live[t]]
            here *= beta[:, : live[t]]
        if n:
            steps += before[:, ~head] @ ahead[:, :n][:, ~head].T
        starts = gamma[:, :n][:, head].sum(1, dtype=float)
        emitted = np.stack([np.bincount(tokens, x, len(self.emit)) for x in gamma], 1)
        # a piece's scales follow from the weights that enter it, so theirs multiply to the sequence's likelihood
        return starts, steps * self.step, emitted, float(np.log(scales).sum(dtype=float))

    def expect_alone(self, symbols: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """As expect_and_like where no step leaves a state: each text is in one."""
        k, n = len(self.start), len(begin) - 1
        if not n:
            return np.zeros(k), np.zeros((k, k)), np.zeros((len(self.emit), k)), 0.0
        size, symbols = np.diff(begin), symbols.astype(np.intp)
        each = np.stack([np.add.reduceat(x.take(symbols), begin[:-1]) for x in np.log(self.by_state)], 1) + np.log(self.start)
        most = each.max(1, keepdims=True)
        weight = np.exp(each - most)
        total = weight.sum(1, keepdims=True)
        weight /= total
        emitted = np.stack([np.bincount(symbols, np.repeat(x, size), len(self.emit)) for x in weight.T], 1)
        return weight.sum(0), np.diag((size - 1) @ weight), emitted, float((most + np.log(total)).sum())

    @staticmethod
    def estimate(starts: np.ndarray, steps: np.ndarray, emitted: np.ndarray, unigram: np.ndarray, prior: float, alone: bool = False) -> Hmm:
        """The M step; the unigram distribution is the emissions' prior, with ``prior`` times a state's own weight."""
        emitted = emitted + (prior * emitted.sum(0) + 1.0) * unigram[:, None]
        start = (starts + 0.1) / (starts + 0.1).sum()
        # after passes without steps, a tenth of them may go anywhere
        step = 0.9 * np.eye(len(start)) + 0.1 * start if alone else (steps + 0.1) / (steps + 0.1).sum(1, keepdims=True)
        return Hmm(start, step, emitted / emitted.sum(0))


def beginning(lexicon: Lexicon, states: int, seed: int = 7) -> Hmm:
    """States whose emissions differ by fixed random factors."""
    noise = np.random.default_rng(seed).gamma(1.0, 1.0, (lexicon.symbols, states)) + 0.05
    emit = lexicon.unigram()[:, None] * noise
    return Hmm(np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), emit / emit.sum(0))


BLOCK = 512


def encoded(df: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """Each text's symbols as little-endian 32-bit numbers (written): what the passes read instead of texts."""
    sent = df.sparkSession.sparkContext.broadcast(lexicon)  # of fixed size: head and classes

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = HashTable(sent.value.head)
        for batch in batches(source):
            texts = texts_of(batch.column(0))
            for a, b in slices(texts):
                symbols, begin = sent.value.sequences(texts[a:b], find)[3:]
                body = pa.py_buffer(symbols.astype("<i4"))
                yield pa.RecordBatch.from_arrays([pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer((begin * 4).astype("<i8")), body]).cast(pa.binary())], names=["symbols"])

    return table(whole_texts(df).select(df[text].alias("text")).mapInArrow(run, "symbols binary"))


def expected_counts(sequences: DataFrame, lexicon: Lexicon, model: Hmm, alone: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """One E step over all rows of ``encoded``, and their log likelihood: summed by task, then by block of symbols across tasks."""
    states, symbols = model.emit.shape[1], lexicon.symbols
    sent = sequences.sparkSession.sparkContext.broadcast(model)  # of fixed size: symbols x states

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = sent.value.expect_alone if alone else sent.value.expect_and_like
        total = None
        for batch in gathered(batches(source, 4 << 20), 4 << 20):
            own = [np.frombuffer(x, "<i4") for x in batch.column(0).to_pylist()]
            part = step(np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])]))
            if total is None:
                total = list(part)
            else:
                for x, y in zip(total[:3], part):
                    x += y
                total[3] += part[3]
        if total is None:
            return
        flat = [np.concatenate([total[0], total[1].ravel(), [total[3]]])] + [total[2][i : i + BLOCK].ravel() for i in range(0, symbols, BLOCK)]
        salt = TaskContext.get().partitionId() // 64
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(np.full(len(flat), salt), pa.int32()), pa.array([x.astype("<f4" if i else "<f8").tobytes() for i, x in enumerate(flat)], pa.binary())], names=["block", "salt", "v"])

    def add(batch: pa.Table) -> pa.Table:
        kind = "<f4" if batch.column("block")[0].as_py() else "<f8"
        total = sum(np.frombuffer(v.as_py(), kind).astype(float) for v in batch.column("v"))
        return pa.table({"block": batch.column("block")[:1], "salt": pa.array([0], pa.int32()), "v": pa.array([total.astype(kind).tobytes()], pa.binary())})

    shape = "block int, salt int, v binary"
    summed = sequences.mapInArrow(run, shape).groupBy("block", "salt").applyInArrow(add, shape).groupBy("block").applyInArrow(add, shape)
    collected = summed.collect()
    sent.unpersist()
    blocks = {r.block: np.frombuffer(r.v, "<f4" if r.block else "<f8").astype(float) for r in collected}  # states x symbols numbers
    if not blocks:
        return np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states)), 0.0
    emitted = np.concatenate([blocks[i] for i in range(1, len(blocks))]).reshape(symbols, states)
    return blocks[0][:states], blocks[0][states:-1].reshape(states, states), emitted, float(blocks[0][-1])


@dataclass
class Trained:
    lexicon: Lexicon
    model: Hmm
    words: DataFrame


def train(df: DataFrame, text: str = "text", states: int = 12, head: int = 1 << 16, alone: int = 1, passes: int = 12, prior: float = 0.1, gain: float = 1e-3) -> Trained:
    """Learns from all rows of ``df``: ``alone`` passes without steps, then full ones until one gains at most ``gain`` of the log likelihood, ``passes`` at most."""
    words = table(word_counts(df, text))
    texts = df.count()
    class_n, class_once, distinct, twice = np.zeros(ENDINGS), np.zeros(ENDINGS), 0, 0
    times = lambda n, name: F.sum((F.col("n") == n).cast("int")).alias(name)
    for r in words.groupBy("ending").agg(F.sum("n").alias("n"), times(1, "once"), times(2, "twice"), F.count("*").alias("words")).collect():  # ENDINGS rows
        class_n[r.ending], class_once[r.ending] = r.n, r.once
        distinct += r.words
        twice += r.twice
    # a count that about head words reach, so that no more are ever sorted in one place
    least = 0
    if distinct > 2 * head:
        least = words.agg(F.percentile_approx("n", 1 - 1.2 * head / distinct, 10_000)).first()[0]
    top = words.where(F.col("n") >= least).orderBy(F.desc("n"), "hash").limit(head).select("hash", "ending", "n").toArrow()  # head rows at most
    top_hash = top.column("hash").to_numpy().view(np.uint64)
    top_n, top_ending = top.column("n").to_numpy(), top.column("ending").to_numpy()
    order = np.argsort(top_hash)
    total, once = int(class_n.sum()) + texts, class_once.copy()
    np.subtract.at(class_n, top_ending, top_n)
    np.subtract.at(class_once, top_ending, top_n == 1)
    lexicon = Lexicon(top_hash[order], top_n[order].astype(float), class_n, class_once, once, twice, total, distinct + (texts > 0), texts)
    sequences = encoded(df, lexicon, text)
    model, unigram = beginning(lexicon, states), lexicon.unigram()
    for _ in range(alone):
        model = Hmm.estimate(*expected_counts(sequences, lexicon, model, True)[:3], unigram, prior, True)
    before = -np.inf
    for _ in range(passes):
        *counts, like = expected_counts(sequences, lexicon, model)
        model = Hmm.estimate(*counts, unigram, prior)
        if like - before <= gain * abs(like):
            break
        before = like
    drop(sequences)
    return Trained(lexicon, model, words)


SCORES = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def score(df: DataFrame, trained: Trained, doc_id: str = "doc_id", text: str = "text", broadcast_words: int = 6_000_000) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10) of every row of ``df``."""
    lexicon, model = trained.lexicon, trained.model
    sc = df.sparkSession.sparkContext
    docs = whole_texts(df).select(df[doc_id].cast("bigint").alias("doc_id"), df[text].alias("text"))
    divisor = np.log10(lexicon.total + 0.1 * (lexicon.distinct + 1))
    sent = sc.broadcast((lexicon, model))  # of fixed size
    ends = np.log10((lexicon.texts if lexicon.texts else 0) + 0.1) - divisor
    known_end = int(lexicon.texts > 0)
    unknown = lexicon.unknown()
    small = lexicon.distinct <= broadcast_words
    counts = None
    if small:
        parts = []
        for top in range(16):  # by the hash's high bits: at most broadcast_words rows in all, a sixteenth at a time
            part = trained.words.where(F.shiftrightunsigned("hash", 60) == top).select("hash", "n").toArrow()
            keys, n = part.column("hash").to_numpy().view(np.uint64), part.column("n").to_numpy()
            order = np.argsort(keys)
            parts.append((keys[order], n[order].astype(np.int32 if lexicon.total < 2**31 else np.int64)))
        counts = sc.broadcast(tuple(np.concatenate(x) for x in zip(*parts)))
        del parts

    def share_logs(n: np.ndarray, ending: np.ndarray) -> np.ndarray:
        """log10 of the share of its class that each word outside the head has."""
        gap = unknown[ending]
        return np.log10(np.maximum(np.where(n > 0, (1 - gap) * n / np.maximum(lexicon.class_n[ending], 1), gap), 1e-300))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, model = sent.value
        find = HashTable(lexicon.head)
        if counts is not None:
            find_word, word_n = HashTable(counts.value[0]), counts.value[1]
        for batch in gathered(batches(source), 4 << 20):
            texts = texts_of(batch.column(1))
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for a, b in slices(texts, 4 << 20):
                words, hashes, at, symbols, begin = lexicon.sequences(texts[a:b], find)
                like = model.forward(symbols, begin) / np.log(10)
                owner = np.repeat(np.arange(b - a), words.counts)
                per = lambda x: np.bincount(owner, x, b - a)[: b - a]
                known, base = np.zeros(b - a), np.zeros(b - a)
                if counts is not None:
                    tail = np.flatnonzero(at < 0)
                    n = (lexicon.head_n[at] if len(lexicon.head) else np.zeros(len(at))).astype(np.int64)
                    where = find_word.find(hashes[tail])
                    n[tail] = np.where(where >= 0, word_n[where] if len(word_n) else 0, 0)
                    known, base = per(n > 0), per(np.log10(n + 0.1) - divisor)
                    like = like + np.bincount(owner[tail], share_logs(n[tail], endings(words, tail)), b - a)[: b - a]
                columns[0].append(words.counts + 1)
                columns[1].append(known + known_end)
                columns[2].append(base + ends)
                columns[3].append(like)
            merged = [np.concatenate(c) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c.astype(np.int64)) for c in merged[:2]), *(pa.array(c, pa.float64()) for c in merged[2:])], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    if small:
        return docs.mapInArrow(run, SCORES)

    def distinct_words(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, _ = sent.value
        find = HashTable(lexicon.head)
        for batch in batches(source, 2 << 20):
            texts = texts_of(batch.column(1))
            k1, k2 = (batch.column(i).to_numpy() for i in (2, 3))
            for a, b in slices(texts, 4 << 20):
                words = Words(texts[a:b], BY_SPACE)
                hashes, ending = words.hashes(), endings(words)
                owner = np.repeat(np.arange(a, b), words.counts)
                order = np.lexsort((hashes, owner))
                o, h = owner[order], hashes[order]
                new = np.flatnonzero(np.concatenate([[True], (np.diff(o) != 0) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(h)))
                yield pa.RecordBatch.from_arrays([pa.array(k1[o[new]]), pa.array(k2[o[new]]), pa.array(h[new].view(np.int64)), pa.array(ending[order][new].astype(np.int32)), pa.array(find.find(h[new]) >= 0), pa.array(times.astype(np.int64))], names=["k1", "k2", "hash", "ending", "in_head", "times"])

    # the way beyond the bound: words of each distinct (id, text) meet the counts by hash, whole rows meet the sums by that key
    keyed = docs.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit(1), "text", "doc_id")})
    met = keyed.dropDuplicates(["k1", "k2"]).mapInArrow(distinct_words, "k1 bigint, k2 bigint, hash bigint, ending int, in_head boolean, times bigint").join(trained.words.select("hash", "n"), "hash", "left")

    def logs(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            ending, in_head, times = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            n = batch.column(5).fill_null(0).to_numpy()
            base, tail = np.log10(n + 0.1) - divisor, np.where(in_head, 0.0, share_logs(n, ending))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(times * (n > 0)), pa.array(base * times), pa.array(tail * times)], names=["k1", "k2", "known", "base", "tail"])

    sums = met.select("k1", "k2", "ending", "in_head", "times", "n").mapInArrow(logs, "k1 bigint, k2 bigint, known bigint, base double, tail double").groupBy("k1", "k2").agg(F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("tail").alias("tail"))
    liked = keyed.mapInArrow(lambda source: (pa.RecordBatch.from_arrays([*out.columns, *b.columns[2:]], names=[*out.schema.names, "k1", "k2"]) for b in batches(source) for out in run([b])), SCORES + ", k1 bigint, k2 bigint")
    full = liked.join(sums, ["k1", "k2"], "left")
    return full.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("tail", F.lit(0.0))).alias("score"),
    )
