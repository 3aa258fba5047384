"""Toxic passages: maximal segments of token log-odds, judged by extreme values.

Learning.  A word stands in a chain of nodes: its first 3, 4, ... 7 bytes and the whole
word.  For every node the labelled documents that hold it are counted by class, each
document once.  A node's rate of toxic documents has a Dirichlet prior of ``prior``
documents at its parent's rate, where a parent counts only documents that its child
on the chain does not have, so no document is evidence twice; the root is the share of toxic documents.
A word's score is the log odds of its rate over the root's, drawn to zero by one
standard deviation, less ``drift``.  A word's k-th occurrence in a document
has a k*k-th of its score if that is positive, as documents were counted and not occurrences.

Search.  All maximal scoring segments of a document are found in one scan of its
cumulated scores.  Only words of positive score start or end one, so the scan itself goes over those alone.

Judgement.  In clean text, segments of score x or more come as often as K n exp(-lambda x)
in n words: their expected number is the passage's E-value.  lambda and K are
fitted to the highest segments of the clean labelled documents, each scored with its own
counts taken out.  Passages of an E-value up to ``significance`` are toxic
passages; a document's statistic is the sum of their -log E, or, without any, the
largest -log E.  A monotone step function of the statistic, fitted to the labelled documents in
the same way, is the score.

What learns is bounded: the labelled documents by the caller, the nodes by ``size``;
beyond it the rarest nodes go and their documents count for their parents.  All
documents are scored whole where they lie, with the model broadcast.

Defined cases: a null, empty or wordless text has no passage and the statistic 0;
repeated rows are scored each; labels other than 0 and 1 do not count; with one class
missing every score is that class's rate, without labels 0.5; an empty table gives no rows; other columns are ignored,
whatever their names; very long texts are taken a slice of texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.cluster import table, whole_texts
from tessera.llm.quality import _monotone
from tessera.llm.textkit import BY_ALNUM, LOW, HashTable, Words, batches, lanes, mix, slices, texts_of

PREFIXES = (3, 4, 5, 6, 7)
#: Steps of the histograms of segment scores and of statistics; the last bin holds all beyond.
STEP, BINS = 0.05, 4000
STATISTIC_STEP, STATISTIC_BINS = 0.25, 400


def chains(words: Words, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level which of the words ``at`` have a node there, and the nodes' keys."""
    eight, length = lanes(words.data)[words.starts[at]], (words.ends - words.starts)[at]
    levels = [(length > k, mix((eight & LOW[k]) ^ np.uint64(k << 56))) for k in PREFIXES]
    return [*levels, (np.ones(len(at), bool), words.hashes()[at])]


@dataclass(frozen=True)
class Lexicon:
    """Documents of each class by node, keys sorted."""

    keys: np.ndarray
    toxic: np.ndarray
    clean: np.ndarray
    root: float
    prior: float
    drift: float

    def scores(self, words: Words, at: np.ndarray, find: HashTable, own: int | None = None) -> np.ndarray:
        """Scores of the words ``at``; ``own`` is the class of the document they are in, if it is one that was counted."""
        counted = []
        for has, keys in chains(words, at):
            place = np.where(has, find.find(keys), -1)
            found = place >= 0
            pair = [np.where(found, c[place], 0).astype(float) if len(c) else np.zeros(len(at)) for c in (self.clean, self.toxic)]
            if own is not None:
                pair[own] = np.maximum(pair[own] - 1, 0)
            counted.append((has, *pair))
        rate = np.full(len(at), self.root)
        a, b = self.prior * rate, self.prior * (1 - rate)
        for k, (has, clean, toxic) in enumerate(counted):
            below = np.zeros(len(at), bool)
            for deeper, c, t in counted[k + 1 :]:
                first = deeper & ~below
                clean, toxic = np.where(first, np.maximum(clean - c, 0), clean), np.where(first, np.maximum(toxic - t, 0), toxic)
                below |= deeper
            a, b = np.where(has, toxic + self.prior * rate, a), np.where(has, clean + self.prior * (1 - rate), b)
            rate = np.clip(a / (a + b), 1e-9, 1 - 1e-9)
        odds = np.log(rate / (1 - rate)) - np.log(self.root / (1 - self.root))
        return np.sign(odds) * np.maximum(np.abs(odds) - np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)), 0) - self.drift


def maximal_segments(before: list[float], after: list[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments, as (score, first, last), from the cumulated scores before and after each positive item.

    Each candidate keeps the nearest earlier one that begins lower, so that every
    item is looked at a bounded number of times.
    """
    found: list[tuple[float, float, int, int, int]] = []  # begin, end, nearest lower, first, last
    for i, (low, high) in enumerate(zip(before, after)):
        first = i
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][0] >= low:
                j = found[j][2]
            if j < 0 or found[j][1] >= high:
                found.append((low, high, j, first, i))
                break
            low, first = found[j][0], found[j][3]
            nearest = found[j][2]
            del found[j:]
            j = nearest
    return [(high - low, first, last) for low, high, _, first, last in found]


Segment = tuple[float, int, int]  # score, first word, word after the last


def segments(texts: list[bytes], lexicon: Lexicon, find: HashTable, own: list[int] | None = None) -> Iterator[tuple[Words, int, list[Segment]]]:
    """For each text its slice's words, its place there, and its maximal segments."""
    for a, b in slices(texts):
        words = Words(texts[a:b], BY_ALNUM)
        _, at, number = np.unique(words.hashes(), return_index=True, return_inverse=True)
        text = np.repeat(np.arange(b - a), words.counts)
        if own is None:
            score = lexicon.scores(words, at, find)[number]
        else:
            each = np.stack([lexicon.scores(words, at, find, k) for k in (0, 1)])
            score = each[np.array(own[a:b], int)[text], number] if len(text) else np.zeros(0)
        positive = np.flatnonzero(score > 0)
        order = positive[np.lexsort((positive, number[positive], text[positive]))]
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(text[order]) != 0) | (np.diff(number[order]) != 0)
        begin = np.flatnonzero(new)
        nth = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order)))) + 1.0
        score[order] = (score[order] + lexicon.drift) / nth**2 - lexicon.drift
        positive = np.flatnonzero(score > 0)
        total = np.concatenate([[0.0], np.cumsum(score)])
        edges = np.searchsorted(positive, words.first)
        before, after = total[positive].tolist(), total[positive + 1].tolist()
        for i in range(b - a):
            lo, hi, first = int(edges[i]), int(edges[i + 1]), int(words.first[i])
            yield words, i, [(s, int(positive[lo + x]) - first, int(positive[lo + y]) - first + 1) for s, x, y in maximal_segments(before[lo:hi], after[lo:hi])]


@dataclass(frozen=True)
class Tail:
    """Expected numbers of segments in clean text, and the score of documents."""

    rate: float  # lambda
    log_k: float
    significance: float
    statistics: np.ndarray
    scores: np.ndarray

    def log_e(self, scores: np.ndarray, n_words: int) -> np.ndarray:
        return self.log_k + np.log(max(n_words, 1)) - self.rate * scores

    def statistic(self, scores: np.ndarray, n_words: int) -> float:
        evidence = -self.log_e(scores, n_words)
        least = -np.log(self.significance)
        if not len(evidence):
            return 0.0
        strong = evidence[evidence >= least]
        return float(strong.sum()) if len(strong) else max(float(evidence.max()), 0.0)

    def score(self, statistic: np.ndarray) -> np.ndarray:
        return np.interp(statistic, self.statistics, self.scores)


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    tail: Tail


def _constant(score: float, lexicon: Lexicon, significance: float) -> Model:
    return Model(lexicon, Tail(1.0, 0.0, significance, np.zeros(1), np.array([score])))


def _node_counts(labelled: DataFrame) -> DataFrame:
    """key, toxic and clean documents (written)."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            texts, label = texts_of(batch.column(0)), np.array(batch.column(1).to_pylist(), int)
            for a, b in slices(texts):
                words = Words(texts[a:b], BY_ALNUM)
                text = np.repeat(np.arange(a, b), words.counts)
                key, of = [], []
                for has, keys in chains(words, np.arange(len(words.starts))):
                    key.append(keys[has])
                    of.append(text[has])
                pairs = np.unique(np.rec.fromarrays([np.concatenate(key), np.concatenate(of)], names="k,t"))
                keys, at = np.unique(pairs["k"], return_inverse=True)
                toxic = np.bincount(at, label[pairs["t"]], len(keys)).astype(np.int64)
                every = np.bincount(at, minlength=len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(toxic), pa.array(every - toxic)], names=["key", "toxic", "clean"])

    rows = whole_texts(labelled).select("text", "label").mapInArrow(run, "key bigint, toxic bigint, clean bigint")
    return table(rows.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic + clean >= 2"))


def fit(labelled: DataFrame, prior: float = 3.0, drift: float = 0.3, significance: float = 0.02, extreme: float = 0.03, size: int = 2_000_000) -> Model:
    """Learns from rows (text, label 0 or 1) of ``labelled``, of which the caller has bounded the number.

    ``extreme`` is the share of clean documents' segments that the tail is fitted to.
    """
    labelled = table(labelled.select("text", F.col("label").cast("int").alias("label")).where(F.col("label").isin(0, 1)))
    clean, toxic = labelled.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).first()
    root = toxic / (clean + toxic) if clean + toxic else 0.5
    nothing = Lexicon(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), min(max(root, 1e-9), 1 - 1e-9), prior, drift)
    if not clean or not toxic:
        return _constant(root, nothing, significance)
    counts = _node_counts(labelled)
    # the most nodes that fit, by documents; at most 1,000 numbers
    sizes = sorted(counts.groupBy(F.least(F.col("toxic") + F.col("clean"), F.lit(1000)).alias("n")).count().collect(), reverse=True)
    least, held = 1000, 0
    for n, more in sizes:
        held += more
        if held > size:
            break
        least = n
    got = counts.where(F.col("toxic") + F.col("clean") >= least).orderBy(F.desc(F.col("toxic") + F.col("clean")), "key").limit(size).toArrow()  # ``size`` rows at most
    keys = got.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    lexicon = Lexicon(keys[order], got.column("toxic").to_numpy()[order].astype(np.int32), got.column("clean").to_numpy()[order].astype(np.int32), root, prior, drift)
    sent = labelled.sparkSession.sparkContext.broadcast(lexicon)

    def alone(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = HashTable(sent.value.keys)
        for batch in batches(source):
            label = batch.column(1).to_pylist()
            found = [(int(w.counts[i]), [s for s, _, _ in own]) for w, i, own in segments(texts_of(batch.column(0)), sent.value, find, label)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.list_(pa.float64()))], names=["label", "n", "scores"])

    judged = table(whole_texts(labelled).mapInArrow(alone, "label int, n bigint, scores array<double>"))
    sent.destroy()
    bins = judged.where("label = 0").select(F.explode("scores").alias("s")).groupBy(F.least(F.floor(F.col("s") / STEP), F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.count("s").alias("n"), F.sum("s").alias("s")).orderBy(F.desc("bin")).collect()
    words = judged.where("label = 0").agg(F.sum("n")).first()[0] or 0
    if not bins or not words:
        return _constant(root, lexicon, significance)
    total, over, mass = sum(r.n for r in bins), 0, 0.0
    for r in bins:  # from the highest on
        over, mass, edge = over + r.n, mass + r.s, r.bin * STEP
        if over >= extreme * total:
            break
    rate = 1 / max(mass / over - edge, STEP)
    tail = Tail(rate, float(np.log(over / words) + rate * edge), significance, np.zeros(1), np.array([root]))

    def statistics(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            value = [tail.statistic(np.array(s), n) for n, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            at = np.minimum((np.array(value) / STATISTIC_STEP).astype(np.int32), STATISTIC_BINS - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int32())], names=["label", "bin"])

    hist = np.zeros((2, STATISTIC_BINS))
    for label, at, n in judged.mapInArrow(statistics, "label int, bin int").groupBy("label", "bin").count().collect():  # 2 STATISTIC_BINS numbers
        hist[label, at] = n
    used = np.flatnonzero(hist.sum(0))
    rates = _monotone(hist[1, used] / hist[:, used].sum(0), hist[:, used].sum(0))
    return Model(lexicon, Tail(rate, tail.log_k, significance, (used + 0.5) * STATISTIC_STEP, rates))


PASSAGE = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64()), ("text", pa.string())])
PASSAGE_TYPE = "struct<start:bigint,stop:bigint,score:double,e_value:double,text:string>"


def score(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, score, and passages: the toxic ones, by words from ``start`` up to ``stop``, with their texts."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, tail = sent.value.lexicon, sent.value.tail
        find = HashTable(lexicon.keys)
        for batch in batches(source):
            texts, counts, statistic, listed = texts_of(batch.column(1)), [], [], []
            for r, (words, i, own) in enumerate(segments(texts, lexicon, find)):
                n, first, origin = int(words.counts[i]), int(words.first[i]), int(words.begin[i])
                values = np.array([s for s, _, _ in own])
                counts.append(n)
                statistic.append(tail.statistic(values, n))
                listed.append([])
                for (s, x, y), e in zip(own, np.exp(tail.log_e(values, n)).tolist()):
                    if e <= tail.significance:
                        passage = texts[r][words.starts[first + x] - origin : words.ends[first + y - 1] - origin].decode()
                        listed[-1].append({"start": x, "stop": y, "score": s, "e_value": e, "text": passage})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(tail.score(np.array(statistic)), pa.float64()), pa.array(listed, pa.list_(PASSAGE))], names=["doc_id", "n_words", "score", "passages"])

    return whole_texts(df).select(df[doc_id].cast("bigint").alias("doc_id"), df[text].alias("text")).mapInArrow(run, f"doc_id bigint, n_words bigint, score double, passages array<{PASSAGE_TYPE}>")
