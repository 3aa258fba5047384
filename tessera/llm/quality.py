"""Document quality by regularised quadratic discriminant analysis.

Statistics of a whole text, transformed to be closer to normal, are scored by
the difference of two Gaussian log densities.  Each class covariance is shrunk
toward the pooled one and toward its diagonal; its Cholesky factor is computed
once and gives both the Mahalanobis distance and the determinant.  Training
needs only each class's count, sum and sum of outer products, which are added
up over all labelled documents, so the driver sees a few hundred numbers
whatever the corpus.  The log-density difference is turned into a probability
by a monotone step function fitted on the labelled documents' difference
histogram (bounded bins), since Gaussian posteriors are far too sure.

Defined cases: a null text counts as empty; an empty text has a score; repeated
rows are scored each; documents without a label do not train; with one class
missing every score is that class's rate; labels that are null do not count.
An empty table gives no rows, very long texts are taken a slice of texts at a time,
other columns are ignored or, by ``keep``, kept, whatever their names; a text whose
label is given as 0 and as 1 counts as both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.cluster import whole_texts
from tessera.llm.textkit import BY_SPACE, Words, batches, slices, texts_of

NAMES = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "symbol", "comma_stop", "high_byte", "words_a_line", "distinct", "repeat_next", "symbol_end", "bar_word", "bang_word", "capital_word", "short_word", "log_lines", "commonest_word",
)

_KIND = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = 1 if "A" <= _c <= "Z" else 2 if "a" <= _c <= "z" else 3 if "0" <= _c <= "9" else 4 if _c in ",." else 5 if 0x80 <= _b else 6 if _c in " \t\r\v\f" else 7 if _c == "\n" else 8


def _per(index: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(index, weights, n)[:n].astype(float)


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of len(NAMES) transformed statistics for each text."""
    return np.concatenate([_statistics(texts[a:b]) for a, b in slices(texts)]) if texts else np.zeros((0, len(NAMES)))


def _statistics(texts: list[bytes]) -> np.ndarray:
    n = len(texts)
    words = Words(texts, BY_SPACE)
    raw = np.frombuffer(b" ".join(texts), np.uint8)
    kind = _KIND[raw]
    size = np.fromiter((len(t) for t in texts), float, n)
    owner = np.repeat(np.arange(n), np.diff(words.begin))[: len(raw)]
    count = lambda k: _per(owner[kind == k], n)
    w = words.counts.astype(float)
    word_of = np.repeat(np.arange(n), words.counts)
    h = words.hashes()
    length = (words.ends - words.starts).astype(float)
    first, last = raw[words.starts], raw[words.ends - 1]
    second_last = raw[np.maximum(words.ends - 2, words.starts)]
    upper_word = (_KIND[first] == 1) & (_KIND[raw[np.minimum(words.starts + 1, words.ends - 1)]] == 1)
    pairs = np.stack([word_of, h.view(np.int64)])
    order = np.lexsort((pairs[1], pairs[0]))
    new = np.ones(len(h), bool)
    new[1:] = (np.diff(pairs[0][order]) != 0) | (np.diff(pairs[1][order]) != 0)
    distinct = _per(word_of[order][new], n)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (word_of[1:] == word_of[:-1])
    lines = count(7)
    per_byte, per_word = np.maximum(size, 1), np.maximum(w, 1)
    # how often a text's words come again, by the share of the commonest
    groups = np.flatnonzero(new)
    runs = np.diff(np.append(groups, len(h)))
    most = np.zeros(n)
    np.maximum.at(most, word_of[order][groups], runs)
    root = lambda x: np.arcsin(np.sqrt(np.clip(x, 0, 1)))
    return np.column_stack(
        [
            np.log1p(size),
            np.log1p(w),
            np.log1p(_per(word_of, n, length) / per_word),
            root(count(1) / per_byte),
            root(count(3) / per_byte),
            root(count(8) / per_byte),
            root(count(4) / per_byte),
            root(count(5) / per_byte),
            np.log1p(w / (lines + 1)),
            np.log(np.maximum(distinct, 1)) / np.log(per_word + 1),
            root(_per(word_of[same], n) / per_word),
            root(_per(word_of[_KIND[last] == 8], n) / per_word),
            root(_per(word_of[(length == 1) & (_KIND[last] == 8)], n) / per_word),
            root(_per(word_of[(_KIND[last] == 8) & (_KIND[second_last] == 8)], n) / per_word),
            root(_per(word_of[upper_word], n) / per_word),
            root(_per(word_of[length <= 3], n) / per_word),
            np.log1p(lines),
            np.log1p(most / np.sqrt(per_word)),
        ]
    )


STATISTICS = "doc_id bigint, x binary"


def features(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the statistics as little-endian doubles, in one pass over whole texts."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            x = statistics(texts_of(batch.column(1))).astype("<f8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])

    return whole_texts(df).select(df[doc_id].cast("bigint").alias("doc_id"), df[text].alias("text")).mapInArrow(run, STATISTICS)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, len(NAMES))


@dataclass(frozen=True)
class Gaussian:
    mean: np.ndarray
    factor: np.ndarray  # lower Cholesky factor of the shrunk covariance
    whiten: np.ndarray  # its inverse, made once
    half_log_det: float

    @classmethod
    def of(cls, mean: np.ndarray, covariance: np.ndarray) -> Gaussian:
        factor = np.linalg.cholesky(covariance)
        return cls(mean, factor, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()))

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = self.whiten @ (x - self.mean).T
        return -0.5 * (z * z).sum(0) - self.half_log_det


@dataclass(frozen=True)
class Discriminant:
    """Scores of statistics; ``edges`` and ``rates`` turn log-density differences into probabilities."""

    classes: tuple[Gaussian, Gaussian] | None
    edges: np.ndarray
    rates: np.ndarray

    def difference(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.zeros(len(x))
        return np.clip(self.classes[1].log_density(x) - self.classes[0].log_density(x), -500, 500)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.difference(x), self.edges, self.rates)


def _fit(moments: list[tuple[float, np.ndarray, np.ndarray]], shrink: float, diagonal: float) -> tuple[Gaussian, Gaussian]:
    means = [s / n for n, s, _ in moments]
    spread = [q / n - np.outer(m, m) for (n, _, q), m in zip(moments, means)]
    pooled = sum(n * c for (n, _, _), c in zip(moments, spread)) / sum(n for n, _, _ in moments)
    out = []
    for (n, _, _), mean, own in zip(moments, means, spread):
        c = (1 - shrink) * own + shrink * pooled
        c = (1 - diagonal) * c + diagonal * np.diag(np.diag(pooled))
        out.append(Gaussian.of(mean, c + 1e-6 * np.eye(len(mean))))
    return out[0], out[1]


def _monotone(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Isotonic regression by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v1, w1, n1 = blocks.pop()
            v0, w0, n0 = blocks.pop()
            blocks.append([(v0 * w0 + v1 * w1) / (w0 + w1), w0 + w1, n0 + n1])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks])


def fit(labelled: DataFrame, label: str = "label", shrink: float = 0.1, diagonal: float = 0.02, bins: int = 200) -> Discriminant:
    """Learns from rows (x, label 0/1) of ``labelled``: sums over all rows, then a histogram over all rows."""
    d = len(NAMES)

    def sums(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
        for batch in source:
            x, y = _matrix(batch.column(0)), np.array(batch.column(1).to_pylist(), dtype=int)
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([k for k in total for _ in range(1 + d + d * d)], pa.int32()), pa.array([i for _ in total for i in range(1 + d + d * d)], pa.int32()), pa.array(np.concatenate(list(total.values())))], names=["k", "i", "v"])

    rows = labelled.select("x", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    moments = [np.zeros(1 + d + d * d) for _ in (0, 1)]
    for k, i, v in rows.mapInArrow(sums, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v")).collect():  # 2 (1 + d + d d) numbers
        moments[k][i] = v
    parts = [(m[0], m[1 : d + 1], m[d + 1 :].reshape(d, d)) for m in moments]
    if min(p[0] for p in parts) < 2:
        total = sum(p[0] for p in parts)
        rate = float(parts[1][0] / total) if total else 0.5
        return Discriminant(None, np.array([-1.0, 1.0]), np.array([rate, rate]))
    classes = _fit(parts, shrink, diagonal)
    raw = Discriminant(classes, np.zeros(0), np.zeros(0))
    # equal steps of a squashed difference: fine near 0, coarse far out
    squash = lambda v: np.tanh(v / 40)

    def counts(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, bins))
        for batch in source:
            y = np.array(batch.column(1).to_pylist(), dtype=int)
            at = np.minimum(((squash(raw.difference(_matrix(batch.column(0)))) + 1) / 2 * bins).astype(int), bins - 1)
            for k in (0, 1):
                out[k] += np.bincount(at[y == k], minlength=bins)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], bins), pa.int32()), pa.array(np.tile(np.arange(bins), 2), pa.int32()), pa.array(out.ravel())], names=["k", "i", "v"])

    hist = np.zeros((2, bins))
    for k, i, v in rows.mapInArrow(counts, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v")).collect():  # 2 bins numbers
        hist[k, i] = v
    prior = hist[1].sum() / hist.sum()
    weight = hist.sum(0) + 1e-3
    rates = _monotone((hist[1] + 1e-3 * prior) / weight, weight)
    middle = 40 * np.arctanh(np.clip((np.arange(bins) + 0.5) / bins * 2 - 1, -1 + 1e-9, 1 - 1e-9))
    used = np.flatnonzero(hist.sum(0) > 0)
    return Discriminant(classes, middle[used], np.clip(rates[used], 0, 1))


def score(scored: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id and score from ``features``."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))), pa.float64())], names=["doc_id", "score"])

    return scored.select("doc_id", "x").mapInArrow(run, "doc_id bigint, score double")


def keep(df: DataFrame, model: Discriminant, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``df``, all columns kept, that score ``least`` or more; nothing is shuffled."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            x = statistics(texts_of(batch.column(batch.schema.get_field_index(text))))
            yield batch.filter(pa.array(model.score(x) >= least))

    return whole_texts(df).mapInArrow(run, df.schema)
