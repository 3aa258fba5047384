"""Runs of periodic words: a harmonic grid of longest common extensions by prefix hashes.

A run is a stretch of words with smallest period q, at least ``exponent`` periods
and ``least`` words long, that no neighbour extends.  The words a period p apart
are then equal over a stretch of (exponent - 1) p words or more, so one of the
places 0, s, 2s, ... lies in it, with s = (exponent - 1) p: n / s places for a period,
n log n / (exponent - 1) in all.  For all pairs (period, place) of a slice of texts at
once the two words are compared; where they are equal, one binary search over prefix
hashes finds how far equality reaches to both sides.  Each stretch is kept under
its least period, which takes multiples of a period away, and its words are then
compared one by one.  Only hashes that are equal for different words could make a
stretch too long, never too short; a text where that shows is taken again by
comparing words at every place.  Word numbers are those of the words' bytes.

Everything happens where a text lies: nothing is shuffled, and a task holds one
slice of texts, or one long text, with at most ``PAIRS`` pairs.

Defined cases: a null or empty text, or one of white space, has no words and no runs;
repeated rows are rows each; a null id is kept; an empty table gives no rows; other
columns are ignored, or kept by ``collapse``, whatever their names; a text of any
length is taken whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.cluster import whole_texts
from tessera.llm.textkit import BY_SPACE_AS_IS, Words, batches, same_bytes, slices, texts_of

#: Pairs (period, place) that are looked at together.
PAIRS = 1 << 20
#: Two random bases modulo a prime whose products fit in 64 bits; fixed, so that every executor has the same.
PRIME = np.uint64((1 << 31) - 1)
BASES = (np.uint64(1_340_157_138), np.uint64(761_908_547))

#: Runs of one text: start, length and period, by start, then period.
Runs = np.ndarray


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        step = np.uint64(pow(int(base), done, int(PRIME)))
        out[done : done + more] = out[:more] * step % PRIME
        done += more
    return out


class Extensions:
    """How far words ``period`` apart stay equal, by prefix hashes modulo a prime under two bases."""

    def __init__(self, ids: np.ndarray) -> None:
        value = ids.astype(np.uint64) + np.uint64(1)
        self.up = [_powers(b, len(ids) + 1) for b in BASES]
        self.sums = []
        for up in self.up:
            prefix = np.zeros(len(ids) + 1, np.uint64)
            np.cumsum(value % PRIME * up[:-1] % PRIME, out=prefix[1:])  # below 2**31 words times 2**31
            self.sums.append(prefix)

    def _same(self, start: np.ndarray, size: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Whether ``size`` words from ``start`` on have the hash of those a period later."""
        out = np.ones(len(start), bool)
        for prefix, up in zip(self.sums, self.up):
            here = (prefix[start + size] - prefix[start]) % PRIME * up[period] % PRIME
            out &= here == (prefix[start + period + size] - prefix[start + period]) % PRIME
        return out

    def reach(self, start: np.ndarray, period: np.ndarray, most: np.ndarray, forward: bool) -> np.ndarray:
        """The largest size up to ``most`` whose hashes are equal, from ``start`` on or before it."""
        low, high = np.zeros(len(start), np.int64), most.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_] + 1) // 2
            begin = start[open_] if forward else start[open_] - middle
            same = self._same(begin, middle, period[open_])
            low[open_[same]] = middle[same]
            high[open_[~same]] = middle[~same] - 1


def _slots(counts: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of entries whose counts sum to about ``limit``."""
    total = np.cumsum(counts)
    at = 0
    while at < len(counts):
        stop = int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, "right"))
        stop = max(stop, at + 1)
        yield at, stop
        at = stop


def _grid(first: np.ndarray, size: np.ndarray, least: int, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of the grid: text, period and place of each pair."""
    n_periods = np.where(size >= least, size // exponent, 0)
    for a, b in _slots(n_periods, PAIRS):  # all periods of some texts, or one text's
        text = np.repeat(np.arange(a, b), n_periods[a:b])
        period = np.arange(len(text)) - np.repeat(np.cumsum(n_periods[a:b]) - n_periods[a:b], n_periods[a:b]) + 1
        step = np.maximum((exponent - 1) * period, least - period)
        places = (size[text] - period - 1) // step + 1
        for c, d in _slots(places, PAIRS):
            of = np.repeat(np.arange(c, d), places[c:d])
            k = np.arange(len(of)) - np.repeat(np.cumsum(places[c:d]) - places[c:d], places[c:d])
            yield text[of], period[of], first[text[of]] + k * step[of]


def _least_periods(text: np.ndarray, start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Indices of one entry for each (text, start, stop), that of the least period, ordered by text, start, period."""
    order = np.lexsort((period, stop, start, text))
    new = np.ones(len(order), bool)
    for column in (text, start, stop):
        new[1:] &= column[order][1:] == column[order][:-1]
    new[1:] = ~new[1:]
    kept = order[new]
    return kept[np.lexsort((period[kept], start[kept], text[kept]))]


def _plain(ids: np.ndarray, least: int, exponent: int) -> Runs:
    """The runs of one text by comparing words at every place, for every period."""
    found = []
    for p in range(1, len(ids) // exponent + 1 if len(ids) >= least else 1):
        flags = np.concatenate([[0], (ids[:-p] == ids[p:]).astype(np.int8), [0]])
        edge = np.flatnonzero(np.diff(flags))
        found += [(s, e + p, p) for s, e in zip(edge[0::2].tolist(), edge[1::2].tolist()) if e + p - s >= max(least, exponent * p)]
    at = np.array(found, np.int64).reshape(-1, 3)
    at = at[_least_periods(np.zeros(len(at), np.int64), at[:, 0], at[:, 1], at[:, 2])]
    return np.column_stack([at[:, 0], at[:, 1] - at[:, 0], at[:, 2]])


def runs_of(ids: np.ndarray, first: np.ndarray, least: int = 6, exponent: int = 4) -> list[Runs]:
    """The runs of each of several texts; ``ids`` are their words' numbers one after another, text i from first[i] to first[i + 1]."""
    first = np.asarray(first, np.int64)
    size = np.diff(first)
    none = np.zeros((0, 3), np.int64)
    extensions, found = None, []
    for text, period, place in _grid(first[:-1], size, least, exponent):
        equal = np.flatnonzero(ids[place] == ids[place + period])
        if not len(equal):
            continue
        text, period, place = text[equal], period[equal], place[equal]
        extensions = extensions or Extensions(ids)
        after = extensions.reach(place, period, first[text + 1] - period - place, True)
        before = extensions.reach(place, period, place - first[text], False)
        whole = before + after + period
        long = whole >= np.maximum(least, exponent * period)
        rows = np.column_stack([text, place - before, place + after + period, period])[long]
        found.append(rows[_least_periods(*rows.T)])
    if not found:
        return [none] * len(size)
    at = np.concatenate(found)
    at = at[_least_periods(*at.T)]
    out = [none] * len(size)
    edges = np.searchsorted(at[:, 0], np.arange(len(size) + 1))
    for i in np.flatnonzero(np.diff(edges)).tolist():
        own = at[edges[i] : edges[i + 1], 1:]
        if all((ids[s : e - p] == ids[s + p : e]).all() for s, e, p in own.tolist()):
            out[i] = np.column_stack([own[:, 0] - first[i], own[:, 1] - own[:, 0], own[:, 2]])
        else:
            out[i] = _plain(ids[first[i] : first[i + 1]], least, exponent)
    return out


def numbered(words: Words) -> np.ndarray:
    """A number for each word, equal where and only where the words' bytes are."""
    _, at, ids = np.unique(words.hashes(), return_index=True, return_inverse=True)
    length = words.ends - words.starts
    of = at[ids]
    same = length == length[of]
    same[same] = same_bytes(words.data, words.starts[same], words.data, words.starts[of[same]], length[same])
    if same.all():
        return ids.astype(np.int64)
    seen: dict[bytes, int] = {}  # different words of one hash
    return np.array([seen.setdefault(words.data[s:e].tobytes(), len(seen)) for s, e in zip(words.starts.tolist(), words.ends.tolist())], np.int64)


def repeated_tail(doc_id: int | None, n: int) -> tuple[int, int]:
    """(a, p): from word a on, words repeat with period p; (n, 1) for most documents, whose words stay as they are."""
    if doc_id is None or not n:
        return n, 1
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    a = g % n
    return (a, 1 + (n - a) // (3 + g % 8)) if h % 10 == 0 else (n, 1)


def dropped(n: int, runs: Runs) -> np.ndarray:
    """Flags of the words after the first period of a run."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge)[:n] > 0


Found = tuple[list[bytes], Runs]


def found_in(texts: list[bytes], least: int, exponent: int, tails: list[Callable[[int], tuple[int, int]]] | None = None) -> Iterator[Found]:
    """Each text's words and runs; ``tails`` say which words repeat before runs are looked for."""
    for a, b in slices(texts):
        words = Words(texts[a:b], BY_SPACE_AS_IS)
        ids = numbered(words)
        first = words.first
        place = np.arange(len(ids))
        for i in range(b - a) if tails else ():
            n = int(words.counts[i])
            start, period = tails[a + i](n)
            if start < n:
                own = np.arange(start, n)
                place[first[i] + own] = first[i] + start + (own - start) % period
        spans = [*zip(words.starts[place].tolist(), words.ends[place].tolist())]
        data = words.data.tobytes()
        for i, runs in enumerate(runs_of(ids[place], first, least, exponent)):
            yield [data[s:e] for s, e in spans[first[i] : first[i + 1]]], runs


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUN_TYPE = "struct<start:bigint,length:bigint,period:bigint>"


def periodic_runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 6, exponent: int = 4, tails: Callable[[int | None, int], tuple[int, int]] | None = None) -> DataFrame:
    """doc_id, runs (start, length, period in words, by start, then period), collapsed: the words that no run repeats, joined by one space.

    ``tails``, of an id and a number of words, says from which word on the text is
    replaced by repeats of which period, before anything else.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            how = None if tails is None else [lambda n, d=d: tails(d, n) for d in batch.column(0).to_pylist()]
            rows, kept = [], []
            for words, runs in found_in(texts_of(batch.column(1)), least, exponent, how):
                rows.append([dict(zip(("start", "length", "period"), r)) for r in runs.tolist()])
                gone = dropped(len(words), runs) if len(runs) else None
                kept.append(b" ".join(words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(RUN)), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    return whole_texts(df).select(df[doc_id].cast("bigint").alias("doc_id"), df[text].alias("text")).mapInArrow(run, f"doc_id bigint, runs array<{RUN_TYPE}>, collapsed string")


def best(runs: Column) -> Column:
    """Of an array of runs that of the greatest length over period, compared exactly, then of the smallest start, then period; null for none."""
    more = lambda top, r: top.isNull() | (r["length"] * top["period"] > top["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast(RUN_TYPE), lambda top, r: F.when(more(top, r), r).otherwise(top))


def listed(runs: Column) -> Column:
    """Every run's start, length and period, commas between, a line each."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")
