"""Repeated byte strings across documents, by longest-previous-factor arrays.

A string of ``length`` bytes that starts at two places is repeated.  Suffix
sorting a whole corpus in one place does not scale, so suffixes are sorted only
where a repeat can be, and only to the depth that decides:

1. Each string of ``length`` bytes chooses an anchor, the least hash of its
   ``gram``-byte substrings (the first of equals).  Equal strings choose the same
   anchor at the same offset.  Runs of strings with one anchor are its context.
2. Anchors whose gram occurs once in the corpus can't be in a repeat and end
   here; all that moved is their hashes.
3. A context that occurs twice as a whole is repeated as a whole.  The commonest
   ones, at most ``COMMON``, are broadcast to where the documents' contexts lie in
   order, and neighbouring ones become one range there; the others meet in a
   join, which so has no hot key.
4. Other contexts with the same gram are brought together.  Their suffix array,
   by prefix doubling to depth ``length``, has equal strings beside each other in
   order of position; a position whose neighbour in suffix order with a smaller
   position shares its rank has a longest previous factor of ``length`` or more.
   Looking at the neighbour with a greater position as well gives all copies.
5. Grams with over ``hot_contexts`` different contexts, some 6 MB that take some
   200 MB to sort, are not brought together.
   Their strings are taken in blocks of neighbouring starts: strings of a block
   can only be repeated if the bytes all of them share are, and all are if the
   block is as a whole.  Only where neither decides is each string counted.  All
   counts are sums that combine before they move.

Defined cases: a null or short text has nothing to remove; rows with the same
id and text are copies of each other, except that with ``keep_first`` they count
as one document, so none loses its text to another; ties in doc_id are ordered
by text hash; an empty table gives no rows; columns of ``df`` are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.cluster import Sieve, partitions, table, whole_texts, with_found
from tessera.llm.textkit import HashTable, batches, mix, prefix_hash, slices, span_hash, texts_of

LOWEST = -(1 << 63)
PIECE = 1 << 18


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """min(values[i:i + width]) for each i with a whole window."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """owner, gram hash, context hash, offset of the anchor, first and last string start of each context."""
    out: list[tuple[np.ndarray, ...]] = []
    pieces, owner, base = [], [], []
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), PIECE):
            if len(t) - at >= length:
                pieces.append(t[at : at + PIECE + length - 1])
                owner.append(i)
                base.append(at)
    width, low = length - gram + 1, np.uint64((1 << 24) - 1)
    for a, b in slices(pieces, 1 << 18):  # some 100 bytes of arrays a byte
        data = np.frombuffer(b"".join(pieces[a:b]), np.uint8)
        sizes = np.fromiter((len(p) for p in pieces[a:b]), np.int64, b - a)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        prefix = prefix_hash(data)
        at = np.arange(len(data) - gram + 1)
        grams = span_hash(prefix, at, at + gram)
        chosen = (sliding_minimum((grams & ~low) | at.astype(np.uint64), width) & low).astype(np.int64)
        piece = np.repeat(np.arange(b - a), sizes)[: len(chosen)]
        start = np.arange(len(chosen))
        valid = start + length <= begin[1:][piece]
        start, chosen, piece = start[valid], chosen[valid], piece[valid]
        new = np.ones(len(start), bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (piece[1:] != piece[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        lo, hi, pos, own = start[first], start[last], chosen[first], piece[first]
        whole = mix(span_hash(prefix, lo, hi + length) + (pos - lo).astype(np.uint64))
        shift = np.array(base[a:b], np.int64)[own] - begin[own]
        out.append((np.array(owner[a:b], np.int64)[own], grams[pos].view(np.int64), whole.view(np.int64), pos - lo, lo + shift, hi + shift))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.zeros(0, np.int64) for _ in range(6))


def _dense(key: np.ndarray) -> np.ndarray:
    """Ranks of keys, equal for equal ones; about 30 bytes a key at the most."""
    order = np.argsort(key)
    new = np.empty(len(key), np.int32)
    new[:1] = 0
    ordered = key[order]
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:], casting="unsafe")
    del ordered
    np.cumsum(new, out=new)
    rank = np.empty(len(key), np.int32)
    rank[order] = new
    return rank


def ranks(data: np.ndarray, depth: int) -> np.ndarray:
    """The rank of data[p:p + depth] among all positions p, by prefix doubling (zeros follow the end)."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    size = 1
    while size * 2 <= min(8, depth):
        size *= 2
    key = np.zeros(n, np.uint64)
    for k in range(size):
        key <<= np.uint64(8)
        key |= padded[k : n + k]
    rank = _dense(key)
    while size < depth:
        step = size if size * 2 <= depth else depth - size
        key = rank.astype(np.uint64)
        key *= np.uint64(n + 2)
        key[: max(0, n - step)] += rank[step:].astype(np.uint64) + np.uint64(1)
        rank = _dense(key)
        size += step
    return rank


def repeated(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts in document order: where each begins in their concatenation, and for each position
    whether its string of ``length`` bytes has an earlier copy, and whether it has any."""
    sizes = np.fromiter((len(c) for c in contexts), np.int64, len(contexts))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(contexts), np.uint8)
    rank = ranks(data, length)
    start = np.arange(len(data))
    inside = start[start + length <= np.repeat(begin[1:], sizes)]
    order = inside[np.lexsort((inside, rank[inside]))]  # the suffix array, cut to the depth
    previous = np.zeros(len(order), bool)
    previous[1:] = rank[order[1:]] == rank[order[:-1]]
    following = np.zeros(len(order), bool)
    following[:-1] = previous[1:]
    earlier, any_ = np.zeros(len(data), bool), np.zeros(len(data), bool)
    earlier[order] = previous
    any_[order] = previous | following
    return begin, earlier, any_


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[0::2], edge[1::2]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as maximal runs."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


SPANS = "d bigint, k bigint, start int, stop int"


def keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """d and k, which name a row up to equal rows, and its text."""
    return whole_texts(df).select(F.coalesce(df[doc_id].cast("bigint"), F.lit(LOWEST)).alias("d"), F.xxhash64(df[doc_id].cast("bigint"), df[text]).alias("k"), df[text].alias("text"))


def spans(rows: DataFrame, length: int = 400, keep_first: bool = False, gram: int = 64, hot_contexts: int = 10_000) -> DataFrame:
    """d, k, start, stop of byte ranges to remove, of ``rows`` made by ``keyed``; ranges may overlap."""

    def find(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            owner, h, c, off, lo, hi = anchors(texts_of(batch.column(2)), length, gram)
            d, k = (batch.column(i).to_numpy()[owner] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(k), pa.array(h), pa.array(c), *(pa.array(x.astype(np.int32)) for x in (off, lo, hi))], names=["d", "k", "h", "c", "off", "lo", "hi"])

    found = table(rows.mapInArrow(find, "d bigint, k bigint, h bigint, c bigint, off int, lo int, hi int"))
    # written, so that the join below has plain inputs, which Spark can split where a gram is hot
    shared = table(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    near = table(found.join(shared, "h", "left_semi"))
    contexts = table(near.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("d", "k", "lo", "hi", "off")).alias("rep")))
    # no more than COMMON contexts can occur this often
    often = max(64, -(-near.count() // COMMON))
    common = table(contexts.where(F.col("n") >= often).select("h", "c", "rep.d", "rep.k", "rep.lo"))
    rare = near.join(F.broadcast(common.select("h", "c")), ["h", "c"], "left_anti")  # at most COMMON rows
    whole = rare.join(contexts.where((F.col("n") > 1) & (F.col("n") < often)), ["h", "c"])
    if keep_first:
        whole = whole.where(~((F.col("d") == F.col("rep.d")) & (F.col("k") == F.col("rep.k")) & (F.col("lo") == F.col("rep.lo"))))
    whole = whole.select("d", "k", F.col("lo").alias("start"), (F.col("hi") + length).alias("stop")).union(_common(found, common, length, keep_first))
    kinds = table(contexts.groupBy("h").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1" if keep_first else "m > 1 and least = 1"))
    open_ = contexts.join(kinds.select("h", (F.col("m") > hot_contexts).alias("hot")), "h")
    wanted = open_.select(F.col("rep.d").alias("d"), F.col("rep.k").alias("k"), F.struct("h", "hot", F.col("rep.lo").alias("lo"), F.col("rep.hi").alias("hi"), F.col("rep.off").alias("off")).alias("w")).groupBy("d", "k").agg(F.collect_list("w").alias("ws"))

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, 2 << 20):
            out: list[tuple] = []
            for d, k, t, ws in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), batch.column(3).to_pylist()):
                out += [(w["h"], w["hot"], d, k, w["lo"], t[w["lo"] : w["hi"] + length], w["off"]) for w in ws]
            columns = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32()))], names=["h", "hot", "d", "k", "lo", "body", "off"])

    bodies = rows.join(wanted, ["d", "k"]).select("d", "k", "text", "ws").mapInArrow(cut, "h bigint, hot boolean, d bigint, k bigint, lo int, body binary, off int")

    def sort(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def spans_of() -> pa.RecordBatch:
            held.sort(key=lambda r: (r[2], r[3], r[4]))
            begin, earlier, any_ = repeated([r[5] for r in held], length)
            flags = earlier if keep_first else any_
            out: list[tuple] = []
            for i, r in enumerate(held):
                first, past = runs(flags[begin[i] : begin[i + 1]])
                out += [(r[2], r[3], r[4] + int(a), r[4] + int(b) - 1 + length) for a, b in zip(first, past)]
            columns = list(zip(*out)) if out else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["d", "k", "start", "stop"])

        last = None
        for batch in source:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != last and size > 1 << 19:
                    yield spans_of()
                    held, size = [], 0
                if last is None or row[0] != last or not held or held[-1][2:5] != row[2:5]:
                    held.append(row)
                    size += len(row[5])
                last = row[0]
        if held:
            yield spans_of()

    cold = bodies.where("not hot").repartition(partitions(rows.sparkSession), "h").sortWithinPartitions("h", "d", "k", "lo").mapInArrow(sort, SPANS)
    result = whole.union(cold)
    if not kinds.where(F.col("m") > hot_contexts).isEmpty():
        result = result.union(_hot(bodies.where("hot"), length, keep_first))
    return result


#: The most contexts that are broadcast.
COMMON = 1 << 16


def _common(found: DataFrame, common: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Spans of the common contexts, neighbouring ones of a document as one; nothing is shuffled."""
    held = common.toArrow()  # at most COMMON rows
    h, c, d, k, lo = (held.column(i).to_numpy() for i in range(5))
    order = np.argsort(c.view(np.uint64), kind="stable")
    sent = found.sparkSession.sparkContext.broadcast(tuple(x[order] for x in (c.view(np.uint64), h, d, k, lo)))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, *others = sent.value
        # a context's hash is of its bytes and its gram's place in them, so equal ones have one gram
        table_ = HashTable(keys)
        for batch in source:
            d, k, c, lo, hi = (batch.column(i).to_numpy() for i in range(5))
            at = table_.find(c.view(np.uint64))
            hit = at >= 0
            if keep_first:
                _, rd, rk, rlo = (x[np.maximum(at, 0)] if len(x) else x for x in others)
                hit = hit & ~((rd == d) & (rk == k) & (rlo == lo)) if len(keys) else hit
            d, k, start, stop = d[hit], k[hit], lo[hit], hi[hit] + length
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1]) | (start[1:] > stop[:-1]) | (start[1:] < start[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(d)) - 1 if len(d) else first
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d[first], k[first], start[first].astype(np.int32), stop[last].astype(np.int32))], names=["d", "k", "start", "stop"])

    return found.select("d", "k", "c", "lo", "hi").mapInArrow(run, SPANS)


#: Neighbouring strings of a block.
BLOCK = 16


def _hot(bodies: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Spans in contexts of hot grams, by blocks of strings and then, where a block does not decide, by strings."""

    def blocks(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, 1 << 19):
            bodies_, off = texts_of(batch.column(5)), batch.column(6).to_numpy().astype(np.int64)
            sizes = np.fromiter((len(b) for b in bodies_), np.int64, len(bodies_))
            begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            strings = sizes - length + 1
            prefix = prefix_hash(np.frombuffer(b"".join(bodies_), np.uint8))
            at = np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings) + np.repeat(begin, strings)
            each = span_hash(prefix, at, at + length)
            # a block: the strings that start from 16 q to 16 q + 15 bytes before the anchor, those furthest from it first
            high, low = off // BLOCK, (off - strings + 1) // BLOCK
            n = high - low + 1
            own = np.repeat(np.arange(len(n)), n)
            q = high[own] - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            first = np.maximum(0, off[own] - (BLOCK * q + BLOCK - 1))
            last = np.minimum(strings[own] - 1, off[own] - BLOCK * q)
            core, core_end = begin[own] + off[own] - BLOCK * q, begin[own] + off[own] - BLOCK * q - (BLOCK - 1) + length
            half = (core + core_end) // 2
            tag = mix((q + 1).astype(np.uint64))
            g1 = span_hash(prefix, core, core_end) ^ tag
            g2 = mix(span_hash(prefix, core, half) ^ (span_hash(prefix, half, core_end) * np.uint64(3)) ^ tag)
            u = mix(span_hash(prefix, begin[own] + first, begin[own] + last + length) + (off[own] - first).astype(np.uint64))
            d, k, lo = (batch.column(i).to_numpy()[own] for i in (2, 3, 4))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(last - first + 1)]).astype(np.int32)), pa.array(each.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (g1, g2, u)), pa.array(d), pa.array(k), pa.array((lo + first).astype(np.int32)), pa.array((last - first + 1).astype(np.int32)), lists], names=["g1", "g2", "u", "d", "k", "s", "n_ws", "ws"])

    rows = table(bodies.mapInArrow(blocks, "g1 bigint, g2 bigint, u bigint, d bigint, k bigint, s int, n_ws int, ws array<bigint>"))
    is_rep = (F.col("d") == F.col("rep.d")) & (F.col("k") == F.col("rep.k")) & (F.col("s") == F.col("rep.s"))
    kinds = table(rows.groupBy("g1", "g2", "u").agg(F.count("*").alias("n"), F.min(F.struct("d", "k", "s")).alias("rep")))
    groups = table(kinds.groupBy("g1", "g2").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1" if keep_first else "m > 1 and least = 1").select("g1", "g2"))
    whole = rows.join(kinds.where("n > 1"), ["g1", "g2", "u"])
    if keep_first:
        whole = whole.where(~is_rep)
    whole = whole.select("d", "k", F.col("s").alias("start"), (F.col("s") + F.col("n_ws") - 1 + length).alias("stop"))
    undecided = rows.join(kinds.join(groups, ["g1", "g2"]), ["g1", "g2", "u"]).where(is_rep)
    each = table(undecided.select("g1", "g2", "d", "k", "s", F.posexplode("ws").alias("p", "w")).select("g1", "g2", "w", "d", "k", (F.col("s") + F.col("p")).alias("s")).distinct())
    several = table(each.groupBy("g1", "g2", "w").agg(F.count("*").alias("n"), F.min(F.struct("d", "k", "s")).alias("rep")).where("n > 1"))
    met = each.join(several, ["g1", "g2", "w"])
    if keep_first:
        met = met.where(~is_rep)
    return whole.union(met.select("d", "k", F.col("s").alias("start"), (F.col("s") + length).alias("stop")))


def _ranges(found: DataFrame) -> DataFrame:
    """d, k and the ranges of each row that has some."""
    return table(found.groupBy("d", "k").agg(F.collect_list(F.struct("start", "stop")).alias("ranges")))


def _nested(rows: DataFrame, outer: DataFrame, length: int, **limits: int) -> DataFrame:
    """Spans of strings of ``length`` bytes, looked for only in what repeats at a lesser length.

    All strings of the lesser length inside a repeated string are repeated, so
    each such string lies in one maximal run of ``outer``, at every place.
    """
    shape = "d bigint, k bigint, text string"

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            texts, rs = texts_of(batch.column(2)), batch.column(3).to_pylist()
            out = [(d, k, a, t[a:b]) for d, k, t, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, rs) for a, b in merged([(x["start"], x["stop"]) for x in r]) if b - a >= length]
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["d", "k", "at", "body"])

    sieve = Sieve(outer, "k")
    parts = table(sieve.passed(rows, F.col("k")).join(outer, ["d", "k"]).select("d", "k", "text", "ranges").mapInArrow(cut, "d bigint, k bigint, at int, body binary"))
    # a part is a row of its own: its place in its document goes into its key, which is unmade at the end
    named = parts.select("d", "k", "at", F.xxhash64("k", "at").alias("p"), "body")
    inner = spans(named.select("d", F.col("p").alias("k"), F.col("body").alias("text")), length, False, **limits)
    return inner.withColumnRenamed("k", "p").join(named.select("d", "p", "k", "at"), ["d", "p"]).select("d", "k", (F.col("start") + F.col("at")).cast("int").alias("start"), (F.col("stop") + F.col("at")).cast("int").alias("stop"))


def removed(df: DataFrame, length: int = 400, keep_first: bool = False, passage: int | None = None, doc_id: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed byte runs), kept (the other bytes) of each row, and n_shared.

    With ``passage``, a lesser length, n_shared counts the bytes in strings of that
    length that also start elsewhere; without, the removed bytes.
    """
    rows = keyed(df, doc_id, text)
    outer = _ranges(spans(rows, length if passage is None else passage, keep_first and passage is None, **limits))
    if passage is None:
        both = outer.select("d", "k", F.struct("ranges", F.col("ranges").alias("inner")).alias("r"))
    else:
        inner = _ranges(_nested(rows, outer, length, **limits)).withColumnRenamed("ranges", "inner")
        both = table(outer.join(inner, ["d", "k"], "left").select("d", "k", F.struct("ranges", "inner").alias("r")))

    def apply(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            texts = texts_of(batch.column(1))
            found = batch.column(2).to_pylist()
            joined = lambda r, name: merged([(x["start"], x["stop"]) for x in r[name]]) if r and r[name] else []
            all_spans, wide = [joined(r, "inner") for r in found], [joined(r, "ranges") for r in found]
            kept = []
            for t, ss in zip(texts, all_spans):
                edges = [0, *(x for s in ss for x in s), len(t)]
                kept.append(b"".join(t[a:b] for a, b in zip(edges[0::2], edges[1::2])) if ss else t)
            struct = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([[{"start": a, "stop": b} for a, b in ss] for ss in all_spans], struct), pa.array(kept, pa.binary()), pa.array([sum(b - a for a, b in ss) for ss in wide], pa.int64())], names=["d", "n_bytes", "spans", "kept", "n_shared"])

    out = with_found(rows, both, "k", ["d", "k"]).select("d", "text", "r").mapInArrow(apply, "d bigint, n_bytes bigint, spans array<struct<start:int,stop:int>>, kept binary, n_shared bigint")
    return out.select(F.when(F.col("d") != LOWEST, F.col("d")).alias("doc_id"), "n_bytes", "spans", "kept", "n_shared")


def clean(df: DataFrame, length: int = 200, doc_id: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """The documents, all columns kept, without later copies of strings of ``length`` bytes; the first stays.

    Removed ranges are drawn in to whole characters.  Documents left without a
    word go.
    """
    d, k, ranges = "__suffix_d", "__suffix_k", "__suffix_ranges"  # beside any columns of the documents
    found = _ranges(spans(keyed(df, doc_id, text), length, True, **limits)).toDF(d, k, ranges)
    named = df.withColumns({d: F.coalesce(df[doc_id].cast("bigint"), F.lit(LOWEST)), k: F.xxhash64(df[doc_id].cast("bigint"), df[text])})
    joined = with_found(whole_texts(named), found, k, [d, k]).select(*(F.col(f"`{c}`") for c in df.columns), ranges)

    def apply(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            at = batch.schema.get_field_index(text)
            last = batch.num_columns - 1
            column, keep = batch.column(at).to_pylist(), np.ones(batch.num_rows, bool)
            for i, rs in enumerate(batch.column(last).to_pylist()):
                if rs:
                    t, parts, begin = column[i].encode(), [], 0
                    for a, b in merged([(r["start"], r["stop"]) for r in rs]):
                        while a < b and t[a] & 0xC0 == 0x80:
                            a += 1
                        while b > a and b < len(t) and t[b] & 0xC0 == 0x80:
                            b -= 1
                        parts.append(t[begin:a])
                        begin = b
                    column[i] = b"".join([*parts, t[begin:]]).decode()
                    keep[i] = bool(column[i].strip())
            columns = [pa.array(column, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns[:last])]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:last]).filter(pa.array(keep))

    return joined.mapInArrow(apply, df.schema)
