"""Harmonic packing of token sequences.

A document of L tokens is cut into full sequences and a rest, the rest into
halves of the capacity (1/2, 1/4, ... down to ``smallest``) and a last piece.
A piece whose length lies in (C/(k+1), C/k] belongs to reciprocal class k, and
k pieces of a class fill one sequence: a fixed count, known beforehand.  Every
task packs its own rows with no shuffle and no shared state; it keeps only the
open sequence of each class.  What is open at a task's end is cut at powers of
two, where sequences need no padding.

Defined cases: a null or empty text has one token (the end id), so has one
piece; equal texts and repeated rows are packed each on its own; an empty table
gives no pieces; other columns are ignored; a very long text is tokenized as one
value in its task; ids may be null or repeat.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.llm.cluster import whole_texts
from tessera.llm.textkit import batches

SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


class ByteBpe:
    """A byte-level BPE vocabulary file of the tokenizers library.

    The merges are done by tiktoken with ranks read from the same file, which
    gives the same ids several times faster; a text it can't take goes to the
    tokenizers library itself.
    """

    #: Fixed value: how byte-level vocabularies of this kind split a text.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, vocabulary: str) -> None:
        import tiktoken

        spec = json.loads(vocabulary)
        printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
        rest = [b for b in range(256) if b not in printable]
        as_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(as_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("bytes", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.vocabulary = vocabulary

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4")
        except BaseException as why:  # its regular expressions panic on some huge runs
            if isinstance(why, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            from tokenizers import Tokenizer

            return np.array(Tokenizer.from_str(self.vocabulary).encode(text, add_special_tokens=False).ids, "<u4")


class Packer:
    """Rows (doc_id, start, length, ids, doc_tokens, sequence_id, offset) from documents fed one after another."""

    def __init__(self, capacity: int = 2048, smallest: int = 64, first: int = 0) -> None:
        self.capacity, self.smallest, self.next = capacity, smallest, first
        self.open: dict[int, list[tuple]] = {}

    def cuts(self, n: int) -> Iterator[tuple[int, int]]:
        at, size = 0, self.capacity
        while size >= self.smallest:
            while n - at >= size:
                yield at, size
                at += size
            size //= 2
        if n > at:
            yield at, n - at

    def close(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids), ids.tobytes(), total, self.next, at
            at += len(ids)
        self.next += 1

    def feed(self, doc: int | None, ids: np.ndarray) -> Iterator[tuple]:
        for at, size in self.cuts(len(ids)):
            k = self.capacity // size
            held = self.open.setdefault(k, [])
            held.append((doc, at, ids[at : at + size], len(ids)))
            if len(held) == k:
                yield from self.close(self.open.pop(k))

    def finish(self) -> Iterator[tuple]:
        held = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        left = sum(len(p[2]) for p in held)
        while left:
            size = min(self.capacity, 1 << (left.bit_length() - 1))
            taken, room = [], size
            while room:
                doc, start, ids, total = held.pop(0)
                if len(ids) > room:
                    held.insert(0, (doc, start + room, ids[room:], total))
                    ids = ids[:room]
                taken.append((doc, start, ids, total))
                room -= len(ids)
            yield from self.close(taken)
            left -= size


def pack(df: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int | None = 1, smallest: int = 64) -> DataFrame:
    """The pieces of all documents; ``vocabulary`` is the content of a byte-level BPE file.

    ``ids`` holds a piece's ids as little-endian unsigned 32-bit integers.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)  # one vocabulary file

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(shared.value)
        packer = Packer(capacity, smallest, TaskContext.get().partitionId() << 40)
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), ARROW)], schema=ARROW)
            rows.clear()
            return out

        for batch in batches(source):
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = bpe.ids(body or "")
                if end_id is not None:
                    ids = np.append(ids, np.array([end_id], "<u4"))
                for row in packer.feed(doc, ids):
                    rows.append(row)
                    if len(rows) >= 4096:
                        yield flush()
        rows.extend(packer.finish())
        if rows:
            yield flush()

    return whole_texts(df).select(df[doc_id].cast("bigint").alias("doc_id"), df[text].alias("text")).mapInArrow(run, SCHEMA)
