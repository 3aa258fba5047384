"""Byte-level text kernels shared by the Arrow-based operators.

Everything works on the UTF-8 bytes of whole texts, a bounded slice of a batch
at a time, so a task's memory does not depend on the partition's size.  Hashes
depend on nothing but the bytes, hence are the same on every executor and on
every run.  Words are hashed eight bytes at a time through an avalanche step,
which is not linear; hashes of any span of bytes are 64-bit polynomial prefix
sums over a random byte table.  Such sums are equal for the Thue-Morse word of
1,024 letters and its mirror, so they only ever choose what is compared by bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1


def splitmix(seed: int, n: int) -> np.ndarray:
    """n deterministic 64-bit words (the splitmix64 sequence)."""
    x = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(seed)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x5851F42D4C957F2D | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BYTES = splitmix(0x1234_5678, 256)


class Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 1 << 20)
            up, down = np.full(m, BASE, np.uint64), np.full(m, BASE_INVERSE, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] = sum of table[data[i]] * BASE**i for s <= i < e."""
    up, _ = POWERS.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * up[:-1], dtype=np.uint64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], the same wherever these bytes stand."""
    _, down = POWERS.upto(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


#: The low bytes of a word of eight, and the longest run of bytes hashed here; longer ones are rare and go to BLAKE2.
LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG = 512


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``data`` on, as a little-endian number; the end is padded with zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))


def byte_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], by an avalanche step for every eight bytes."""
    length = end - start
    eight = lanes(data)
    h = mix(length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x51ED270B))
    todo = np.flatnonzero((length > 0) & (length <= LONG))
    at = 0
    while len(todo):
        rest = length[todo] - at
        h[todo] = mix((h[todo] ^ (eight[start[todo] + at] & LOW[np.minimum(rest, 8)])) + np.uint64(0xD6E8FEB86659FD93))
        todo, at = todo[rest > 8], at + 8
    for i in np.flatnonzero(length > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def same_bytes(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of a[a_start:] and b[b_start:] are equal over ``length`` bytes."""
    one, other = lanes(a), lanes(b)
    same = np.ones(len(length), bool)
    todo = np.flatnonzero(length > 0)
    at = 0
    while len(todo) and at < LONG:
        rest = length[todo] - at
        same[todo] = ((one[a_start[todo] + at] ^ other[b_start[todo] + at]) & LOW[np.minimum(rest, 8)]) == 0
        todo, at = todo[(rest > 8) & same[todo]], at + 8
    for i in todo.tolist():
        same[i] = bool((a[a_start[i] : a_start[i] + length[i]] == b[b_start[i] : b_start[i] + length[i]]).all())
    return same


def separators(*ranges: tuple[int, int], fold: bool = True) -> bytes:
    """A translation table: A-Z to a-z where ``fold``, bytes in the ranges to a space."""
    table = bytearray(range(256))
    for b in range(ord("A"), ord("Z") + 1) if fold else ():
        table[b] = b + 32
    for low, high in ranges:
        for b in range(low, high + 1):
            table[b] = 0x20
    return bytes(table)


#: Words are runs of anything but ASCII white space.
BY_SPACE = separators((0x09, 0x0D), (0x20, 0x20))
BY_SPACE_AS_IS = separators((0x09, 0x0D), (0x20, 0x20), fold=False)
#: Words are runs of ASCII letters, digits and all bytes from 0x80.
BY_ALNUM = separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def slices(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of about ``limit`` bytes each (one text at least)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


class Words:
    """The words of several texts: spans, hashes and the words' counts a text."""

    def __init__(self, texts: list[bytes], table: bytes) -> None:
        joined = b" ".join(texts).translate(table)
        self.data = data = np.frombuffer(joined, np.uint8)
        word = np.zeros(len(data) + 2, np.int8)
        word[1:-1] = data != 0x20
        edge = np.flatnonzero(np.diff(word))
        self.starts, self.ends = edge[0::2], edge[1::2]
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.begin = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.first = np.searchsorted(self.starts, self.begin)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return byte_hash(self.data, self.starts, self.ends)


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each row, null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def batches(source: Iterable[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded bytes."""
    for batch in source:
        if not batch.num_rows:
            continue
        step = max(1, min(batch.num_rows, int(batch.num_rows * limit / max(batch.nbytes, 1))))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def gathered(source: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches, of at most ``limit`` bytes each unless one of the source's is larger."""
    held: list[pa.RecordBatch] = []
    for batch in source:
        if held and sum(x.nbytes for x in held) + batch.nbytes > limit:
            yield pa.concat_batches(held)
            held.clear()
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


class HashTable:
    """Positions of 64-bit keys in a sorted array, by their high bits first."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.bits = max(4, min(26, int(len(keys)).bit_length() - 1))
        edges = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.start = np.searchsorted(keys, edges).astype(np.int32 if len(keys) < 1 << 31 else np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Index of each wanted key, -1 where there is none."""
        out = np.full(len(wanted), -1, np.int64)
        if not len(self.keys):
            return out
        at = self.start[(wanted >> np.uint64(64 - self.bits)).astype(np.int64)].astype(np.int64)
        todo = np.arange(len(wanted))
        while len(todo):
            inside = at < len(self.keys)
            todo, at = todo[inside], at[inside]
            here = self.keys[at]
            hit = here == wanted[todo]
            out[todo[hit]] = at[hit]
            less = here < wanted[todo]
            todo, at = todo[less], at[less] + 1
        return out
