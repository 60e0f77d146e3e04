"""Vectorised word and shingle hashing over Arrow string columns, for use inside tasks.

The texts of a batch are looked at as one byte array. A word's hash is half of a
BLAKE2b digest of its bytes; a run of words is hashed by mixing (`run_hash`) to
find what may be equal, and by a 128-bit BLAKE2b digest of its bytes to decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The integers of all ranges one after the other, and which range each is of."""
    size = ends - starts
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) + (starts - np.cumsum(size) + size)[of], of


def digests(buf: np.ndarray, inside: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(n, 2) 64-bit halves of the BLAKE2b digests of n consecutive byte strings: those bytes of buf that are inside. Each distinct string is hashed once."""
    data = np.ascontiguousarray(buf[inside])
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    coded = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    each = b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in coded.dictionary.to_pylist()])
    return np.frombuffer(each, U).reshape(-1, 2)[coded.indices.to_numpy()]


def slice_digests(data: bytes | memoryview, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(n, 2) halves of the BLAKE2b digests of byte ranges that may overlap."""
    view = memoryview(data)
    each = b"".join([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist())])
    return np.frombuffer(each, U).reshape(-1, 2)


def run_hash(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k values, by doubling. Every level mixes its two halves, so no pattern of equal values cancels out."""
    n = len(values) - k + 1
    if n <= 0:
        return values[:0]
    join = lambda a, b, span: mix64(mix64(a + U(0x9E3779B97F4A7C15 * span & 0xFFFFFFFFFFFFFFFF)) + b)
    have, span = values, 1
    while span * 2 <= k:
        have = join(have[: len(have) - span], have[span:], span)
        span *= 2
    return have[:n] if span == k else join(have[:n], have[k - span : k - span + n], k)


@dataclass
class Words:
    """The words of a batch: byte ranges, the row each stands in, and the first word of each row (n_rows + 1 entries)."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray

    _digests: np.ndarray | None = None
    _joined: tuple | None = None

    def hashes(self, half: int = 0) -> np.ndarray:
        """Of each word, one 64-bit half of its digest."""
        if self._digests is None:
            self._digests = digests(self.buf, ~_SPACE[self.buf], self.end - self.start)
        return np.ascontiguousarray(self._digests[:, half])

    def grams(self, word_hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of k words that starts at word i, and whether that run lies in one row."""
        n = len(word_hashes)
        if n < k:
            return np.zeros(0, U), np.zeros(0, bool)
        return run_hash(word_hashes, k), self.row[: n - k + 1] == self.row[k - 1 :]

    def sequence_digests(self, first: np.ndarray, after: np.ndarray) -> np.ndarray:
        """(n, 2) halves of the BLAKE2b digests of the words first up to after, with one space between."""
        if self._joined is None:
            size = self.end - self.start
            spot = np.cumsum(size + 1) - size - 1
            data = np.full(int(spot[-1] + size[-1] + 1) if len(size) else 0, 0x20, np.uint8)
            at, of = ranges(self.start, self.end)
            data[at - self.start[of] + spot[of]] = self.buf[at]
            self._joined = data, spot, spot + size
        data, spot, stop = self._joined
        full = after > first
        out = np.zeros((len(first), 2), U)
        out[full] = slice_digests(data, spot[first[full]], stop[after[full] - 1])
        return out


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """Words of each text; a null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    joined = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    if isinstance(joined, pa.ChunkedArray):
        joined = joined.combine_chunks()
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = joined.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    if lower:
        buf = _LOWER[buf]
    gap = np.ones(len(buf) + 2, np.int8)
    gap[1:-1] = _SPACE[buf]
    turn = np.diff(gap)
    start, end = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(buf, start, end, row, first)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about most_bytes of text (a longer single text stays whole)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held = batch.column(column)
        if pa.types.is_list(held.type):  # of strings
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(held.values), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
            sizes = np.diff(ends[held.offsets.to_numpy()])
        else:
            sizes = pc.fill_null(pc.binary_length(held), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def sliding(values: np.ndarray, width: int, op) -> np.ndarray:
    """op over each run of width values, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    have, span = values, 1
    while span * 2 <= width:
        have = op(have[: len(have) - span], have[span:])
        span *= 2
    return op(have[:n], have[width - span : width - span + n])
