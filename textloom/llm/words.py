"""Vectorised words, hashes and n-grams over Arrow batches of whole texts.

A word is a maximal run of bytes other than space and 0x09-0x0D; on UTF-8 that equals the
pattern ``[^\\x20\\x09-\\x0D]+``. Within a chunk, words and lines are numbered by their bytes, so
equal numbers mean equal bytes. Across chunks, a word is named by 128 bits of XXH3, and a range of
words by the names of its parts, joined pairwise by a mixing function; no sum over positions is
involved, so exchanged or repeated parts do not cancel out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One name for two names in this order."""
    x = a * U(0x9E3779B97F4A7C15)
    x ^= (b << U(29)) | (b >> U(35))
    return mix(x)


class Ranges:
    """Names of ranges of a sequence, by doubling: 2**k values are named by their halves, and any other number by its first and its last 2**k."""

    def __init__(self, values: np.ndarray):
        self.levels = [mix(values ^ U(0x6A09E667F3BCC909))]

    def _level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(joined(last[:-half], last[half:]) if len(last) > half else last[:0])
        return self.levels[k]

    def __call__(self, start: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        """The ranges of ``size`` values (one number, or one for each range) that begin at ``start``; all lie in the sequence, and none is empty."""
        if isinstance(size, int):
            k = size.bit_length() - 1
            level = self._level(k)
            name = level[start]
            return name if size == 1 << k else joined(name ^ U(size), level[start + (size - (1 << k))])
        out = np.empty(len(start), U)
        for n in np.unique(size).tolist():
            of = size == n
            out[of] = self(start[of], n)
        return out


def numbered(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """For ranges of bytes that follow one another without overlap: the number of each among the distinct ones, and those."""
    edge = np.zeros(len(buf) + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    data = buf[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def names(distinct: pa.Array) -> np.ndarray:
    """128 bits for each value, as two columns."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(x) for x in distinct.to_pylist()]), U).reshape(-1, 2)


@dataclass
class Words:
    """The words of several texts. ``doc`` is each word's text; ``first`` has each text's first word, then the count."""

    buf: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def numbers(self) -> tuple[np.ndarray, pa.Array]:
        return numbered(self.buf, self.start, self.end)

    def values(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent names of 64 bits for each word."""
        number, distinct = self.numbers()
        both = names(distinct)
        return both[number, 0], both[number, 1]

    def grams(self, n: int) -> np.ndarray:
        """Positions at which n words of one text begin."""
        at = np.arange(max(0, len(self.start) - n + 1))
        return at[self.doc[at] == self.doc[at + n - 1]]


def split_words(buf: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(buf)
    space = SPACE[buf]
    begins, ends = ~space, ~space
    edge = offsets[offsets < n]
    begins[1:] &= space[:-1]
    begins[edge] = ~space[edge]
    ends[:-1] &= space[1:]
    last = offsets[(offsets > 0) & (offsets <= n)] - 1
    ends[last] = ~space[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Words(buf, offsets, start, end, doc, np.searchsorted(doc, np.arange(len(offsets))))


def text_chunks(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo to hi of a string column, with their bytes and offsets; each chunk has at most ``limit`` bytes or one text. Null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over texts, where first bounds each text's values."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
