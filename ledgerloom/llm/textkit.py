"""Vectorised text kernels shared by the corpus operators.

All functions work on one Arrow string column at a time: the UTF-8 bytes of the
whole batch lie in one buffer, so words, hashes and windows of every document
come from a few numpy passes without a Python object per word. Working sets are
bounded by the batch, never by the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one kernel call looks at; its arrays of 8 bytes per byte of text take 8 MB each.
BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.ones(n, np.uint64)
    have, step = 1, base
    while have < n:
        take = min(have, n - have)
        with np.errstate(over="ignore"):
            out[have : have + take] = out[:take] * np.uint64(step)
        have, step = have + take, step * step % (1 << 64)
    return out


_UP, _DOWN = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; kept for the next call."""
    global _UP, _DOWN
    if len(_UP) < n:
        size = 1 << (n - 1).bit_length()
        _UP, _DOWN = _powers(_BASE, size), _powers(_INVERSE, size)
    return _UP[:n], _DOWN[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over all 64 output bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


@dataclass
class Texts:
    """Documents i of a batch: data[offsets[i]:offsets[i + 1]] are its UTF-8 bytes; nulls are empty."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def texts_of(column: pa.Array) -> Texts:
    """The bytes and offsets of a string column, without a copy where it has no nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and at[-1] else np.zeros(0, np.uint8)
    return Texts(raw[at[0] : at[-1]], at - at[0])


def blocks(texts: Texts, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """Cuts a batch into runs of whole documents of about `most` bytes: (first, end, texts)."""
    first, n = 0, len(texts)
    while first < n:
        end = int(np.searchsorted(texts.offsets, texts.offsets[first] + most, "right")) - 1
        end = min(n, max(first + 1, end))
        at = texts.offsets[first : end + 1]
        yield first, end, Texts(texts.data[at[0] : at[-1]], at - at[0])
        first = end


@dataclass
class Words:
    """Words in order: start and end byte, document, and the first word of each document (n + 1 values)."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def words_of(texts: Texts, separator: np.ndarray = _SPACE) -> Words:
    """Maximal runs of bytes that aren't separators; a document's end also ends a word."""
    n = len(texts.data)
    inside = ~separator[texts.data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cut = texts.offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    if len(cut):
        begins[cut] = inside[cut]
        ends[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, texts.offsets)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(start, end, doc, first)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """p with p[j] - p[i] = sum of the hash terms of bytes i .. j - 1."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    term = out[1:]  # in place: one array for any length
    np.take(_BYTE, data, out=term)
    with np.errstate(over="ignore"):
        np.multiply(term, up[:-1], out=term)
        np.cumsum(term, out=term)
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), equal for equal strings wherever they lie."""
    _, down = powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(texts: Texts, words: Words, lower: bool = True) -> np.ndarray:
    return span_hash(prefix_hash(LOWER[texts.data] if lower else texts.data), words.start, words.end)


_STEP = 0xD6E8FEB86659FD93 | 1


def gram_hashes(word: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of n consecutive word hashes, whatever documents they lie in."""
    if len(word) < n:
        return np.zeros(0, np.uint64)
    m = len(word) - n + 1
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out += word[k : k + m] * np.uint64(pow(_STEP, k + 1, 1 << 64))
    return mix(out)


def sequence_hash(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each run values[first[i]:first[i + 1]] of 64-bit values, in order; empty runs give that of length 0."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values * up[: len(values)], out=total[1:])
        return mix((total[first[1:]] - total[first[:-1]]) * down[first[:-1]] + np.diff(first).astype(np.uint64))


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... count[i] values for each i, one after the other."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(count) - count
    return np.arange(total, dtype=np.int64) + np.repeat(first - before, count)


def union_length(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal runs covered by the intervals [start, end) of each document: (doc, start, end), sorted."""
    keep = end > start
    doc, start, end = doc[keep], start[keep], end[keep]
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    span = int(max(end.max(), 1)) + 1
    key = np.unique(doc, return_inverse=True)[1].astype(np.int64) * span
    reach = np.maximum.accumulate(end + key)
    new = np.ones(len(doc), bool)
    new[1:] = (start + key)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], (reach - key)[last]
