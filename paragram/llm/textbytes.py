"""Vectorised word scanning over Arrow string buffers.

A batch of texts is one UTF-8 byte buffer plus row offsets.  Words are maximal
runs of bytes other than 0x20 and 0x09-0x0D (the pattern ``[^\\x20\\x09-\\x0D]+``;
those bytes never occur inside a multi-byte character, so byte and character
scanning agree).  A span is hashed eight bytes at a time: the state takes them
in by exclusive or and goes through a bijective mixer, for all spans at once;
spans of more than LONG bytes go through xxh3.  Sequences of words are chained
in the same way over the words' hashes.  Another seed gives an independent
hash.  Equal spans have equal hashes in every task.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Seeds of two independent hashes.
ONE, TWO = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Bytes from which a span is hashed by xxh3.
LONG = 64
#: Bytes behind a text that is read eight at a time.
PAD = 16
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser (the splitmix64 steps)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (int64, from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64, count=column.offset + len(column) + 1)[column.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _row_edges(offsets: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    return edge[:n]


def _views(padded: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as a number (unaligned views); for bytes with PAD more behind them."""
    return np.ndarray((len(padded) - PAD // 2,), dtype="<u8", buffer=padded, strides=(1,))


def _lanes(raw: np.ndarray) -> np.ndarray:
    """``_views`` of a padded copy."""
    padded = np.zeros(len(raw) + PAD, dtype=np.uint8)
    padded[: len(raw)] = raw
    return _views(padded)


def _eights(lanes: np.ndarray, start: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """The k-th eight bytes of each span, zeros behind its end."""
    return lanes[start + 8 * k] & _MASK[np.minimum(size - 8 * k, 8)]


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = ONE) -> np.ndarray:
    """A 64-bit hash of raw[start:end] for every span."""
    size = end - start
    out = mix64(size.astype(np.uint64) * _U(0x9FB21C651E98DF25) + _U(seed))
    if not len(size):
        return out
    lanes, longest = _lanes(raw), int(size.max())
    if longest > LONG:
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]].data, seed & 0xFFFFFFFF)
    for k in range(-(-min(longest, LONG) // 8)):
        at = np.flatnonzero((size > 8 * k) & (size <= LONG))
        out[at] = mix64(out[at] ^ _eights(lanes, start[at], size[at], k))
    return out


def same_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, at: np.ndarray, to: np.ndarray, padded: bool = False) -> np.ndarray:
    """Whether raw[start:end] equals other[at:to], byte by byte; padded: other ends in PAD bytes that no span holds."""
    size = end - start
    same = size == to - at
    if not len(size):
        return same
    one, two = _lanes(raw), _views(other) if padded else _lanes(other)
    left = np.flatnonzero(same & (size > 0))
    k = 0
    while len(left):
        same[left] = _eights(one, start[left], size[left], k) == _eights(two, at[left], size[left], k)
        k += 1
        if k == 64:  # the few very long ones
            for i in left.tolist():
                same[i] = raw[start[i] : end[i]].tobytes() == other[at[i] : to[i]].tobytes()
            break
        left = left[same[left] & (size[left] > 8 * k)]
    return same


def slices(offsets: np.ndarray, most: int = 6 << 20) -> list[tuple[int, int]]:
    """Row ranges of at most `most` bytes each (a longer row stands alone)."""
    out, a, n = [], 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        out.append((a, b))
        a = b
    return out


@dataclass
class Words:
    """Words of a batch: byte spans, hashes, and the word range of each row."""

    raw: np.ndarray
    offsets: np.ndarray  # of rows, in bytes
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # first[i]:first[i + 1] are row i's words

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts())

    def hashes(self, seed: int = ONE) -> np.ndarray:
        return span_hashes(self.raw, self.start, self.end, seed)


def words(column: pa.Array | pa.ChunkedArray) -> Words:
    raw, offsets = buffers(column)
    return words_of(raw, offsets)


def words_of(raw: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(raw)
    if n == 0:
        none = np.empty(0, dtype=np.int64)
        return Words(raw, offsets, none, none, np.zeros(len(offsets), dtype=np.int64))
    letter = ~_SPACE[raw]
    edge = _row_edges(offsets, n)
    begins = letter.copy()
    begins[1:] &= ~letter[:-1] | edge[1:]
    ends = letter.copy()
    ends[:-1] &= ~letter[1:] | edge[1:]
    start = np.flatnonzero(begins)
    return Words(raw, offsets, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def _step(state: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The state with one more value taken in; a bijection of either for the other fixed."""
    state = (state ^ value) * _U(0xD6E8FEB86659FD93)
    state ^= state >> _U(32)
    return state


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words (those that cross rows included; mask them with ``window_valid``)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    state = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        state = _step(state, hashes[j : j + n])
    return mix64(state)


def range_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words start:end for every range, in as many steps as the longest range has words; equal to window_hashes at one size."""
    size = end - start
    state = size.astype(np.uint64)
    for j in range(int(size.max()) if len(size) else 0):
        at = np.flatnonzero(size > j)
        state[at] = _step(state[at], hashes[start[at] + j])
    return mix64(state)


def window_valid(first: np.ndarray, k: int) -> np.ndarray:
    """Which of the windows that window_hashes() gives lie within one row."""
    total = int(first[-1])
    n = total - k + 1
    if n <= 0:
        return np.empty(0, dtype=bool)
    room = np.repeat(first[1:], np.diff(first))
    return (np.arange(n) + k) <= room[:n]


def take(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans, one after another, and their offsets."""
    size = end - start
    offsets = np.zeros(len(size) + 1, dtype=np.int64)
    np.cumsum(size, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return raw[at], offsets


def strings(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
    """The spans as Python strings."""
    data, offsets = take(raw, start, end)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data)).to_pylist()


def expand(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i], first[i]+1, ... size[i] of them, for each i in turn."""
    out = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(first - out, size)


def word_digests(w: Words) -> list[bytes]:
    """The SHA-256 of each row's words, joined by one space."""
    data, cuts = w.raw.tobytes(), w.offsets.tolist()
    return [hashlib.sha256(b" ".join(data[x:y].split())).digest() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
