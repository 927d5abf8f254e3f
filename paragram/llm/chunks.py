"""Values of distinct text chunks, computed once and kept in a cache that is bounded in bytes, one for each worker."""

from __future__ import annotations

import weakref
from collections.abc import Callable

import numpy as np

from paragram.llm.textbytes import PAD, expand, same_spans, span_hashes, strings, take


class ChunkCache:
    """Maps a chunk of text to an array of values.

    Chunks are found by a 64-bit hash, and the bytes of every hit are compared; a chunk whose hash belongs to another text
    is computed by itself, each time.  Keys, texts and values take `most_bytes` at most (or what one batch needs).  Of a
    process's caches only the last one used holds anything, so that a reused worker doesn't add them up.
    """

    _last: weakref.ref[ChunkCache] | None = None

    def __init__(self, kind: type, most_bytes: int = 96 << 20) -> None:
        self.kind, self.most_bytes = kind, most_bytes
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, dtype=np.uint64)
        self.at, self.size = np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int32)
        self.text_at, self.text_size = np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int32)
        self.texts = np.zeros(PAD, dtype=np.uint8)  # with PAD bytes behind them
        self.values = np.empty(0, dtype=self.kind)

    def _bytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.at, self.size, self.text_at, self.text_size, self.texts, self.values))

    def rows(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The chunks' values one after another, and the offset of each chunk's.  make: values and sizes of new chunks."""
        last = ChunkCache._last() if ChunkCache._last else None
        if last is not self:
            if last is not None:
                last.clear()
            ChunkCache._last = weakref.ref(self)
        keys, first, back = np.unique(span_hashes(raw, start, end), return_index=True, return_inverse=True)
        if self._bytes() > self.most_bytes:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            spans = first[new]
            values, size = make(strings(raw, start[spans], end[spans]))
            merged = np.concatenate([self.keys, keys[new]])
            order = np.argsort(merged, kind="stable")
            texts, bounds = take(raw, start[spans], end[spans])
            join = lambda old, places, base: np.concatenate([old, (base + places).astype(np.int32)])[order]
            self.at = join(self.at, np.cumsum(size) - size, len(self.values))
            self.size = join(self.size, size, 0)
            self.text_at = join(self.text_at, bounds[:-1], len(self.texts) - PAD)
            self.text_size = join(self.text_size, np.diff(bounds), 0)
            self.keys = merged[order]
            self.texts = np.concatenate([self.texts[:-PAD], texts, np.zeros(PAD, dtype=np.uint8)])
            self.values = np.concatenate([self.values, values.astype(self.kind)])
            at = np.searchsorted(self.keys, keys)
        entry = at[back]
        text_at = self.text_at[entry].astype(np.int64)
        other = np.flatnonzero(~same_spans(raw, start, end, self.texts, text_at, text_at + self.text_size[entry], True))
        place, size, values = self.at[entry].astype(np.int64), self.size[entry].astype(np.int64), self.values
        if len(other):
            more, sizes = make(strings(raw, start[other], end[other]))
            place[other], size[other] = len(values) + np.cumsum(sizes) - sizes, sizes
            values = np.concatenate([values, more.astype(self.kind)])
        total = np.zeros(len(start) + 1, dtype=np.int64)
        np.cumsum(size, out=total[1:])
        return values[expand(place, size)], total
