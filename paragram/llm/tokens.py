"""Token ids of whole texts through the tokenizers library, with each distinct chunk encoded once.

A text is cut before white space that follows a plain letter, digit or sign.
No pre-token of the two public BPE files reaches across such a cut, so the ids
of a text are those of its chunks, one after another (tests compare them with
encoding whole texts).  Chunks that hold a special token's string are encoded
alone; the others are joined by a special token, whose id marks the borders.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa

from paragram.llm import workers
from paragram.llm.chunks import ChunkCache
from paragram.llm.textbytes import _SPACE, _row_edges, buffers, slices

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

_SEPARATOR = "<|endoftext|>"


def chunk_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the chunks: every row start, and white space after an ASCII sign or a letter U+00C0 to U+00FF."""
    n = len(raw)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    space = _SPACE[raw]
    solid = ~space & (raw < 0x80) & (raw > 0x20)
    solid[1:] |= (raw[1:] >= 0x80) & (raw[:-1] == 0xC3)
    cut = _row_edges(offsets, n).copy()
    cut[1:] |= space[1:] & solid[:-1]
    return np.flatnonzero(cut)


class Encoder:
    """Ids of batches of texts.  One per Python worker; see ``encoder``."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.separator = self.tokenizer.token_to_id(_SEPARATOR)
        self.type = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.cache = ChunkCache(self.type)

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks one after another, and how many each has."""
        special = [i for i, c in enumerate(chunks) if "<|" in c]
        held, plain = set(special), chunks
        if special:
            plain = [c if i not in held else "" for i, c in enumerate(chunks)]
        parts, sizes = [], []
        for k in range(0, len(plain), 50_000):
            joined = _SEPARATOR.join(plain[k : k + 50_000]) + _SEPARATOR
            got = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=np.int64)
            ends = np.flatnonzero(got == self.separator)
            sizes.append(np.diff(ends, prepend=-1) - 1)
            parts.append(got[got != self.separator])
        ids, size = np.concatenate(parts), np.concatenate(sizes)
        if special:
            split = np.split(ids, np.cumsum(size)[:-1])
            for i in special:
                split[i] = np.array(self.tokenizer.encode(chunks[i], add_special_tokens=False).ids, dtype=np.int64)
            ids, size = np.concatenate(split), np.array([len(x) for x in split])
        return ids.astype(self.type), size.astype(np.int32)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, and the id range of each row (as offsets)."""
        start = chunk_starts(raw, offsets)
        if len(start) == 0:
            return np.empty(0, dtype=self.type), np.zeros(len(offsets), dtype=np.int64)
        end = np.append(start[1:], len(raw))
        out, total = self.cache.rows(raw, start, end, self._encode)
        return out, total[np.searchsorted(start, offsets)]


def encoder(path: str) -> Encoder:
    return workers.tool(path, lambda: Encoder(path))


def encoded_rows(column: pa.Array, path: str, end: int):
    """For each slice of the column: its first row, ids with `end` after each row, and the id range of each row."""
    raw, offsets = buffers(column)
    tool = encoder(path)
    for a, b in slices(offsets):
        ids, bounds = tool.encode(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        rows = np.arange(b - a + 1)
        out = np.empty(len(ids) + b - a, dtype=tool.type)
        ends = bounds[1:] + rows[:-1]
        out[ends] = end
        body = np.ones(len(out), dtype=bool)
        body[ends] = False
        out[body] = ids
        yield a, out, bounds + rows


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
