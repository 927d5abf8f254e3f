"""SentencePiece encoding by suffix-array matching, and decoding.

The distinct chunks of a batch are laid one after another.  A suffix array of
that text (ordered by as many characters as the longest piece has) gives every
occurrence of a piece as one range, which two binary searches find; all pieces
are searched at once.  The occurrences are edges from a position to a later
one; sorted by position, they are relaxed: an edge whose piece may follow the
last piece at its start (see pieces.py) settles its end.  Exactly one edge
settles each position, so the path to a chunk's end is the model's encoding.

Null and empty texts have no ids.  Whole texts are read, however long; a slice
of a batch holds a few megabytes of text, or one longer text.  Repeated rows
are encoded each; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from paragram.llm import pieces, storage, workers
from paragram.llm.chunks import ChunkCache
from paragram.llm.textbytes import buffers, expand, slices
from paragram.llm.tokens import crc

#: Characters in a 64-bit sort key.
_PER_KEY, _BITS = 5, 12


def _ahead(keys: list[np.ndarray], at: np.ndarray, want: list[np.ndarray], or_equal: bool) -> np.ndarray:
    """Whether keys[at] < want (or <=), key by key."""
    less, equal = np.zeros(len(at), dtype=bool), np.ones(len(at), dtype=bool)
    for k, w in zip(keys, want, strict=True):
        have = k[at]
        less |= equal & (have < w)
        equal &= have == w
    return less | equal if or_equal else less


def _search(keys: list[np.ndarray], want: list[np.ndarray], right: bool) -> np.ndarray:
    lo = np.zeros(len(want[0]), dtype=np.int64)
    hi = np.full(len(want[0]), len(keys[0]), dtype=np.int64)
    for _ in range(int(len(keys[0])).bit_length() + 1):
        open_ = lo < hi
        mid = np.minimum((lo + hi) // 2, max(0, len(keys[0]) - 1))
        ahead = _ahead(keys, mid, want, right) & open_
        lo = np.where(ahead, mid + 1, lo)
        hi = np.where(open_ & ~ahead, mid, hi)
    return lo


class SuffixMatcher:
    def __init__(self, path: str) -> None:
        self.model = model = pieces.load(path)
        self.cache = ChunkCache(np.int32)
        if len(model.alphabet) >= (1 << _BITS) - 1:
            raise ValueError("the model's alphabet is too large")
        self.codes = np.zeros(max(map(ord, model.alphabet)) + 2, dtype=np.uint64)
        for i, c in enumerate(model.alphabet):
            self.codes[ord(c)] = i + 1
        found = sorted(model.reached)
        self.size = np.array([len(p) for p in found])
        self.number = np.array([model.id[p] for p in found])
        self.words = -(-model.longest // _PER_KEY)
        low, high = [], []
        for w in range(self.words):
            lo, hi = np.zeros(len(found), dtype=np.uint64), np.zeros(len(found), dtype=np.uint64)
            for j in range(_PER_KEY):
                at = w * _PER_KEY + j
                code = np.array([int(self.codes[ord(p[at])]) if at < len(p) else 0 for p in found], dtype=np.uint64)
                shift = np.uint64(_BITS)
                lo = lo << shift | code
                hi = hi << shift | np.where(self.size > at, code, np.uint64((1 << _BITS) - 1))
            low.append(lo)
            high.append(hi)
        self.low, self.high = low, high

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and piece of every occurrence, sorted by start; text: code points."""
        known = np.minimum(text, len(self.codes) - 1)
        code = self.codes[known]
        padded = np.concatenate([code, np.zeros(self.words * _PER_KEY, dtype=np.uint64)])
        n, keys = len(code), []
        for w in range(self.words):
            key = np.zeros(n, dtype=np.uint64)
            for j in range(_PER_KEY):
                at = w * _PER_KEY + j
                key = key << np.uint64(_BITS) | padded[at : at + n]
            keys.append(key)
        suffixes = np.lexsort(keys[::-1])
        keys = [k[suffixes] for k in keys]
        lo, hi = _search(keys, self.low, False), _search(keys, self.high, True)
        count = np.maximum(hi - lo, 0)
        start = suffixes[expand(lo, count)]
        order = np.argsort(start, kind="stable")
        return start[order], np.repeat(self.size, count)[order], np.repeat(self.number, count)[order]

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        model = self.model
        joined = "\x00".join(chunks).replace(" ", pieces.MARK) + "\x00"
        text = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        start, size, piece = self.edges(text)
        n = len(text)
        first = np.searchsorted(start, np.arange(n + 1)).tolist()
        ends, numbers = (start + size).tolist(), piece.tolist()
        last, back = [-1] * (n + 1), [0] * (n + 1)
        follows, at, ids, sizes = model.follows, 0, [], []
        for chunk in chunks:
            begin, stop = at, at + len(chunk)
            for p in range(begin, stop):
                a = last[p]
                for e in range(first[p], first[p + 1]):
                    b, end = numbers[e], ends[e]
                    if last[end] < 0 and (p == begin or follows(a, b)):
                        last[end], back[end] = b, p
                if last[p + 1] < 0 and joined[p] not in model.id:
                    b = model.number(joined[p])
                    if p == begin or follows(a, b):
                        last[p + 1], back[p + 1] = b, p
            path, p = [], stop
            while p > begin:
                path.append(last[p])
                p = back[p]
            own = [i for b in reversed(path) for i in ((b,) if b < pieces.UNKNOWN else model.ids_of(b))]
            ids += own
            sizes.append(len(own))
            at = stop + 1
            if at <= n:
                last[at] = -1
        return np.array(ids, dtype=np.int32), np.array(sizes, dtype=np.int64)

    def batch(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows, and the range of each row."""
        text, grown = pieces.marked(raw, offsets)
        start = pieces.piece_chunk_starts(text, grown, self.model.barrier)
        if len(start) == 0:
            return np.empty(0, dtype=np.int32), np.zeros(len(offsets), dtype=np.int64)
        ids, at = self.cache.rows(text, start, np.append(start[1:], len(text)), self.encode_chunks)
        return ids, at[np.searchsorted(start, grown)]


class Decoder:
    """Text of ids: pieces, bytes of unknown characters, spaces for marks, without the mark put before the text."""

    def __init__(self, path: str) -> None:
        model = pieces.load(path)
        self.parts = {i: p.replace(pieces.MARK, " ").encode() for p, i in model.id.items()}
        self.parts |= {i: bytes([b]) for b, i in model.bytes.items()}
        self.parts = [self.parts.get(i, b"") for i in range(max(self.parts) + 1)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.parts.__getitem__, ids))[1:]


def tools(path: str) -> tuple[SuffixMatcher, Decoder]:
    return workers.tool(("pieces", path), lambda: (SuffixMatcher(path), Decoder(path)))


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int)."""

    def run(batches):
        tool, _ = tools(model)
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            for a, b in slices(offsets, 3 << 20):
                ids, at = tool.batch(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["doc_id", "ids"])

    return df.selectExpr(f"CAST(`{id_col}` AS LONG) AS id", f"CAST(`{text_col}` AS STRING) AS text").mapInArrow(workers.task(run, ("pieces", model)), "doc_id long, ids array<int>")


def decode(df: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """doc_id, text of the ids; a null list is an empty text, bytes that aren't UTF-8 become U+FFFD."""

    def run(batches):
        _, tool = tools(model)
        for batch in batches:
            out = [tool.decode(x or []).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return df.selectExpr("CAST(doc_id AS LONG) AS doc_id", f"`{ids_col}` AS ids").mapInArrow(workers.task(run, ("pieces", model)), "doc_id long, text string")


def digest(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded_sha256, round_trip: encoding and decoding in one pass."""

    def run(batches):
        tool, back = tools(model)
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            data = raw.tobytes()
            for a, b in slices(offsets, 3 << 20):
                ids, at = tool.batch(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                rows, bounds, cuts = [], at.tolist(), offsets.tolist()
                for i in range(b - a):
                    own = ids[bounds[i] : bounds[i + 1]]
                    text = back.decode(own.tolist())
                    rows.append((len(own), crc(own), hashlib.sha256(text).hexdigest(), text == data[cuts[a + i] : cuts[a + i + 1]]))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"])

    schema = "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean"
    return df.selectExpr(f"CAST(`{id_col}` AS LONG) AS id", f"CAST(`{text_col}` AS STRING) AS text").mapInArrow(workers.task(run, ("pieces", model)), schema)
