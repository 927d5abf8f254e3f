"""Exact token counts of every prefix of a text, by prefix dynamic programming.

The encoding of each prefix has exactly one last piece (see pieces.py), so a
table over prefix lengths holds it: the piece that ends there and whose start
is a prefix whose own last piece it may follow.  The count at a prefix is the
count at that start plus one (plus the bytes, for a character outside the
model).  ``stored_tables`` writes the table of every document, as differences
from prefix to prefix (a byte each), to the shared folder.  From what is stored
``count_at`` (how many tokens has the text cut here?), ``longest_within`` (how
far may the text go under a budget?) and ``prefix_counts`` answer without
encoding again.  Distinct chunks are computed once; chunks in sorted order
share the table of their common start.

Null counts as empty: no tokens.  Whole texts are read, however long; a slice
of a batch holds a few megabytes of text, or one longer text.  Repeated rows
are counted each; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragram.llm import pieces, storage, workers
from paragram.llm.chunks import ChunkCache
from paragram.llm.textbytes import buffers, slices


class PrefixCounter:
    def __init__(self, path: str) -> None:
        self.model = pieces.load(path)
        self.cache = ChunkCache(np.int32)

    def tables(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each chunk the counts after 1, 2, ... characters, one chunk after another; and their sizes."""
        model = self.model
        reached, number, follows, longest = model.reached, model.id, model.follows, model.longest
        order = sorted(range(len(chunks)), key=chunks.__getitem__)
        out: list[list[int]] = [[]] * len(chunks)
        before, last, count = "", [-1], [0]
        for i in order:
            text = chunks[i].replace(" ", pieces.MARK)
            same, most = 0, min(len(text), len(before))
            while same < most and text[same] == before[same]:
                same += 1
            del last[same + 1 :], count[same + 1 :]
            for end in range(same + 1, len(text) + 1):
                for start in range(end - 1, max(-1, end - 1 - longest), -1):
                    piece = text[start:end]
                    if piece in reached:
                        b = number[piece]
                        if start == 0 or follows(last[start], b):
                            last.append(b)
                            count.append(count[start] + 1)
                            break
                    elif end - start == 1 and piece not in number:
                        b = model.number(piece)
                        if start == 0 or follows(last[start], b):
                            last.append(b)
                            count.append(count[start] + model.cost(b))
                            break
            before = text
            out[i] = count[1:]
        size = np.array([len(x) for x in out], dtype=np.int64)
        return np.array([c for x in out for c in x], dtype=np.int32), size

    def batch(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts after 0, 1, 2, ... characters of each row, and the range of each row."""
        rows = len(offsets) - 1
        text, grown = pieces.marked(raw, offsets)
        start = pieces.piece_chunk_starts(text, grown, self.model.barrier)
        if len(start) == 0:
            return np.zeros(rows, dtype=np.int64), np.arange(rows + 1)
        counts, at = self.cache.rows(text, start, np.append(start[1:], len(text)), self.tables)
        whole = counts[at[1:] - 1].astype(np.int64)
        total = np.zeros(len(start) + 1, dtype=np.int64)
        np.cumsum(whole, out=total[1:])
        bounds = np.searchsorted(start, grown)
        base = np.repeat(total[:-1] - np.repeat(total[bounds[:-1]], np.diff(bounds)), np.diff(at))
        table = counts + base
        # A row that isn't empty has one more entry than characters, that of the mark put before it; it becomes the
        # entry of the empty prefix.
        chars = at[bounds]
        full = np.diff(chars) > 0
        table[chars[:-1][full]] = 0
        if not full.all():
            table = np.insert(table, chars[:-1][~full], 0)
            chars = np.concatenate([[0], np.cumsum(np.maximum(np.diff(chars), 1))])
        return table, chars


def counter(path: str) -> PrefixCounter:
    return workers.tool(("counts", path), lambda: PrefixCounter(path))


def packed(table: np.ndarray) -> bytes:
    """Counts after 0, 1, 2, ... characters as stored: a byte for the width (1 or 4), then the differences, little-endian."""
    steps = np.diff(table.astype(np.int64))
    width = 1 if len(steps) == 0 or (steps.min() >= -128 and steps.max() <= 127) else 4
    return bytes([width]) + steps.astype(f"<i{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """Counts after 0, 1, 2, ... characters."""
    steps = np.frombuffer(data, dtype=f"<i{data[0]}", offset=1)
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


def count_at(data: bytes, chars: int) -> int:
    """Tokens of the first `chars` characters, from a stored table."""
    return int(np.frombuffer(data, dtype=f"<i{data[0]}", offset=1, count=chars).sum(dtype=np.int64)) if chars else 0


def longest_within(data: bytes, budget: int) -> int:
    """The most characters from the start that have `budget` tokens at most, from a stored table."""
    return int(np.flatnonzero(unpacked(data) <= budget)[-1])


def stored_tables(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, table (see ``packed``) of every row, written to the shared folder."""

    def run(batches):
        tool = counter(model)
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            for a, b in slices(offsets, 3 << 20):
                table, at = tool.batch(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                tables = [packed(table[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offsets[a : b + 1])), pa.array(tables, pa.binary())], ["doc_id", "n_bytes", "table"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return storage.written_by(rows, run, "doc_id long, n_bytes long, table binary", "prefixes", ("counts", model))


def prefix_counts(tables: DataFrame, budget: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fits_chars (the longest prefix within the budget), from stored tables alone."""

    def run(batches):
        for batch in batches:
            found = []
            for data in batch.column(2).to_pylist():
                counts = unpacked(data)
                found.append((int(counts[-1]), bool(counts[-1] > budget), int(np.flatnonzero(counts <= budget)[-1])))
            columns = [pa.array(c, k) for c, k in zip(list(zip(*found, strict=True)) or ((), (), ()), (pa.int64(), pa.bool_(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fits_chars"])

    return tables.select("doc_id", "n_bytes", "table").mapInArrow(workers.task(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fits_chars long")
