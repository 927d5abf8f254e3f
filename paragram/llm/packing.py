"""Sum-of-squares online packing of documents into token windows.

The ids of a document (its text's ids and an end id) are cut into whole windows
and a rest.  Each rest goes, as it arrives, to the fill level at which the sum
of squares of the numbers of partly filled windows by level becomes least
(placing s tokens at level h takes a window from level h and gives one to level
h + s; a new window counts as level 0, and a full one counts no more); ties go
to the fullest window.  The numbers by level are an array of one entry for each
token of a window, so a placement costs the same however many documents came
before.

At most MOST_OPEN windows are partly filled at a time.  While that many are, no
window is begun for a rest that fits into one of them, and a rest that fits
into none is cut: it fills the window, again of the level that leaves the least
sum of squares, and its remainder begins the next.  So all but the MOST_OPEN
windows that a task still holds at its end are filled by this rule.  The ids of
those are laid one after another and cut at window borders, and what is left is
cut into sequences of powers of two, which need no padding.  Each task packs
its own partition.

Null and empty texts are the end id alone.  A null doc_id stays null.  Repeated
rows are packed each.  Other columns are ignored.  An empty table gives no row.
A very long text is whole windows and a rest.  Sequence ids are unique in the
result: partition number * 2**32 + a count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from paragram.llm import workers
from paragram.llm.tokens import crc, encoded_rows

#: Windows that a task holds open; each more keeps more documents whole and leaves more to be re-cut at the task's end.
MOST_OPEN = 16


class SumOfSquares:
    """Assigns pieces of at most `capacity` tokens to windows, online, with at most `most_open` partly filled windows."""

    def __init__(self, capacity: int, most_open: int = MOST_OPEN) -> None:
        self.capacity, self.most_open = capacity, most_open
        self.levels = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.windows = self.n_open = 0

    def _begin(self) -> int:
        self.windows += 1
        return self.windows - 1

    def _put(self, window: int, level: int) -> None:
        if level < self.capacity:
            self.levels[level] += 1
            self.open[level].append(window)
            self.n_open += 1

    def _take(self, level: int) -> int:
        self.levels[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def place(self, size: int) -> list[tuple[int, int, int]]:
        """Where `size` tokens go: window, offset in it, how many (two parts where they are cut)."""
        n, cap = self.levels, self.capacity
        if size == cap:
            return [(self._begin(), 0, cap)]
        full = self.n_open >= self.most_open
        held = np.flatnonzero(n[1 : cap - size + 1]) + 1
        level = 0
        if len(held):
            up = 2 * (n[held + size] - n[held]) + 2
            if held[-1] + size == cap:  # a window that fills leaves the sum
                up[-1] = 1 - 2 * n[held[-1]]
            k = len(up) - 1 - int(np.argmin(up[::-1]))
            if full or up[k] <= 2 * int(n[size]) + 1:
                level = int(held[k])
        if level or not full:
            window = self._take(level) if level else self._begin()
            self._put(window, level + size)
            return [(window, level, size)]
        held = np.flatnonzero(n)
        rest = size - (cap - held)
        up = 2 * (n[rest] - n[held] - (rest == held)) + 2  # one window leaves its level, another enters the remainder's
        k = len(up) - 1 - int(np.argmin(up[::-1]))
        level, rest = int(held[k]), int(rest[k])
        first, second = self._take(level), self._begin()
        self._put(second, rest)
        return [(first, level, cap - level), (second, 0, rest)]


class Packer:
    """Packs documents and gives the pieces of windows as they fill."""

    COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

    def __init__(self, capacity: int, first_id: int, with_ids: bool, most_open: int = MOST_OPEN) -> None:
        self.bins, self.first_id, self.with_ids = SumOfSquares(capacity, most_open), first_id, with_ids
        self.waiting: dict[int, list[tuple]] = {}
        self.done: list[tuple] = []
        self.placed = self.recut = 0

    def _emit(self, doc: tuple, start: int, ids: np.ndarray, window: int, offset: int) -> None:
        row = (doc[0], start, len(ids), crc(ids), doc[1], self.first_id + window, offset)
        self.done.append(row + (ids.astype("<u4").tobytes(),) if self.with_ids else row)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        cap, doc = self.bins.capacity, (doc_id, len(ids))
        for start in range(0, len(ids), cap):
            for window, offset, size in self.bins.place(min(cap, len(ids) - start)):
                piece = ids[start : start + size]
                if size == cap:
                    self._emit(doc, start, piece, window, 0)
                else:
                    self.waiting.setdefault(window, []).append((doc, start, piece.copy(), offset))
                    if offset + size == cap:
                        for d, s, p, o in self.waiting.pop(window):
                            self._emit(d, s, p, window, o)
                start += size
        self.placed += len(ids)

    def finish(self) -> None:
        """Lays out the windows that are still open."""
        cap, window, room, used = self.bins.capacity, self.bins.windows, 0, 0
        left = self.recut = sum(len(p[2]) for parts in self.waiting.values() for p in parts)
        for parts in self.waiting.values():
            for doc, start, piece, _ in parts:
                while len(piece):
                    if used == room:
                        window, used = window + (room > 0), 0
                        room = cap if left >= cap else 1 << (left.bit_length() - 1)
                    take = min(room - used, len(piece))
                    self._emit(doc, start, piece[:take], window, used)
                    start, piece, used, left = start + take, piece[take:], used + take, left - take
        self.waiting = {}

    def rows(self) -> pa.RecordBatch:
        names = [*self.COLUMNS, *["ids"] * self.with_ids]
        types = [pa.int64()] * 7 + [pa.binary()] * self.with_ids
        columns = list(zip(*self.done, strict=True)) or [[] for _ in names]
        self.done = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def pack(df: DataFrame, tokenizer: str, end: int, capacity: int = 4096, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", most_open: int = MOST_OPEN) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, little-endian uint32, if asked for).

    No shuffle: the partitions of the input are packed as they are.
    """

    def run(batches):
        packer = Packer(capacity, TaskContext.get().partitionId() << 32, with_ids, most_open)
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for a, ids, bounds in encoded_rows(batch.column(1), tokenizer, end):
                at = bounds.tolist()
                for i in range(len(at) - 1):
                    packer.add(docs[a + i], ids[at[i] : at[i + 1]])
                if len(packer.done) > 5_000:
                    yield packer.rows()
        packer.finish()
        yield packer.rows()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return df.selectExpr(f"CAST(`{id_col}` AS LONG) AS id", f"CAST(`{text_col}` AS STRING) AS text").mapInArrow(workers.task(run, tokenizer), schema + ", ids binary" * with_ids)
