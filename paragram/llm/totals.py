"""Sums of vectors over all rows of a table, and exact order statistics of its columns; the driver holds sums only."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragram.llm import workers

#: Vectors that the driver adds up at once; of more tasks, groups of tasks are summed before.
FAN = 64
_UNIT = 2.0**20


def over(parts: Iterable, one: Callable[..., np.ndarray]) -> np.ndarray | None:
    """The sum of one(part); None without parts.  Each is rounded to multiples of 2**-20, so that no order of adding shows (below 2**33)."""
    total = None
    for part in parts:
        v = np.rint(one(part) * _UNIT) / _UNIT
        total = v if total is None else total + v
    return total


def summed(table: DataFrame, function: Callable[[Iterator], np.ndarray | None]) -> np.ndarray | None:
    """The sum of function(batches) over tasks, one for each core of the cluster at most; None without rows."""
    cores = table.sparkSession.sparkContext.defaultParallelism

    def row(v):
        return pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "v": pa.array([v.tobytes()], pa.binary())})

    def first(batches):
        v = function(batches)
        if v is not None:
            yield row(v)

    def add(batches):
        v = over((np.frombuffer(b) for batch in batches for b in batch.column(1).to_pylist()), lambda v: v)
        if v is not None:
            yield row(v)

    got = table.coalesce(cores).mapInArrow(workers.task(first), "part int, v binary")
    if cores > FAN:
        groups = isqrt(cores - 1) + 1
        got = got.repartition(groups, F.col("part") % groups).mapInArrow(workers.task(add), "part int, v binary")
    return over((np.frombuffer(b.as_py()) for b in got.toArrow()["v"]), lambda v: v)


def _keys(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the numbers."""
    bits = (np.ascontiguousarray(x, dtype=np.float64) + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def _numbers(keys: np.ndarray) -> np.ndarray:
    return np.where(keys >> np.uint64(63) == 1, keys ^ np.uint64(1 << 63), ~keys).view(np.float64)


def _digits(columns: list[np.ndarray], heads: list[np.ndarray], level: int) -> np.ndarray:
    """Of each column and each of its sorted heads (the first `level` bytes of a key): how many keys go on with each byte."""
    out = []
    for x, own in zip(columns, heads, strict=True):
        k = _keys(x) >> np.uint64(56 - 8 * level)
        at = np.minimum(np.searchsorted(own, k >> np.uint64(8)), len(own) - 1)
        ok = own[at] == k >> np.uint64(8)
        out.append(np.bincount(at[ok] * 256 + (k[ok] & np.uint64(255)).astype(np.int64), minlength=256 * len(own)))
    return np.concatenate(out).astype(np.float64)


def order_statistics(total: Callable, columns: Callable[..., list[np.ndarray]], ranks: list[np.ndarray]) -> list[np.ndarray]:
    """The numbers at the ranks (from 0) of each column, over all parts; exact, by a count for each of eight bytes of a key.

    total(one): the sum of one(part) over all parts; columns(part): the part's numbers of each column.
    """
    heads = [np.zeros(1, dtype=np.uint64) for _ in ranks]
    at, left = [np.zeros(len(r), dtype=np.int64) for r in ranks], [np.asarray(r, dtype=np.int64) for r in ranks]
    for level in range(8):
        counts = total(lambda part, heads=heads, level=level: _digits(columns(part), heads, level)).astype(np.int64)
        ends = np.cumsum([256 * len(own) for own in heads])
        for c, own in enumerate(heads):
            upto = counts[ends[c] - 256 * len(own) : ends[c]].reshape(-1, 256).cumsum(axis=1)
            digit = (upto[at[c]] <= left[c][:, None]).sum(axis=1)
            left[c] = left[c] - np.where(digit > 0, upto[at[c], np.maximum(digit, 1) - 1], 0)
            found = (own[at[c]] << np.uint64(8)) | digit.astype(np.uint64)
            heads[c], at[c] = np.unique(found, return_inverse=True)
    return [_numbers(own[k]) for own, k in zip(heads, at, strict=True)]


def quantiles(total: Callable, columns: Callable[..., list[np.ndarray]], rows: list[int], shares: np.ndarray) -> list[np.ndarray]:
    """numpy's quantiles, between the two nearest numbers, of columns of `rows` numbers each."""
    places = [np.asarray(shares) * (n - 1) for n in rows]
    low = [np.floor(p).astype(np.int64) for p in places]
    got = order_statistics(total, columns, [np.concatenate([k, np.minimum(k + 1, n - 1)]) for k, n in zip(low, rows, strict=True)])
    out = []
    for p, k, v in zip(places, low, got, strict=True):
        a, b, t = v[: len(k)], v[len(k) :], p - k
        out.append(np.where(t >= 0.5, b - (b - a) * (1 - t), a + (b - a) * t))
    return out
