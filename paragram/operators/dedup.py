"""Order-stable deduplication, merging and anti-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in the given order.

    An aggregation (least of order and row), so it combines before the shuffle and a hot key costs one row a task.
    """
    rest = [c for c in df.columns if c not in keys]
    ranks = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    best = F.min(F.struct(*ranks, *[F.col(c).alias(f"_c{i}") for i, c in enumerate(rest)])).alias("_b")
    out = df.groupBy(*keys).agg(best)
    return out.select(*[F.col(c) if c in keys else F.col(f"_b._c{rest.index(c)}").alias(c) for c in df.columns])


def keep_first(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return keep_best(df, keys, [F.col(c) for c in order])


def keep_last(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row wins, as when a dictionary is overwritten; the order columns are numbers."""
    return keep_best(df, keys, [-F.col(c) for c in order])


def new_only(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't among the known ones."""
    return df.join(known.select(*keys).distinct(), keys, "left_anti")


def merged(*parts: DataFrame) -> DataFrame:
    """All rows one part after another; `part` tells which."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("part", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return out
