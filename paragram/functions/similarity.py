"""Similarity of strings and token sets."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def _matcher(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio_bound(a: Column, b: Column) -> Column:
    """No ratio exceeds 2 min / (sum) of the lengths."""
    total = F.length(a) + F.length(b)
    return F.when(total > 0, F.lit(2.0) * F.least(F.length(a), F.length(b)) / total).otherwise(F.lit(1.0))


def fuzzy_ratio(a: Column, b: Column, needed: float | None = None) -> Column:
    """Ratcliff-Obershelp ratio as the standard library computes it (asymmetric, popular characters skipped in long b).

    needed: below this bound the value doesn't matter; such rows go to Python as nulls and get the bound instead.
    """
    if needed is None:
        return _matcher(a, b)
    ask = ratio_bound(a, b) > needed
    return F.coalesce(_matcher(F.when(ask, a), F.when(ask, b)), ratio_bound(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Of distinct tokens; 0 if either side has none."""
    both = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both).otherwise(F.lit(0.0))


def blended(a: Column, b: Column, tokens_a: Column, tokens_b: Column, weight: float = 0.65) -> Column:
    return F.lit(weight) * fuzzy_ratio(a, b) + F.lit(1 - weight) * jaccard(tokens_a, tokens_b)
