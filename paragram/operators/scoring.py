"""Gates and confidence scores of sentence pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paragram.functions import lang as L
from paragram.functions import split as S
from paragram.functions import text as T
from paragram.functions.similarity import fuzzy_ratio
from paragram.plans.profiles import Expansion


def _points(*rules: tuple[Column, int]) -> Column:
    """Sum of the points of the rules that hold."""
    total = F.lit(0)
    for rule, points in rules:
        total = total + F.when(rule, F.lit(points)).otherwise(F.lit(0))
    return total


def char_ratio_noise(src: Column, tgt: Column, p: Expansion) -> Column:
    """Too short, empty, or of unlike length."""
    ratio = F.length(tgt) / F.greatest(F.lit(1), F.length(src))  # an empty src is noise anyway
    return (F.length(tgt) < 3) | (F.length(src) == 0) | (ratio < p.noise[0]) | (ratio > p.noise[1])


def too_similar(src: Column, tgt: Column, p: Expansion) -> Column:
    return fuzzy_ratio(src, tgt, p.noise[2]) > p.noise[2]


def clean_pair(src: Column, tgt: Column) -> Column:
    """The gate of the plain expansion, without noise."""
    s, t = T.n_words(src), T.n_words(tgt)
    return s.between(2, 35) & t.between(3, 45) & T.length_ratio(src, tgt).between(0.3, 4.2) & T.has_letter(src) & T.has_letter(tgt) & (T.count_of(src, ".") <= 1) & T.even_quotes(tgt)


def band_gate(src: Column, tgt: Column) -> Column:
    """Within fixed lengths and the bands of the statistics (columns src_min and so on)."""
    s, t, r = T.n_words(src), T.n_words(tgt), T.length_ratio(src, tgt)
    low, high = F.greatest(F.lit(0.3), F.col("ratio_min") * F.lit(0.8)), F.least(F.lit(4.0), F.col("ratio_max") * F.lit(1.1))
    return (
        s.between(5, 35) & t.between(4, 45) & T.has_letter(src) & T.has_letter(tgt)
        & (s >= F.col("src_min")) & (s <= F.col("src_max")) & (t >= F.col("tgt_min")) & (t <= F.col("tgt_max")) & (r >= low) & (r <= high)
    )


def ratio_gate(src: Column, tgt: Column) -> Column:
    """Import: three words or more on both sides, and 0.3 to 6 words for one."""
    return (T.n_words(src) >= 3) & (T.n_words(tgt) >= 3) & T.length_ratio(src, tgt).between(0.3, 6.0)


def english_quality(text: Column, p: Expansion) -> Column:
    c = T.clean_text(text)
    hits = L.hits(S.ascii_words(c), p.common)
    more, alpha, alpha_points = p.english
    rules = [(hits >= 2, 2), (hits >= more, 1), (T.alpha_ratio(c) >= alpha, alpha_points), (c.rlike("[.!?]$"), 1), (T.even_quotes(c), 1)]
    if p.name == "v41":
        rules += [(~T.dirty(c), 1), (c.contains("<gap>"), -1)]
        return F.when(F.size(S.ascii_words(c)) < 3, F.lit(0)).otherwise(_points(*rules))
    rules += [(c.contains(":"), -1), (T.dirty(c), -3)]
    if p.name == "v42":
        rules += [(c.contains("<gap>"), -2), (c.contains('""'), -3)]
    return _points(*rules)


def source_quality(text: Column, p: Expansion) -> Column:
    c = T.clean_text(text)
    words = T.words(c)
    hyphens = F.size(F.filter(words, lambda w: w.contains("-")))
    gaps = F.size(F.filter(words, lambda w: w == "<gap>"))
    least, points, share = p.hyphens
    rules = [(L.is_surface_any_case(c), 2), (hyphens >= least, points), (hyphens / F.greatest(F.lit(1), F.size(words)) >= share, 1), (~c.contains("."), 1)]
    if p.name != "v51":
        rules += [(~c.startswith("<gap>") & ~c.endswith("<gap>"), 1), (gaps <= (1 if p.name == "v41" else 0), 1)]
    return _points(*rules)


def pair_confidence(src: Column, tgt: Column, p: Expansion) -> Column:
    """Additive score; the statistics are columns of the frame."""
    s, t, ratio, c = T.n_words(src), T.n_words(tgt), T.length_ratio(src, tgt), T.clean_text(tgt)
    off = F.abs(ratio - F.col(p.centre))
    near = F.when(off <= p.near[0][0], p.near[0][1]).when(off <= p.near[1][0], p.near[1][1]).otherwise(0)
    if p.name == "v41":
        rules = [(s.between(4, 18), 1), (t.between(5, 24), 1), (c.contains(":"), -1), (T.dirty(c), -2), (c.contains('""'), -2), (c.contains("<gap>"), -1)]
    else:
        rules = [(s.between(F.col("src_min"), F.col("src_max")), 2), (t.between(F.col("tgt_min"), F.col("tgt_max")), 2)]
        rules += [(s < 6, -2), (t < 5, -2), (t > 24, -1)] if p.name == "v42" else [(s < 5, -3), (t < 4, -3), (s > 35, -1), (t > 35, -1)]
    return source_quality(src, p) + english_quality(tgt, p) + near + _points(*rules)


def scored(pairs: DataFrame, p: Expansion) -> DataFrame:
    """confidence, src_len, tgt_len, ratio (three places, half to even) beside the pairs."""
    src, tgt = F.col("src"), F.col("tgt")
    return pairs.withColumn("confidence", pair_confidence(src, tgt, p)).withColumn("src_len", T.n_words(src)).withColumn("tgt_len", T.n_words(tgt)).withColumn("ratio", F.bround(T.length_ratio(src, tgt), 3))
