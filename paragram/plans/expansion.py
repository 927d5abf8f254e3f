"""Corpus expansion: sentence pairs by proportional alignment, gated, scored, deduplicated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paragram.functions import text as T
from paragram.operators import align, dedup, scoring, stats
from paragram.plans.profiles import Expansion


def candidates(docs: DataFrame, baseline: DataFrame, order: list[str], p: Expansion) -> DataFrame:
    """Cleaned chunks that aren't baseline pairs: the columns of docs, k, src, tgt."""
    normalize = T.normalize_transliteration if p.whole else (lambda c: F.coalesce(c, F.lit("")))
    c = align.proportional_chunks(docs, p.whole, p.at_least, normalize)
    c = c.withColumn("src", T.clean_text(F.col("src"))).withColumn("tgt", T.clean_text(F.col("tgt")))
    return dedup.new_only(c, baseline, ["src", "tgt"])


def expand(docs: DataFrame, order: list[str], p: Expansion, baseline: DataFrame | None = None, similarity: bool = True) -> DataFrame:
    """New pairs of docs (order columns, src, tgt): src, tgt, and from v41 on confidence, src_len, tgt_len, ratio.

    baseline: pairs that are known already (default: the docs' own unit pairs).  similarity: with the fuzzy-similarity gate,
    which alone leaves the JVM, and only for rows that its length bound and the other gates leave.
    """
    baseline = align.baseline_pairs(docs, order) if baseline is None else baseline
    src, tgt = F.col("src"), F.col("tgt")
    c = candidates(docs, baseline, order, p)
    if p.percentiles:
        c = c.crossJoin(F.broadcast(stats.baseline_stats(baseline, *p.percentiles)))  # one row
    gate = {"v4": scoring.clean_pair(src, tgt), "v41": scoring.band_gate(src, tgt) if p.name == "v41" else None}.get(p.name)
    gate = T.has_letter(src) & T.has_letter(tgt) if gate is None else gate
    c = c.where(gate & ~scoring.char_ratio_noise(src, tgt, p))
    if p.percentiles:
        c = scoring.scored(c, p).where((F.col("confidence") >= p.cut) & (F.col("src_len") >= p.least[0]) & (F.col("tgt_len") >= p.least[1]))
    if similarity:
        c = c.where(~scoring.too_similar(src, tgt, p))
    where = [F.col(o) for o in (*order, "k")]
    if not p.percentiles:
        return dedup.keep_best(c, ["src", "tgt"], where).select("src", "tgt")
    rank = _rank(p)
    extra = [x for x in ("source", "match_key", "ref_id") if x in docs.columns]
    return dedup.keep_best(c, ["src", "tgt"], rank + where).select(*extra, "src", "tgt", "confidence", "src_len", "tgt_len", "ratio")


def _rank(p: Expansion) -> list[Column]:
    if p.name == "v41":
        return [-F.col("confidence"), F.col("src_len"), F.col("tgt_len")]
    return [-F.col("confidence"), F.abs(F.col("ratio") - F.col(p.centre)), F.col("src_len")]


def ordered(found: DataFrame, p: Expansion, *ties: str) -> DataFrame:
    """The output's order, with the statistics as columns: confidence, closeness to the central ratio (v41: fewer words), length."""
    return found.orderBy(*_rank(p), *ties)


def merged_corpus(docs: DataFrame, order: list[str], p: Expansion) -> DataFrame:
    """Baseline pairs, then new ones; part 0 and 1."""
    baseline = align.baseline_pairs(docs, order)
    return dedup.merged(baseline.select("src", "tgt"), expand(docs, order, p, baseline).select("src", "tgt"))
