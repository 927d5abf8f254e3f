"""Import of external parallel corpora next to an active one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragram.functions import text as T
from paragram.operators import scoring
from paragram.operators.dedup import keep_first


def classified(external: DataFrame, active: DataFrame) -> DataFrame:
    """First occurrences of non-empty pairs (mode, mode_ord, line_no, row_id, src, tgt), each with its verdict: kept, active or filtered."""
    rows = external.withColumn("src", T.clean_text(F.col("src"))).withColumn("tgt", T.clean_text(F.col("tgt"))).where("src <> '' AND tgt <> ''")
    rows = keep_first(rows, ["src", "tgt"], "mode_ord", "line_no")
    known = active.select("src", "tgt").distinct().withColumn("_active", F.lit(True))
    src, tgt = F.col("src"), F.col("tgt")
    ok = T.has_letter(src) & T.has_letter(tgt) & scoring.ratio_gate(src, tgt)
    verdict = F.when(F.col("_active").isNotNull(), "active").when(ok, "kept").otherwise("filtered")
    return rows.join(known, ["src", "tgt"], "left").withColumn("verdict", verdict).drop("_active")


def imported(external: DataFrame, active: DataFrame) -> DataFrame:
    """mode, row_id, src, tgt, src_len, tgt_len, ratio of the pairs that are new and pass."""
    rows = classified(external, active).where("verdict = 'kept'")
    n = rows.withColumn("src_len", T.n_words(F.col("src"))).withColumn("tgt_len", T.n_words(F.col("tgt")))
    return n.select("mode", "row_id", "src", "tgt", "src_len", "tgt_len", F.bround(F.col("tgt_len") / F.greatest(F.lit(1), F.col("src_len")), 3).alias("ratio"))


def import_stats(external: DataFrame, active: DataFrame) -> DataFrame:
    """One row of counts; empty rows count as raw only."""
    full = external.withColumn("src", T.clean_text(F.col("src"))).withColumn("tgt", T.clean_text(F.col("tgt")))
    raw = full.agg(F.count("*").alias("external_raw"), F.count(F.when((F.col("src") != "") & (F.col("tgt") != ""), 1)).alias("_full"))
    c = classified(external, active)
    of = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    modes = [F.count(F.when((F.col("verdict") == "kept") & (F.col("mode") == m), 1)).alias(f"{m}_kept") for m in ("train", "valid", "test")]
    one = c.agg(F.count("*").alias("external_unique"), of("active").alias("already_in_active"), of("filtered").alias("filtered_out"), of("kept").alias("imported_new"), *modes)
    return raw.crossJoin(one).withColumn("duplicate_inside_external", F.col("_full") - F.col("external_unique")).drop("_full")
