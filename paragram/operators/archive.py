"""Identifier joins of archive texts with published ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragram.functions import text as T
from paragram.operators.dedup import keep_best, keep_last


def archive_pairs(literals: DataFrame, published: DataFrame, known_ids: DataFrame, clean=T.clean_translation) -> DataFrame:
    """literals (ord, source_kind alias or excavation, match_key, translation) with published texts (ord, ref_id, aliases, excavation_no, transliteration).

    Alias keys are normalised on both sides, excavation numbers only stripped; of several texts with a key the last counts.
    One row for each ref_id: alias matches before excavation matches, in order.  is_new: ref_id isn't among known_ids.
    """
    names = published.select("ord", "ref_id", F.posexplode(F.split(F.coalesce("aliases", F.lit("")), "[|;]")).alias("pos", "a")).withColumn("key", T.normalize_id(F.col("a"))).where("key <> ''")
    by_alias = keep_last(names.select("key", "ord", "pos", "ref_id"), ["key"], "ord", "pos").select("key", "ref_id", F.col("ord").alias("p_ord"))
    digs = published.select("ord", "ref_id", T.strip(F.coalesce("excavation_no", F.lit(""))).alias("key")).where("key <> ''")
    by_dig = keep_last(digs, ["key"], "ord").select("key", "ref_id", F.col("ord").alias("p_ord"))
    a = literals.where("source_kind = 'alias'").withColumn("key", T.normalize_id(F.col("match_key"))).join(by_alias, "key").withColumn("rank", F.lit(0))
    d = literals.where("source_kind = 'excavation'").withColumn("key", F.col("match_key")).join(by_dig, "key").withColumn("rank", F.lit(1))
    found = a.unionByName(d).select("ref_id", "p_ord", "rank", "ord", "match_key", "translation")
    one = keep_best(found, ["ref_id"], [F.col("rank"), F.col("ord")])
    text = published.select(F.col("ord").alias("p_ord"), "aliases", "excavation_no", "transliteration")
    known = known_ids.select("ref_id").distinct().withColumn("_known", F.lit(True))
    out = one.join(text, "p_ord").join(known, "ref_id", "left")
    return out.select(
        F.when(F.col("rank") == 0, "archive_alias").otherwise("excavation_match").alias("source"), "match_key", "ref_id", F.col("_known").isNull().alias("is_new"),
        "aliases", "excavation_no", "transliteration", clean(F.col("translation")).alias("translation"),
    )
