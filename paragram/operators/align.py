"""Alignment: by position, by share of length, by nearness of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paragram.functions import split as S
from paragram.functions import text as T


def zipped(a: Column, b: Column) -> Column:
    """Pairs of two arrays up to the shorter's end."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.struct(x.alias("src"), y.alias("tgt")))


def unit_pairs(docs: DataFrame, least: int = 5) -> DataFrame:
    """Units of src and tgt paired by position, `least` characters or more on both sides; keeps the other columns, adds pos."""
    keep = [c for c in docs.columns if c not in ("src", "tgt")]
    rows = docs.select(*keep, F.posexplode(zipped(S.units(F.col("src")), S.units(F.col("tgt")))).alias("pos", "p"))
    out = rows.select(*keep, "pos", "p.src", "p.tgt")
    return out.where((F.length("src") >= least) & (F.length("tgt") >= least))


def baseline_pairs(docs: DataFrame, order: list[str]) -> DataFrame:
    """Cleaned unit pairs with a letter on both sides, the first of each pair: src, tgt and the order columns with pos."""
    from paragram.operators.dedup import keep_first

    p = unit_pairs(docs).withColumn("src", T.clean_text(F.col("src"))).withColumn("tgt", T.clean_text(F.col("tgt")))
    p = p.where(T.has_letter(F.col("src")) & T.has_letter(F.col("tgt"))).select(*order, "pos", "src", "tgt")
    return keep_first(p, ["src", "tgt"], *order, "pos")


def proportional_chunks(docs: DataFrame, whole: bool = True, at_least: int = 2, normalize=T.normalize_transliteration) -> DataFrame:
    """Words of src dealt to the sentences of tgt by their share of its characters: k, src (chunk), tgt (sentence).

    whole: shares of the length of tgt, else of the sentences' lengths together.  Each sentence gets one word at least while
    words last (half-even rounding), the last one gets the rest.  All within the row, without a shuffle.
    """
    keep = [c for c in docs.columns if c not in ("src", "tgt")]
    d = docs.select(*keep, normalize(F.col("src")).alias("src"), normalize(F.col("tgt")).alias("tgt")).where("src <> '' AND tgt <> ''")
    d = d.withColumn("sents", S.sentences(F.col("tgt"))).withColumn("words", T.words(F.col("src"))).where(F.size("sents") >= at_least)
    total = F.length("tgt") if whole else F.aggregate(F.transform("sents", F.length), F.lit(0), lambda a, x: a + x)
    share = F.transform("sents", lambda s: F.greatest(F.lit(1), F.rint(F.size("words") * (F.length(s) / F.greatest(F.lit(1), F.col("total")))).cast("int")))
    d = d.withColumn("total", total).withColumn("lens", share)
    upto = lambda k: F.least(F.size("words"), F.aggregate(F.slice("lens", 1, k), F.lit(0), lambda a, x: a + x))
    d = d.withColumn("ends", F.transform(F.sequence(F.lit(0), F.size("lens")), upto))
    chunk = F.transform("sents", lambda s, k: F.struct(
        k.alias("k"), F.array_join(F.slice("words", F.get("ends", k) + 1, F.when(k == F.size("sents") - 1, F.size("words")).otherwise(F.get("ends", k + 1)) - F.get("ends", k)), " ").alias("src"), s.alias("tgt"),
    ))
    return d.select(*keep, F.inline(chunk))


def near_lines(candidates: DataFrame, others: DataFrame, page: list[str], most: int, score: Column | None = None) -> DataFrame:
    """For each candidate line the best other line of its page within `most` lines: the nearest, or of greatest score.

    candidates, others: page, line_no, line.  Ties go to the line before.  A band join: lines are keyed by page and by a
    bucket of lines, so a long page doesn't meet itself whole.
    """
    width = most + 1
    a = candidates.select(*page, F.col("line_no").alias("a_no"), F.col("line").alias("a_line")).withColumn("bucket", F.explode(F.array(*[F.floor(F.col("a_no") / width) + d for d in (-1, 0, 1)])))
    b = others.select(*page, F.col("line_no").alias("b_no"), F.col("line").alias("b_line")).withColumn("bucket", F.floor(F.col("b_no") / width))
    distance = F.abs(F.col("a_no") - F.col("b_no"))
    met = a.join(b, [*page, "bucket"]).withColumn("distance", distance).where((F.col("distance") >= 1) & (F.col("distance") <= most))
    met = met.withColumn("near_score", score) if score is not None else met.withColumn("near_score", -F.col("distance").cast("double"))
    best = F.min(F.struct((-F.col("near_score")).alias("o"), F.col("b_no").alias("b_no"), "b_line", "distance", "near_score"))
    out = met.groupBy(*page, "a_no", "a_line").agg(best.alias("b"))
    return out.select(*page, F.col("a_no").alias("line_no"), F.col("a_line").alias("line"), "b.b_no", "b.b_line", "b.distance", "b.near_score")


def near_in_page(pages: DataFrame, page: list[str], lines: str, candidate: str, other: str, most: int) -> DataFrame:
    """For each candidate line the nearest other line of its page within `most` lines, without a shuffle: page, line_no, line, b_no, b_line, distance.

    lines: an array column; candidate, other: array columns of flags, one for each line.  Ties go to the line before.
    """
    steps = F.array(*[F.lit(x) for d in range(1, most + 1) for x in (-d, d)])

    def nearest(i: Column) -> Column:
        return F.get(F.filter(steps, lambda d: (i + d >= 0) & F.coalesce(F.get(F.col(other), F.greatest(i + d, F.lit(0))), F.lit(False))), F.lit(0))

    at = F.filter(F.transform(candidate, lambda flag, i: F.when(flag, i)), lambda i: i.isNotNull())
    met = F.filter(F.transform(at, lambda i: F.struct(i.alias("line_no"), nearest(i).alias("d"))), lambda x: x["d"].isNotNull())
    out = pages.select(*page, lines, F.inline(met))
    b_no = F.col("line_no") + F.col("d")
    return out.select(*page, "line_no", F.get(lines, F.col("line_no")).alias("line"), b_no.alias("b_no"), F.get(lines, b_no).alias("b_line"), F.abs("d").alias("distance"))


def greedy_lines(pages: DataFrame, page: list[str], sources: str, targets: str, most: int = 3) -> DataFrame:
    """Sources in page order, each takes the nearest target line not taken yet within `most` lines (ties: the line before).

    sources, targets: array columns of (i, line).  A fold over the arrays within the row.
    """
    kind = "array<struct<a:int,src:string,b:int,tgt:string>>"
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast(kind).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        free = F.filter(targets, lambda t: ~F.array_contains(acc["used"], t["i"]) & (F.abs(t["i"] - s["i"]) >= 1) & (F.abs(t["i"] - s["i"]) <= most))
        best = F.array_min(F.transform(free, lambda t: F.struct(F.abs(t["i"] - s["i"]).alias("d"), t["i"].alias("i"), t["line"].alias("line"))))
        pair = F.struct(s["i"].alias("a"), s["line"].alias("src"), best["i"].alias("b"), best["line"].alias("tgt"))
        return F.when(best.isNull(), acc).otherwise(F.struct(F.concat(acc["used"], F.array(best["i"])).alias("used"), F.concat(acc["out"], F.array(pair)).alias("out")))

    return pages.select(*page, F.inline(F.aggregate(F.col(sources), start, step, lambda acc: acc["out"])))
