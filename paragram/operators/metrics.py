"""Translation quality metrics and pipeline counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paragram.functions import split as S
from paragram.functions import text as T


def corpus_bleu(pairs: DataFrame, key: list[str], pred: str, ref: str, max_n: int = 4) -> DataFrame:
    """One row: bleu, and precision and counts for every n.  Add-one smoothing for all n; 0 without predicted tokens."""
    p = pairs.select(*key, T.words(F.col(pred)).alias("p"), T.words(F.col(ref)).alias("r"))
    out = p.agg(F.sum(F.size("p")).alias("pred_length"), F.sum(F.size("r")).alias("ref_length"))
    precisions = []
    for n in range(1, max_n + 1):
        def counts(side: str, name: str, n: int = n) -> DataFrame:
            return p.select(*key, F.explode(S.ngrams(F.col(side), n)).alias("g")).groupBy(*key, "g").agg(F.count("*").alias(name))

        both = counts("p", "a").join(counts("r", "b"), [*key, "g"], "left")
        one = both.agg(F.coalesce(F.sum(F.least("a", F.coalesce("b", F.lit(0)))), F.lit(0)).alias(f"overlap_{n}"), F.coalesce(F.sum("a"), F.lit(0)).alias(f"total_{n}"))
        out = out.crossJoin(one)  # one row each
        precisions.append((F.col(f"overlap_{n}") + 1.0) / (F.col(f"total_{n}") + 1.0))
    mean = reduce(lambda a, b: a + b, [F.log(x) for x in precisions]) / max_n
    brevity = F.when(F.col("pred_length") > F.col("ref_length"), F.lit(1.0)).otherwise(F.exp(1.0 - F.col("ref_length") / F.greatest(F.lit(1), "pred_length")))
    return out.withColumn("bleu", F.when(F.coalesce("pred_length", F.lit(0)) == 0, F.lit(0.0)).otherwise(brevity * F.exp(mean) * 100.0))


def accuracy(pairs: DataFrame, pred: str, ref: str) -> DataFrame:
    """One row: exact_match (share of equal texts), token_accuracy (equal tokens at the same place over reference tokens)."""
    p = pairs.select(F.col(pred).alias("a"), F.col(ref).alias("b"), T.words(F.col(pred)).alias("p"), T.words(F.col(ref)).alias("r"))
    same = F.size(F.filter(F.zip_with("p", "r", lambda x, y: x == y), lambda x: F.coalesce(x, F.lit(False))))
    return p.agg(
        (F.sum((F.col("a") == F.col("b")).cast("int")) / F.greatest(F.lit(1), F.count("*"))).alias("exact_match"),
        (F.sum(same) / F.greatest(F.lit(1), F.sum(F.size("r")))).alias("token_accuracy"),
    )


def weighted_loss(rows: DataFrame, loss: str, tokens: str) -> DataFrame:
    """One row: token-weighted mean loss and its perplexity (exponent capped at 20)."""
    mean = F.sum(F.col(loss) * F.col(tokens)) / F.greatest(F.lit(1), F.sum(tokens))
    return rows.agg(mean.alias("loss")).withColumn("perplexity", F.exp(F.least(F.lit(20.0), "loss")))


def funnel(df: DataFrame, **stages: Column) -> DataFrame:
    """stage, rows, percent: how many rows pass each condition, in one pass."""
    one = df.agg(F.count("*").alias("_all"), *[F.count(F.when(c, 1)).alias(k) for k, c in stages.items()])
    each = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(k).alias("stage"), F.col(k).alias("rows")) for i, k in enumerate(stages)])
    out = one.select("_all", F.inline(each))
    return out.select("step", "stage", "rows", T.percent(F.col("rows"), F.col("_all")).alias("percent"))
