"""Splits, vocabularies, id encoding and padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paragram.functions import text as T
from paragram.operators import stats

#: Ids of the special tokens.
SPECIALS = ("<pad>", "<unk>", "<bos>", "<eos>")
PAD, UNK, BOS, EOS = range(4)
_BUCKETS = 1 << 12


#: Keys of a seeded order lie below this.
SHUFFLE_BOUND = 1 << 60


def shuffle_key(seed: int, *columns: str) -> Column:
    """A reproducible random order: the first 60 bits of a digest of the seed and the columns, which other engines can make too."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def shuffled(df: DataFrame, seed: int, *columns: str) -> DataFrame:
    """rank (from 0): the place of every row in the seeded order (ties by the columns)."""
    return ranked(df.withColumn("_key", shuffle_key(seed, *columns)), "_key", list(columns), SHUFFLE_BOUND).drop("_key")


def ranked(df: DataFrame, key: str, order: list[str], bound: int) -> DataFrame:
    """rank (from 0) of every row by key, then order; key lies in [0, bound).

    Buckets of the key are counted (a fixed number of rows, broadcast) and ranks are taken within them, so no task orders it all.
    """
    d = df.withColumn("_b", F.floor(F.col(key) / F.lit(max(1, -(-bound // _BUCKETS)))))
    size = d.groupBy("_b").agg(F.count("*").alias("_k"))
    before = F.sum("_k").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    size = size.select("_b", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_b").orderBy(key, *order))
    return d.withColumn("_r", within).join(F.broadcast(size), "_b").withColumn("rank", F.col("_before") + F.col("_r") - 1).drop("_b", "_r", "_before")


def split(df: DataFrame, key: str, order: list[str], bound: int, train: float = 0.70, valid: float = 0.15) -> DataFrame:
    """part: the first int(n * train) rows in order are train, the next int(n * valid) valid, the rest test."""
    n = df.agg(F.count("*").alias("_n"))
    a, b = F.floor(F.col("_n") * F.lit(float(train))), F.floor(F.col("_n") * F.lit(float(valid)))
    out = ranked(df, key, order, bound).crossJoin(F.broadcast(n))
    return out.withColumn("part", F.when(F.col("rank") < a, "train").when(F.col("rank") < a + b, "valid").otherwise("test")).drop("_n")


def vocabulary(df: DataFrame, text: str, order: list[str], max_size: int = 20_000, min_freq: int = 2) -> DataFrame:
    """token, id, n: special tokens first, then by frequency, those seen first before others of the same count."""
    counts = stats.token_counts(df.withColumn("_w", T.words(F.col(text))), "_w", *order)
    top = stats.most_common(counts.where((F.col("n") >= min_freq) & ~F.col("token").isin(*SPECIALS)), max(0, max_size - len(SPECIALS)))
    top = top.withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), "ord")) + (len(SPECIALS) - 1))  # at most max_size rows
    special = df.sparkSession.createDataFrame([(t, i, None) for i, t in enumerate(SPECIALS)], "token string, id int, n long")
    return special.unionByName(top.select("token", F.col("id").cast("int").alias("id"), "n"))


def encode(df: DataFrame, keys: list[str], text: str, vocab: DataFrame, bos: bool = False, eos: bool = False, most: int | None = None) -> DataFrame:
    """keys, ids: unknown words as UNK; cut to `most` after the marks are added (which may cut off EOS)."""
    w = df.select(*keys, F.posexplode_outer(T.words(F.col(text))).alias("_i", "token"))
    w = w.join(F.broadcast(vocab.select("token", "id")), "token", "left")  # bounded by the vocabulary's size
    w = w.withColumn("id", F.when(F.col("_i").isNotNull(), F.coalesce("id", F.lit(UNK))))
    got = F.array_sort(F.collect_list(F.when(F.col("_i").isNotNull(), F.struct("_i", "id"))))
    ids = F.transform("g", lambda x: x["id"])
    ids = F.concat(*[F.array(F.lit(BOS))] * bos, ids, *[F.array(F.lit(EOS))] * eos)
    out = w.groupBy(*keys).agg(got.alias("g")).select(*keys, ids.alias("ids"))
    return out.withColumn("ids", F.slice("ids", 1, most)) if most else out


def decode(df: DataFrame, keys: list[str], ids: str, vocab: DataFrame) -> DataFrame:
    """keys, text: up to the first EOS, without PAD and BOS; UNK stays as its token."""
    end = F.array_position(ids, EOS)
    body = F.when(end > 0, F.slice(F.col(ids), F.lit(1), (end - 1).cast("int"))).otherwise(F.col(ids))
    body = F.filter(body, lambda x: ~x.isin(PAD, BOS))
    w = df.select(*keys, F.posexplode_outer(body).alias("_i", "id")).join(F.broadcast(vocab.select("id", "token")), "id", "left")
    got = F.array_sort(F.collect_list(F.when(F.col("_i").isNotNull(), F.struct("_i", "token"))))
    return w.groupBy(*keys).agg(got.alias("g")).select(*keys, F.array_join(F.transform("g", lambda x: x["token"]), " ").alias("text"))


def examples(df: DataFrame, keys: list[str], src_vocab: DataFrame, tgt_vocab: DataFrame, most: tuple[int, int] = (80, 80)) -> DataFrame:
    """keys, src_ids (with EOS), tgt_ids (with BOS and EOS), without examples too short to train on."""
    s = encode(df, keys, "src", src_vocab, eos=True, most=most[0]).withColumnRenamed("ids", "src_ids")
    t = encode(df, keys, "tgt", tgt_vocab, bos=True, eos=True, most=most[1]).withColumnRenamed("ids", "tgt_ids")
    return s.join(t, keys).where((F.size("src_ids") >= 2) & (F.size("tgt_ids") >= 3))


def padded(df: DataFrame, rank: str, size: int, *columns: str) -> DataFrame:
    """batch, and each id column padded to its batch's longest, with its own length before."""
    out = df.withColumn("batch", F.floor(F.col(rank) / size))
    for c in columns:
        most = F.max(F.size(c)).over(Window.partitionBy("batch"))
        out = out.withColumn(f"{c}_length", F.size(c)).withColumn(c, F.concat(c, F.array_repeat(F.lit(PAD), most - F.size(c))))
    return out
