"""Corpus statistics: counts, exact rank percentiles, medians, top tokens, IDF."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from paragram.functions import plain
from paragram.functions import text as T
from paragram.operators.rows import sizes, slices
from paragram.sources.staging import staged

#: Distinct tokens that a task counts before it hands its counts on.
TASK_TOKENS = 300_000


def rank_percentiles(df: DataFrame, column: str, points: dict[str, float], clamp: bool = False, times: str | None = None) -> DataFrame:
    """One row: for each point p the value at index int(p * n) of the sorted values (null beyond the end; clamp: the last).

    Values are counted first, so what is put in one order are distinct values, not rows.  times: how often a row counts.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg((F.sum(times) if times else F.count("*")).alias("k"))
    order = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("k").over(order)).withColumn("n", F.sum("k").over(Window.partitionBy()))
    out = []
    for name, p in points.items():
        index = F.floor(F.col("n") * F.lit(float(p)))
        index = F.least(F.col("n") - 1, index) if clamp else index
        out.append(F.min(F.when(F.col("upto") > index, F.col("v"))).alias(name))
    return ranked.agg(*out)


def pair_lengths(pairs: DataFrame) -> DataFrame:
    """src_len, tgt_len (words) and ratio of pairs."""
    n = pairs.withColumn("src_len", T.n_words(F.col("src"))).withColumn("tgt_len", T.n_words(F.col("tgt")))
    return n.withColumn("ratio", F.col("tgt_len") / F.greatest(F.lit(1), F.col("src_len")))


def baseline_stats(pairs: DataFrame, low: float, high: float) -> DataFrame:
    """One row: src_min, src_max, tgt_min, tgt_max, ratio_min, ratio_max, and medians and the mean of the ratio."""
    n = pair_lengths(pairs)
    out = n.agg(F.median("src_len").alias("src_med"), F.median("tgt_len").alias("tgt_med"), F.median("ratio").alias("ratio_med"), F.avg("ratio").alias("ratio_avg"))
    for column, name in (("src_len", "src"), ("tgt_len", "tgt"), ("ratio", "ratio")):
        out = out.crossJoin(rank_percentiles(n, column, {f"{name}_min": low, f"{name}_max": high}))  # one row each
    return out


def average_chars(pairs: DataFrame, *columns: str) -> DataFrame:
    """One row: rows, and the average number of characters of each column (null without rows)."""
    return pairs.agg(F.count("*").alias("rows"), *[F.avg(F.length(c)).alias(f"{c}_chars") for c in columns])


def token_counts(df: DataFrame, tokens: str, *order: str) -> DataFrame:
    """token, n, and the place of its first occurrence (ord: order columns and position)."""
    t = df.select(*order, F.posexplode(tokens).alias("_pos", "token"))
    return t.groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct(*order, "_pos")).alias("ord"))


def most_common(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent tokens, those seen first before others of the same count."""
    return counts.orderBy(F.desc("n"), "ord").limit(k)


def unit_counts(docs: DataFrame, text: str, order: list[str], kinds: tuple[str, ...]) -> DataFrame:
    """kind, token, size, n, ord of the texts' units that have tokens, in one pass over the texts.

    Kinds: length (size: tokens of a unit), first (a unit's first token), token (every token).  n: how many; ord: the place of
    the first one (order columns, unit, position).  A task counts in memory and hands on its counts, not its tokens.
    """
    docs = docs.select(*order, F.col(text).alias("_text"))
    fields = _parse_datatype_string("kind string, token string, size int, n long").fields
    schema = StructType([*fields, *[docs.schema[k] for k in order], *_parse_datatype_string("unit int, pos int").fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        counts, seen = {k: Counter() for k in kinds}, {k: {} for k in kinds}

        def handed_on():
            rows = [(kind, None, key, n, *[None] * len(order), None, None) if kind == "length" else (kind, key, None, n, *[v for _, v in seen[kind][key][0]], *seen[kind][key][1:]) for kind in kinds for key, n in counts[kind].items()]
            for k in kinds:
                counts[k].clear()
                seen[k].clear()
            for i in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 20_000], strict=True), target, strict=True)], schema=target)

        for whole in batches:
            for batch in slices(whole, sizes(whole.column(len(order)))):
                for *place, value in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    place, unit = tuple((v is not None, v) for v in place), -1
                    for raw in plain.units(value or ""):
                        unit += 1
                        tokens = plain.tokens(raw)
                        if not tokens:
                            continue
                        if "length" in kinds:
                            counts["length"][len(tokens)] += 1
                        for kind, found in (("first", tokens[:1]), ("token", tokens)):
                            if kind in kinds:
                                counts[kind].update(found)
                                known = seen[kind]
                                for pos, t in enumerate(found):
                                    if t not in known or (place, unit, pos) < known[t]:
                                        known[t] = (place, unit, pos)
                if max(map(len, counts.values())) > TASK_TOKENS:
                    yield from handed_on()
        yield from handed_on()

    parts = docs.mapInArrow(run, schema)
    return parts.groupBy("kind", "token", "size").agg(F.sum("n").alias("n"), F.min(F.struct(*order, "unit", "pos")).alias("ord"))


def unit_lengths(counts: DataFrame, low: float, high: float, clamp: bool = False) -> DataFrame:
    """One row of unit_counts: min_length, max_length, avg_length, detect_min, detect_max."""
    sizes = counts.where("kind = 'length'").select("size", "n")
    lengths = sizes.agg(F.min("size").alias("min_length"), F.max("size").alias("max_length"), (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("avg_length"))
    return lengths.crossJoin(rank_percentiles(sizes, "size", {"detect_min": low, "detect_max": high}, clamp, "n"))


def learned_lengths(docs: DataFrame, text: str, low: float, high: float, clamp: bool = False) -> DataFrame:
    """The lengths of learned_structure alone."""
    return unit_lengths(staged(unit_counts(docs, text, [], ("length",)).select("kind", "size", "n"), "lengths"), low, high, clamp)


def learned_structure(docs: DataFrame, text: str, order: list[str], low: float, high: float, starters: int, frequent: int, clamp: bool = False) -> dict[str, DataFrame]:
    """What a corpus looks like: lengths (one row), common first tokens, frequent tokens.  The counts are made once and kept in the shared folder."""
    counts = staged(unit_counts(docs, text, order, ("length", "first", "token")), "counts")
    tokens = lambda kind: counts.where(F.col("kind") == kind).select("token", "n", "ord")
    return {"lengths": unit_lengths(counts, low, high, clamp), "starters": most_common(tokens("first"), starters), "frequent": most_common(tokens("token"), frequent)}


def idf(windows: DataFrame, tokens: str) -> DataFrame:
    """token, df, idf = ln((1 + N) / (1 + df)) + 1 over the windows that have tokens."""
    n = windows.agg(F.count("*").alias("N"))
    df = windows.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("token", "df", (F.log((1 + F.col("N")) / (1 + F.col("df"))) + 1).alias("idf"))
