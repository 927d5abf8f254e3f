"""Tokenisers and splitters: Column to array Column, and rows from them with their ordinals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paragram.functions import text as T


def units(c: Column) -> Column:
    """Parts between newlines and periods, stripped, without empty ones."""
    return F.filter(F.transform(F.split(c, "[\\n.]"), T.strip), lambda x: x != "")


def normalized_units(c: Column, normalize=T.normalize_signs) -> Column:
    return F.filter(F.transform(F.split(c, "[\\n.]"), normalize), lambda x: x != "")


def sentences(c: Column) -> Column:
    """After . ! or ? and white space before a capital or an opening quote; an empty text has none."""
    flat = T.collapse(c)
    return F.filter(F.split(flat, f'(?<=[.!?]){T.WS}+(?=[A-Z"“])'), lambda x: x != "")


def lexical_tokens(c: Column, normalize=T.normalize_signs) -> Column:
    return F.filter(F.transform(F.split(normalize(c), " "), T.edge_strip), lambda x: x != "")


def variants(token: Column) -> Column:
    """The token, its form without hyphens, and its parts at hyphens."""
    joined = F.replace(token, F.lit("-"), F.lit(""))
    return F.array_distinct(F.filter(F.concat(F.array(token, joined), F.split(token, "-")), lambda x: x != ""))


def lines(c: Column, clean=T.clean_text, sep: str = "\n") -> Column:
    """Non-empty lines, cleaned; ordinals count from 0 without the blank ones."""
    return F.filter(F.transform(F.split(c, sep), clean), lambda x: x != "")


def aliases(c: Column, sep: str = "[|]", least: int = 1) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), sep), T.strip), lambda x: F.length(x) >= least)


def ascii_words(c: Column, pattern: str = "[a-z]+") -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    at = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.slice(tokens, i, n))


def line_windows(df: DataFrame, lines_col: str, sizes: tuple[int, ...] = (1, 2, 3), sep: str = " ") -> DataFrame:
    """Windows of consecutive lines: window_size, start, window_text."""
    n = F.size(lines_col)

    def of_size(k: int) -> Column:
        window = lambda i: F.struct(F.lit(k).alias("window_size"), i.alias("start"), F.array_join(F.slice(lines_col, i + 1, k), sep).alias("window_text"))
        return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), window))

    each = [of_size(k) for k in sizes]
    none = F.array().cast("array<struct<window_size:int,start:int,window_text:string>>")
    keep = [c for c in df.columns if c != lines_col]
    return df.select(*keep, F.inline(F.flatten(F.array(*[F.coalesce(e, none) for e in each]))))


def rejoin_hyphens(df: DataFrame, keys: list[str], tokens_col: str, forms: DataFrame) -> DataFrame:
    """Greedy left-to-right merge of neighbours whose hyphenated pair is a known form (forms: one column, form).

    Few forms are sent to the workers, which merge within the row.  With more of them tokens are joined with them: in a run of
    mergeable neighbours every second one merges, counted from the run's start (gaps and islands).
    """
    from paragram.functions import plain
    from paragram.operators.retrieval import FORM_CHARS, FORMS, few
    from paragram.operators.rows import made

    own = few(forms.select("form").where(F.col("form").contains("-")).distinct(), FORMS, FORM_CHARS)
    if own is not None:
        pairs = frozenset(f for f, in own)
        return made(df, keys, [tokens_col], "rejoined string", lambda t: [(" ".join(plain.rejoined(t, pairs)),)] if t else [])
    return rejoin_hyphens_by_join(df, keys, tokens_col, forms)


def rejoin_hyphens_by_join(df: DataFrame, keys: list[str], tokens_col: str, forms: DataFrame) -> DataFrame:
    """The same for any number of forms."""
    tok = df.select(*keys, F.posexplode(tokens_col).alias("i", "token"))
    over = Window.partitionBy(*keys).orderBy("i")
    tok = tok.withColumn("pair", F.concat_ws("-", "token", F.lead("token").over(over))).withColumn("has_next", F.lead("token").over(over).isNotNull())
    known = forms.select(F.col("form").alias("pair")).distinct().withColumn("known", F.lit(True))
    tok = tok.join(known, "pair", "left").withColumn("link", F.coalesce("known", F.lit(False)) & F.col("has_next"))
    tok = tok.withColumn("island", F.sum((~F.col("link")).cast("int")).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.row_number().over(Window.partitionBy(*keys, "island", "link").orderBy("i"))
    tok = tok.withColumn("merge", F.col("link") & (rank % 2 == 1))
    tok = tok.withColumn("eaten", F.coalesce(F.lag("merge").over(over), F.lit(False)))
    out = tok.where(~F.col("eaten")).select(*keys, "i", F.when(F.col("merge"), F.col("pair")).otherwise(F.col("token")).alias("token"))
    parts = F.array_sort(F.collect_list(F.struct("i", "token")))
    return out.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["token"]), " ").alias("rejoined"))
