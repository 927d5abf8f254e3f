"""Detectors of language and of sentence-like lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paragram.functions import split as S
from paragram.functions import text as T

# Word lists of the profiles.
ENGLISH_24 = ("the", "and", "to", "of", "in", "for", "that", "with", "is", "was", "on", "as", "he", "she", "it", "they", "his", "her", "from", "this", "by", "be", "or", "an")
ENGLISH_33 = (*ENGLISH_24, "not", "are", "were", "had", "have", "at", "which", "their", "there")
ENGLISH_35 = (*ENGLISH_24, "you", "we", "i", "my", "your", "their", "will", "if", "not", "have", "has")
ENGLISH_44 = (*ENGLISH_35, "do", "are", "me", "at", "all", "here", "there", "then", "when")
ENGLISH_10 = ("the", "and", "to", "of", "in", "i", "that", "you", "it", "for")
GERMAN = ("der", "die", "das", "und", "ist", "mit", "nicht", "ein", "eine", "zu", "von", "den")
FRENCH = ("le", "la", "les", "de", "des", "et", "est", "dans", "une", "un", "pour", "que")
SPANISH = ("el", "la", "los", "las", "de", "y", "es", "una", "un", "por", "que", "con")
NEARBY_BONUS = ("translation", "translated", "means", "reads", "rendered", "text", "letter")


def hits(words: Column, known: tuple[str, ...]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*known)))


def is_surface(c: Column) -> Column:
    """A letter of the alphabet with a mark, or a hyphenated word; case matters."""
    return c.rlike(f"[{T.DIACRITICS}]|(?<![{T.WORD}])[a-z]+-[a-z]+(?![{T.WORD}])")


def is_surface_any_case(c: Column) -> Column:
    return c.rlike(T.SURFACE)


def english_like_words(c: Column) -> Column:
    """More than 0.7 of the words plain, and one of ten common ones among those."""
    w = T.words(c)
    plain = F.filter(w, lambda x: x.rlike("^[a-z.,!?:]+\\n?$"))
    return (F.size(plain) / (F.size(w) + F.lit(1e-9)) > 0.7) & F.exists(plain, lambda x: x.isin(*ENGLISH_10))


def has_quote(c: Column, curly: bool = True) -> Column:
    return c.rlike("[\"'“”]" if curly else "[\"']")


def sentence_like_words(c: Column) -> Column:
    """3 to 50 words, mostly ASCII or with a quote."""
    w = T.words(c)
    plain = F.filter(w, lambda x: x.rlike("^[a-zA-Z.,!?'\"-]+$"))
    return F.size(w).between(3, 50) & ((F.size(plain) / (F.size(w) + F.lit(1e-9)) > 0.6) | has_quote(c, False))


def english_like_share(c: Column) -> Column:
    """3 words or more, at least one and 0.06 of them common."""
    w = S.ascii_words(c)
    return (F.size(w) >= 3) & (hits(w, ENGLISH_24) >= 1) & (hits(w, ENGLISH_24) / F.size(w) >= 0.06)


def english_like_alpha(c: Column, known: tuple[str, ...] = ENGLISH_24, least: float = 0.55) -> Column:
    """3 words or more, a common one, and mostly letters."""
    w = S.ascii_words(c)
    return (F.size(w) >= 3) & (hits(w, known) >= 1) & (T.alpha_ratio(c) >= least)


def english_score(c: Column) -> Column:
    """Share of common words, and 0.05 for each bonus word."""
    w = S.ascii_words(c)
    return F.when(F.size(w) > 0, hits(w, ENGLISH_33) / F.size(w) + F.lit(0.05) * hits(w, NEARBY_BONUS)).otherwise(F.lit(0.0))


def mostly_alphabetic(c: Column, least: float = 0.55) -> Column:
    return T.alpha_ratio(c) >= least


def sentence_like(c: Column, most: int, english: Column | None, least: float, ends: bool) -> Column:
    """3 to `most` words, and English, a quote, mostly letters, or (ends) closing punctuation."""
    any_of = has_quote(c) | mostly_alphabetic(c, least)
    if english is not None:
        any_of |= english
    if ends:
        any_of |= c.rlike("[.!?:;]$")
    return T.n_words(c).between(3, most) & any_of


def sentence_like_v3(c: Column) -> Column:
    return sentence_like(c, 45, None, 0.55, True)


def sentence_like_v31(c: Column) -> Column:
    return sentence_like(c, 55, english_like_alpha(c), 0.60, False)


def sentence_like_v32(c: Column) -> Column:
    return sentence_like(c, 60, english_like_alpha(c, ENGLISH_33, 0.60), 0.68, False)


def line_flags(df: DataFrame, line: str) -> DataFrame:
    """All the detectors of English and of sentences at once, beside the other columns; words, letters and hits are made once.

    english_1, english_3, english_31, english_32, sentence_2, sentence_3, sentence_31, sentence_32, english_score.
    """
    c, keep = F.col(line), df.columns
    made = df.select(*keep, T.words(c).alias("_w"), S.ascii_words(c).alias("_az"), T.alpha_ratio(c).alias("_alpha"), c.rlike("[\"']").alias("_quote"), c.rlike("[“”]").alias("_curly"), c.rlike("[.!?:;]$").alias("_ends"))
    bonus = F.filter("_az", lambda x: x.isin(*ENGLISH_33, *NEARBY_BONUS))  # the few words that count for anything
    made = made.withColumn("_n", F.size("_w")).withColumn("_m", F.size("_az")).withColumn("_known", bonus)
    made = made.withColumn("_h24", hits(F.col("_known"), ENGLISH_24)).withColumn("_h33", hits(F.col("_known"), ENGLISH_33)).withColumn("_near", hits(F.col("_known"), NEARBY_BONUS))
    made = made.withColumn("_plain", F.filter("_w", lambda x: x.rlike("^[a-z.,!?:]+\n?$")))
    n, m, alpha, quote = F.col("_n"), F.col("_m"), F.col("_alpha"), F.col("_quote") | F.col("_curly")
    e31, e32 = (m >= 3) & (F.col("_h24") >= 1) & (alpha >= 0.55), (m >= 3) & (F.col("_h33") >= 1) & (alpha >= 0.60)
    ascii_ = F.size(F.filter("_w", lambda x: x.rlike("^[a-zA-Z.,!?'\"-]+$")))
    flags = {
        "english_1": (F.size("_plain") / (n + F.lit(1e-9)) > 0.7) & F.exists("_plain", lambda x: x.isin(*ENGLISH_10)), "english_3": (m >= 3) & (F.col("_h24") >= 1) & (F.col("_h24") / m >= 0.06), "english_31": e31, "english_32": e32,
        "sentence_2": n.between(3, 50) & (F.col("_quote") | (ascii_ / (n + F.lit(1e-9)) > 0.6)), "sentence_3": n.between(3, 45) & (quote | (alpha >= 0.55) | F.col("_ends")),
        "sentence_31": n.between(3, 55) & (quote | (alpha >= 0.60) | e31), "sentence_32": n.between(3, 60) & (quote | (alpha >= 0.68) | e32),
        "english_score": F.when(m > 0, F.col("_h33") / m + F.lit(0.05) * F.col("_near")).otherwise(F.lit(0.0)),
    }
    return made.select(*keep, *[f.alias(k) for k, f in flags.items()])


def detect_language(c: Column) -> Column:
    """en, de, fr or es by common words (ties in that order); unknown below three words or without a hit."""
    w = S.ascii_words(c, "[a-zà-ÿ]+")
    scores = {"en": hits(w, ENGLISH_24), "de": hits(w, GERMAN), "fr": hits(w, FRENCH), "es": hits(w, SPANISH)}
    best = F.greatest(*scores.values())
    out = F.when((F.size(w) < 3) | (best == 0), "unknown")
    for name, score in scores.items():
        out = out.when(score == best, name)
    return out


def english_or_none(c: Column) -> Column:
    """The text itself if it is English (or unknown) and English-like; else null."""
    return F.when(detect_language(c).isin("en", "unknown") & english_like_share(c), c)
