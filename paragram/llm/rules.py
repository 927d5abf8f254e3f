"""Quality rules in a bitmask ledger, with DataFrame functions only.

Every rule is evaluated once for each document; the ledger keeps what was
measured and one failure bit for each rule.  A policy is a versioned set of
rules (a mask), so a verdict, another policy or an ablation over rules is bit
arithmetic on the ledger and never touches the text again.

Null texts count as empty: no words, so ``few_words`` fails.  A null doc_id
stays null; repeated rows are judged each; other columns of the input are
ignored; an empty table gives an empty ledger.  Whole texts are read, however
long.  Five-word windows are compared by a 64-bit hash within one document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = "[\\x20\\x09-\\x0D]+"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    name: str
    failed: str  # a SQL condition on the measurements


#: Bit i of failure_bits belongs to RULES[i].  Only ever append.
RULES: tuple[Rule, ...] = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * n_words"),
    Rule("duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule("capitals", "100 * n_upper > 50 * n_letters"),
    Rule("exclamations", "100 * n_exclamations > 30 * n_words"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("stuttering", "100 * n_stutters > 20 * n_words"),
)
BIT = {r.name: 1 << i for i, r in enumerate(RULES)}

#: Versioned policies: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base@1": ("few_words", "repeated_words"),
    "standard@1": ("few_words", "repeated_words", "symbols", "duplicate_lines", "capitals", "exclamations"),
    "standard@2": ("few_words", "repeated_words", "symbols", "duplicate_lines", "capitals", "exclamations", "word_length", "stuttering"),
}
STANDARD = "standard@2"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_exclamations", "n_stutters")


def mask_of(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def _without(text: Column, signs: str) -> Column:
    """How many characters of `signs` the text has."""
    return F.length(text) - F.length(F.translate(text, signs, ""))


def _repeated(hashes: Column) -> Column:
    """Words in windows that occur twice or more; hashes: of the windows, in order."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twins(sorted_pairs: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(sorted_pairs, j)["h"] == x["h"], F.lit(False))
        return F.filter(sorted_pairs, lambda x, j: same(x, j - 1) | same(x, j + 1))

    def covered(starts: Column) -> Column:
        size = F.transform(starts, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - p, F.lit(WINDOW))))
        return F.aggregate(size, F.lit(0), lambda a, x: a + x)

    # A one-element transform binds an intermediate array once instead of repeating its expression.
    found = F.transform(F.array(pairs), lambda p: F.array_sort(F.transform(twins(p), lambda x: x["i"])))
    return F.transform(found, covered)[0]


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the measurements (long), failure_bits (long); `keep`: further columns to carry (as input_<name> where the ledger has that name)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = {"doc_id", "failure_bits", "_text", "_words", "_lines", "_windows", *MEASURES}
    kept = [f"input_{c}" if c in own else c for c in keep if c != id_col]
    rows = df.select(F.col(id_col).alias("doc_id"), *[F.col(c).alias(k) for c, k in zip([c for c in keep if c != id_col], kept, strict=True)], text.alias("_text"))
    rows = rows.withColumn("_words", F.filter(F.split("_text", _SPACE), lambda w: w != ""))
    rows = rows.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    n, words = F.size("_words"), F.col("_words")
    window = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])))
    rows = rows.withColumn("_windows", window)
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    body = F.col("_text")
    measures = {
        "n_words": n,
        "word_chars": F.length(F.regexp_replace(body, _SPACE, "")),
        "n_symbols": _without(body, "#*$%&|<>"),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.when(repeats, _repeated(F.col("_windows"))).otherwise(0),
        "n_upper": F.length(F.regexp_replace(body, "\\P{Lu}+", "")),
        "n_letters": F.length(F.regexp_replace(body, "\\P{L}+", "")),
        "n_exclamations": _without(body, "!"),
        "n_stutters": F.size(F.filter(words, lambda w, i: F.coalesce(F.get(words, i - 1) == w, F.lit(False)))),
    }
    # A generator of one row: the optimizer doesn't copy expressions across it, so each measurement is made once, whatever
    # conditions on the ledger follow.
    measured = rows.select("doc_id", *kept, F.inline(F.array(F.struct(*[m.cast("long").alias(k) for k, m in measures.items()]))))
    bits = sum((F.when(F.expr(r.failed), F.lit(BIT[r.name])).otherwise(0) for r in RULES), F.lit(0))
    return measured.withColumn("failure_bits", bits.cast("long"))


def failed(policy: str, bits: str = "failure_bits") -> Column:
    """Whether a policy rejects a document, from its failure bits."""
    return F.col(bits).bitwiseAND(F.lit(mask_of(policy))) != 0


def ablation(book: DataFrame, policy: str, by: tuple[str, ...] = ()) -> DataFrame:
    """For every rule of a policy: documents that fail it, that fail it alone (dropping the rule would keep them).

    One bitwise aggregation of the ledger; any_bits and common_bits are the rules that some, and all, rejected documents fail.
    """
    own = F.col("failure_bits").bitwiseAND(F.lit(mask_of(policy)))
    counts = [F.count(F.when(own.bitwiseAND(F.lit(BIT[r])) != 0, 1)).alias(f"failed_{r}") for r in POLICIES[policy]]
    alone = [F.count(F.when(own == BIT[r], 1)).alias(f"only_{r}") for r in POLICIES[policy]]
    wide = book.groupBy(*by).agg(F.count("*").alias("documents"), F.count(F.when(own == 0, 1)).alias("kept"), F.bit_or(F.when(own != 0, own)).alias("any_bits"), F.bit_and(F.when(own != 0, own)).alias("common_bits"), *counts, *alone)
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).alias("bit"), F.col(f"failed_{r}").alias("failed"), F.col(f"only_{r}").alias("failed_alone")) for r in POLICIES[policy]])
    return wide.select(*by, "documents", "kept", "any_bits", "common_bits", F.inline(each))


DIGEST = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failure_bits", "base_failed", "kept")


def judged(book: DataFrame, policy: str = STANDARD) -> DataFrame:
    return book.withColumn("base_failed", failed("base@1")).withColumn("kept", ~failed("base@1") & ~failed(policy))


def accepted(docs: DataFrame, policy: str = STANDARD) -> DataFrame:
    """The rows that a policy keeps, with all their columns, whatever their names; null and empty texts go (few_words)."""
    book = ledger(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), keep=("row",))
    return book.where(~failed("base@1") & ~failed(policy)).select("row.*")


#: The same for DuckDB, by joins instead of arrays.
_JUDGED = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lists AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, string_split(text, chr(10)) AS ls FROM docs),
word AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM lists),
wide AS (
  SELECT r, p, w, lag(w, 1) OVER o AS w0, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3, lead(w, 4) OVER o AS w4
  FROM word WINDOW o AS (PARTITION BY r ORDER BY p)),
found AS (
  SELECT r, p FROM (
    SELECT r, p, count(*) OVER (PARTITION BY r, w, w1, w2, w3, w4) AS n FROM wide WHERE w4 IS NOT NULL) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p + k) AS n_repeat_words FROM found, range(5) t(k) GROUP BY r),
stutter AS (SELECT r, count(*) AS n_stutters FROM wide WHERE w = w0 GROUP BY r),
line AS (SELECT r, unnest(ls) AS l FROM lists),
lined AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
measured AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    length(regexp_replace(text, '\P{Lu}+', '', 'g')) AS n_upper, length(regexp_replace(text, '\P{L}+', '', 'g')) AS n_letters,
    length(text) - length(replace(text, '!', '')) AS n_exclamations, coalesce(n_stutters, 0) AS n_stutters
  FROM lists LEFT JOIN covered USING (r) LEFT JOIN stutter USING (r) LEFT JOIN lined USING (r)),
judged AS (
  SELECT *, CAST(CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END
    + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END + CASE WHEN 100 * n_upper > 50 * n_letters THEN 16 ELSE 0 END
    + CASE WHEN 100 * n_exclamations > 30 * n_words THEN 32 ELSE 0 END + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 64 ELSE 0 END
    + CASE WHEN 100 * n_stutters > 20 * n_words THEN 128 ELSE 0 END AS BIGINT) AS failure_bits
  FROM measured)
"""
SQL = _JUDGED + """
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, failure_bits, failure_bits & 3 <> 0 AS base_failed, failure_bits = 0 AS kept
FROM judged
"""

#: ``ablation`` of the policy standard@2 for DuckDB.
ABLATION_SQL = _JUDGED + """
SELECT rule, CAST(bit AS BIGINT) AS bit, count(*) AS documents, count(*) FILTER (failure_bits = 0) AS kept, bit_or(CASE WHEN failure_bits <> 0 THEN failure_bits END) AS any_bits,
  bit_and(CASE WHEN failure_bits <> 0 THEN failure_bits END) AS common_bits, count(*) FILTER (failure_bits & bit <> 0) AS failed, count(*) FILTER (failure_bits = bit) AS failed_alone
FROM judged, (VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('duplicate_lines', 8), ('capitals', 16), ('exclamations', 32), ('word_length', 64), ('stuttering', 128)) t(rule, bit)
GROUP BY rule, bit
"""
