"""Queries of the operators over the driver's tables, each with DuckDB SQL of the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paragram import fixtures as X
from paragram.functions import lang as L
from paragram.functions import plain
from paragram.functions import similarity
from paragram.functions import split as S
from paragram.functions import text as T
from paragram.operators import align, archive, dataset, dedup, metrics, retrieval, rows, scoring, stats
from paragram.plans import expansion, importing, pages
from paragram.plans.profiles import EXPANSIONS, SURFACES, V4, V41, V42, V51
from paragram.sources.staging import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: A source-line class that the driver's tables have (they hold no transliteration).
MARKED = "[àâçèéêëîïôùûüäöß]"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# SQL expressions in DuckDB's dialect (RE2: no lookaround, \b is ASCII).
_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_W = r"\p{L}\p{N}_"


def _sub(x: str, pattern: str, to: str, flags: str = "g") -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', '{flags}')"


def _collapse(x: str) -> str:
    return f"trim({_sub(x, _WS + '+', ' ')})"


def _strip(x: str) -> str:
    return _sub(x, f"^{_WS}+|{_WS}+$", "")


def _clean(x: str) -> str:
    return _collapse(f"lower({x})")


def _marks(x: str) -> str:
    return _clean(f"translate({x}, chr(65279), ' ')")


def _digits(x: str) -> str:
    return _clean(f"translate(translate({x}, chr(65279), ' '), '{T.DIGITS_SMALL}', '{T.DIGITS_PLAIN}')")


def _signs(x: str) -> str:
    x = _sub(_digits(x), "<[^>]*>", " <gap> ")
    x = f"translate(translate({x}, '{{}}', ''), '[]()', '    ')"
    x = _sub(x, rf"\b(fig|table|pl|plate|note|notes|fn|n)\.?{_WS}*\d+\b", " ")
    x = _collapse(_sub(x, r"\b\d{1,4}\b", " "))
    x = _sub(f"translate({x}, '—–', '--')", f"{_WS}*-{_WS}*", "-")
    return _collapse(_sub(x, "[,;:!?./|]+", " "))


def _words(x: str) -> str:
    return f"[w FOR w IN string_split_regex({x}, '{_WS}+') IF w <> '']"


def _n(x: str) -> str:
    return f"len({_words(x)})"


def _lex(x: str) -> str:
    edge = _sub("w", f"^[^{_W}<]+|[^{_W}>]+$", "")
    return f"[t FOR t IN [{edge} FOR w IN string_split({_signs(x)}, ' ')] IF t <> '']"


def _letter(x: str) -> str:
    return f"regexp_matches(lower({x}), '[a-z{T.DIACRITICS}]')"


def _alpha(x: str) -> str:
    solid = f"length({_sub(x, _WS + '+', '')})"
    return f"CASE WHEN {solid} > 0 THEN length({_sub(x, r'[^\p{L}]+', '')}) / CAST({solid} AS DOUBLE) ELSE 0.0::DOUBLE END"


def _units(x: str) -> str:
    return f"[u FOR u IN [{_strip('v')} FOR v IN string_split_regex({x}, '[\\n.]')] IF u <> '']"


def _in(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _hits(list_: str, words: tuple[str, ...]) -> str:
    return f"len([h FOR h IN {list_} IF h IN {_in(words)}])"


def _ratio(s: str, t: str) -> str:
    return f"(len({_words(t)}) / CAST(greatest(1, len({_words(s)})) AS DOUBLE))"


_EX = """ex AS (
  SELECT u.conv_id, u.turn, u.text AS src, a.text AS tgt FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""
_PAIRS = f"""{_EX},
zipped AS (SELECT conv_id, turn, unnest(range(least(len(s), len(t)))) AS pos, s, t FROM (SELECT conv_id, turn, {_units('src')} AS s, {_units('tgt')} AS t FROM ex)),
pairs AS (
  SELECT conv_id, turn, pos, {_clean('s[pos + 1]')} AS src, {_clean('t[pos + 1]')} AS tgt FROM zipped WHERE length(s[pos + 1]) >= 5 AND length(t[pos + 1]) >= 5),
base AS (
  SELECT conv_id, turn, pos, src, tgt FROM (
    SELECT *, row_number() OVER (PARTITION BY src, tgt ORDER BY conv_id, turn, pos) AS rn FROM pairs WHERE {_letter('src')} AND {_letter('tgt')}) WHERE rn = 1)"""
_DOCLINES = f"""dl AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no FROM (
    SELECT doc_id, [x FOR x IN [{_clean('y')} FOR y IN string_split(text, chr(10))] IF x <> ''] AS l FROM documents))"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_lines(X.pages(spark, sf_dir)).withColumnRenamed("page_id", "doc_id")


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.baseline_pairs(X.exchanges(spark, sf_dir), ["conv_id", "turn"])


# Scalar functions.


@query(f"SELECT doc_id, md5({_clean('text')}) AS cleaned, md5({_digits('text')}) AS cleaned_digits, CAST(length({_clean('text')}) AS BIGINT) AS n_chars, CAST({_n('text')} AS BIGINT) AS n_tokens FROM documents")
def clean_text_docs(spark, sf_dir):
    c = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.clean_text(c)).alias("cleaned"), F.md5(T.clean_text_digits(c)).alias("cleaned_digits"), F.length(T.clean_text(c)).cast("long").alias("n_chars"), T.n_words(c).cast("long").alias("n_tokens"))


@query(f"SELECT page_id, {_signs('html')} AS normalized, replace({_sub(_signs('html'), f'[^a-z0-9{T.DIACRITICS}<> -]+', ' ')}, '-', '') AS canonical FROM pages")
def normalize_markup(spark, sf_dir):
    both = lambda x: [(plain.signs(x), plain.canonical(x))] if x is not None else [(None, None)]
    return rows.made(X.table(spark, sf_dir, "pages"), ["page_id"], ["html"], "normalized string, canonical string", both)


@query(f"""SELECT doc_id, replace({_sub("split_part(" + _strip("lower(raw)") + ", '|', 1)", _WS + "+", "")}, ',', '') AS id_key FROM (SELECT doc_id, ' ' || upper(source) || ', ' || lang || ' | x' AS raw FROM documents)""")
def normalize_ids(spark, sf_dir):
    raw = F.concat(F.lit(" "), F.upper("source"), F.lit(", "), F.col("lang"), F.lit(" | x"))
    return X.table(spark, sf_dir, "documents").select("doc_id", T.normalize_id(raw).alias("id_key"))


@query(f"""SELECT conv_id, turn, md5({_collapse("replace(replace(" + _sub(_sub(_sub("replace(text, chr(13), chr(10))", r"\n(?:lo\.e\.|rev\.|u\.e\.|l\.e\.|1\.e\.)", "\n", "gi"), rf"\n{_WS}*\d+{_WS}*\n", "\n"), rf"\n{_WS}*\d+{_WS}+", " ") + ", '-' || chr(10), ''), chr(10), ' ')")}) AS translation FROM (SELECT conv_id, turn, text || chr(10) || '12' || chr(10) || 'rev. ' || text || '-' || chr(10) || '3 end' AS text FROM conversations)""")
def clean_translation_lines(spark, sf_dir):
    raw = F.concat("text", F.lit("\n12\nrev. "), "text", F.lit("-\n3 end"))
    return X.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.clean_translation(raw)).alias("translation"))


@query(f"SELECT doc_id, {_letter('text')} AS letters, round_even({_alpha('text')}, 6) AS alpha, regexp_matches(text, '[^\\x00-\\x7F{T.DIACRITICS}]') AS dirty, (length(text) - length(replace(text, '\"', ''))) % 2 = 0 AS quotes_even FROM documents")
def character_gates(spark, sf_dir):
    c = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", T.has_letter(c).alias("letters"), F.bround(T.alpha_ratio(c), 6).alias("alpha"), T.dirty(c).alias("dirty"), T.even_quotes(c).alias("quotes_even"))


@query(f"SELECT conv_id, turn, md5({_collapse('replace(replace(replace(replace(replace(replace(text, ' + chr(39) + 'ḫ' + chr(39) + ', ' + chr(39) + 'h' + chr(39) + '), ' + chr(39) + 'Ḫ' + chr(39) + ', ' + chr(39) + 'H' + chr(39) + '), ' + chr(39) + 'sz' + chr(39) + ', ' + chr(39) + 'š' + chr(39) + '), ' + chr(39) + 'SZ' + chr(39) + ', ' + chr(39) + 'Š' + chr(39) + '), ' + chr(39) + '[...]' + chr(39) + ', ' + chr(39) + '<gap>' + chr(39) + '), ' + chr(39) + 'x x x' + chr(39) + ', ' + chr(39) + '<gap>' + chr(39) + ')')}) AS normalized FROM conversations")
def normalize_transliteration(spark, sf_dir):
    return X.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.normalize_transliteration(F.col("text"))).alias("normalized"))


# Splitters.


@query(f"SELECT doc_id, pos - 1 AS pos, u[pos] AS unit FROM (SELECT doc_id, u, unnest(range(1, len(u) + 1)) AS pos FROM (SELECT doc_id, {_units('text')} AS u FROM documents))")
def split_units(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(S.units(F.col("text"))).alias("pos", "unit")).withColumn("pos", F.col("pos").cast("long"))


def _sents(x: str) -> str:
    return f"[x FOR x IN string_split(regexp_replace({_collapse(x)}" + r""", '([.!?]) ([A-Z"“])', '\1' || chr(1) || '\2', 'g'), chr(1)) IF x <> '']"""



@query(f"SELECT doc_id, pos - 1 AS k, u[pos] AS sentence FROM (SELECT doc_id, u, unnest(range(1, len(u) + 1)) AS pos FROM (SELECT doc_id, {_sents('text')} AS u FROM documents))")
def sentence_split(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(S.sentences(F.col("text"))).alias("k", "sentence")).withColumn("k", F.col("k").cast("long"))


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens FROM (SELECT doc_id, {_lex('text')} AS t FROM documents)")
def lexical_tokens(spark, sf_dir):
    t = rows.made(_docs(spark, sf_dir), ["doc_id"], ["text"], "t array<string>", lambda x: [(plain.tokens(x),)])
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens"))


@query(f"""SELECT variant, count(*) AS n FROM (SELECT unnest(list_distinct([v FOR v IN list_concat([t, replace(t, '-', '')], string_split(t, '-')) IF v <> ''])) AS variant
  FROM (SELECT unnest({_lex("replace(text, 'e ', 'e-')")}) AS t FROM conversations)) GROUP BY 1""")
def token_variants(spark, sf_dir):
    t = X.table(spark, sf_dir, "conversations").select(F.explode(S.lexical_tokens(F.replace("text", F.lit("e "), F.lit("e-")))).alias("t"))
    return t.select(F.explode(S.variants(F.col("t"))).alias("variant")).groupBy("variant").agg(F.count("*").alias("n"))


@query(f"""WITH l AS (SELECT doc_id, [x FOR x IN [{_clean('y')} FOR y IN string_split(text, chr(10))] IF x <> ''] AS l FROM documents),
w AS (SELECT doc_id, l, k, unnest(range(0, len(l) - k + 1)) AS start FROM l, (VALUES (1), (2), (3)) t(k) WHERE len(l) >= k)
SELECT doc_id, CAST(k AS BIGINT) AS window_size, CAST(start AS BIGINT) AS start, md5(array_to_string(l[start + 1:start + k], ' ')) AS window_text FROM w""")
def line_windows(spark, sf_dir):
    w = S.line_windows(_docs(spark, sf_dir).select("doc_id", S.lines(F.col("text")).alias("l")), "l")
    return w.select("doc_id", F.col("window_size").cast("long").alias("window_size"), F.col("start").cast("long").alias("start"), F.md5("window_text").alias("window_text"))


_FORMS = f"forms AS (SELECT DISTINCT w[i] || '-' || w[i + 1] AS form FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT {_words('lower(text)')} AS w FROM benchmark)))"


def _forms(spark, sf_dir):
    w = X.table(spark, sf_dir, "benchmark").select(T.words(F.lower("text")).alias("w"))
    return w.select(F.explode(S.ngrams(F.col("w"), 2)).alias("g")).select(F.array_join("g", "-").alias("form")).distinct()


@query(f"""WITH {_FORMS},
tok AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, {_words('lower(text)')} AS w FROM documents)),
linked AS (SELECT t.*, lead(token) OVER o AS nxt FROM tok t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
known AS (SELECT l.*, f.form IS NOT NULL AS link FROM linked l LEFT JOIN forms f ON f.form = token || '-' || nxt),
isl AS (SELECT *, sum(CASE WHEN link THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM known),
runs AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island, link ORDER BY i) AS r FROM isl),
m AS (SELECT *, link AND r % 2 = 1 AS merge FROM runs),
e AS (SELECT *, coalesce(lag(merge) OVER (PARTITION BY doc_id ORDER BY i), false) AS eaten FROM m)
SELECT doc_id, md5(string_agg(CASE WHEN merge THEN token || '-' || nxt ELSE token END, ' ' ORDER BY i)) AS rejoined FROM e WHERE NOT eaten GROUP BY doc_id""")
def hyphen_rejoin(spark, sf_dir):
    t = rows.made(_docs(spark, sf_dir), ["doc_id"], ["text"], "t array<string>", lambda x: [(x.lower().split(),)])
    return S.rejoin_hyphens(t, ["doc_id"], "t", _forms(spark, sf_dir)).select("doc_id", F.md5("rejoined").alias("rejoined"))


# Detectors.

_AZ = "regexp_extract_all(lower(line), '[a-z]+')"
_EL3 = f"(len({_AZ}) >= 3 AND {_hits(_AZ, L.ENGLISH_24)} >= 1 AND {_hits(_AZ, L.ENGLISH_24)} / CAST(len({_AZ}) AS DOUBLE) >= 0.06)"
_EL31 = f"(len({_AZ}) >= 3 AND {_hits(_AZ, L.ENGLISH_24)} >= 1 AND {_alpha('line')} >= 0.55)"
_EL32 = f"(len({_AZ}) >= 3 AND {_hits(_AZ, L.ENGLISH_33)} >= 1 AND {_alpha('line')} >= 0.60)"
_PLAIN1 = f"[p FOR p IN {_words('line')} IF regexp_full_match(p, '[a-z.,!?:]+')]"
_PLAIN2 = f"""[p FOR p IN {_words('line')} IF regexp_full_match(p, '[a-zA-Z.,!?''"-]+')]"""
_QUOTE = "regexp_matches(line, '[\"''“”]')"


@query(f"""WITH {_DOCLINES}, f AS (SELECT doc_id,
  len({_PLAIN1}) / (len({_words('line')}) + 1e-9::DOUBLE) > 0.7 AND {_hits(_PLAIN1, L.ENGLISH_10)} > 0 AS e1, {_EL3} AS e3, {_EL31} AS e31, {_EL32} AS e32,
  {_n('line')} BETWEEN 3 AND 50 AND (len({_PLAIN2}) / (len({_words('line')}) + 1e-9::DOUBLE) > 0.6 OR regexp_matches(line, '["'']')) AS s2,
  {_n('line')} BETWEEN 3 AND 45 AND ({_QUOTE} OR {_alpha('line')} >= 0.55 OR regexp_matches(line, '[.!?:;]$')) AS s3,
  {_n('line')} BETWEEN 3 AND 55 AND ({_QUOTE} OR {_alpha('line')} >= 0.60 OR {_EL31}) AS s31, {_n('line')} BETWEEN 3 AND 60 AND ({_QUOTE} OR {_alpha('line')} >= 0.68 OR {_EL32}) AS s32,
  CASE WHEN len({_AZ}) > 0 THEN {_hits(_AZ, L.ENGLISH_33)} / CAST(len({_AZ}) AS DOUBLE) + 0.05::DOUBLE * {_hits(_AZ, L.NEARBY_BONUS)} ELSE 0 END AS es FROM dl)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (e1) AS english_1, count(*) FILTER (e3) AS english_3, count(*) FILTER (e31) AS english_31, count(*) FILTER (e32) AS english_32,
  count(*) FILTER (s2) AS sentence_2, count(*) FILTER (s3) AS sentence_3, count(*) FILTER (s31) AS sentence_31, count(*) FILTER (s32) AS sentence_32, round_even(max(es), 6) AS best_score FROM f GROUP BY doc_id""")
def english_and_sentence_like(spark, sf_dir):
    names = ("english_1", "english_3", "english_31", "english_32", "sentence_2", "sentence_3", "sentence_31", "sentence_32")

    def counted(text):  # a row for each text that has lines
        flags = [plain.line_flags(x) for x in plain.lines(text)]
        return [(len(flags), *[sum(f[i] for f in flags) for i in range(8)], max(f[8] for f in flags))] if flags else []

    of_text = rows.made(_docs(spark, sf_dir), ["doc_id"], ["text"], "n_lines long, " + ", ".join(f"{k} long" for k in names) + ", best_score double", counted)
    return of_text.groupBy("doc_id").agg(*[F.sum(k).alias(k) for k in ("n_lines", *names)], F.bround(F.max("best_score"), 6).alias("best_score"))


_AZX = "regexp_extract_all(lower(text), '[a-zà-ÿ]+')"


@query(f"""SELECT lang, CASE WHEN n < 3 OR greatest(en, de, fr, es) = 0 THEN 'unknown' WHEN en = greatest(en, de, fr, es) THEN 'en' WHEN de = greatest(en, de, fr, es) THEN 'de' WHEN fr = greatest(en, de, fr, es) THEN 'fr' ELSE 'es' END AS detected, count(*) AS n
FROM (SELECT lang, len({_AZX}) AS n, {_hits(_AZX, L.ENGLISH_24)} AS en, {_hits(_AZX, L.GERMAN)} AS de, {_hits(_AZX, L.FRENCH)} AS fr, {_hits(_AZX, L.SPANISH)} AS es FROM documents) GROUP BY 1, 2""")
def detect_language(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").select("lang", L.detect_language(F.coalesce("text", F.lit(""))).alias("detected"))
    return d.groupBy("lang", "detected").agg(F.count("*").alias("n"))


@query(f"WITH {_DOCLINES} SELECT doc_id, count(*) FILTER (regexp_matches(line, '[{T.DIACRITICS}]|\\b[a-z]+-[a-z]+\\b')) AS surface, count(*) FILTER (regexp_matches(lower(line), '[{T.DIACRITICS}]|[a-z]+-[a-z]+')) AS surface_any, count(*) FILTER (regexp_matches(line, '{MARKED}')) AS marked FROM dl GROUP BY doc_id")
def surface_lines(spark, sf_dir):
    c = F.col("line")
    rows = _lines(spark, sf_dir)
    return rows.groupBy("doc_id").agg(F.count(F.when(L.is_surface(c), 1)).alias("surface"), F.count(F.when(L.is_surface_any_case(c), 1)).alias("surface_any"), F.count(F.when(c.rlike(MARKED), 1)).alias("marked"))


# Baseline, statistics, alignment.


@query(f"WITH {_PAIRS} SELECT * FROM base")
def baseline_pairs(spark, sf_dir):
    b = _base(spark, sf_dir)
    return b.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), "src", "tgt")


def _stats_sql(low: float, high: float) -> str:
    one = f"m AS (SELECT {_n('src')} AS s, {_n('tgt')} AS t, {_ratio('src', 'tgt')} AS r FROM base)"
    at = lambda c, p: f"(SELECT {c} FROM (SELECT {c}, row_number() OVER (ORDER BY {c}) AS rn, count(*) OVER () AS n FROM m) WHERE rn = 1 + CAST(floor(n * CAST({p} AS DOUBLE)) AS BIGINT))"
    cols = ", ".join(f"{at(c, p)} AS {name}_{end}" for c, name in (("s", "src"), ("t", "tgt"), ("r", "ratio")) for end, p in (("min", low), ("max", high)))
    return f"{one}, st AS (SELECT median(s) AS src_med, median(t) AS tgt_med, median(r) AS ratio_med, avg(r) AS ratio_avg, {cols} FROM m)"


_STATS_OUT = "CAST(src_min AS BIGINT) AS src_min, CAST(src_max AS BIGINT) AS src_max, CAST(tgt_min AS BIGINT) AS tgt_min, CAST(tgt_max AS BIGINT) AS tgt_max, round_even(ratio_min, 6) AS ratio_min, round_even(ratio_max, 6) AS ratio_max, CAST(src_med AS DOUBLE) AS src_med, CAST(tgt_med AS DOUBLE) AS tgt_med, round_even(ratio_med, 6) AS ratio_med, round_even(ratio_avg, 6) AS ratio_avg"


def _stats_out(df: DataFrame) -> DataFrame:
    longs = [F.col(c).cast("long").alias(c) for c in ("src_min", "src_max", "tgt_min", "tgt_max")]
    return df.select(*longs, *[F.bround(F.col(c).cast("double"), 6).alias(c) for c in ("ratio_min", "ratio_max", "src_med", "tgt_med", "ratio_med", "ratio_avg")])


@query(f"WITH {_PAIRS}, {_stats_sql(0.05, 0.95)} SELECT {_STATS_OUT} FROM st")
def baseline_stats_p05(spark, sf_dir):
    return _stats_out(stats.baseline_stats(_base(spark, sf_dir), 0.05, 0.95))


@query(f"WITH {_PAIRS}, {_stats_sql(0.15, 0.85)} SELECT {_STATS_OUT} FROM st")
def baseline_stats_p15(spark, sf_dir):
    return _stats_out(stats.baseline_stats(_base(spark, sf_dir), 0.15, 0.85))


def _norm(x: str) -> str:
    for a, b in (("ḫ", "h"), ("Ḫ", "H"), ("sz", "š"), ("SZ", "Š"), ("[...]", "<gap>"), ("x x x", "<gap>")):
        x = f"replace({x}, '{a}', '{b}')"
    return _collapse(x)


_CHUNKS = f"""nz AS (SELECT conv_id, turn, {_norm('src')} AS src, {_norm('tgt')} AS tgt FROM ex),
sp AS (SELECT conv_id, turn, tgt, string_split(src, ' ') AS words, {_sents('tgt')} AS sents FROM nz WHERE src <> '' AND tgt <> ''),
se AS (SELECT conv_id, turn, words, len(words) AS total, len(sents) AS ns, i - 1 AS k, sents[i] AS sentence, length(tgt) AS chars FROM (SELECT *, unnest(range(1, len(sents) + 1)) AS i FROM sp WHERE len(sents) > 1)),
ln AS (SELECT *, greatest(1, CAST(round_even(total * (length(sentence) / CAST(chars AS DOUBLE)), 0) AS BIGINT)) AS take FROM se),
cu AS (SELECT *, sum(take) OVER (PARTITION BY conv_id, turn ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto FROM ln),
ch AS (SELECT conv_id, turn, k, array_to_string(words[CAST(least(upto - take, total) AS BIGINT) + 1:CASE WHEN k = ns - 1 THEN total ELSE CAST(least(upto, total) AS BIGINT) END], ' ') AS src, sentence AS tgt FROM cu)"""


@query(f"WITH {_EX}, {_CHUNKS} SELECT conv_id, turn, CAST(k AS BIGINT) AS k, src, tgt FROM ch")
def proportional_chunks(spark, sf_dir):
    c = align.proportional_chunks(X.exchanges(spark, sf_dir))
    return c.select("conv_id", "turn", F.col("k").cast("long").alias("k"), "src", "tgt")


@query(f"""WITH tok AS (SELECT doc_id, unit, t, unnest(t) AS token, generate_subscripts(t, 1) AS p FROM (SELECT doc_id, i AS unit, {_lex('u[i]')} AS t FROM (SELECT doc_id, u, unnest(range(1, len(u) + 1)) AS i FROM (SELECT doc_id, {_units('text')} AS u FROM documents)))),
first AS (SELECT token, count(*) AS n, min((doc_id, unit)) AS o FROM tok WHERE p = 1 GROUP BY 1),
freq AS (SELECT token, count(*) AS n, min((doc_id, unit, p)) AS o FROM tok GROUP BY 1)
SELECT 'starter' AS kind, token, n FROM (SELECT token, n FROM first ORDER BY n DESC, o LIMIT 50) UNION ALL SELECT 'frequent' AS kind, token, n FROM (SELECT token, n FROM freq ORDER BY n DESC, o LIMIT 500)""")
def learned_tokens(spark, sf_dir):
    s = stats.learned_structure(_docs(spark, sf_dir), "text", ["doc_id"], 0.05, 0.95, 50, 500, True)
    kinds = [s[k].select(F.lit(name).alias("kind"), "token", "n") for k, name in (("starters", "starter"), ("frequent", "frequent"))]
    return kinds[0].unionByName(kinds[1])


@query(f"""WITH n AS (SELECT len(t) AS n FROM (SELECT {_lex('v')} AS t FROM (SELECT unnest({_units('text')}) AS v FROM documents)) WHERE len(t) > 0),
r AS (SELECT n, row_number() OVER (ORDER BY n) AS rn, count(*) OVER () AS c FROM n)
SELECT CAST(min(n) AS BIGINT) AS min_length, CAST(max(n) AS BIGINT) AS max_length, round_even(avg(n), 6) AS avg_length,
  CAST(max(n) FILTER (rn = 1 + CAST(floor(c * 0.05::DOUBLE) AS BIGINT)) AS BIGINT) AS detect_min, CAST(max(n) FILTER (rn = 1 + least(c - 1, CAST(floor(c * 0.95::DOUBLE) AS BIGINT))) AS BIGINT) AS detect_max FROM r""")
def learned_lengths(spark, sf_dir):
    s = stats.learned_lengths(_docs(spark, sf_dir), "text", 0.05, 0.95, True)
    return s.select(*[F.col(c).cast("long").alias(c) for c in ("min_length", "max_length", "detect_min", "detect_max")], F.bround("avg_length", 6).alias("avg_length"))


@query(f"""SELECT DISTINCT form FROM (SELECT {_marks('text')} AS form FROM benchmark UNION ALL SELECT unnest({_lex(_marks('text'))}) AS form FROM benchmark) WHERE form <> ''""")
def lexicon_build(spark, sf_dir):
    return retrieval.lexicon(X.table(spark, sf_dir, "benchmark"), "text")


# Gates and scores.


@query(f"""WITH {_PAIRS}, {_stats_sql(0.05, 0.95)}, g AS (SELECT conv_id, turn, pos, {_n('src')} AS s, {_n('tgt')} AS t, {_ratio('src', 'tgt')} AS r, src, tgt, st.* FROM base, st)
SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos,
  s BETWEEN 2 AND 35 AND t BETWEEN 3 AND 45 AND r BETWEEN 0.3 AND 4.2 AND length(src) - length(replace(src, '.', '')) <= 1 AND (length(tgt) - length(replace(tgt, '"', ''))) % 2 = 0 AS clean_pair,
  s BETWEEN 5 AND 35 AND t BETWEEN 4 AND 45 AND s BETWEEN src_min AND src_max AND t BETWEEN tgt_min AND tgt_max AND r >= greatest(0.3::DOUBLE, ratio_min * 0.8::DOUBLE) AND r <= least(4.0::DOUBLE, ratio_max * 1.1::DOUBLE) AS in_bands,
  s >= 3 AND t >= 3 AND r BETWEEN 0.3 AND 6.0 AS ratio_ok, length(tgt) / CAST(length(src) AS DOUBLE) < 0.25 OR length(tgt) / CAST(length(src) AS DOUBLE) > 3.2 AS noisy FROM g""")
def pair_gates(spark, sf_dir):
    b = _base(spark, sf_dir)
    src, tgt = F.col("src"), F.col("tgt")
    g = b.crossJoin(F.broadcast(stats.baseline_stats(b, 0.05, 0.95)))
    return g.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), scoring.clean_pair(src, tgt).alias("clean_pair"), scoring.band_gate(src, tgt).alias("in_bands"), scoring.ratio_gate(src, tgt).alias("ratio_ok"), scoring.char_ratio_noise(src, tgt, V41).alias("noisy"))


def _pt(*rules: tuple[str, int]) -> str:
    return "(" + " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p in rules) + ")"


def _confidence_sql(name: str, s: str = "src", t: str = "tgt") -> str:
    """The score of a cleaned pair; statistics are columns."""
    p = EXPANSIONS[name]
    az = f"regexp_extract_all({t}, '[a-z]+')"
    quotes, dirty, gap, colon, twice = f"(length({t}) - length(replace({t}, '\"', ''))) % 2 = 0", f"regexp_matches({t}, '[^\\x00-\\x7F{T.DIACRITICS}]')", f"contains({t}, '<gap>')", f"contains({t}, ':')", f"contains({t}, '\"\"')"
    more, alpha, points = p.english
    en = [(f"{_hits(az, p.common)} >= 2", 2), (f"{_hits(az, p.common)} >= {more}", 1), (f"{_alpha(t)} >= {alpha}", points), (f"regexp_matches({t}, '[.!?]$')", 1), (quotes, 1)]
    en += [(f"NOT {dirty}", 1), (gap, -1)] if name == "v41" else [(colon, -1), (dirty, -3)] + ([(gap, -2), (twice, -3)] if name == "v42" else [])
    english = f"CASE WHEN len({az}) < 3 THEN 0 ELSE {_pt(*en)} END" if name == "v41" else _pt(*en)
    hy = f"len([h FOR h IN {_words(s)} IF contains(h, '-')])"
    least, pts, share = p.hyphens
    source = [(f"regexp_matches({s}, '[{T.DIACRITICS}]|[a-z]+-[a-z]+')", 2), (f"{hy} >= {least}", pts), (f"{hy} / CAST(greatest(1, {_n(s)}) AS DOUBLE) >= {share}", 1), (f"NOT contains({s}, '.')", 1)]
    if name != "v51":
        source += [(f"NOT starts_with({s}, '<gap>') AND NOT ends_with({s}, '<gap>')", 1), (f"len([h FOR h IN {_words(s)} IF h = '<gap>']) <= {1 if name == 'v41' else 0}", 1)]
    off = f"abs({_ratio(s, t)} - {p.centre})"
    near = f"CASE WHEN {off} <= {p.near[0][0]} THEN {p.near[0][1]} WHEN {off} <= {p.near[1][0]} THEN {p.near[1][1]} ELSE 0 END"
    ns, nt = _n(s), _n(t)
    if name == "v41":
        rest = [(f"{ns} BETWEEN 4 AND 18", 1), (f"{nt} BETWEEN 5 AND 24", 1), (colon, -1), (dirty, -2), (twice, -2), (gap, -1)]
    else:
        rest = [(f"{ns} BETWEEN src_min AND src_max", 2), (f"{nt} BETWEEN tgt_min AND tgt_max", 2)]
        rest += [(f"{ns} < 6", -2), (f"{nt} < 5", -2), (f"{nt} > 24", -1)] if name == "v42" else [(f"{ns} < 5", -3), (f"{nt} < 4", -3), (f"{ns} > 35", -1), (f"{nt} > 35", -1)]
    return f"({english} + {_pt(*source)} + {near} + {_pt(*rest)})"


def _confidence_query(p):
    def run(spark, sf_dir):
        b = _base(spark, sf_dir)
        g = scoring.scored(b.crossJoin(F.broadcast(stats.baseline_stats(b, *p.percentiles))), p)
        return g.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), F.col("confidence").cast("long").alias("confidence"), F.col("src_len").cast("long").alias("src_len"), F.col("tgt_len").cast("long").alias("tgt_len"), "ratio")

    run.__name__ = f"pair_confidence_{p.name}"
    return run


for _p in (V41, V42, V51):
    query(f"""WITH {_PAIRS}, {_stats_sql(*_p.percentiles)} SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos, CAST({_confidence_sql(_p.name)} AS BIGINT) AS confidence, CAST({_n('src')} AS BIGINT) AS src_len, CAST({_n('tgt')} AS BIGINT) AS tgt_len, round_even({_ratio('src', 'tgt')}, 3) AS ratio FROM base, st""")(_confidence_query(_p))


# Expansion pipelines.  The cut-offs of the tuned profiles lie above what untransliterated text reaches, so the SQL
# twins lower them; the full profiles run too.


def _loose(p, cut: int = 6):
    from dataclasses import replace

    return replace(p, cut=cut, least=(1, 1))


def _expand_query(name: str, p, similarity: bool):
    def run(spark, sf_dir):
        out = expansion.expand(X.exchanges(spark, sf_dir), ["conv_id", "turn"], p, similarity=similarity)
        return out.select(*[F.col(c).cast("long").alias(c) if c in ("confidence", "src_len", "tgt_len") else F.col(c) for c in out.columns])

    run.__name__ = name
    return run


def _expand_sql(name: str) -> str:
    p = EXPANSIONS[name]
    lo, hi, _ = p.noise
    char = "length(tgt) / CAST(length(src) AS DOUBLE)"
    fresh = f"""fresh AS (SELECT conv_id, turn, k, {_clean('src')} AS src, {_clean('tgt')} AS tgt FROM ch),
c AS (SELECT f.* FROM fresh f ANTI JOIN base b ON b.src = f.src AND b.tgt = f.tgt WHERE {_letter('f.src')} AND {_letter('f.tgt')} AND length(f.tgt) >= 3 AND length(f.src) > 0),
q AS (SELECT * FROM c WHERE {char} >= {lo} AND {char} <= {hi})"""
    if name == "v4":
        gate = f"""{_n('src')} BETWEEN 2 AND 35 AND {_n('tgt')} BETWEEN 3 AND 45 AND {_ratio('src', 'tgt')} BETWEEN 0.3 AND 4.2 AND length(src) - length(replace(src, '.', '')) <= 1 AND (length(tgt) - length(replace(tgt, '"', ''))) % 2 = 0"""
        return f"WITH {_PAIRS}, {_CHUNKS}, {fresh} SELECT DISTINCT src, tgt FROM q WHERE {gate}"
    gate = "true" if name == "v42" else f"{_n('src')} BETWEEN 5 AND 35 AND {_n('tgt')} BETWEEN 4 AND 45 AND {_n('src')} BETWEEN src_min AND src_max AND {_n('tgt')} BETWEEN tgt_min AND tgt_max AND {_ratio('src', 'tgt')} >= greatest(0.3::DOUBLE, ratio_min * 0.8::DOUBLE) AND {_ratio('src', 'tgt')} <= least(4.0::DOUBLE, ratio_max * 1.1::DOUBLE)"
    return f"""WITH {_PAIRS}, {_stats_sql(*p.percentiles)}, {_CHUNKS}, {fresh},
s AS (SELECT src, tgt, CAST({_confidence_sql(name)} AS BIGINT) AS confidence, CAST({_n('src')} AS BIGINT) AS src_len, CAST({_n('tgt')} AS BIGINT) AS tgt_len, round_even({_ratio('src', 'tgt')}, 3) AS ratio FROM q, st WHERE {gate})
SELECT DISTINCT src, tgt, confidence, src_len, tgt_len, ratio FROM s WHERE confidence >= 6 AND src_len >= 1 AND tgt_len >= 1"""


query(_expand_sql("v4"))(_expand_query("expansion_v4_nosim", V4, False))
query(_expand_sql("v41"))(_expand_query("expansion_v41_nosim", _loose(V41), False))
query(_expand_sql("v42"))(_expand_query("expansion_v42_nosim", _loose(V42), False))
@query(f"WITH {_PAIRS}, {_CHUNKS}, fresh AS (SELECT DISTINCT {_clean('src')} AS src, {_clean('tgt')} AS tgt FROM ch) SELECT 0 AS part, src, tgt FROM base UNION ALL SELECT 1 AS part, src, tgt FROM fresh ANTI JOIN base USING (src, tgt)")
def union_merge(spark, sf_dir):
    e = X.exchanges(spark, sf_dir)
    b = align.baseline_pairs(e, ["conv_id", "turn"])
    new = dedup.keep_first(expansion.candidates(e, b, ["conv_id", "turn"], V4), ["src", "tgt"], "conv_id", "turn", "k")
    return dedup.merged(b.select("src", "tgt"), new.select("src", "tgt"))


# Archive and import.


def _archive(spark, sf_dir):
    n = X.table(spark, sf_dir, "nation")
    published = n.select(F.col("n_nationkey").cast("long").alias("ord"), F.col("n_regionkey").cast("string").alias("ref_id"), F.concat(F.col("n_name"), F.lit(" | "), F.lower("n_name"), F.lit(", x;"), F.substring("n_name", 1, 1)).alias("aliases"), F.concat(F.lit(" k"), "n_nationkey", F.lit(" ")).alias("excavation_no"), F.concat(F.lit("text of "), "n_name").alias("transliteration"))
    s = X.table(spark, sf_dir, "supplier")
    alias = F.substring(F.array_join(F.array(F.chr(65 + F.col("s_nationkey"))), ""), 1, 1)
    literals = s.select(F.col("s_suppkey").alias("ord"), F.when(F.col("s_suppkey") % 2 == 0, "alias").otherwise("excavation").alias("source_kind"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(" "), alias, F.lit("|z"))).otherwise(F.concat(F.lit("k"), "s_nationkey")).alias("match_key"), F.concat(F.lit("line\n12\nof "), "s_name", F.lit("-\nend.")).alias("translation"))
    known = X.table(spark, sf_dir, "region").where("r_regionkey < 2").select(F.col("r_regionkey").cast("string").alias("ref_id"))
    return literals, published, known


@query(r"""WITH p AS (SELECT n_nationkey AS ord, CAST(n_regionkey AS VARCHAR) AS ref_id, n_name || ' | ' || lower(n_name) || ', x;' || n_name[1:1] AS aliases, ' k' || n_nationkey || ' ' AS excavation_no, 'text of ' || n_name AS transliteration FROM nation),
l AS (SELECT s_suppkey AS ord, s_suppkey % 2 = 0 AS is_alias, CASE WHEN s_suppkey % 2 = 0 THEN ' ' || chr(65 + s_nationkey) || '|z' ELSE 'k' || s_nationkey END AS match_key, s_name FROM supplier),
names AS (SELECT ord, i, replace(regexp_replace(lower(a[i]), '\s+', '', 'g'), ',', '') AS k FROM (SELECT ord, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT ord, string_split_regex(aliases, '[|;]') AS a FROM p))),
ai AS (SELECT k, arg_max(ord, ord * 100 + i) AS p_ord FROM names WHERE k <> '' GROUP BY k),
di AS (SELECT trim(excavation_no) AS k, max(ord) AS p_ord FROM p GROUP BY 1),
hit AS (SELECT l.*, ai.p_ord, 0 AS rk FROM l JOIN ai ON is_alias AND ai.k = trim(split_part(lower(trim(match_key)), '|', 1)) UNION ALL SELECT l.*, di.p_ord, 1 AS rk FROM l JOIN di ON NOT is_alias AND di.k = match_key),
one AS (SELECT * FROM (SELECT hit.*, p.ref_id, p.aliases, p.excavation_no, p.transliteration, row_number() OVER (PARTITION BY p.ref_id ORDER BY rk, hit.ord) AS rn FROM hit JOIN p ON p.ord = hit.p_ord) WHERE rn = 1)
SELECT CASE WHEN rk = 0 THEN 'archive_alias' ELSE 'excavation_match' END AS source, match_key, ref_id, CAST(ref_id AS INT) >= 2 AS is_new, aliases, excavation_no, transliteration, 'line of ' || s_name || 'end.' AS translation FROM one""")
def archive_join(spark, sf_dir):
    return archive.archive_pairs(*_archive(spark, sf_dir))


_EXT = f"""{_EX}, xt AS (SELECT CASE conv_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS mode, conv_id % 3 AS mo, conv_id * 1000 + turn AS line_no, {_clean('src')} AS src, {_clean('tgt')} AS tgt FROM ex),
active AS (SELECT DISTINCT src, tgt FROM xt WHERE line_no % 7 = 0),
un AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, tgt ORDER BY mo, line_no) AS rn FROM xt WHERE src <> '' AND tgt <> '') WHERE rn = 1),
cl AS (SELECT un.*, CASE WHEN a.src IS NOT NULL THEN 'active' WHEN {_letter('un.src')} AND {_letter('un.tgt')} AND {_n('un.src')} >= 3 AND {_n('un.tgt')} >= 3 AND {_ratio('un.src', 'un.tgt')} BETWEEN 0.3 AND 6.0 THEN 'kept' ELSE 'filtered' END AS verdict FROM un LEFT JOIN active a ON a.src = un.src AND a.tgt = un.tgt)"""


def _active(spark, sf_dir):
    a = X.external(spark, sf_dir).where("line_no % 7 = 0")
    return a.select(T.clean_text(F.col("src")).alias("src"), T.clean_text(F.col("tgt")).alias("tgt"))


@query(f"WITH {_EXT} SELECT mode, mode || ':' || line_no AS row_id, src, tgt, CAST({_n('src')} AS BIGINT) AS src_len, CAST({_n('tgt')} AS BIGINT) AS tgt_len, round_even({_ratio('src', 'tgt')}, 3) AS ratio FROM cl WHERE verdict = 'kept'")
def external_import(spark, sf_dir):
    out = importing.imported(X.external(spark, sf_dir), _active(spark, sf_dir))
    return out.withColumn("src_len", F.col("src_len").cast("long")).withColumn("tgt_len", F.col("tgt_len").cast("long"))


@query(f"""WITH {_EXT} SELECT (SELECT count(*) FROM xt) AS external_raw, count(*) AS external_unique, (SELECT count(*) FROM xt WHERE src <> '' AND tgt <> '') - count(*) AS duplicate_inside_external, count(*) FILTER (verdict = 'active') AS already_in_active,
  count(*) FILTER (verdict = 'filtered') AS filtered_out, count(*) FILTER (verdict = 'kept') AS imported_new, count(*) FILTER (verdict = 'kept' AND mode = 'train') AS train_kept, count(*) FILTER (verdict = 'kept' AND mode = 'valid') AS valid_kept, count(*) FILTER (verdict = 'kept' AND mode = 'test') AS test_kept FROM cl""")
def import_stats(spark, sf_dir):
    return importing.import_stats(X.external(spark, sf_dir), _active(spark, sf_dir))


# Deduplication.


@query("SELECT doc_id, md5(text) AS digest FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def dedup_keep_first(spark, sf_dir):
    return dedup.keep_first(_docs(spark, sf_dir), ["text"], "doc_id").select("doc_id", F.md5("text").alias("digest"))


@query("SELECT lang, source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1")
def dedup_best_first(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").select("lang", "source", "doc_id", "n_chars")
    return dedup.keep_best(d, ["lang", "source"], [-F.col("n_chars"), F.col("doc_id")])


@query(f"WITH {_PAIRS} SELECT src AS line FROM base UNION ALL SELECT unnest({_units('text')}) AS line FROM benchmark")
def corpus_append(spark, sf_dir):
    b = X.table(spark, sf_dir, "benchmark").select(F.explode(S.units(F.col("text"))).alias("line"))
    return _base(spark, sf_dir).select(F.col("src").alias("line")).unionByName(b)


# Containment and proximity.


@query("SELECT doc_id, a.item_id AS ref, alias FROM documents d JOIN (SELECT item_id, array_to_string(string_split(lower(text), ' ')[1:3], ' ') AS alias FROM benchmark) a ON contains(lower(d.text), a.alias)")
def alias_containment(spark, sf_dir):
    a = X.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ref"), F.substring_index(F.lower("text"), " ", 3).alias("alias"))
    d = _docs(spark, sf_dir).select("doc_id", F.lower("text").alias("low"))
    return retrieval.alias_containment(d, ["doc_id"], "low", a).select("doc_id", "ref", "alias")


@query("SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> '' AND EXISTS (SELECT 1 FROM benchmark b WHERE contains(b.text, line) OR contains(replace(b.text, '-', ''), replace(line, '-', '')))")
def line_in_reference(spark, sf_dir):
    lines = rows.made(_docs(spark, sf_dir), ["doc_id"], ["text"], "line string", lambda x: [(y,) for y in x.split("\n") if y])
    return retrieval.lines_in_references(lines, "line", X.table(spark, sf_dir, "benchmark"), "text")


def _near_sql(k: int) -> str:
    return f"""WITH {_DOCLINES}, c AS (SELECT * FROM dl WHERE regexp_matches(line, '{MARKED}')), o AS (SELECT * FROM dl WHERE {_EL31})
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(near_no AS BIGINT) AS near_no, CAST(distance AS BIGINT) AS distance FROM (
  SELECT c.doc_id, c.line_no, o.line_no AS near_no, abs(c.line_no - o.line_no) AS distance, row_number() OVER (PARTITION BY c.doc_id, c.line_no ORDER BY abs(c.line_no - o.line_no), o.line_no) AS rn
  FROM c JOIN o ON o.doc_id = c.doc_id AND abs(c.line_no - o.line_no) BETWEEN 1 AND {k}) WHERE rn = 1"""


def _near_query(k: int):
    def run(spark, sf_dir):
        rows = X.pages(spark, sf_dir).select(F.col("page_id").alias("doc_id"), S.lines(F.col("page_text")).alias("l"))
        flags = lambda f: F.transform("l", f)
        n = align.near_in_page(rows.withColumn("marked", flags(lambda c: c.rlike(MARKED))).withColumn("english", flags(lambda c: L.english_like_alpha(c))), ["doc_id"], "l", "marked", "english", k)
        return n.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("b_no").cast("long").alias("near_no"), F.col("distance").cast("long").alias("distance"))

    run.__name__ = f"proximity_pairs_k{k}"
    return run


for _k in (3, 4, 6):
    query(_near_sql(_k))(_near_query(_k))


# Retrieval.

_WIN = f"""un AS (SELECT item_id, [u FOR u IN [{_signs('v')} FOR v IN string_split_regex(text, '[\\n.]')] IF u <> ''] AS u FROM benchmark),
kept AS (SELECT item_id, [x FOR x IN u IF len({_lex('x')}) BETWEEN 2 AND 35] AS u FROM un),
wn AS (SELECT item_id, u, k, unnest(range(0, len(u) - k + 1)) AS start FROM kept, (VALUES (1), (2), (3)) t(k) WHERE len(u) >= k),
wt AS (SELECT item_id * 4000000 + k * 1000000 + start AS ref_id, item_id AS ref, {_lex("array_to_string(u[start + 1:start + k], ' ')")} AS tokens FROM wn),
win AS (SELECT *, list_distinct(tokens) AS token_set FROM wt WHERE len(list_distinct(tokens)) >= 2),
dfs AS (SELECT token, count(*) AS df FROM (SELECT unnest(token_set) AS token FROM win) GROUP BY 1),
idf AS (SELECT token, df, ln((1 + (SELECT count(*) FROM win)) / CAST(1 + df AS DOUBLE)) + 1 AS idf FROM dfs)"""


def _windows(spark, sf_dir):
    return staged(retrieval.reference_windows(X.references(spark, sf_dir), "ref", "ref_text"), "windows")  # read several times


@query(f"WITH {_WIN} SELECT token, CAST(df AS BIGINT) AS df, round_even(idf, 6) AS idf FROM idf")
def idf_table(spark, sf_dir):
    return retrieval.idf_table(_windows(spark, sf_dir)).select("token", "df", F.bround("idf", 6).alias("idf"))


_POST = "post AS (SELECT token, ref_id FROM (SELECT token, ref_id, row_number() OVER (PARTITION BY token ORDER BY ref_id) AS rn FROM (SELECT unnest(token_set) AS token, ref_id FROM win)) WHERE rn <= {})"


@query(f"WITH {_WIN}, {_POST.format(5)} SELECT token, ref_id FROM post")
def postings_topn(spark, sf_dir):
    return retrieval.postings(_windows(spark, sf_dir), 5).select("token", "ref_id")


_CAND = f"""cand AS (SELECT conv_id, turn, {_lex('text')} AS tokens FROM conversations WHERE role = 'user'),
qt AS (SELECT conv_id, turn, token, idf FROM (SELECT c.conv_id, c.turn, c.token, i.idf, row_number() OVER (PARTITION BY c.conv_id, c.turn ORDER BY i.idf DESC, c.token) AS rn
  FROM (SELECT DISTINCT conv_id, turn, token FROM (SELECT conv_id, turn, unnest(list_concat([t, replace(t, '-', '')], string_split(t, '-'))) AS token FROM (SELECT conv_id, turn, unnest(tokens) AS t FROM cand)) WHERE token <> '') c JOIN idf i ON i.token = c.token) WHERE rn <= 6),
sc AS (SELECT q.conv_id, q.turn, p.ref_id, sum(q.idf) AS score FROM qt q JOIN post p ON p.token = q.token GROUP BY ALL),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY round_even(score, 9) DESC, ref_id) AS pool_rank FROM sc) WHERE pool_rank <= 40)"""


def _candidates(spark, sf_dir):
    c = X.table(spark, sf_dir, "conversations").where("role = 'user'")
    return staged(rows.made(c, ["conv_id", "turn"], ["text"], "tokens array<string>", lambda x: [(plain.tokens(x),)] if x is not None else [(None,)]), "candidates")  # read several times


@query(f"WITH {_WIN}, {_POST.format(180)}, {_CAND} SELECT conv_id, turn, ref_id, round_even(score, 6) AS score, pool_rank FROM pool")
def retrieve_topk(spark, sf_dir):
    w = _windows(spark, sf_dir)
    r = retrieval.retrieve(_candidates(spark, sf_dir), ["conv_id", "turn"], "tokens", w, retrieval.idf_table(w))
    return r.select("conv_id", "turn", "ref_id", F.bround("retrieval_score", 6).alias("score"), F.col("pool_rank").cast("long").alias("pool_rank"))


@query(f"""WITH {_WIN}, {_POST.format(180)}, {_CAND},
ct AS (SELECT conv_id, turn, t.token, coalesce(idf, 1.0) AS w FROM (SELECT DISTINCT conv_id, turn, unnest(tokens) AS token FROM cand) t LEFT JOIN idf i ON i.token = t.token),
cw AS (SELECT conv_id, turn, sum(w) AS cw FROM ct GROUP BY ALL),
rt AS (SELECT ref_id, t.token, idf AS w FROM (SELECT ref_id, unnest(token_set) AS token FROM win) t JOIN idf i ON i.token = t.token),
rw AS (SELECT ref_id, sum(w) AS rw FROM rt GROUP BY ALL),
ov AS (SELECT p.conv_id, p.turn, p.ref_id, p.pool_rank, count(*) AS shared, sum(ct.w) AS overlap FROM pool p JOIN ct ON ct.conv_id = p.conv_id AND ct.turn = p.turn JOIN rt ON rt.ref_id = p.ref_id AND rt.token = ct.token GROUP BY ALL),
co AS (SELECT ov.*, overlap / (cw + rw - overlap) + CASE WHEN c.tokens[1:2] = w.tokens[1:2] THEN 0.05 ELSE 0 END AS coarse FROM ov JOIN cw USING (conv_id, turn) JOIN rw USING (ref_id) JOIN cand c USING (conv_id, turn) JOIN win w USING (ref_id))
SELECT conv_id, turn, ref_id, shared, round_even(overlap, 6) AS overlap, round_even(coarse, 6) AS coarse FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY round_even(coarse, 9) DESC, pool_rank) AS rn FROM co) WHERE rn <= 6""")
def rerank_coarse(spark, sf_dir):
    w, key, c = _windows(spark, sf_dir), ["conv_id", "turn"], _candidates(spark, sf_dir)
    weights = retrieval.idf_table(w)
    r = retrieval.rerank_coarse(c, key, "tokens", retrieval.retrieve(c, key, "tokens", w, weights), w, weights)
    return r.select(*key, "ref_id", F.col("shared").cast("long").alias("shared"), F.bround("overlap", 6).alias("overlap"), F.bround("coarse", 6).alias("coarse"))


@query(f"""SELECT conv_id, turn, round_even(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) ELSE 0 END, 6) AS jaccard,
  round_even(2.0::DOUBLE * least(length(src), length(tgt)) / (length(src) + length(tgt)), 6) AS bound FROM (SELECT conv_id, turn, src, tgt, list_distinct({_lex('src')}) AS a, list_distinct({_lex('tgt')}) AS b FROM (WITH {_EX} SELECT * FROM ex))""")
def token_jaccard(spark, sf_dir):
    e = X.exchanges(spark, sf_dir)
    a, b = F.col("src"), F.col("tgt")
    j = similarity.jaccard(F.array_distinct(S.lexical_tokens(a)), F.array_distinct(S.lexical_tokens(b)))
    return e.select("conv_id", "turn", F.bround(j, 6).alias("jaccard"), F.bround(similarity.ratio_bound(a, b), 6).alias("bound"))


@query(f"""WITH {_DOCLINES}, t AS (SELECT doc_id, line_no, {_lex('line')} AS t FROM dl), forms AS (SELECT DISTINCT unnest({_lex(_marks('text'))}) AS form FROM benchmark UNION SELECT DISTINCT {_marks('text')} FROM benchmark),
x AS (SELECT doc_id, line_no, p, max(CASE WHEN form IS NULL THEN 0 ELSE 1 END) AS hit FROM (SELECT doc_id, line_no, unnest(t) AS token, generate_subscripts(t, 1) AS p FROM t) LEFT JOIN forms ON form = token GROUP BY ALL)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, count(*) AS n_tokens, CAST(sum(hit) AS BIGINT) AS n_hits, round_even(sum(hit) / CAST(count(*) AS DOUBLE), 6) AS coverage FROM x GROUP BY 1, 2""")
def lexicon_coverage(spark, sf_dir):
    t = rows.made(_lines(spark, sf_dir), ["doc_id", "line_no"], ["line"], "t array<string>", lambda x: [(plain.tokens(x),)])
    m = retrieval.membership(t, ["doc_id", "line_no"], "t", retrieval.lexicon(X.table(spark, sf_dir, "benchmark"), "text"))
    return m.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "n_tokens", F.col("n_hits").cast("long").alias("n_hits"), F.bround("coverage", 6).alias("coverage"))


# Dataset and metrics.

_KEY = "(conv_id * 7919 + turn * 104729 + pos * 1299709 + 42) % 1000003"


def _split(spark, sf_dir):
    b = _base(spark, sf_dir).withColumn("key", F.expr(_KEY))
    return dataset.split(b, "key", ["conv_id", "turn", "pos"], 1_000_003)


_SPLIT = f"""{_PAIRS}, rk AS (SELECT *, row_number() OVER (ORDER BY {_KEY}, conv_id, turn, pos) - 1 AS rank, count(*) OVER () AS n FROM base),
spl AS (SELECT *, CASE WHEN rank < floor(n * 0.7::DOUBLE) THEN 'train' WHEN rank < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'valid' ELSE 'test' END AS part FROM rk)"""


@query(f"WITH {_SPLIT} SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos, CAST(rank AS BIGINT) AS rank, part FROM spl")
def dataset_split(spark, sf_dir):
    return _split(spark, sf_dir).select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), F.col("rank").cast("long").alias("rank"), "part")


_VOC = f"""{_SPLIT}, tk AS (SELECT conv_id, turn, pos, unnest(w) AS token, generate_subscripts(w, 1) AS p FROM (SELECT conv_id, turn, pos, {_words('src')} AS w FROM spl WHERE part = 'train')),
cnt AS (SELECT token, count(*) AS n, min((conv_id, turn, pos, p)) AS o FROM tk GROUP BY 1 HAVING count(*) >= 2),
voc AS (SELECT token, 3 + row_number() OVER (ORDER BY n DESC, o) AS id, n FROM (SELECT * FROM cnt ORDER BY n DESC, o LIMIT 19996))"""


def _vocab(spark, sf_dir, side="src"):
    return dataset.vocabulary(_split(spark, sf_dir).where("part = 'train'"), side, ["conv_id", "turn", "pos"])


@query(f"WITH {_VOC} SELECT token, CAST(id AS BIGINT) AS id, n FROM voc UNION ALL SELECT * FROM (VALUES ('<pad>', CAST(0 AS BIGINT), CAST(NULL AS BIGINT)), ('<unk>', 1, NULL), ('<bos>', 2, NULL), ('<eos>', 3, NULL))")
def vocab_build(spark, sf_dir):
    return _vocab(spark, sf_dir).withColumn("id", F.col("id").cast("long"))


@query(f"""WITH {_VOC}, w AS (SELECT conv_id, turn, pos, unnest(w) AS token, generate_subscripts(w, 1) AS p FROM (SELECT conv_id, turn, pos, {_words('src')} AS w FROM spl))
SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos, '2 ' || string_agg(coalesce(v.id, 1), ' ' ORDER BY p) || ' 3' AS ids FROM w LEFT JOIN voc v ON v.token = w.token GROUP BY 1, 2, 3""")
def encode_ids(spark, sf_dir):
    key = ["conv_id", "turn", "pos"]
    e = dataset.encode(_base(spark, sf_dir), key, "src", _vocab(spark, sf_dir), bos=True, eos=True)
    return e.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query(f"""WITH {_VOC}, w AS (SELECT conv_id, turn, pos, unnest(w) AS token, generate_subscripts(w, 1) AS p FROM (SELECT conv_id, turn, pos, {_words('src')} AS w FROM spl))
SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos, string_agg(coalesce(v.token, '<unk>'), ' ' ORDER BY p) AS text FROM w LEFT JOIN voc v ON v.token = w.token GROUP BY 1, 2, 3""")
def decode_roundtrip(spark, sf_dir):
    key, vocab = ["conv_id", "turn", "pos"], _vocab(spark, sf_dir)
    e = dataset.encode(_base(spark, sf_dir), key, "src", vocab, bos=True, eos=True)
    return dataset.decode(e, key, "ids", vocab).withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH {_VOC}, e AS (SELECT conv_id, turn, pos, rank, least(80, len({_words('src')}) + 1) AS n FROM spl)
SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos, CAST(rank // 32 AS BIGINT) AS batch, CAST(n AS BIGINT) AS src_length, CAST(max(n) OVER (PARTITION BY rank // 32) AS BIGINT) AS padded_length FROM e""")
def pad_batches(spark, sf_dir):
    key, vocab = ["conv_id", "turn", "pos"], _vocab(spark, sf_dir)
    s = _split(spark, sf_dir)
    e = dataset.encode(s, key, "src", vocab, eos=True, most=80).join(s.select(*key, "rank"), key)
    p = dataset.padded(e, "rank", 32, "ids")
    return p.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), F.col("batch").cast("long").alias("batch"), F.col("ids_length").cast("long").alias("src_length"), F.size("ids").cast("long").alias("padded_length"))


def _bleu_sql() -> str:
    parts, names = [], []
    for n in range(1, 5):
        for side in ("p", "r"):
            parts.append(f"{side}{n} AS (SELECT conv_id, turn, g, count(*) AS c FROM (SELECT conv_id, turn, array_to_string({side}[i:i + {n - 1}], ' ') AS g FROM (SELECT *, unnest(range(1, len({side}) - {n - 2})) AS i FROM tok WHERE len({side}) >= {n})) GROUP BY ALL)")
        parts.append(f"o{n} AS (SELECT coalesce(sum(least(p{n}.c, coalesce(r{n}.c, 0))), 0) AS o, coalesce(sum(p{n}.c), 0) AS t FROM p{n} LEFT JOIN r{n} USING (conv_id, turn, g))")
        names.append(f"ln((o{n}.o + 1.0) / CAST(o{n}.t + 1.0 AS DOUBLE))")
    return f"""WITH {_EX}, tok AS (SELECT conv_id, turn, {_words('src')} AS p, {_words('tgt')} AS r FROM ex), {', '.join(parts)}, len AS (SELECT sum(len(p)) AS pl, sum(len(r)) AS rl FROM tok)
SELECT round_even(CASE WHEN pl > rl THEN 1.0 ELSE exp(1.0 - rl / CAST(greatest(1, pl) AS DOUBLE)) END * exp(({' + '.join(names)}) / 4) * 100, 6) AS bleu, CAST(pl AS BIGINT) AS pred_length, CAST(rl AS BIGINT) AS ref_length FROM len, o1, o2, o3, o4"""


@query(_bleu_sql())
def corpus_bleu(spark, sf_dir):
    b = metrics.corpus_bleu(X.exchanges(spark, sf_dir), ["conv_id", "turn"], "src", "tgt")
    return b.select(F.bround("bleu", 6).alias("bleu"), F.col("pred_length").cast("long").alias("pred_length"), F.col("ref_length").cast("long").alias("ref_length"))


@query(f"""WITH {_EX}, t AS (SELECT src = tgt AS eq, {_words('src')} AS p, {_words('tgt')} AS r FROM ex), m AS (SELECT eq, len(r) AS n, len([i FOR i IN range(1, least(len(p), len(r)) + 1) IF p[i] = r[i]]) AS s FROM t)
SELECT round_even(sum(CASE WHEN eq THEN 1 ELSE 0 END) / CAST(greatest(1, count(*)) AS DOUBLE), 6) AS exact_match, round_even(sum(s) / CAST(greatest(1, sum(n)) AS DOUBLE), 6) AS token_accuracy FROM m""")
def token_accuracy(spark, sf_dir):
    a = metrics.accuracy(X.exchanges(spark, sf_dir), "src", "tgt")
    return a.select(F.bround("exact_match", 6).alias("exact_match"), F.bround("token_accuracy", 6).alias("token_accuracy"))


@query("SELECT round_even(sum(value * user_id) / CAST(sum(user_id) AS DOUBLE), 4) AS loss, round_even(exp(least(20.0::DOUBLE, sum(value * user_id) / CAST(sum(user_id) AS DOUBLE))), 0) AS perplexity FROM (SELECT value / 1000 AS value, user_id FROM events)")
def weighted_perplexity(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").select((F.col("value") / 1000).alias("value"), "user_id")
    return metrics.weighted_loss(e, "value", "user_id").select(F.bround("loss", 4).alias("loss"), F.bround("perplexity", 0).alias("perplexity"))


@query(f"""WITH {_DOCLINES}, f AS (SELECT count(*) AS n, count(*) FILTER (regexp_matches(line, '{MARKED}')) AS marked, count(*) FILTER ({_EL31}) AS english, count(*) FILTER ({_n('line')} BETWEEN 3 AND 55) AS bounded FROM dl)
SELECT stage, CAST(rows AS BIGINT) AS rows, round_even(rows / CAST(n AS DOUBLE) * 100, 6) AS percent FROM (SELECT n, unnest(['lines', 'marked', 'english', 'bounded']) AS stage, unnest([n, marked, english, bounded]) AS rows FROM f)""")
def funnel_metrics(spark, sf_dir):
    c = F.col("line")
    f = metrics.funnel(_lines(spark, sf_dir), lines=F.lit(True), marked=c.rlike(MARKED), english=L.english_like_alpha(c), bounded=T.n_words(c).between(3, 55))
    return f.select("stage", "rows", F.bround("percent", 6).alias("percent"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: corpus expansion with the high-confidence profile, at a cut-off that plain text reaches."""
    return expansion.expand(X.exchanges(spark, sf_dir), ["conv_id", "turn"], _loose(V42))


from paragram import catalog_io, catalog_mining  # noqa: E402, F401  (they add their queries)
