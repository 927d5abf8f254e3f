"""Queries of string similarity, expansion at its own cut-offs, surface detection and page mining, with DuckDB SQL.

The SQL has numbers of its own where it needs the profiles', so that a wrong constant shows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from paragram import fixtures as X
from paragram.catalog import (
    _CAND, _CHUNKS, _DOCLINES, _EL3, _EL31, _EL32, _EX, _PAIRS, _POST, _QUOTE, _SPLIT, _WIN, MARKED, _alpha, _base, _candidates, _clean, _digits, _docs, _expand_query, _expand_sql, _hits, _lex, _lines, _marks,
    _n, _sents, _signs, _split, _stats_sql, _strip, _sub, _units, _vocab, _windows, _words, query,
)
from paragram.functions import lang as L
from paragram.functions import plain
from paragram.functions import similarity
from paragram.functions import split as S
from paragram.functions import text as T
from paragram.operators import align, dataset, retrieval, stats
from paragram.operators import rows as by_row
from paragram.plans import expansion, pages
from paragram.plans.profiles import SURFACES, V4, V41, V42, V51
from paragram.sources.staging import staged

# The similarity of strings in SQL: the longest common block, then the same to its left and right, until no block is left.
# Blocks start at characters of b that aren't popular (b of 200 or more: above 1 % and one) and may grow over popular ones.
_STEP = """
    SELECT id, unnest([{'alo': alo, 'ahi': i, 'blo': blo, 'bhi': j, 'k': CAST(0 AS BIGINT)}, {'alo': i + k, 'ahi': ahi, 'blo': j + k, 'bhi': bhi, 'k': CAST(0 AS BIGINT)}, {'alo': 0, 'ahi': 0, 'blo': 0, 'bhi': 0, 'k': k}]) AS s FROM (
      SELECT e.id, alo, ahi, blo, bhi, i - l AS i, j - l AS j, k + l + r AS k FROM (
        SELECT c.id, alo, ahi, blo, bhi, i, j, k,
          CASE WHEN p.lb < 200 THEN 0 ELSE coalesce(list_position([p.a[i - t + 1] = p.b[j - t + 1] FOR t IN range(1, least(i - alo, j - blo) + 1)], false) - 1, least(i - alo, j - blo)) END AS l,
          CASE WHEN p.lb < 200 THEN 0 ELSE coalesce(list_position([p.a[i + k + t] = p.b[j + k + t] FOR t IN range(1, least(ahi - i - k, bhi - j - k) + 1)], false) - 1, least(ahi - i - k, bhi - j - k)) END AS r
        FROM (
          SELECT g.id, g.alo, g.ahi, g.blo, g.bhi, coalesce(-m.x, 0) AS k, coalesce(m.y, g.alo) AS i, coalesce(m.z, g.blo) AS j
          FROM (SELECT * FROM fzs WHERE ahi > alo AND bhi > blo) g LEFT JOIN (
            SELECT id, alo, blo, min({'x': -k, 'y': i, 'z': i - d}) AS m FROM (
              SELECT id, alo, blo, d, min(i) AS i, count(*) AS k FROM (
                SELECT m.id, f.alo, f.blo, m.i, m.i - m.j AS d, m.i - row_number() OVER (PARTITION BY m.id, f.alo, f.blo, m.i - m.j ORDER BY m.i) AS run
                FROM (SELECT * FROM fzs WHERE ahi > alo AND bhi > blo) f JOIN fzm m ON m.id = f.id AND m.i >= f.alo AND m.i < f.ahi AND m.j >= f.blo AND m.j < f.bhi)
              GROUP BY id, alo, blo, d, run)
            GROUP BY id, alo, blo) best ON best.id = g.id AND best.alo = g.alo AND best.blo = g.blo) c JOIN fzp p ON p.id = c.id) e)
    WHERE k > 0"""


def _fuzzy(pairs: str) -> str:
    """CTEs that end in fuzzy (a, b, ratio) for the distinct pairs a, b of a table; for WITH RECURSIVE."""
    return f"""fzp AS MATERIALIZED (SELECT row_number() OVER () AS id, a, b, length(a) AS la, length(b) AS lb FROM (SELECT DISTINCT a, b FROM {pairs})),
fza AS (SELECT id, i, a[i + 1] AS ch FROM (SELECT id, a, unnest(range(la)) AS i FROM fzp)),
fzb AS (SELECT id, j, ch FROM (SELECT id, lb, j, ch, count(*) OVER (PARTITION BY id, ch) AS n FROM (SELECT id, lb, j, b[j + 1] AS ch FROM (SELECT id, b, lb, unnest(range(lb)) AS j FROM fzp))) WHERE lb < 200 OR n <= lb // 100 + 1),
fzm AS MATERIALIZED (SELECT x.id, x.i, y.j FROM fza x JOIN fzb y ON x.id = y.id AND x.ch = y.ch),
fzs AS (
  SELECT id, CAST(0 AS BIGINT) AS alo, la AS ahi, CAST(0 AS BIGINT) AS blo, lb AS bhi, CAST(0 AS BIGINT) AS k FROM fzp WHERE la > 0 AND lb > 0
  UNION ALL SELECT id, s.alo, s.ahi, s.blo, s.bhi, s.k FROM ({_STEP}) WHERE s.k > 0 OR (s.ahi > s.alo AND s.bhi > s.blo)),
fuzzy AS MATERIALIZED (SELECT a, b, CASE WHEN la + lb = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(k, 0) / (la + lb) END AS ratio FROM fzp LEFT JOIN (SELECT id, sum(k) AS k FROM fzs GROUP BY id) USING (id))"""


def _jaccard(a: str, b: str) -> str:
    """Of two lists of tokens."""
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect(list_distinct({a}), list_distinct({b}))) / CAST(len(list_distinct(list_concat({a}, {b}))) AS DOUBLE) ELSE 0.0::DOUBLE END"


@query(f"""WITH RECURSIVE {_EX}, pr AS (SELECT src AS a, tgt AS b FROM ex), {_fuzzy('pr')}
SELECT conv_id, turn, round_even(ratio, 6) AS ratio, round_even(CASE WHEN length(src) + length(tgt) > 0 THEN 2.0::DOUBLE * least(length(src), length(tgt)) / (length(src) + length(tgt)) ELSE 1.0 END, 6) AS bound,
  round_even(0.65::DOUBLE * ratio + 0.35::DOUBLE * {_jaccard(_lex('src'), _lex('tgt'))}, 6) AS blended FROM ex JOIN fuzzy ON fuzzy.a = src AND fuzzy.b = tgt""")
def fuzzy_similarity(spark, sf_dir):
    e = X.exchanges(spark, sf_dir)
    a, b = F.col("src"), F.col("tgt")
    ta, tb = F.array_distinct(S.lexical_tokens(a)), F.array_distinct(S.lexical_tokens(b))
    values = {"ratio": similarity.fuzzy_ratio(a, b), "bound": similarity.ratio_bound(a, b), "blended": similarity.blended(a, b, ta, tb)}
    return e.select("conv_id", "turn", *[F.bround(v, 6).alias(k) for k, v in values.items()])


# Expansion with the similarity gate, at each profile's own cut-offs: confidence, source words, target words, similarity.
_CUTS = {"v4": (None, None, None, "0.85"), "v41": (12, 5, 0, "0.80"), "v42": (15, 6, 5, "0.80")}


def _whole_expand_sql(name: str) -> str:
    cut, least_src, least_tgt, alike = _CUTS[name]
    body = _expand_sql(name).replace("WITH ", "WITH RECURSIVE ", 1)
    head, _, last = body.rpartition("SELECT DISTINCT")
    last = "SELECT DISTINCT" + last.replace("confidence >= 6 AND src_len >= 1 AND tgt_len >= 1", f"confidence >= {cut} AND src_len >= {least_src} AND tgt_len >= {least_tgt}")
    return f"{head.rstrip()}{'' if head.rstrip().endswith(',') else ','} gated AS ({last}), pr AS (SELECT src AS a, tgt AS b FROM gated), {_fuzzy('pr')}\nSELECT gated.* FROM gated JOIN fuzzy ON a = src AND b = tgt WHERE NOT fuzzy.ratio > {alike}::DOUBLE"


for _p in (V4, V41, V42):
    query(_whole_expand_sql(_p.name))(_expand_query(f"expansion_{_p.name}", _p, True))


# Sentences of archive texts: spans by the sentences' own lengths, known pairs and the last profile's scores.


def _hyphened(c):
    """Words joined by hyphens, as transliterations have them."""
    return F.replace(F.replace(F.lower(c), F.lit("e "), F.lit("e-")), F.lit("n "), F.lit("n-"))


_ARCHIVED = "SELECT conv_id AS ref_id, turn, replace(replace(lower(src), 'e ', 'e-'), 'n ', 'n-') AS src, tgt FROM ex"
_V51_CHUNKS = f"""ax AS ({_ARCHIVED}),
sp5 AS (SELECT ref_id, turn, {_words('src')} AS words, {_sents('tgt')} AS sents FROM ax WHERE src <> '' AND tgt <> ''),
se5 AS (SELECT ref_id, turn, words, len(words) AS total, len(sents) AS ns, i - 1 AS k, sents[i] AS sentence, list_sum([length(x) FOR x IN sents]) AS chars FROM (SELECT *, unnest(range(1, len(sents) + 1)) AS i FROM sp5)),
ln5 AS (SELECT *, greatest(1, CAST(round_even(total * (length(sentence) / CAST(greatest(1, chars) AS DOUBLE)), 0) AS BIGINT)) AS take FROM se5),
cu5 AS (SELECT *, sum(take) OVER (PARTITION BY ref_id, turn ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto FROM ln5),
ch5 AS (SELECT ref_id, turn, k, {_clean("array_to_string(words[CAST(least(upto - take, total) AS BIGINT) + 1:CASE WHEN k = ns - 1 THEN total ELSE CAST(least(upto, total) AS BIGINT) END], ' ')")} AS src, {_clean('sentence')} AS tgt FROM cu5)"""


def _archive_sql() -> str:
    from paragram.catalog import _confidence_sql, _letter, _ratio

    char = "length(tgt) / CAST(length(src) AS DOUBLE)"
    return f"""WITH RECURSIVE {_PAIRS}, {_V51_CHUNKS}, known AS (SELECT DISTINCT src, tgt FROM base),
bl AS (SELECT DISTINCT conv_id, turn, pos, src, tgt FROM base), m5 AS (SELECT {_n('src')} AS s, {_n('tgt')} AS t, {_ratio('src', 'tgt')} AS r FROM bl),
{_stats_sql(0.15, 0.85).partition(', st AS')[0]}, st AS {_stats_sql(0.15, 0.85).partition(', st AS')[2]},
c5 AS (SELECT c.* FROM ch5 c ANTI JOIN known b ON b.src = c.src AND b.tgt = c.tgt WHERE {_letter('c.src')} AND {_letter('c.tgt')} AND length(c.tgt) >= 3 AND length(c.src) > 0),
q5 AS (SELECT * FROM c5 WHERE {char} >= 0.25 AND {char} <= 3.2),
s5 AS (SELECT ref_id, turn, k, src, tgt, ratio_med, CAST({_confidence_sql('v51')} AS BIGINT) AS confidence, CAST({_n('src')} AS BIGINT) AS src_len, CAST({_n('tgt')} AS BIGINT) AS tgt_len, round_even({_ratio('src', 'tgt')}, 3) AS ratio FROM q5, st),
g5 AS (SELECT * FROM s5 WHERE confidence >= 16 AND src_len >= 5 AND tgt_len >= 4), pr AS (SELECT src AS a, tgt AS b FROM g5), {_fuzzy('pr')},
o5 AS (SELECT g5.*, row_number() OVER (PARTITION BY src, tgt ORDER BY confidence DESC, abs(g5.ratio - ratio_med), src_len, ref_id, turn, k) AS rn FROM g5 JOIN fuzzy ON a = src AND b = tgt WHERE NOT fuzzy.ratio > 0.80::DOUBLE)
SELECT 'archive_alias' AS source, CAST(ref_id AS VARCHAR) AS match_key, ref_id, src, tgt, confidence, src_len, tgt_len, ratio FROM o5 WHERE rn = 1"""


@query(_archive_sql())
def archive_sentences(spark, sf_dir):
    e = X.exchanges(spark, sf_dir).withColumnRenamed("conv_id", "ref_id")
    e = e.select("ref_id", "turn", _hyphened(F.col("src")).alias("src"), "tgt", F.lit("archive_alias").alias("source"), F.col("ref_id").cast("string").alias("match_key"))
    out = expansion.expand(e, ["ref_id", "turn"], V51, baseline=_base(spark, sf_dir).select("src", "tgt"))
    return out.select(*[F.col(c).cast("long").alias(c) if c in ("confidence", "src_len", "tgt_len") else F.col(c) for c in out.columns])


# The greedy proximity: each source line in order takes the nearest target within three lines that none before it took.


@query(f"""WITH RECURSIVE {_DOCLINES},
s AS (SELECT doc_id, list(struct_pack(i := line_no, x := line) ORDER BY line_no) AS ss FROM dl WHERE regexp_matches(line, '{MARKED}') GROUP BY 1),
t AS (SELECT doc_id, list(struct_pack(i := line_no, x := line) ORDER BY line_no) AS ts FROM dl WHERE {_EL31} GROUP BY 1),
go AS (
  SELECT s.doc_id, ss, ts, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS b FROM s JOIN t USING (doc_id)
  UNION ALL
  SELECT doc_id, ss, ts, n + 1, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit) END, hit FROM (
    SELECT doc_id, ss, ts, n, used, list_sort([struct_pack(d := abs(x.i - ss[n + 1].i), i := x.i) FOR x IN ts IF abs(x.i - ss[n + 1].i) BETWEEN 1 AND 3 AND NOT list_contains(used, x.i)])[1].i AS hit FROM go WHERE n < len(ss)))
SELECT doc_id AS page_id, ss[n].i AS a, b, ss[n].x AS src, [x.x FOR x IN ts IF x.i = b][1] AS tgt FROM go WHERE b IS NOT NULL""")
def proximity_greedy(spark, sf_dir):
    out = pages.mined_greedy(X.pages(spark, sf_dir), surface=lambda c: c.rlike(MARKED), english=L.english_like_alpha)
    return out.withColumn("a", F.col("a").cast("long")).withColumn("b", F.col("b").cast("long"))


# Final reranking.

_COARSE = """ct AS (SELECT {key}, t.token, coalesce(idf, 1.0) AS w FROM (SELECT DISTINCT {key}, unnest(tokens) AS token FROM cand) t LEFT JOIN idf i ON i.token = t.token),
cw AS (SELECT {key}, sum(w) AS cw FROM ct GROUP BY ALL),
rt AS (SELECT ref_id, t.token, idf AS w FROM (SELECT ref_id, unnest(token_set) AS token FROM win) t JOIN idf i ON i.token = t.token),
rw AS (SELECT ref_id, sum(w) AS rw FROM rt GROUP BY ALL),
ov AS (SELECT p.*, shared, overlap FROM pool p JOIN (SELECT {pkey}, p.ref_id, count(*) AS shared, sum(ct.w) AS overlap FROM pool p JOIN ct USING ({key}) JOIN rt ON rt.ref_id = p.ref_id AND rt.token = ct.token GROUP BY ALL) o USING ({key}, ref_id)),
co AS (SELECT ov.*, c.alias_match, overlap / (cw + rw - overlap) + CASE WHEN c.tokens[1:2] = w.tokens[1:2] THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN c.alias_match THEN 0.04::DOUBLE ELSE 0 END AS coarse
  FROM ov JOIN cw USING ({key}) JOIN rw USING (ref_id) JOIN cand c USING ({key}) JOIN win w USING (ref_id)),
short AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round_even(coarse, 9) DESC, pool_rank) AS coarse_rank FROM co) WHERE coarse_rank <= 6)"""


def _canonical(x: str) -> str:
    return f"replace({_sub(_signs(x), f'[^a-z0-9{T.DIACRITICS}<> -]+', ' ')}, '-', '')"


#: Windows with their text, beside _WIN.
_WINDOW_TEXT = f"wtext AS (SELECT item_id * 4000000 + k * 1000000 + start AS ref_id, array_to_string(u[start + 1:start + k], ' ') AS window_text FROM wn)"
_FINAL = """fin AS (SELECT s.*, w.ref, x.window_text, 0.65::DOUBLE * coarse + 0.35::DOUBLE * fuzzy.ratio + CASE WHEN alias_match THEN 0.05::DOUBLE ELSE 0 END AS final
  FROM short s JOIN win w USING (ref_id) JOIN wtext x USING (ref_id) JOIN canon c USING ({key}) JOIN rcanon r USING (ref_id) JOIN fuzzy ON fuzzy.a = c.canonical AND fuzzy.b = r.canonical),
best AS (SELECT *, (final >= 0.40 AND shared >= 3) OR (final >= 0.47 AND shared >= 2) OR (alias_match AND final >= 0.34 AND shared >= 2) AS matched FROM (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round_even(final, 9) DESC, coarse_rank) AS rn FROM fin) WHERE rn = 1)"""
_KEY = {"key": "conv_id, turn", "pkey": "p.conv_id, p.turn"}


@query(f"""WITH RECURSIVE {_WIN}, {_WINDOW_TEXT}, {_POST.format(180)}, {_CAND.replace("AS tokens FROM conversations WHERE role = 'user')", "AS tokens, false AS alias_match FROM conversations WHERE role = 'user')")}, {_COARSE.format(**_KEY)},
canon AS (SELECT conv_id, turn, {_canonical('text')} AS canonical FROM conversations WHERE role = 'user'), rcanon AS (SELECT ref_id, {_canonical('window_text')} AS canonical FROM wtext),
pr AS (SELECT c.canonical AS a, r.canonical AS b FROM short JOIN canon c USING (conv_id, turn) JOIN rcanon r USING (ref_id)), {_fuzzy('pr')}, {_FINAL.format(**_KEY)}
SELECT conv_id, turn, ref_id, ref, window_text, CAST(shared AS BIGINT) AS shared, round_even(overlap, 6) AS overlap, round_even(final, 6) AS final, alias_match, matched FROM best""")
def rerank_final(spark, sf_dir):
    w, key, c = _windows(spark, sf_dir), ["conv_id", "turn"], _candidates(spark, sf_dir)
    weights = staged(retrieval.idf_table(w), "weights")
    short = retrieval.rerank_coarse(c, key, "tokens", retrieval.retrieve(c, key, "tokens", w, weights), w, weights)
    texts = by_row.made(X.table(spark, sf_dir, "conversations"), key, ["text"], "canonical string", lambda x: [(plain.canonical(x),)] if x is not None else [(None,)])
    out = retrieval.rerank_final(short, key, texts, w)
    return out.withColumn("shared", F.col("shared").cast("long")).withColumn("overlap", F.bround("overlap", 6)).withColumn("final", F.bround("final", 6))


# Surface detection.  Of each profile: percentiles, clamped or not, greatest length, share of hyphened tokens, coverage for
# two points and for one more, starters, frequent tokens, tokens that may be frequent, variants, penalty for English.
_SURFACE = {
    "v3": ("0.05", "0.95", True, None, None, ("0.5",), 50, 500, 0, False, False),
    "v31": ("0.03", "0.97", False, 40, None, ("0.40",), 75, 750, 3, False, False),
    "v32": ("0.02", "0.98", False, 45, "0.20", ("0.35", "0.55"), 100, 1000, 4, True, True),
}


def _variants(x: str) -> str:
    return f"list_distinct([v FOR v IN list_concat([{x}, replace({x}, '-', '')], string_split({x}, '-')) IF v <> ''])"


def _structure_sql(name: str, corpus: str) -> str:
    """CTEs starters, frequent and lengths, learned from corpus (ord, text)."""
    low, high, clamp, _, _, _, starters, frequent, *_ = _SURFACE[name]
    at = f"1 + CAST(floor(c * {low}::DOUBLE) AS BIGINT)", f"1 + {'least(c - 1, ' if clamp else ''}CAST(floor(c * {high}::DOUBLE) AS BIGINT){')' if clamp else ''}"
    return f"""stok AS MATERIALIZED (SELECT ord, unit, t FROM (SELECT ord, i AS unit, {_lex('u[i]')} AS t FROM (SELECT ord, u, unnest(range(1, len(u) + 1)) AS i FROM (SELECT ord, {_units('text')} AS u FROM ({corpus})))) WHERE len(t) > 0),
starters AS (SELECT t[1] AS token FROM stok GROUP BY 1 ORDER BY count(*) DESC, min((ord, unit)) LIMIT {starters}),
frequent AS (SELECT token FROM (SELECT ord, unit, unnest(t) AS token, generate_subscripts(t, 1) AS p FROM stok) GROUP BY 1 ORDER BY count(*) DESC, min((ord, unit, p)) LIMIT {frequent}),
lengths AS (SELECT max(n) FILTER (rn = {at[0]}) AS detect_min, max(n) FILTER (rn = {at[1]}) AS detect_max FROM (SELECT len(t) AS n, row_number() OVER (ORDER BY len(t)) AS rn, count(*) OVER () AS c FROM stok))"""


def _surface_sql(name: str, rows: str, key: str, line: str, known: str) -> str:
    """CTE surf (key, n_tokens, coverage, score) of the lines in rows; known: a table of forms."""
    _, _, _, longest, share, coverage, _, _, ahead, variants, penalty = _SURFACE[name]
    az = f"regexp_extract_all(lower({line}), '[a-z]+')"
    english = f"CASE WHEN len({az}) > 0 THEN {_hits(az, L.ENGLISH_33)} / CAST(len({az}) AS DOUBLE) + 0.05::DOUBLE * {_hits(az, L.NEARBY_BONUS)} ELSE 0 END"
    hyphens = "len([h FOR h IN t IF contains(h, '-')])"
    points = [(f"{hyphens} / CAST(len(t) AS DOUBLE) >= {share}" if share else f"{hyphens} > 0", 2), (f"coverage >= {coverage[0]}", 2), *[(f"coverage >= {c}", 1) for c in coverage[1:]]]
    points += [(f"len(t) BETWEEN detect_min AND {f'least(detect_max, {longest})' if longest else 'detect_max'}", 1), ("t[1] IN (SELECT token FROM starters)", 1)]
    points += [(f"f.{key.split(', ')[0]} IS NOT NULL", 1)] if ahead else []
    points += [(f"{english} > 0.20", -2)] if penalty else []
    forms = f"unnest({_variants('token')})" if variants else "token"
    on = " AND ".join(f"f.{k} = x.{k}" for k in key.split(", "))
    return f"""sl AS MATERIALIZED (SELECT {key}, {line}, t FROM (SELECT {key}, {line}, {_lex(line)} AS t FROM {rows}) WHERE len(t) > 0),
sw AS MATERIALIZED (SELECT {key}, unnest(t) AS token, generate_subscripts(t, 1) AS p FROM sl),
sh AS (SELECT {key}, p, max(CASE WHEN k.form IS NULL THEN 0 ELSE 1 END) AS hit FROM (SELECT {key}, p, {forms} AS form FROM sw) v LEFT JOIN (SELECT DISTINCT form FROM {known}) k ON k.form = v.form GROUP BY ALL),
sc0 AS (SELECT {key}, count(*) AS n_tokens, sum(hit) / CAST(count(*) AS DOUBLE) AS coverage FROM sh GROUP BY ALL),
sfreq AS (SELECT DISTINCT {key} FROM sw WHERE p <= {ahead} AND token IN (SELECT token FROM frequent)),
surf AS MATERIALIZED (SELECT {', '.join('x.' + k for k in key.split(', '))}, n_tokens, coverage, {' + '.join(f'CASE WHEN {c} THEN {n} ELSE 0 END' for c, n in points)} AS score
  FROM sl x JOIN sc0 USING ({key}) LEFT JOIN sfreq f ON {on}, lengths)"""


def _forms_sql(variants: bool) -> str:
    value = _marks("text")
    more = f" UNION SELECT unnest(v) FROM (SELECT {_variants('t')} AS v FROM (SELECT unnest({_lex(value)}) AS t FROM benchmark))" if variants else ""
    return f"bforms AS (SELECT DISTINCT form FROM (SELECT {value} AS form FROM benchmark UNION SELECT unnest({_lex(value)}) FROM benchmark{more}) WHERE form <> '')"


def _surface_query(name: str):
    def run(spark, sf_dir):
        forms = retrieval.lexicon(X.table(spark, sf_dir, "benchmark"), "text", True)
        p = SURFACES[name]
        corpus = _docs(spark, sf_dir).withColumnRenamed("doc_id", "ord")
        s = stats.learned_structure(corpus, "text", ["ord"], *p.percentiles, p.starters, p.frequent, p.clamp)
        out = retrieval.surface_scores(_lines(spark, sf_dir), ["doc_id", "line_no"], "line", s, forms, p)
        return out.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "n_tokens", F.bround("coverage", 6).alias("coverage"), F.col("score").cast("long").alias("score"), "detected")

    run.__name__ = f"surface_scores_{name}"
    return run


for _name in SURFACES:
    query(f"""WITH {_DOCLINES}, {_structure_sql(_name, 'SELECT doc_id AS ord, text FROM documents')}, {_forms_sql(True)}, {_surface_sql(_name, 'dl', 'doc_id, line_no', 'line', 'bforms')}
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, n_tokens, round_even(coverage, 6) AS coverage, CAST(score AS BIGINT) AS score, score >= 4 AS detected FROM surf""")(_surface_query(_name))


# Page mining.


def _mined_query(name: str):
    def run(spark, sf_dir):
        refs, docs = X.references(spark, sf_dir), X.table(spark, sf_dir, "documents")
        corpus = docs.where("lang <> 'en'").select(F.col("doc_id").alias("ord"), F.col("text"))
        forms = retrieval.lexicon(X.table(spark, sf_dir, "benchmark"), "text", name == "v32")
        found = pages.mined(X.pages(spark, sf_dir), refs, corpus, forms, SURFACES[name], surface=lambda c: c.rlike("[a-z]"), least=2, accept=5)
        whole = [F.col(c).cast("long").alias(c) if c in ("line_no", "score", "distance", "shared") else F.bround(c, 6).alias(c) if c in ("reference_score", "overlap", "translation_score") else F.col(c) for c in found.columns]
        return pages.ordered(found.select(*whole))

    run.__name__ = f"mined_pages_{name}"
    return run


def _page_lines(clean) -> str:
    return f"""pl AS MATERIALIZED (SELECT page_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no FROM (SELECT doc_id AS page_id, [x FOR x IN [{clean('y')} FOR y IN string_split(text, chr(10))] IF x <> ''] AS l FROM documents))"""


def _candidates_sql(name: str) -> str:
    """CTEs up to cd (page_id, line_no, cand, coverage, n_tokens, alias_match): rejoined source lines that score 2 or more."""
    clean = _digits if name == "v32" else _marks
    names = f"names AS (SELECT item_id AS ref, {clean(_strip('text_alias'))} AS alias FROM (SELECT item_id, unnest(string_split(array_to_string(string_split(text, ' ')[1:2], ' '), '|')) AS text_alias FROM benchmark) WHERE {_strip('text_alias')} <> '' AND {clean(_strip('text_alias'))} <> '')"
    return f"""{_page_lines(clean)}, {_structure_sql(name, "SELECT doc_id AS ord, text FROM documents WHERE lang <> 'en'")}, {_forms_sql(name == 'v32')},
kf AS (SELECT form FROM bforms UNION SELECT token FROM frequent), {names},
ptext AS MATERIALIZED (SELECT doc_id AS page_id, {clean('text')} AS x FROM documents),
onp AS MATERIALIZED (SELECT DISTINCT page_id, alias, ref FROM ptext JOIN names ON contains(x, alias)),
al AS (SELECT DISTINCT page_id FROM onp),
jt AS (SELECT page_id, line_no, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM (SELECT page_id, line_no, [q FOR q IN string_split({_signs('line')}, ' ') IF q <> ''] AS w FROM pl WHERE regexp_matches(line, '[a-z]'))),
jl AS (SELECT *, lead(token) OVER (PARTITION BY page_id, line_no ORDER BY i) AS nxt FROM jt),
jk AS (SELECT jl.*, kf.form IS NOT NULL AS link FROM jl LEFT JOIN kf ON kf.form = token || '-' || nxt),
ji AS (SELECT *, sum(CASE WHEN link THEN 0 ELSE 1 END) OVER (PARTITION BY page_id, line_no ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM jk),
jm AS (SELECT *, link AND row_number() OVER (PARTITION BY page_id, line_no, island, link ORDER BY i) % 2 = 1 AS merge FROM ji),
je AS (SELECT *, coalesce(lag(merge) OVER (PARTITION BY page_id, line_no ORDER BY i), false) AS eaten FROM jm),
jo AS MATERIALIZED (SELECT page_id, line_no, string_agg(CASE WHEN merge THEN token || '-' || nxt ELSE token END, ' ' ORDER BY i) AS cand FROM je WHERE NOT eaten GROUP BY 1, 2 HAVING cand <> ''),
{_surface_sql(name, 'jo', 'page_id, line_no', 'cand', 'kf')},
cd AS MATERIALIZED (SELECT jo.*, coverage, n_tokens, al.page_id IS NOT NULL AS alias_match FROM jo JOIN surf USING (page_id, line_no) LEFT JOIN al ON al.page_id = jo.page_id WHERE surf.score >= 2)"""


#: Of each profile: the English-like lines, the lines a translation may lie away, points for its distance, points besides.
_LIKE = {
    "v3": f"{_n('line')} BETWEEN 3 AND 45 AND ({_QUOTE} OR {_alpha('line')} >= 0.55 OR regexp_matches(line, '[.!?:;]$')) AND {_EL3}",
    "v31": f"{_n('line')} BETWEEN 3 AND 55 AND ({_QUOTE} OR {_alpha('line')} >= 0.60 OR {_EL31}) AND {_EL31}",
    "v32": f"{_n('line')} BETWEEN 3 AND 60 AND ({_QUOTE} OR {_alpha('line')} >= 0.68 OR {_EL32}) AND {_EL32}",
}
_POINTS = {
    "v3": (4, f"CASE WHEN distance <= 3 THEN 2 ELSE 0 END + CASE WHEN n_tokens BETWEEN 3 AND 40 AND {_n('b_line')} BETWEEN 3 AND 50 THEN 1 ELSE 0 END"),
    "v31": (4, f"CASE WHEN distance <= 4 THEN 2 ELSE 0 END + CASE WHEN n_tokens BETWEEN 3 AND 45 AND {_n('b_line')} BETWEEN 3 AND 55 THEN 1 ELSE 0 END"),
    "v32": (6, "CASE WHEN distance <= 4 THEN 2 ELSE 1 END + CASE WHEN shared >= 3 THEN 1 ELSE 0 END + CASE WHEN coverage >= 0.5 THEN 1 ELSE 0 END"),
}


def _result_sql(name: str) -> str:
    """From cd and ok (page_id, line_no, reference_score, reference, shared, overlap) to the result."""
    most, points = _POINTS[name]
    near = "-CAST(distance AS DOUBLE)"
    if name == "v32":
        az = "regexp_extract_all(lower(b_line), '[a-z]+')"
        near = f"CASE WHEN len({az}) > 0 THEN {_hits(az, L.ENGLISH_33)} / CAST(len({az}) AS DOUBLE) + 0.05::DOUBLE * {_hits(az, L.NEARBY_BONUS)} ELSE 0.0::DOUBLE END + 0.04::DOUBLE * greatest(0, 6 - distance)"
    return f"""ot AS (SELECT page_id, line_no AS b_no, line AS b_line FROM pl WHERE {_LIKE[name]}),
mt AS (SELECT *, {near} AS translation_score FROM (SELECT cd.*, ok.* EXCLUDE (page_id, line_no), b_no, b_line, abs(cd.line_no - b_no) AS distance FROM cd JOIN ok USING (page_id, line_no) JOIN ot ON ot.page_id = cd.page_id AND abs(cd.line_no - b_no) BETWEEN 1 AND {most})),
nr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, line_no ORDER BY translation_score DESC, b_no) AS rn FROM mt) WHERE rn = 1),
tt AS (SELECT *, CASE WHEN alias_match THEN 5 ELSE 0 END + 3 + 2 + {points} AS score, {_strip('lower(cand)')} AS src, {_strip('lower(b_line)')} AS tgt FROM nr),
ff AS (SELECT *, row_number() OVER (PARTITION BY src, tgt ORDER BY page_id, line_no) AS fn FROM tt WHERE score >= 5 AND length(src) BETWEEN 5 AND 500 AND length(tgt) BETWEEN 5 AND 500)
SELECT src, tgt, page_id, CAST(line_no AS BIGINT) AS line_no, CAST(score AS BIGINT) AS score, CAST(distance AS BIGINT) AS distance, round_even(reference_score, 6) AS reference_score, CAST(shared AS BIGINT) AS shared, round_even(overlap, 6) AS overlap, reference,
  alias_match, round_even(translation_score, 6) AS translation_score FROM ff WHERE fn = 1"""


def _lex_marks(x: str) -> str:
    """Tokens of a text that is only cleaned, not normalised."""
    edge = r"regexp_replace(w, '^[^\p{L}\p{N}_<]+|[^\p{L}\p{N}_>]+$', '', 'g')"
    return f"[t FOR t IN [{edge} FOR w IN string_split({_marks(x)}, ' ')] IF t <> '']"


# Whole references: those with the same first token and the first 2,000, 300 by closeness of token counts.
# The score is at most .65 of the bound by lengths and .35 of the token sets' similarity; pairs that can't reach .72 are spared.
_REFERENCE_V3 = f"""rr AS (SELECT item_id AS ord, r, {_lex('r')} AS rt FROM (SELECT item_id, {_marks('text')} AS r FROM benchmark) WHERE r <> ''),
cc AS (SELECT page_id, line_no, cand, {_lex('cand')} AS ct FROM cd WHERE len({_lex('cand')}) > 0),
pp AS (SELECT page_id, line_no, cand, ct, r, rt, src, ord, abs(len(ct) - len(rt)) AS off FROM (SELECT cc.*, rr.*, 0 AS src FROM cc JOIN rr ON rr.rt[1] = cc.ct[1] UNION ALL SELECT cc.*, rr.*, 1 AS src FROM cc JOIN rr ON rr.ord < 2000)),
po AS (SELECT *, {_jaccard('ct', 'rt')} AS jac FROM (SELECT *, row_number() OVER (PARTITION BY page_id, line_no ORDER BY off, src, ord) AS place FROM pp) WHERE place <= 300),
pq AS MATERIALIZED (SELECT * FROM po WHERE 0.65::DOUBLE * 2 * least(length(cand), length(r)) / (length(cand) + length(r)) + 0.35::DOUBLE * jac >= 0.72 - 1e-9),
pr AS (SELECT cand AS a, r AS b FROM pq), {_fuzzy('pr')},
sr AS (SELECT pq.*, 0.65::DOUBLE * ratio + 0.35::DOUBLE * jac AS score FROM pq JOIN fuzzy ON a = cand AND b = r),
ok AS (SELECT page_id, line_no, score AS reference_score, r AS reference, 0 AS shared, 0.0::DOUBLE AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY page_id, line_no ORDER BY round_even(score, 9) DESC, place) AS rn FROM sr) WHERE rn = 1 AND score >= 0.72)"""

# Single lines: those of aliases on the page, then those with the same first token, then the first 3,000; of repeated texts the
# first; token counts at most 18 apart; 500 of them.
_REFERENCE_V31 = f"""bl AS (SELECT item_id AS ref, item_id * 1000000 + p AS n, line, {_lex_marks('line')} AS rt FROM (SELECT item_id, unnest(u) AS line, generate_subscripts(u, 1) - 1 AS p FROM (SELECT item_id, [x FOR x IN [{_marks('v')} FOR v IN string_split_regex(text, '[\\n.]')] IF x <> ''] AS u FROM benchmark))),
tx AS (SELECT line, min(n) AS id, any_value(rt) AS rt FROM bl GROUP BY 1),
na AS (SELECT alias, min((names.ref, 0)) AS place FROM names JOIN bl ON bl.ref = names.ref GROUP BY 1),
li AS (SELECT alias, tx.id, min(bl.n) AS ord FROM names JOIN bl USING (ref) JOIN tx USING (line) GROUP BY ALL),
hi AS (SELECT page_id, id, min((place, ord)) AS spot FROM (SELECT DISTINCT page_id, alias FROM onp) JOIN li USING (alias) JOIN na USING (alias) GROUP BY ALL),
cc AS (SELECT page_id, line_no, cand, {_lex_marks('cand')} AS ct FROM cd WHERE len({_lex_marks('cand')}) > 0),
fi AS (SELECT DISTINCT tx.id FROM (SELECT line FROM bl WHERE len(rt) > 0 ORDER BY n LIMIT 3000) f JOIN tx USING (line)),
pp AS (SELECT page_id, line_no, cand, ct, id, 0 AS src, spot FROM cc JOIN hi USING (page_id) UNION ALL
  SELECT page_id, line_no, cand, ct, id, 1, ((NULL, NULL), id) FROM cc JOIN tx ON len(rt) > 0 AND rt[1] = ct[1] UNION ALL SELECT page_id, line_no, cand, ct, id, 2, ((NULL, NULL), id) FROM cc, fi),
pu AS (SELECT page_id, line_no, id, any_value(cand) AS cand, any_value(ct) AS ct, min((src, spot)) AS spot FROM pp GROUP BY ALL),
po AS (SELECT * FROM (SELECT pu.*, line AS r, rt, {_jaccard('ct', 'rt')} AS jac, row_number() OVER (PARTITION BY page_id, line_no ORDER BY spot) AS place FROM pu JOIN tx USING (id) WHERE abs(len(ct) - len(rt)) <= 18) WHERE place <= 500),
pq AS MATERIALIZED (SELECT * FROM po WHERE 0.55::DOUBLE * 2 * least(length(cand), length(r)) / (length(cand) + length(r)) + 0.45::DOUBLE * jac >= 0.46 - 1e-9),
pr AS (SELECT cand AS a, r AS b FROM pq), {_fuzzy('pr')},
sr AS (SELECT pq.*, 0.55::DOUBLE * ratio + 0.45::DOUBLE * jac AS score FROM pq JOIN fuzzy ON a = cand AND b = r),
ok AS (SELECT page_id, line_no, score AS reference_score, r AS reference, 0 AS shared, 0.0::DOUBLE AS overlap FROM (SELECT sr.*, alias_match, row_number() OVER (PARTITION BY page_id, line_no ORDER BY round_even(score, 9) DESC, place) AS rn FROM sr JOIN cd USING (page_id, line_no)) WHERE rn = 1 AND (score >= 0.58 OR (alias_match AND score >= 0.46)))"""

_PAGE_KEY = {"key": "page_id, line_no", "pkey": "p.page_id, p.line_no"}
# Windows: every one that shares a token with the line is compared; nothing is cut.  The score is at most .65 of the coarse one, .35 of the
# bound by lengths and .05 with an alias; pairs that can't reach the least accepted score are spared.
_REFERENCE_V32 = f"""{_WIN}, {_WINDOW_TEXT}, post AS (SELECT unnest(token_set) AS token, ref_id FROM win),
cand AS MATERIALIZED (SELECT page_id, line_no, alias_match, {_lex('cand')} AS tokens FROM cd),
qt AS (SELECT c.*, i.idf FROM (SELECT DISTINCT page_id, line_no, unnest({_variants('t')}) AS token FROM (SELECT page_id, line_no, unnest(tokens) AS t FROM cand)) c JOIN idf i ON i.token = c.token),
sc AS (SELECT page_id, line_no, ref_id, sum(w) AS score FROM (SELECT page_id, line_no, ref_id, idf AS w FROM qt JOIN post USING (token) UNION ALL
  SELECT page_id, line_no, ref_id, 5.0 FROM cand JOIN (SELECT DISTINCT page_id, ref FROM onp) USING (page_id) JOIN (SELECT ref, ref_id FROM win) USING (ref)) GROUP BY ALL),
pool AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_id, line_no ORDER BY round_even(score, 9) DESC, ref_id) AS pool_rank FROM sc),
{_COARSE.format(**_PAGE_KEY).replace(" WHERE coarse_rank <= 6", "").replace("short AS (", "short AS MATERIALIZED (")},
canon AS MATERIALIZED (SELECT page_id, line_no, {_canonical('cand')} AS canonical FROM cd), rcanon AS MATERIALIZED (SELECT ref_id, {_canonical('window_text')} AS canonical FROM wtext),
pr AS (SELECT c.canonical AS a, r.canonical AS b FROM short JOIN canon c USING (page_id, line_no) JOIN rcanon r USING (ref_id) WHERE 0.65::DOUBLE * coarse + CASE WHEN alias_match THEN 0.05::DOUBLE ELSE 0 END
  + CASE WHEN length(c.canonical) + length(r.canonical) = 0 THEN 0.35::DOUBLE ELSE 0.35::DOUBLE * 2 * least(length(c.canonical), length(r.canonical)) / (length(c.canonical) + length(r.canonical)) END >= CASE WHEN alias_match THEN 0.34::DOUBLE ELSE 0.40::DOUBLE END - 1e-9),
{_fuzzy('pr')}, {_FINAL.format(**_PAGE_KEY)},
ok AS (SELECT page_id, line_no, final AS reference_score, window_text AS reference, shared, overlap FROM best WHERE matched)"""

for _name, _reference in (("v3", _REFERENCE_V3), ("v31", _REFERENCE_V31), ("v32", _REFERENCE_V32)):
    query(f"WITH RECURSIVE {_candidates_sql(_name)}, {_reference}, {_result_sql(_name)}")(_mined_query(_name))


_AZB = "regexp_extract_all(lower(b_line), '[a-zà-ÿ]+')"
_LANGUAGE_HITS = ", ".join(_hits(_AZB, words) for words in (L.ENGLISH_24, L.GERMAN, L.FRENCH, L.SPANISH))
_PLAIN2 = f"""[p FOR p IN {_words('line')} IF regexp_full_match(p, '[a-zA-Z.,!?''"-]+')]"""


@query(f"""WITH {_page_lines(_clean)},
ab AS (SELECT DISTINCT lower(array_to_string(string_split(text, ' ')[1:2], ' ')) AS alias FROM benchmark),
al AS (SELECT DISTINCT doc_id AS page_id FROM documents JOIN ab ON contains(lower(text), alias)),
cd AS (SELECT * FROM pl WHERE regexp_matches(line, '[a-z]') AND {_n('line')} <= 20),
inside AS (SELECT line FROM (SELECT DISTINCT line FROM cd) WHERE EXISTS (SELECT 1 FROM benchmark b WHERE contains(b.text, line) OR contains(replace(b.text, '-', ''), replace(line, '-', '')))),
ot AS (SELECT page_id, line_no AS b_no, line AS b_line FROM pl WHERE {_n('line')} BETWEEN 3 AND 50 AND (len({_PLAIN2}) / (len({_words('line')}) + 1e-9::DOUBLE) > 0.6 OR regexp_matches(line, '["'']'))),
nr AS (SELECT * FROM (SELECT cd.*, b_no, b_line, abs(cd.line_no - b_no) AS distance, row_number() OVER (PARTITION BY cd.page_id, cd.line_no ORDER BY abs(cd.line_no - b_no), b_no) AS rn FROM cd JOIN ot ON ot.page_id = cd.page_id AND abs(cd.line_no - b_no) BETWEEN 1 AND 3) WHERE rn = 1),
sc AS (SELECT nr.*, CASE WHEN al.page_id IS NULL THEN 0 ELSE 5 END + CASE WHEN i.line IS NULL THEN 0 ELSE 3 END + 2
  + CASE WHEN len({_AZB}) >= 3 AND {_hits(_AZB, L.ENGLISH_24)} > 0 AND {_hits(_AZB, L.ENGLISH_24)} = greatest({_LANGUAGE_HITS}) THEN 2 ELSE 0 END
  + CASE WHEN length(nr.line) BETWEEN 5 AND 500 AND length(b_line) BETWEEN 5 AND 500 THEN 1 ELSE 0 END AS score FROM nr LEFT JOIN al USING (page_id) LEFT JOIN inside i ON i.line = nr.line)
SELECT line AS src, b_line AS tgt, CAST(score AS BIGINT) AS score, CAST(distance AS BIGINT) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY line, b_line ORDER BY page_id, line_no) AS fn FROM sc WHERE score >= 7) WHERE fn = 1""")
def mined_pages_v2(spark, sf_dir):
    refs = X.references(spark, sf_dir).select("ref_text")
    names = X.table(spark, sf_dir, "benchmark").select(F.substring_index("text", " ", 2).alias("alias"))
    out = pages.mined_substring(X.pages(spark, sf_dir), refs, names, surface=lambda c: c.rlike("[a-z]"))
    return out.withColumn("score", F.col("score").cast("long")).withColumn("distance", F.col("distance").cast("long"))


# Training examples.


def _side_sql(side: str) -> str:
    """The vocabulary of one side's training texts, and its ids: at most 80 with the marks."""
    marks = "[3]" if side == "src" else "[3]"
    start = "[]" if side == "src" else "[2]"
    return f"""tk_{side} AS (SELECT conv_id, turn, pos, unnest(w) AS token, generate_subscripts(w, 1) AS p FROM (SELECT conv_id, turn, pos, {_words(side)} AS w FROM spl WHERE part = 'train')),
voc_{side} AS (SELECT token, 3 + row_number() OVER (ORDER BY n DESC, o) AS id FROM (SELECT token, count(*) AS n, min((conv_id, turn, pos, p)) AS o FROM tk_{side} GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, o LIMIT 19996)),
ids_{side} AS (SELECT conv_id, turn, pos, list_concat(list_concat(CAST({start} AS BIGINT[]), list(coalesce(v.id, 1) ORDER BY p)), CAST({marks} AS BIGINT[]))[1:80] AS ids FROM tk_{side} t LEFT JOIN voc_{side} v ON v.token = t.token GROUP BY 1, 2, 3)"""


@query(f"""WITH {_SPLIT}, {_side_sql('src')}, {_side_sql('tgt')}
SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos, array_to_string(s.ids, ' ') AS src_ids, array_to_string(t.ids, ' ') AS tgt_ids FROM ids_src s JOIN ids_tgt t USING (conv_id, turn, pos) WHERE len(s.ids) >= 2 AND len(t.ids) >= 3""")
def training_examples(spark, sf_dir):
    s = _split(spark, sf_dir).where("part = 'train'")
    e = dataset.examples(s, ["conv_id", "turn", "pos"], _vocab(spark, sf_dir), _vocab(spark, sf_dir, "tgt"))
    return e.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), *[F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("src_ids", "tgt_ids")])
