"""Queries of sources and sinks: each writes files of the driver's tables to the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from paragram import fixtures as X
from paragram.catalog import _EX, _KEY, _PAIRS, _base, _clean, _lines, _strip, query
from paragram.functions import lang as L
from paragram.functions import split as S
from paragram.functions import text as T
from paragram.operators import dataset, dedup, stats
from paragram.plans import expansion, pages
from paragram.plans.profiles import V42
from paragram.sources import io
from paragram.sources.staging import folder, staged

_ORDER = ("conv_id", "turn", "pos")
#: A line as the line sinks write it.
_FLAT = r"regexp_replace({}, '[\r\n]+', ' ', 'g')"


@query("SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, text, '' AS missing FROM conversations")
def csv_round_trip(spark, sf_dir):
    """A CSV sink with chosen fields, and the CSV source with quoted cells over several lines and a column that isn't there."""
    path = folder(spark, "csv")
    io.write_csv(X.table(spark, sf_dir, "conversations"), path, ["conv_id", "turn", "role", "text"], "conv_id", "turn")
    return io.read_csv(spark, path, ["conv_id", "turn", "role", "text", "missing"])


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, 'say "' || lang || '", then' || chr(10) || 'a, b' AS quoted, CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END AS even FROM documents""")
def csv_quoted_cells(spark, sf_dir):
    path = folder(spark, "csv")
    rows = X.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit('say "'), "lang", F.lit('", then\na, b')).alias("cell"), (F.col("doc_id") % 2 == 0).alias("even"))
    io.write_csv(rows, path, {"doc_id": "id", "cell": "quoted", "even": "even"})
    return io.read_csv(spark, path, ["id", "quoted", "even"])


@query("SELECT n_name AS name, n_name || ' of ' || n_regionkey AS note FROM nation")
def csv_mark_and_nul(spark, sf_dir):
    """A byte order mark before the header, NUL characters inside cells."""
    path = folder(spark, "csv")
    header = spark.createDataFrame([(-1, "﻿name,note")], "o long, line string")
    body = X.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("o"), F.concat("n_name", F.lit(',"'), "n_name", F.lit(" \x00of\x00 "), "n_regionkey", F.lit('"')).alias("line"))
    io.write_lines(header.unionByName(body), path, "line", "o", one_file=True)
    return io.read_csv(spark, path, ["name", "note"])


@query(f"""WITH l AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS line_no, {_FLAT.format('text')} AS line FROM conversations) SELECT line_no, md5(line) AS line FROM l""")
def corpus_lines(spark, sf_dir):
    """One line a row, in order over many files; read back with the numbers of the lines."""
    path = folder(spark, "lines")
    io.write_lines(X.table(spark, sf_dir, "conversations"), path, "text", "conv_id", "turn")
    return io.read_lines(spark, path).select("line_no", F.md5("line").alias("line"))


@query(f"WITH {_PAIRS} SELECT row_number() OVER (ORDER BY conv_id, turn, pos) AS line_no, src, tgt FROM base")
def parallel_files(spark, sf_dir):
    src, tgt = folder(spark, "src"), folder(spark, "tgt")
    io.write_parallel(_base(spark, sf_dir), src, tgt, *_ORDER)
    return io.read_parallel(spark, src, tgt, T.clean_text)


@query(f"""WITH {_EX}, l AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS line_no, {_clean(_FLAT.format("CASE WHEN turn % 3 = 0 THEN '' ELSE src END"))} AS src, {_clean(_FLAT.format('tgt'))} AS tgt FROM ex)
SELECT line_no, src, tgt FROM l WHERE src <> '' AND tgt <> '' ORDER BY line_no LIMIT 20""")
def parallel_first_pairs(spark, sf_dir):
    """Pairs with an empty side go; then the first 20 stay."""
    src, tgt = folder(spark, "src"), folder(spark, "tgt")
    e = X.exchanges(spark, sf_dir).withColumn("src", F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("src")))
    io.write_parallel(e, src, tgt, "conv_id", "turn", one_file=True)
    return io.read_parallel(spark, src, tgt, T.clean_text, drop_empty=True, max_pairs=20)


@query(f"""WITH {_EX}, m AS (SELECT CASE conv_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS mode, row_number() OVER (PARTITION BY conv_id % 3 ORDER BY conv_id, turn) AS line_no, {_clean('src')} AS src, {_clean('tgt')} AS tgt FROM ex)
SELECT mode, CASE mode WHEN 'train' THEN 0 WHEN 'valid' THEN 1 ELSE 2 END AS mode_ord, line_no, mode || ':' || line_no AS row_id, src, tgt FROM m""")
def external_files(spark, sf_dir):
    """Three parallel corpora, each from its own pair of files."""
    paths = {}
    e = X.external(spark, sf_dir)
    for i, mode in enumerate(("train", "valid", "test")):
        paths[mode] = folder(spark, f"{mode}-src"), folder(spark, f"{mode}-tgt")
        io.write_parallel(e.where(F.col("mode_ord") == i), *paths[mode], "line_no")
    return io.read_modes(spark, paths, T.clean_text)


@query("SELECT n_name, label FROM nation JOIN (VALUES (0, 'first'), (1, 'second'), (2, 'third, with a comma'), (3, NULL)) t(k, label) ON n_regionkey = k")
def literal_rows(spark, sf_dir):
    rows = io.literal_table(spark, [(0, "first"), (1, "second"), (2, "third, with a comma"), (3, None)], "k int, label string")
    n = X.table(spark, sf_dir, "nation")
    return n.join(F.broadcast(rows), n["n_regionkey"] == rows["k"]).select("n_name", "label")  # four rows


@query(f"WITH {_PAIRS} SELECT conv_id, count(*) AS pairs, CAST(max(length(tgt)) AS BIGINT) AS longest FROM base GROUP BY 1")
def derived_stage(spark, sf_dir):
    """A stage that reads what the stage before wrote."""
    b = staged(_base(spark, sf_dir), "pairs")
    return b.groupBy("conv_id").agg(F.count("*").alias("pairs"), F.max(F.length("tgt")).cast("long").alias("longest"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 3 = 0")
def flagged_pages(spark, sf_dir):
    """A flag that comes as text, typed once; the filter then reaches the scan."""
    flag = F.when(F.col("doc_id") % 3 == 0, "True ").when(F.col("doc_id") % 3 == 1, "no")
    pages_ = io.to_parquet(X.table(spark, sf_dir, "documents").select("doc_id", "lang", flag.alias("has_source")), folder(spark, "pages"), ("has_source",))
    return pages_.where("has_source").select("doc_id", "lang")


@query("SELECT copy, s_suppkey, s_name FROM supplier, (VALUES ('first'), ('second')) t(copy)")
def copied_rows(spark, sf_dir):
    """The same rows in two places."""
    paths = {k: folder(spark, k) for k in ("first", "second")}
    io.write_copies(X.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), lambda rows, path: rows.write.parquet(path), *paths.values())
    both = [spark.read.parquet(p).select(F.lit(k).alias("copy"), "s_suppkey", "s_name") for k, p in paths.items()]
    return both[0].unionByName(both[1])


@query("SELECT doc_id, lang, n_chars, text IS NULL AS empty FROM documents")
def json_round_trip(spark, sf_dir):
    path = folder(spark, "json")
    io.write_json(X.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.col("text").isNull().alias("empty")), path)
    kinds = {f.name: f.dataType.simpleString() for f in X.table(spark, sf_dir, "documents").schema}
    return spark.read.schema(f"doc_id {kinds['doc_id']}, lang string, n_chars {kinds['n_chars']}, empty boolean").json(path)


@query(f"""WITH {_EX}, s AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS k, replace(src, chr(10), ' ') AS src, replace(tgt, chr(10), ' ') AS tgt FROM ex),
f AS (SELECT k, unnest(['  - SRC: ' || src[1:220], '  - TGT: ' || tgt[1:220]]) AS line, unnest([1, 2]) AS part FROM s WHERE k <= 3),
m AS (SELECT 1 AS k, '- conversations: ' || count(DISTINCT conv_id) AS line FROM conversations UNION ALL SELECT 2, '- turns: ' || count(*) FROM conversations)
SELECT 1 AS line_no, '# Conversations' AS line UNION ALL SELECT 2, '' UNION ALL SELECT 2 + k, line FROM m UNION ALL SELECT 5, '' UNION ALL SELECT 6, '## Samples' UNION ALL SELECT 7, '' UNION ALL SELECT 8 + 2 * (k - 1) + part - 1, line FROM f""")
def markdown_report(spark, sf_dir):
    c = X.table(spark, sf_dir, "conversations")
    metrics = c.agg(F.countDistinct("conv_id").alias("conversations"), F.count("*").alias("turns"))
    metrics = metrics.select(F.inline(F.array(*[F.struct(F.lit(k).alias("stage"), F.col(k).alias("value")) for k in ("conversations", "turns")])))
    flat = lambda c: F.replace(c, F.lit("\n"), F.lit(" ")).alias(c)
    text = io.report(metrics, X.exchanges(spark, sf_dir).orderBy("conv_id", "turn").select(flat("src"), flat("tgt")), "Conversations", 3)
    return spark.createDataFrame(list(enumerate(text.rstrip("\n").split("\n"), 1)), "line_no int, line string")


# Small functions that the files' users share.


@query("SELECT conv_id, turn, text[1:220] AS sample FROM conversations")
def sample_texts(spark, sf_dir):
    return X.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.sample(F.col("text")).alias("sample"))


@query(rf"""SELECT doc_id, x AS alias FROM (SELECT doc_id, unnest([{_strip('y')} FOR y IN string_split_regex(raw, '[|;]')]) AS x FROM (SELECT doc_id, ' ' || source || ' |' || lang || '; ;ab|' || coalesce(text, '')[1:40] AS raw FROM documents)) WHERE length(x) >= 3""")
def alias_split(spark, sf_dir):
    raw = F.concat(F.lit(" "), "source", F.lit(" |"), "lang", F.lit("; ;ab|"), F.substring(F.coalesce("text", F.lit("")), 1, 40))
    return X.table(spark, sf_dir, "documents").select("doc_id", F.explode(S.aliases(raw, "[|;]", 3)).alias("alias"))


_AZX, _AZ = "regexp_extract_all(lower(text), '[a-zà-ÿ]+')", "regexp_extract_all(lower(text), '[a-z]+')"


def _english_sql() -> str:
    from paragram.catalog import _hits

    en, de, fr, es = (_hits(_AZX, words) for words in (L.ENGLISH_24, L.GERMAN, L.FRENCH, L.SPANISH))
    lang = f"(len({_AZX}) < 3 OR {en} = greatest({en}, {de}, {fr}, {es}))"
    like = f"(len({_AZ}) >= 3 AND {_hits(_AZ, L.ENGLISH_24)} >= 1 AND {_hits(_AZ, L.ENGLISH_24)} / CAST(len({_AZ}) AS DOUBLE) >= 0.06)"
    return f"SELECT doc_id, md5(CASE WHEN {lang} AND {like} THEN text END) AS english FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)"


@query(_english_sql())
def english_or_nothing(spark, sf_dir):
    """What would be handed on untranslated; other languages give null."""
    d = X.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", F.md5(L.english_or_none(F.col("text"))).alias("english"))


@query(f"WITH {_PAIRS} SELECT count(*) AS rows, round_even(avg(length(src)), 6) AS src_chars, round_even(avg(length(tgt)), 6) AS tgt_chars FROM base")
def average_lengths(spark, sf_dir):
    a = stats.average_chars(_base(spark, sf_dir), "src", "tgt")
    return a.select("rows", F.bround("src_chars", 6).alias("src_chars"), F.bround("tgt_chars", 6).alias("tgt_chars"))


# Orders of results, as the numbers of the lines of what was written.


@query(f"""WITH {_PAIRS} SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos, row_number() OVER (ORDER BY CAST('0x' || md5('42|' || conv_id || '|' || turn || '|' || pos)[1:15] AS BIGINT), conv_id, turn, pos) - 1 AS rank FROM base""")
def seeded_shuffle(spark, sf_dir):
    b = dataset.shuffled(_base(spark, sf_dir).select(*_ORDER), 42, *_ORDER)
    return b.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), F.col("rank").cast("long").alias("rank"))


def _expanded_sql() -> str:
    from paragram.catalog import _expand_sql

    head, _, _ = _expand_sql("v42").rpartition("SELECT DISTINCT")
    head = head.replace("s AS (SELECT src, tgt,", "s AS (SELECT conv_id, turn, k, ratio_med, src, tgt,")
    return f"""{head.rstrip()}, o AS (SELECT *, row_number() OVER (PARTITION BY src, tgt ORDER BY confidence DESC, abs(ratio - ratio_med), src_len, conv_id, turn, k) AS rn FROM s WHERE confidence >= 6)
SELECT row_number() OVER (ORDER BY confidence DESC, abs(ratio - ratio_med), src_len, src, tgt) AS line_no, src || ' = ' || tgt AS line FROM o WHERE rn = 1"""


@query(_expanded_sql())
def expansion_order(spark, sf_dir):
    """Expanded pairs by confidence, closeness to the median ratio and length."""
    from paragram.catalog import _loose

    e, key = X.exchanges(spark, sf_dir), ["conv_id", "turn"]
    base = _base(spark, sf_dir)
    out = expansion.expand(e, key, _loose(V42), base, similarity=False).crossJoin(F.broadcast(stats.baseline_stats(base, *V42.percentiles)))  # one row
    path = folder(spark, "ordered")
    ordered = expansion.ordered(out.withColumn("line", F.concat("src", F.lit(" = "), "tgt")), V42, "src", "tgt")
    io.write_lines(ordered, path, "line")
    return io.read_lines(spark, path)


@query(f"""WITH l AS (SELECT doc_id, n_chars, doc_id % 7 AS score, (doc_id % 5) / 10.0 AS reference_score, doc_id % 3 AS shared, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 9 END AS distance FROM documents)
SELECT row_number() OVER (ORDER BY score DESC, reference_score DESC, shared DESC, coalesce(distance, 99), doc_id) AS line_no, CAST(doc_id AS VARCHAR) AS line FROM l""")
def mined_order(spark, sf_dir):
    """Mined pairs by score, reference score, shared tokens and distance, those without one last."""
    d = X.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("line"), "doc_id", (F.col("doc_id") % 7).alias("score"), ((F.col("doc_id") % 5) / 10).alias("reference_score"), (F.col("doc_id") % 3).alias("shared"), F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 9).alias("distance"))
    path = folder(spark, "ordered")
    io.write_lines(pages.ordered(d, "doc_id"), path, "line")
    return io.read_lines(spark, path)
