"""Mining of sentence pairs from scanned pages: detect source lines, find their reference, take the English line nearby."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paragram.functions import lang as L
from paragram.functions import plain
from paragram.functions import split as S
from paragram.functions import text as T
from paragram.operators import align, dedup, matching, retrieval, stats
from paragram.operators.rows import made
from paragram.plans.profiles import Surface
from paragram.sources.staging import staged


def page_lines(pages: DataFrame, page: str = "page_id", text: str = "page_text", clean=T.clean_text) -> DataFrame:
    """page, line_no, line of the non-empty lines."""
    if clean in plain.CLEAN:
        own = plain.CLEAN[clean]
        return made(pages, [page], [text], "line_no int, line string", lambda x: list(enumerate(plain.lines(x, own))) if x else [])
    return pages.select(page, F.posexplode(S.lines(F.col(text), clean)).alias("line_no", "line"))


def mined_greedy(pages: DataFrame, page: str = "page_id", text: str = "page_text", surface: Column | None = None, english: Column | None = None) -> DataFrame:
    """First method: every source-like line takes the nearest English-like line within 3 that none has taken."""
    at = lambda keep: F.filter(F.transform("l", lambda x, i: F.struct(i.alias("i"), x.alias("line"))), lambda s: keep(s["line"]))
    surface, english = surface or L.is_surface, english or L.english_like_words
    rows = pages.select(page, S.lines(F.col(text)).alias("l")).select(page, at(surface).alias("sources"), at(english).alias("targets"))
    return align.greedy_lines(rows, [page], "sources", "targets").select(page, "a", "b", "src", "tgt")


def mined_substring(pages: DataFrame, refs: DataFrame, aliases: DataFrame, page: str = "page_id", text: str = "page_text", surface=None) -> DataFrame:
    """Second method: alias on the page, containment in a reference line, nearest sentence within 3 lines; score 7 or more."""
    surface = surface or L.is_surface
    lines = page_lines(pages, page, text)
    low = pages.select(page, F.lower(F.col(text)).alias("_low"))
    with_alias = retrieval.contained(low, [page], "_low", aliases.select(F.lower("alias").alias("alias")), "alias").select(page).distinct().withColumn("alias_match", F.lit(5))
    cand = lines.where(surface(F.col("line")) & (T.n_words(F.col("line")) <= 20))
    inside = retrieval.lines_in_references(cand, "line", refs, "ref_text").select(page, "line_no").withColumn("ref_match", F.lit(3))
    near = align.near_lines(cand, lines.where(L.sentence_like_words(F.col("line"))), [page], 3)
    out = near.join(with_alias, page, "left").join(inside, [page, "line_no"], "left")
    score = F.coalesce("alias_match", F.lit(0)) + F.coalesce("ref_match", F.lit(0)) + 2 + F.when(L.detect_language(F.col("b_line")) == "en", 2).otherwise(0)
    fits = F.length("line").between(5, 500) & F.length("b_line").between(5, 500)
    out = out.withColumn("score", score + F.when(fits, 1).otherwise(0)).where("score >= 7")
    found = out.select(F.col("line").alias("src"), F.col("b_line").alias("tgt"), "score", "distance", page, "line_no")
    return dedup.keep_first(found, ["src", "tgt"], page, "line_no").select("src", "tgt", "score", "distance")


def mined(pages: DataFrame, refs: DataFrame, corpus: DataFrame, forms: DataFrame, p: Surface, page: str = "page_id", text: str = "page_text", surface=None, least: int = 4, accept: int = 7) -> DataFrame:
    """Later methods (profiles v3, v31, v32).

    pages: page, text.  refs: ref (long), ref_text, aliases.  corpus: ord, text, to learn lengths and frequent tokens from.
    forms: form.  surface: what counts as a source line before the costlier tests; least: its detection score.
    Few references and forms are sent to the workers, which then do all of a page's work in its row; with more of them it is done by joins.
    """
    clean = T.clean_text_digits if p.name == "v32" else T.clean_text_marks
    structure = stats.learned_structure(corpus, "text", ["ord"], *p.percentiles, p.starters, p.frequent, p.clamp)
    structure = {k: staged(v, k) for k, v in structure.items()}
    known_forms = retrieval.few(forms.select("form").where("form IS NOT NULL").distinct(), retrieval.FORMS, retrieval.FORM_CHARS)
    own = retrieval.few(refs.select(F.col("ref").cast("long"), "ref_text", "aliases")) if known_forms is not None else None
    if own is not None:
        out = _mined_by_row(pages, own, structure, [f for f, in known_forms], p, page, text, clean, surface or L.is_surface_any_case, least, accept)
    else:
        out = _mined_by_joins(pages, refs, structure, forms, p, page, text, clean, surface or L.is_surface_any_case, least, accept)
    return dedup.keep_first(out, ["src", "tgt"], page, "line_no")


def _mined_by_row(pages, refs: list[tuple], structure, forms: list[str], p, page, text, clean, surface, least, accept) -> DataFrame:
    tidy = plain.CLEAN[clean]
    where: dict[str, list[tuple[int, int]]] = {}
    for ref, _, aliases in refs:
        for pos, alias in enumerate(a for a in map(str.strip, (aliases or "").split("|")) if a):
            if tidy(alias):
                where.setdefault(tidy(alias), []).append((ref, pos))
    texts = [(ref, x) for ref, x, _ in refs if x is not None]
    if p.name == "v31":
        lined = {ref for ref, x in texts if plain.units(x, plain.clean_marks)}
        where = {a: [w for w in at if w[0] in lined] for a, at in where.items()}
        where = {a: at for a, at in where.items() if at}
    names = list(where)
    found = retrieval.detector(structure, forms, p)
    found.forms |= found.frequent
    if p.name == "v32":
        search = (matching.Windows, texts, list(where.values()))
    elif p.name == "v31":
        search = (matching.SingleLines, texts, list(where.values()), p.accept)
    else:
        search = (matching.WholeReferences, [(ref, plain.clean_marks(x)) for ref, x in texts], p.accept)
    miner = matching.Miner(p, found, least, accept, *search)

    def read(x):
        if x is None:
            return []
        whole = tidy(x)
        return [(plain.lines(x, tidy), [i for i, a in enumerate(names) if a in whole])]

    rows = made(pages, [page], [text], "_lines array<string>, _aliases array<int>", read)
    rows = rows.withColumn("_flags", F.transform("_lines", surface))
    fields = "src string, tgt string, line_no int, score int, distance int, reference_score double, shared int, overlap double, reference string, alias_match boolean, translation_score double"
    out = made(rows, [page], ["_lines", "_flags", "_aliases"], fields, miner)
    return out.select("src", "tgt", page, "line_no", "score", "distance", "reference_score", "shared", "overlap", "reference", "alias_match", "translation_score")


def _mined_by_joins(pages, refs: DataFrame, structure, forms: DataFrame, p, page, text, clean, surface, least, accept) -> DataFrame:
    lines = staged(page_lines(pages, page, text, clean), "page-lines")
    known = forms.select("form").unionByName(structure["frequent"].select(F.col("token").alias("form"))).distinct()
    names = refs.select("ref", F.posexplode(S.aliases(F.col("aliases"))).alias("pos", "alias")).select("ref", "pos", clean(F.col("alias")).alias("alias")).where("alias <> ''")
    v31 = p.name == "v31"
    if v31:
        ref_lines = staged(retrieval.reference_lines(refs, "ref", "ref_text"), "reference-lines")
        names = names.join(ref_lines.select("ref").distinct(), "ref", "left_semi")
    pages_clean = pages.select(page, clean(F.col(text)).alias("_text"))
    on_page = retrieval.alias_containment(pages_clean, [page], "_text", names.select("alias", "ref")).select(page, "alias", "ref").distinct()
    on_page = staged(on_page, "on-page") if v31 else on_page.select(page, "ref").distinct()
    with_alias = on_page.select(page).distinct().withColumn("alias_match", F.lit(True))

    key = [page, "line_no"]
    cand = lines.where(surface(F.col("line")))
    tokens = cand.select(*key, F.filter(F.split(T.normalize_signs(F.col("line")), " "), lambda w: w != "").alias("t"))
    joined = staged(S.rejoin_hyphens(tokens, key, "t", known).withColumnRenamed("rejoined", "cand").where("cand <> ''"), "lines")
    found = retrieval.surface_scores(joined, key, "cand", structure, known, p).where(F.col("score") >= least)
    cand = joined.join(found.select(*key, "coverage", "n_tokens"), key).join(with_alias, page, "left").withColumn("alias_match", F.coalesce("alias_match", F.lit(False)))
    cand = staged(cand, "candidates")  # read several times below
    flags = cand.select(*key, "alias_match")

    if p.name == "v32":
        windows = staged(retrieval.reference_windows(refs, "ref", "ref_text"), "windows")
        weights = retrieval.idf_table(windows)
        toks = cand.select(*key, "alias_match", S.lexical_tokens(F.col("cand")).alias("tokens"))
        hits = toks.select(*key, page).select(*key).join(on_page, page).join(windows.select("ref", "ref_id"), "ref").select(*key, "ref_id")
        pool = retrieval.retrieve(toks.drop("alias_match"), key, "tokens", windows, weights, hits, whole=True)
        short = retrieval.rerank_coarse(toks, key, "tokens", pool, windows, weights, F.col("alias_match"), None)
        texts = cand.select(*key, "alias_match", T.canonical(F.col("cand")).alias("canonical"))
        best = retrieval.rerank_final(short, key, texts, windows, F.col("alias_match")).where("matched")
        best = best.select(*key, F.col("final").alias("reference_score"), F.col("window_text").alias("reference"), "shared", "overlap")
    else:
        if v31:
            best = retrieval.best_reference_line(cand, key, page, "cand", ref_lines, names, on_page)
        else:
            numbered = refs.select("ref", T.clean_text_marks(F.col("ref_text")).alias("r")).where("r <> ''").withColumn("n", F.col("ref"))
            best = retrieval.best_reference(cand, key, "cand", numbered, "n", "r", p.accept)
        ok = F.col("score") >= p.accept
        if v31:
            ok = ok | (F.col("alias_match") & (F.col("score") >= 0.46))
        best = best.join(flags, key).where(ok).select(*key, F.col("score").alias("reference_score"), "reference", F.lit(0).alias("shared"), F.lit(0.0).alias("overlap"))

    like = {"v3": L.sentence_like_v3, "v31": L.sentence_like_v31, "v32": L.sentence_like_v32}[p.name]
    english = {"v3": L.english_like_share, "v31": L.english_like_alpha, "v32": lambda c: L.english_like_alpha(c, L.ENGLISH_33, 0.60)}[p.name]
    others = lines.where(like(F.col("line")) & english(F.col("line")))
    score = L.english_score(F.col("b_line")) + F.lit(0.04) * F.greatest(F.lit(0), 6 - F.col("distance")) if p.name == "v32" else None
    anchored = staged(cand.join(best, key), "anchored")
    near = align.near_lines(anchored.select(*key, F.col("cand").alias("line")), others, [page], p.window, score).drop("line")
    out = anchored.join(near, key)
    near_points = F.when(F.col("distance") <= (3 if p.name == "v3" else 4), 2).otherwise(1 if p.name == "v32" else 0)
    total = F.when(F.col("alias_match"), 5).otherwise(0) + 3 + near_points + 2
    if p.name == "v32":
        total = total + F.when(F.col("shared") >= 3, 1).otherwise(0) + F.when(F.col("coverage") >= 0.5, 1).otherwise(0)
    else:
        longest = 40 if p.name == "v3" else 45
        total = total + F.when(F.col("n_tokens").between(3, longest) & T.n_words(F.col("b_line")).between(3, 50 if p.name == "v3" else 55), 1).otherwise(0)
    out = out.withColumn("score", total).withColumn("src", T.strip(F.lower("cand"))).withColumn("tgt", T.strip(F.lower("b_line")))
    out = out.where((F.col("score") >= accept) & F.length("src").between(5, 500) & F.length("tgt").between(5, 500))
    return out.select("src", "tgt", page, "line_no", "score", "distance", "reference_score", "shared", "overlap", "reference", "alias_match", F.col("near_score").alias("translation_score"))


def ordered(found: DataFrame, *ties: str) -> DataFrame:
    """The output's order: score, reference score, shared tokens, distance (none last), then the columns that break ties."""
    return found.orderBy(F.desc("score"), F.desc("reference_score"), F.desc("shared"), F.coalesce("distance", F.lit(99)), *ties)
