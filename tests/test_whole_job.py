"""Operators and queries over the whole of their input, against plain loops and statements without cuts."""

import glob
import os
import random
from difflib import SequenceMatcher

import duckdb

from paragram import catalog
from paragram.operators import retrieval


def _rows(sf, sql):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con.execute(sql).fetchall()


def _loop(cand, page_text, alias_map, index, lines, gap, first, most):
    """The v3.1 search in plain Python."""
    tokens, pool, seen = cand.split(), [], set()
    for alias, refs in alias_map.items():
        if alias in page_text:
            pool += refs
    pool = [r for r in pool + index.get(tokens[0], []) + lines[:first] if not (r in seen or seen.add(r)) and abs(len(r.split()) - len(tokens)) <= gap][:most]
    best = (0.0, None)
    for r in pool:
        a, b = set(tokens), set(r.split())
        score = 0.55 * SequenceMatcher(None, cand, r).ratio() + 0.45 * len(a & b) / len(a | b)
        if score > best[0] + 1e-9:
            best = (score, r)
    return best


def test_reference_lines_match_the_loop(spark):
    rnd = random.Random(5)
    make = lambda: " ".join(rnd.choices("alpha beta gamma delta eta zeta theta iota".split(), k=rnd.randint(1, 7)))
    refs = [(i, "\n".join(make() for _ in range(6)), f"kt {i % 7}|kt {rnd.randrange(9)}") for i in range(30)]
    alias_map, index, lines = {}, {}, []
    for _, text, aliases in refs:
        own = text.split("\n")
        lines += own
        for x in own:
            index.setdefault(x.split()[0], []).append(x)
        for a in aliases.split("|"):
            alias_map.setdefault(a, []).extend(own)
    page_of = {1: "see kt 3 and kt 5", 2: "nothing", 3: "kt 0"}
    cands = [(p, n, make()) for p in page_of for n in range(12)]
    frame = spark.createDataFrame(refs, "ref long, ref_text string, aliases string")
    names = spark.createDataFrame([(r, i, a) for r, _, x in refs for i, a in enumerate(x.split("|"))], "ref long, pos int, alias string")
    on_page = spark.createDataFrame([(p, a) for p, t in page_of.items() for a in alias_map if a in t], "page_id int, alias string")
    c = spark.createDataFrame(cands, "page_id int, line_no int, cand string")
    for gap, first, most in ((18, 3000, 500), (2, 20, 9)):
        found = retrieval.best_reference_line(c, ["page_id", "line_no"], "page_id", "cand", retrieval.reference_lines(frame, "ref", "ref_text"), names, on_page, 0.55, first, most, gap)
        got = {(r.page_id, r.line_no): (round(r.score, 6), r.reference) for r in found.collect()}
        for p, n, text in cands:
            score, ref = _loop(text, page_of[p], alias_map, index, lines, gap, first, most)
            if score >= 0.46:
                assert got[p, n] == (round(score, 6), ref)
            else:
                assert got.get((p, n), (0,))[0] < 0.46


def test_a_page_line_finds_its_line_of_a_long_reference(spark):
    from paragram.plans import pages
    from paragram.plans.profiles import SURFACES

    line = "a-na ku-li qi-bi ma"
    long_text = "\n".join([f"um-ma x{i} sa-lim a-sur i-di-in" for i in range(9)] + [line])
    refs = spark.createDataFrame([(0, long_text, "kt 1")], "ref long, ref_text string, aliases string")
    page = spark.createDataFrame([(1, f"letter kt 1\n{line}\nHe said to the man that the silver is in the city of his father.")], "page_id int, page_text string")
    corpus = spark.createDataFrame([(0, long_text)], "ord long, text string")
    forms = retrieval.lexicon(refs, "ref_text")
    got = pages.mined(page, refs, corpus, forms, SURFACES["v31"], surface=lambda c: c.rlike("-"), least=0, accept=0).collect()
    assert {(r.reference, round(r.reference_score, 6)) for r in got} == {(line, 1.0)}


def test_archive_join_reads_every_supplier(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    for name in ("nation", "region"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    suppliers = spark.read.parquet(f"{sf}/supplier.parquet").withColumn("s_suppkey", F.col("s_suppkey") + 1000)
    suppliers.write.parquet(f"{tmp_path}/supplier.parquet")
    literals, _, _ = catalog._archive(spark, str(tmp_path))
    assert literals.count() == suppliers.count() > 0
    assert catalog.archive_join(spark, str(tmp_path)).count() > 0


def test_archive_join_against_the_statement_without_its_filter(spark):
    sf, cut = "/root/testdata/sf0.1", " WHERE s_suppkey <= 30"
    sql = catalog.SQL["archive_join"]
    want = _rows(sf, f"SELECT source, match_key, ref_id, is_new, aliases, excavation_no, transliteration, translation FROM ({sql.replace(cut, '')})")
    got = catalog.archive_join(spark, sf).select("source", "match_key", "ref_id", "is_new", "aliases", "excavation_no", "transliteration", "translation")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_vocabulary_holds_every_frequent_word(spark):
    sf = "/root/testdata/sf0.1"
    want = _rows(sf, f"SELECT token, id, n FROM ({catalog.SQL['vocab_build'].replace('LIMIT 496', 'LIMIT 19996')})")
    got = [tuple(r) for r in catalog.vocab_build(spark, sf).select("token", "id", "n").collect()]
    assert len(got) > 500 and sorted(got, key=str) == sorted(want, key=str)


def test_short_lines_are_found_in_references(spark, tmp_path):
    spark.createDataFrame([(0, "tiny\nno such line\n\n"), (1, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "a tiny text")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [tuple(r) for r in catalog.line_in_reference(spark, str(tmp_path)).select("doc_id", "line").collect()] == [(0, "tiny")]


def test_line_in_reference_against_the_statement_for_all_lines(spark, sf):
    want = _rows(sf, f"SELECT doc_id, line FROM ({catalog.SQL['line_in_reference'].replace('length(line) >= 20', 'length(line) > 0')})")
    got = catalog.line_in_reference(spark, sf).select("doc_id", "line")
    assert sorted(map(tuple, got.collect())) == sorted(want)
