import random
import zlib
from collections import Counter

import duckdb
import numpy as np
from helpers import SCHEMA, corpus, frame, words
from pyspark.sql import functions as F

from paragram.llm import features, ranking, rules, toxicity
from paragram.llm.textbytes import buffers

import pyarrow as pa


def measures(t):
    w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
    count = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {p for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_rules_by_brute_force(spark):
    rows = corpus() + [(900, "a b c d e a b c d e f", "", "", 1, "", 1, 1, 1, ""), (901, "# $ x|y <b> " * 5, "", "", 1, "", 1, 1, 1, "")]
    book = rules.ledger(frame(spark, rows), keep=("source", "words"))
    want = Counter((r[0], *measures(r[1])) for r in rows)
    got = rules.judged(book).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    assert rules.ledger(spark.createDataFrame([], SCHEMA)).count() == 0
    kept = rules.accepted(frame(spark, rows))
    assert kept.columns == [f.split(" ")[0] for f in SCHEMA.split(", ")] and kept.count() == sum(r.kept for r in got)


def test_rules_policies_and_ablation(spark):
    book = rules.ledger(frame(spark)).cache()
    bits = [r.failure_bits for r in book.collect()]
    mask = rules.mask_of("standard@1")
    for r in rules.ablation(book, "standard@1").collect():
        assert r.failed == sum(bool(b & r.bit) for b in bits) and r.failed_alone == sum(b & mask == r.bit for b in bits) and r.kept == sum(b & mask == 0 for b in bits)
    assert rules.ablation(book.limit(0), "standard@1").first().documents == 0


def test_rules_against_sql(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cur = con.execute(rules.SQL)
    names = [d[0] for d in cur.description]
    want = Counter(tuple(r[names.index(c)] for c in rules.DIGEST) for r in cur.fetchall())
    assert Counter(map(tuple, rules.judged(rules.ledger(docs)).select(*rules.DIGEST).collect())) == want


def test_rules_stay_in_the_jvm(spark):
    plan = rules.judged(rules.ledger(frame(spark)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_quality_features_by_brute_force():
    texts = [r[1] for r in corpus()]
    x = features.quality_matrix(*buffers(pa.array(texts)))
    for t, row in zip(texts, x, strict=True):
        n, _, symbols, _, repeated = measures(t)
        if not n:
            assert not row.any()
            continue
        assert abs(row[0] - symbols / n) < 1e-9 and abs(row[8] - repeated / n) < 1e-9 and abs(row[7] - np.log1p(n)) < 1e-9


def held(doc_id, folds, k):
    return zlib.crc32(str(doc_id).encode()) % folds == k


def accuracy(spark, sf, out, label, folds, k):
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert rows and all(held(r.doc_id, folds, k) for r in rows)
    return np.mean([r.predicted == r[label] for r in rows]), len(rows)


def test_ranking(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = ranking.train(docs, labels)
    out = ranking.rank(docs, model)
    assert out.count() == docs.count() and accuracy(spark, sf, out, "quality", 5, 0)[0] >= 0.95
    odd = ranking.rank(frame(spark), model).collect()
    assert len(odd) == len(corpus()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in odd)
    assert [r.held_out for r in odd if r.doc_id is None] == [False, False]
    none = ranking.train(docs, labels.limit(0))
    assert {r.score for r in ranking.rank(docs.limit(3), none).collect()} == {0.5}


def test_pairwise_fit_orders_and_cuts():
    rnd = np.random.default_rng(0)
    label = (rnd.random(600) < 0.8).astype(float)
    x = rnd.normal(size=(600, 3)) + label[:, None] * [2.5, 0, -2.5]
    m = ranking.fit(x, label)
    s = m.score(x)
    assert np.mean(s[label == 1][:, None] > s[label == 0][None, :]) > 0.97
    assert abs((s < 0.3).mean() - (label == 0).mean()) < 0.03  # the quantile


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model)
    assert accuracy(spark, sf, out, "toxic", 3, 1)[0] >= 0.95
    odd = toxicity.score(frame(spark), model).collect()
    assert len(odd) == len(corpus()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in odd)
    kept = toxicity.accepted(frame(spark), model)
    assert kept.count() == sum(r.predicted == 0 for r in odd) and kept.columns[:2] == ["doc_id", "text"]
    none = toxicity.train(docs, labels.where(F.col("toxic") == 5))
    assert toxicity.score(docs.limit(3), none).count() == 3


def test_lexicon_features():
    lex = toxicity.Lexicon(frozenset(toxicity.INSULTS), frozenset({"achli"}))
    x = lex.matrix(*buffers(pa.array(["you are an idiot", "st0p the 1diot now", "", "achlichung und so", "all is well"])))
    f = {n: i for i, n in enumerate(toxicity.FEATURES)}
    assert x[0, f["lexicon"]] == 0.25 and x[0, f["near_second_person"]] == 1 and x[1, f["lexicon"]] == 0.25 and x[1, f["hidden_lexicon"]] == 0.25
    assert not x[2].any() and x[3, f["beginnings"]] == 1 / 3 and not x[4, : f["second_person"]].any()


def test_trees_and_isotonic():
    rnd = np.random.default_rng(2)
    x = rnd.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((toxicity.boost(x, y).raw(x) > 0) == y).mean() > 0.95
    knots, values = toxicity.isotonic(np.arange(6.0), np.array([0, 1, 0, 1, 1, 1.0]))
    assert (np.diff(values) >= 0).all() and np.interp(1.5, knots, values) == 0.5
    random.seed(1)
