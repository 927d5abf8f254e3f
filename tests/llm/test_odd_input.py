"""Large ids, clashing names, repeated rows and very long texts."""

import hashlib
import random

import numpy as np
import pytest
from helpers import words
from pyspark.sql import functions as F

from paragram.llm import debruijn, labelled, ngram_join, packing, ranking, rules, sstable, storage, suffix_matching, toxicity, weighted_sampling
from paragram.llm.queries import tokenizer_path

LEAST = -(1 << 63)
CLASHING = ("_h", "_id", "_x", "_spans", "_first", "_raw", "_row", "n_words", "failure_bits", "row", "own", "h", "x", "id", "spans", "nameless", "raw", "root", "text_key", "t", "u", "doc id")


def edited(ordered):
    out = []
    for i, (d, t) in enumerate(ordered):
        half = len(t) // 2
        out.append((d, hashlib.sha256((t[: len(t) - half] + ordered[(i + 1) % len(ordered)][1][:half]).encode()).hexdigest()))
    return out


def test_large_ids_follow_one_another(spark):
    n = 3000
    df = spark.range(n, numPartitions=16).select((F.col("id") + (1 << 62)).alias("doc_id"), F.concat(F.md5(F.col("id").cast("string")), F.lit(" "), F.md5((F.col("id") + 7).cast("string"))).alias("text"))
    md5 = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    want = edited([((1 << 62) + i, f"{md5(i)} {md5(i + 7)}") for i in range(n)])
    got = weighted_sampling.edited_fingerprints(df).collect()
    assert sorted((r.doc_id, r.edited_sha256) for r in got) == want


def test_the_least_id_is_no_null(spark):
    rows = [(LEAST, "the least of all ids"), (None, "no id at all here"), (0, "zero is in between"), ((1 << 63) - 1, "and the greatest one")]
    got = weighted_sampling.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    order = [rows[1], rows[0], rows[2], rows[3]]
    assert {(r.doc_id, r.edited_sha256) for r in got} == set(edited(order))


def test_ranges_are_exact():
    rnd = random.Random(1)
    keys = [(1, (1 << 62) + rnd.randrange(60), rnd.randrange(-5, 5)) for _ in range(500)] + [(0, LEAST, rnd.randrange(-5, 5)) for _ in range(50)] + [(1, LEAST, 3)]
    deal = weighted_sampling._Ranges(rnd.sample(keys, 20))
    r = deal.of(*(np.array([k[i] for k in keys]) for i in range(3)))
    assert [int(x) for x in r] == [sum(c <= k for c in deal.cuts) for k in keys]


@pytest.fixture(scope="module")
def clashing(spark):
    rnd = random.Random(9)
    make = lambda k: " ".join(f"w{rnd.randrange(10**5)}" for _ in range(k))
    passage, base = make(50), make(80)
    rows = [(1, f"{make(20)} {passage}"), (2, f"{passage} {make(30)}"), (3, base), (4, base + " more"), (4, base + " more"), (5, None), (6, ""), (None, base), (None, make(30))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in CLASHING:
        df = df.withColumn(name, F.lit(f"value of {name}"))
    return df


def test_stages_keep_columns_of_any_name(clashing):
    for stage in (debruijn.cleaned, ngram_join.representatives, rules.accepted):
        out = stage(clashing)
        assert out.columns == clashing.columns
        rows = out.collect()
        assert rows and all(r[name] == f"value of {name}" for r in rows for name in CLASHING)
    assert debruijn.cleaned(clashing).count() == clashing.count()
    kept = ngram_join.representatives(clashing).select("doc_id", "text").collect()
    # 3, its near copies and the copy without an id are one class; the other row without an id stays.
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 2), (False, 3), (False, 5), (False, 6), (True, 0)]


def test_ledger_carries_clashing_columns(clashing):
    book = rules.ledger(clashing, keep=("n_words", "failure_bits", "_h"))
    assert {"input_n_words", "input_failure_bits", "_h"} < set(book.columns) and book.count() == clashing.count()
    assert {r.input_n_words for r in book.collect()} == {"value of n_words"}


def test_operators_ignore_other_columns(spark, clashing):
    n = clashing.count()
    assert debruijn.deduplicated(clashing).count() == ngram_join.joined(clashing).count() == weighted_sampling.edited_fingerprints(clashing).count() == n
    assert suffix_matching.digest(clashing, tokenizer_path("piece_bpe_32k.model")).count() == n
    assert packing.pack(clashing, tokenizer_path("word_bpe_49k.json"), 2).select("doc_id").distinct().count() == 7


def test_very_long_texts(spark):
    rnd = random.Random(4)
    long = " ".join(f"w{rnd.randrange(3000)}" for _ in range(400_000))  # over two megabytes, more than a slice
    word = "z" * 3_000_000
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, word), (4, word + "z")], "doc_id long, text string")
    found = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.joined(df).collect()}
    assert found == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0)}
    cut = {r.doc_id: (r.n_words, r.n_removed) for r in debruijn.deduplicated(df).collect()}
    assert cut == {1: (400_000, 400_000), 2: (400_001, 400_000), 3: (1, 0), 4: (1, 0)}
    folder = storage.scratch(spark, "t")
    rows = sstable.read_shards(spark, folder, sstable.write_shards(df.where("doc_id < 3"), folder, tokenizer_path("byte_bpe_50k.json"), 2)).orderBy("start").collect()
    assert [r.start for r in rows] == [0, rows[0].n_tokens] and all(r.looked_up for r in rows)
    near = {r.doc_id: r.near_next for r in weighted_sampling.edited_fingerprints(df).collect()}
    assert near[1] > 0.9
    book = {r.doc_id: r.n_words for r in rules.ledger(df).collect()}
    assert book == {1: 400_000, 2: 400_001, 3: 1, 4: 1}


def test_samples_are_bounded_in_rows(spark):
    docs = spark.range(200 * 50).select((F.col("id") % 200).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    rows = labelled.training_rows(docs, labels, "quality", 5, 0, most=100)
    assert rows.count() == 100 == rows.select("h").distinct().count()
    few = labelled.training_rows(docs, labels, "quality", 5, 0, most=3000)
    assert few.count() == labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).count()


def test_every_pair_that_is_promised_is_learnt_from(monkeypatch):
    drawn = []
    real = np.random.default_rng

    class Draw:
        def __init__(self, seed):
            self.own = real(seed)

        def integers(self, low, high, n):
            drawn.append(n)
            return self.own.integers(low, high, n)

    rnd = real(1)
    label = (np.arange(20_400) % 2).astype(float)
    x = rnd.normal(size=(len(label), 2)) + label[:, None]
    monkeypatch.setattr(np.random, "default_rng", Draw)
    ranking.fit(x, label, rounds=1)
    assert drawn[0] == ranking.PAIRS * 10_200


def test_long_words_enter_the_lexicon(spark):
    long = ["q" * 40, "v" * 60, "k" * 300]
    rows = [(" ".join(long), 1, i % 4, i) for i in range(40)] + [("calm", 0, i % 4, 100 + i) for i in range(40)]
    *_, lexicon = toxicity.learn_lexicons(spark.createDataFrame(rows, "text string, label int, part int, h long"), 4)
    assert set(long) <= lexicon.words


def test_scratch_is_removed(spark):
    df = storage.written(spark.range(5).toDF("a"), "t")
    fs, path = storage.filesystem(next(f for f in storage._FOLDERS if f.rstrip("/").split("/")[-1] == df.inputFiles()[0].split("/")[-2]))
    assert fs.get_file_info(path).type.name == "Directory"
    storage.release(df)
    assert fs.get_file_info(path).type.name == "NotFound"


def test_file_systems():
    assert storage.reachable("s3a://bucket/x") and storage.reachable("file:///x") and storage.reachable("abfss://c@a/x") and not storage.reachable("viewfs://in/x")
    assert storage.filesystem("dbfs:/a/b")[1] == "/dbfs/a/b" and storage.filesystem("file:/a/b")[1] == "/a/b"
