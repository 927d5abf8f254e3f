"""op6 learns from every labelled document, whatever their number, and from each alike."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paragram.llm import ranking, totals

FOLD = "crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 <> 0"


def _texts(spark, n, bad):
    """Texts of n documents, junk where `bad` holds, and their labels."""
    docs = spark.range(n).select(F.col("id").alias("doc_id"))
    text = F.when(bad, F.concat(F.lit("# $$ !!! BUY 99 !!! "), F.md5(F.col("doc_id").cast("string")))).otherwise(F.concat(F.lit("a calm line of words, "), F.md5(F.col("doc_id").cast("string"))))
    return docs.select("doc_id", text.alias("text")), docs.select("doc_id", F.when(bad, 0).otherwise(1).alias("quality"))


def test_rows_beyond_any_sample_are_learnt_from(spark):
    n = 26_000
    known = spark.range(n).select(F.col("id").alias("doc_id")).where(FOLD)
    hashes = sorted(r.h for r in known.select(F.xxhash64("doc_id").alias("h")).collect())
    assert len(hashes) > 20_500
    last = hashes[20_000]  # quality 0 stands only beyond the 20,000 lowest hashes
    docs, labels = _texts(spark, n, F.xxhash64("doc_id") >= last)
    out = ranking.rank(docs, ranking.train(docs, labels)).join(labels, "doc_id")
    assert out.where("predicted <> quality").count() == 0 and out.select("quality").distinct().count() == 2


def _spread(spark, n):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(n, len(ranking.QUALITY)))
    bad = rnd.random(n) < 0.25
    x[:, 0] -= 1.5 * bad
    x[:, 1] = np.round(x[:, 1])
    table = spark.createDataFrame([(i, i * 7, [float(v) for v in row]) for i, row in enumerate(x)], "doc_id long, t long, x array<double>")
    return table, spark.createDataFrame([(i, int(not b)) for i, b in enumerate(bad)], "doc_id long, quality int")


def _known(table, labels):
    rows = table.join(labels.where(FOLD), "doc_id").withColumn("h", F.xxhash64("doc_id")).orderBy("h").collect()
    return np.array([r.x for r in rows]), np.array([float(r.quality) for r in rows])


def test_one_block_is_the_fit_in_memory_and_many_are_near_it(spark, monkeypatch):
    table, labels = _spread(spark, 1_500)
    x, y = _known(table, labels)
    plain, one = ranking.fit(x, y), ranking.learn(table, labels)
    assert all(np.array_equal(a, b) for a, b in zip(plain.steps, one.steps, strict=True))
    assert np.allclose(plain.weights, one.weights, atol=1e-5) and abs(plain.threshold - one.threshold) < 1e-4 and abs(plain.slope - one.slope) < 1e-4
    monkeypatch.setattr(ranking, "BLOCK", 200)
    many = ranking.learn(table, labels)
    assert all(np.array_equal(a, b) for a, b in zip(plain.steps, many.steps, strict=True))
    s = np.sort(many.design(x) @ many.weights)
    assert many.threshold == pytest.approx(s[int(np.ceil((len(s) - 1) * (y == 0).mean()))], abs=1e-12)
    assert np.corrcoef(plain.score(x), many.score(x))[0, 1] > 0.98
    z = many.design(x) @ many.weights - many.threshold
    assert abs(z @ (y - 1 / (1 + np.exp(-(many.slope * z + np.log(3 / 7)))))) < 1e-2  # the likeliest slope


def test_neither_partitions_nor_steps_of_adding_show(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK", 200)
    table, labels = _spread(spark, 900)
    one = ranking.learn(table.repartition(1), labels)
    monkeypatch.setattr(totals, "FAN", 1)
    other = ranking.learn(table.repartition(7), labels)
    assert np.array_equal(one.weights, other.weights) and (one.threshold, one.slope) == (other.threshold, other.slope)


@pytest.mark.parametrize("rare", [3, 70])
def test_every_row_is_in_a_block_and_in_a_pair(spark, monkeypatch, rare):
    monkeypatch.setattr(ranking, "BLOCK", 100)
    n, width = 1_000, 2
    rows = spark.createDataFrame([(int(i >= rare), i * 11, [float(i), 1.0]) for i in range(n)], "label int, h long, x array<double>")
    blocks = list(ranking._blocks(ranking.dealt(rows, [np.arange(5.0)] * width, n - rare, rare).toArrow().to_batches(), width))
    assert len(blocks) == 10 and sum(b.own.sum() for b in blocks) == n and sum(b.own[b.label == 0].sum() for b in blocks) == rare
    for b in blocks:
        good, bad = int((b.label == 1).sum()), int((b.label == 0).sum())
        assert good and bad >= min(rare, 40)
        i, j = ranking.drawn(good, bad, b.number)
        assert set(i) == set(range(good)) and set(j) == set(range(bad)) and np.bincount(j).min() >= ranking.PAIRS
    i, j = ranking.drawn(2, 1_000, 0)  # more of the commoner label than PAIRS for each of the rarer
    assert set(i) == {0, 1} and set(j) == set(range(1_000))


def test_quantiles_are_those_of_numpy():
    rnd = np.random.default_rng(4)
    columns = [rnd.normal(size=1_001), np.round(rnd.normal(size=400), 1), np.zeros(7), np.array([5.0]), rnd.normal(size=300) * 10.0 ** rnd.integers(-300, 300, 300), np.array([-0.0, 0.0, 1e-310, -1e-310])]
    shares = np.array(ranking._STEPS)
    for cut in (1, 3):
        parts = [[c[k::cut] for c in columns] for k in range(cut)]
        got = totals.quantiles(lambda one, parts=parts: totals.over(parts, one), lambda part: part, [len(c) for c in columns], shares)
        assert all(np.array_equal(a, np.quantile(c, shares)) for a, c in zip(got, columns, strict=True))
