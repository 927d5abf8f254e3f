from pyspark.sql import functions as F

from paragram.llm import toxicity


def _sample(spark, n):
    """Toxic rows say a word of their fold and a word of all."""
    docs = spark.range(n).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.md5(F.col("id").cast("string")), F.when(F.col("id") % 2 == 0, F.lit(" grumblix snarfen zorp")).otherwise(F.lit(" lovely quiet day"))).alias("text")
    )
    return docs, docs.select("doc_id", (1 - F.col("doc_id") % 2).alias("toxic"))


def test_every_labelled_row_is_learnt_from_at_every_size(spark, monkeypatch):
    fitted, learnt = [], []
    fit, learn = toxicity.fit, toxicity.learn_lexicons
    monkeypatch.setattr(toxicity, "fit", lambda lexicon, x, y, part: fitted.append(len(y)) or fit(lexicon, x, y, part))
    monkeypatch.setattr(toxicity, "learn_lexicons", lambda rows, folds: learnt.append(rows.count()) or learn(rows, folds))
    monkeypatch.setattr(toxicity, "distinct_texts", lambda rows: rows)
    for n in (600, 9_600):
        docs, labels = _sample(spark, n)
        toxicity.train(docs, labels)
        assert fitted[-1] == learnt[-1] == labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).count()


def test_lexicons_of_the_other_folds(spark):
    rows = [(f"only{i % 4} everyone", 1, i % 4, i) for i in range(80)] + [("calm", 0, i % 4, 100 + i) for i in range(80)]
    *others, whole = toxicity.learn_lexicons(spark.createDataFrame(rows, "text string, label int, part int, h long"), 4)
    for k, lexicon in enumerate(others):
        assert f"only{k}" not in lexicon.words and {f"only{j}" for j in range(4) if j != k} <= lexicon.words and "everyone" in lexicon.words
    assert {f"only{j}" for j in range(4)} <= whole.words
