import re

import corpus_pipeline
from helpers import words

from paragram.llm import toxicity
from paragram.llm.queries import labels


def test_stages_against_brute_force(spark, sf):
    """Each stage on what the one before kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = corpus_pipeline.toxicity_stage(spark, docs, sf).cache()
    model = toxicity.train(docs, labels(spark, sf))
    toxic = {r.doc_id for r in toxicity.score(docs, model).collect() if r.predicted}
    assert kept.columns == names and {r.doc_id for r in kept.collect()} == set(texts) - toxic
    ruled = corpus_pipeline.quality_stage(spark, kept, sf).cache()
    for r in ruled.collect():
        assert len(words(r.text)) >= 10 and len(re.findall(r"[#*$%&|<>]", r.text)) * 10 <= len(words(r.text))
    single = corpus_pipeline.near_duplicate_stage(spark, ruled, sf).cache()
    left = [r.text for r in single.collect()]
    assert single.columns == names and len(left) == len(set(left))
    cut = corpus_pipeline.repeats_stage(spark, single, sf).cache()
    assert cut.columns == names and cut.count() == single.count()
    seen = {}
    for r in cut.collect():
        assert r.n_chars == len(r.text)
        if r.text == texts[r.doc_id]:  # nothing went, so no window of it is anywhere else
            w = words(r.text)
            for i in range(len(w) - 34):
                assert seen.setdefault(tuple(w[i : i + 35]), r.doc_id) == r.doc_id
    packed = corpus_pipeline.packing_stage(spark, cut, sf).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in cut.collect()}
    whole = corpus_pipeline.run(spark, sf)
    assert whole.count() > 0 and whole.columns == list(packed[0].__fields__)


def test_registered():
    import __spark_entry__ as entry

    found = entry.queries()
    assert all(any(q.startswith(f"op{n}_") for q in found) for n in range(1, 11)) and "pipeline" in found
    assert set(entry.oracle_sql()) <= set(found)
