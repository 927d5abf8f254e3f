import random

from paragram.llm import ngram_join


def test_an_id_of_two_texts_keeps_only_firsts_of_classes(spark):
    rnd = random.Random(2)
    make = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(60))
    a, b, c = make(), make(), make()
    rows = [(1, a), (5, a + " more"), (5, b), (7, b + " more"), (9, c), (9, c), (10, ""), (11, None)]
    kept = ngram_join.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == sorted([(1, a), (5, b), (9, c), (10, ""), (11, "")])
