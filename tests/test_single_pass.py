"""Structure of a corpus learnt in one pass, against plain loops."""

import random
from collections import Counter

import pytest

from paragram.operators import stats


def _loop(docs):
    sizes, first, every, at = [], Counter(), Counter(), {}
    for i, text in sorted(docs):
        for u, unit in enumerate([x.strip() for x in text.replace(".", "\n").split("\n") if x.strip()]):
            words = unit.split()
            sizes.append(len(words))
            first[words[0]] += 1
            every.update(words)
            for p, w in enumerate(words):
                at.setdefault(("t", w), (i, u, p))
            at.setdefault(("f", words[0]), (i, u, 0))
    top = lambda counts, kind, k: sorted(counts, key=lambda w: (-counts[w], at[kind, w]))[:k]
    return sorted(sizes), [(w, first[w]) for w in top(first, "f", 5)], [(w, every[w]) for w in top(every, "t", 9)]


@pytest.mark.parametrize("most", [3, 300_000])
def test_learned_structure_matches_the_loop(spark, monkeypatch, most):
    monkeypatch.setattr(stats, "TASK_TOKENS", most)
    rnd = random.Random(2)
    docs = [(i, "".join(rnd.choice(["ab", "cd", "ef", "gh", "ij"]) + rnd.choice([" ", " ", " ", ". ", "\n"]) for _ in range(rnd.randint(0, 30)))) for i in range(200)]
    rnd.shuffle(docs)
    frame = spark.createDataFrame(docs, "ord long, text string").repartition(5)
    sizes, first, every = _loop(docs)
    s = stats.learned_structure(frame, "text", ["ord"], 0.05, 0.95, 5, 9, True)
    assert [(r.token, r.n) for r in s["starters"].collect()] == first and [(r.token, r.n) for r in s["frequent"].collect()] == every
    want = (sizes[0], sizes[-1], sum(sizes) / len(sizes), sizes[int(len(sizes) * 0.05)], sizes[int(len(sizes) * 0.95)])
    for lengths in (s["lengths"], stats.learned_lengths(frame, "text", 0.05, 0.95, True)):
        r = lengths.first()
        assert (r.min_length, r.max_length, r.avg_length, r.detect_min, r.detect_max) == want


def test_the_texts_are_tokenised_once(spark):
    """The whole plan reads the corpus in one scan and shuffles counts, not tokens."""
    frame = spark.createDataFrame([(0, "a b. c")], "ord long, text string")
    plan = stats.learned_lengths(frame, "text", 0.05, 0.95)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Scan ExistingRDD" not in plan
