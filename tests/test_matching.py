"""In-worker search against plain loops and against the joins it stands for."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from paragram.functions import split as S
from paragram.operators import matching, retrieval
from paragram.plans import pages
from paragram.plans.profiles import SURFACES


def _text(rnd, n):
    return " ".join(rnd.choice("alpha beta gamma delta eta zeta theta iota a-na ku-li qi-bi um-ma".split()) for _ in range(n))


def test_bounds_are_above_the_ratio(spark):
    rnd = random.Random(4)
    texts = ["", *["".join(rnd.choices("ab cdé", k=rnd.randint(1, 260))) for _ in range(60)]]
    strings, at = matching.Strings(texts), np.arange(len(texts))
    for a in texts[::5]:
        rough, close = strings.bound(a, at), strings.close_bound(a, at)
        for i, b in enumerate(texts):
            ratio = SequenceMatcher(None, a, b).ratio()
            assert strings.ratio(a, i) == ratio <= close[i] + 1e-12 and close[i] <= rough[i] + 1e-12


def test_common_subsequence_matches_the_table():
    rnd = random.Random(6)
    texts = ["".join(rnd.choices("abc", k=rnd.randint(1, 40))) for _ in range(30)]
    for a in texts:
        want = []
        for b in texts:
            row = [0] * (len(b) + 1)
            for x in a:
                row = [0] + [0] * len(b) if not row else [0, *row[1:]]
                last = row[:]
                for j, y in enumerate(b):
                    row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
            want.append(row[-1])
        assert list(matching.common(a, [matching.masks(b) for b in texts])) == want


@pytest.mark.parametrize("name", ["v3", "v31", "v32"])
def test_pages_by_row_and_by_joins_agree(spark, monkeypatch, name):
    rnd = random.Random(8)
    refs = [(i, ".".join(_text(rnd, rnd.randint(2, 6)) for _ in range(3)), f"kt {i % 5}|kt {rnd.randrange(9)}") for i in range(14)]
    lines = lambda: [rnd.choice([_text(rnd, rnd.randint(2, 7)), rnd.choice(refs)[1].replace(".", " "), rnd.choice(rnd.choice(refs)[1].split(".")), "he said that the silver is in the city of his father."]) for _ in range(12)]
    docs = [(i, "\n".join([f"letter kt {rnd.randrange(14)}", *lines()])) for i in range(25)] + [(99, None)]
    page, frame = spark.createDataFrame(docs, "page_id long, page_text string"), spark.createDataFrame(refs, "ref long, ref_text string, aliases string")
    corpus = frame.selectExpr("ref AS ord", "ref_text AS text")

    def mined():
        out = pages.mined(page, frame, corpus, retrieval.lexicon(frame, "ref_text", True), SURFACES[name], surface=lambda c: c.rlike("[a-z]"), least=2, accept=5)
        return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in out.collect())

    by_row = mined()
    monkeypatch.setattr(retrieval, "few", lambda *a, **k: None)
    assert by_row and by_row == mined()


def test_no_window_is_cut_from_the_pool():
    """A window beyond the first 180 of its tokens, outside a pool of 40 and a shortlist of 6, is found."""
    refs = [(i, f"alpha beta gamma w{i}") for i in range(300)] + [(300, "alpha beta gamma delta")]
    found = matching.Windows(refs, [])("alpha beta gamma delt", ())
    assert found and found[1] == "alpha beta gamma delta"


def test_few_and_many_give_the_same(spark, monkeypatch):
    rnd = random.Random(1)
    texts = spark.createDataFrame([(i, _text(rnd, 9)) for i in range(60)] + [(99, None)], "k int, t string")
    needles = spark.createDataFrame([("alpha beta",), ("na ku",), ("",), (None,), ("ta", )], "n string")
    refs = spark.createDataFrame([("alpha beta gamma",), (None,), ("ana kuli qi-bi",)], "r string")
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(["alpha", "a-na ku-li", "--", "", None, "beta gamma", "qibi", "nothing of it"])], "k int, l string")
    words = texts.selectExpr("k", "split(t, ' ') AS w")
    forms = spark.createDataFrame([("alpha-beta",), ("beta-alpha",), ("eta-zeta",), ("iota",)], "form string")

    def results():
        yield sorted(map(tuple, retrieval.contained(texts, ["k"], "t", needles, "n").collect()))
        yield sorted(r.k for r in retrieval.lines_in_references(lines, "l", refs, "r").collect())
        yield sorted(map(tuple, S.rejoin_hyphens(words, ["k"], "w", forms).collect()))
        for variants in (True, False):
            yield sorted(map(tuple, retrieval.membership(words, ["k"], "w", forms, variants).select("k", "n_tokens", "n_hits", "coverage").collect()))

    few = list(results())
    monkeypatch.setattr(retrieval, "few", lambda *a, **k: None)
    assert few == list(results()) and all(few)
