import random

import pytest
from pyspark.sql import functions as F

from paragram.operators import align, retrieval


def texts(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("ab-c", k=rnd.randint(1, 9)))
    hay = [" ".join(word() for _ in range(rnd.randint(0, 14))) for _ in range(60)] + ["", "  ", "q" * 300 + " tail", None]
    needles = [h[i : i + rnd.randint(1, 25)] for h in hay[:60] for i in (rnd.randrange(max(1, len(h))), 0)]
    needles += [" ".join(word() for _ in range(rnd.randint(1, 4))) for _ in range(60)] + ["", " ", "q" * 250, "q tai", "-", "--", "a b", None]
    return hay, needles


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("few", [10**6, 0])
def test_contained_by_brute_force(spark, monkeypatch, seed, few):
    monkeypatch.setattr(retrieval, "FEW", few)
    hay, needles = texts(seed)
    h = spark.createDataFrame(list(enumerate(hay)), "id long, t string")
    n = spark.createDataFrame([(x,) for x in needles], "needle string")
    got = retrieval.contained(h, ["id"], "t", n, "needle").collect()
    want = {(i, x) for i, t in enumerate(hay) for x in needles if t is not None and x and x in t}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    lines = spark.createDataFrame(list(enumerate(needles)), "k long, line string")
    kept = {r.k for r in retrieval.lines_in_references(lines, "line", h, "t").collect()}
    known = [t for t in hay if t is not None]
    assert kept == {k for k, x in enumerate(needles) if x and any(x in t or x.replace("-", "") in t.replace("-", "") for t in known)}
    none = h.where("id < 0")
    assert retrieval.lines_in_references(lines, "line", none, "t").count() == 0 == retrieval.contained(none, ["id"], "t", n, "needle").count()


def test_no_nested_loop_over_many(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "FEW", 0)
    h = spark.range(9).selectExpr("id", "concat('word', id, ' other') AS t")
    plan = retrieval.contained(h, ["id"], "t", h.select(F.col("t").alias("needle")), "needle").select("id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (word" in plan


def test_near_in_page_is_near_lines(spark):
    rnd = random.Random(3)
    pages = [(p, [f"line {i}" for i in range(rnd.randint(0, 25))]) for p in range(20)]
    df = spark.createDataFrame([(p, x, [rnd.random() < 0.3 for _ in x], [rnd.random() < 0.3 for _ in x]) for p, x in pages], "p long, l array<string>, a array<boolean>, b array<boolean>").cache()
    rows = df.select("p", F.posexplode(F.arrays_zip("l", "a", "b")).alias("line_no", "z")).select("p", "line_no", F.col("z.l").alias("line"), "z.a", "z.b")
    for most in (1, 3, 6):
        want = align.near_lines(rows.where("a").select("p", "line_no", "line"), rows.where("b").select("p", "line_no", "line"), ["p"], most)
        columns = ["p", "line_no", "line", "b_no", "b_line", "distance"]
        got = align.near_in_page(df, ["p"], "l", "a", "b", most)
        assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
