"""Odd and plain texts that every operator must take, and brute-force views of them."""

import random
import re
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, t long, r long, x long, words string"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def corpus(n=60, seed=1):
    """Nulls, empty and long texts, copies, near copies, shared passages, ties, repeated rows, odd signs; columns with clashing names."""
    rnd = random.Random(seed)
    pool = ["".join(rnd.choices("abcdefghé", k=rnd.randint(2, 7))) for _ in range(900)]
    make = lambda k: " ".join(rnd.choices(pool, k=k))
    passage = make(60)
    texts = [make(rnd.randint(12, 150)) for _ in range(n)]
    texts += [texts[0]] * 4 + [f"{texts[i]} {passage} {texts[i + 1]}" for i in range(2, 8)]
    near = make(120).split(" ")
    for _ in range(5):
        changed = list(near)
        changed[rnd.randrange(120)] = "changed" + str(rnd.randrange(99))
        texts.append(" ".join(changed))
    texts += [None, "", " \n\t ", "one", "one two three", "one two three", make(9000), "x" * 4000, "日本語 テスト\n" * 3, "<|endoftext|> a <s> ▁b", "line\n" * 50, " ".join(["same"] * 80), texts[1].upper() + "!!!"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(3, texts[3]), (3, texts[3]), (None, make(40)), (None, texts[5])]
    rnd.shuffle(rows)
    return [(i, t, "en", "s", None if t is None else len(t), "a", 7, 8, 9, "w") for i, t in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA).repartition(3)


def shingle_counts(t, k=5):
    w = words(t)
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)] if w else [])
