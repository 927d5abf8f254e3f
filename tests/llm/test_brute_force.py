"""The learnt operators and the pipeline's stages against plain versions of themselves."""

import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from helpers import shingle_counts, words

from paragram.llm import features, labelled, ranking, rules, toxicity
from paragram.llm.queries import QUERIES, labels
from paragram.llm.textbytes import buffers

# Bradley-Terry.


def pair_loss(model, good, bad, i, j, w, ridge):
    """The mean logistic loss of preferred minus other, pair by pair."""
    total = 0.0
    for a, b in zip(i, j, strict=True):
        total += np.log1p(np.exp(-((model.design(good[a : a + 1]) - model.design(bad[b : b + 1])) @ w).item()))
    return total / len(i) + ridge / 2 * float(w @ w)


def test_the_fit_is_the_least_pair_loss():
    rnd = np.random.default_rng(3)
    label = (rnd.random(60) < 0.7).astype(float)
    x = rnd.normal(size=(60, 2)) + 0.8 * label[:, None]
    model = ranking.fit(x, label, ridge=1e-2)
    good, bad = x[label == 1], x[label == 0]
    draw = np.random.default_rng(7)  # the operator's own pairs
    n = ranking.PAIRS * min(len(good), len(bad))
    i = np.concatenate([np.arange(len(good)), draw.integers(0, len(good), n)])
    j = np.concatenate([draw.integers(0, len(bad), len(good)), np.resize(np.arange(len(bad)), n)])
    least = pair_loss(model, good, bad, i, j, model.weights, 1e-2)
    for k in range(len(model.weights)):
        for step in (-0.05, 0.05):
            w = model.weights.copy()
            w[k] += step
            assert pair_loss(model, good, bad, i, j, w, 1e-2) > least
    s = np.sort(model.design(x) @ model.weights)
    assert model.threshold == s[int(np.ceil((len(s) - 1) * (label == 0).mean()))]


def test_all_quality_features_by_brute_force():
    texts = ["The Cat sat. The cat, SAT!!\nthe cat sat. the cat, sat on 12 mats & more", "a a a a b\na a a a b\n\nzz #1 <x>", "Über élan Ça va", "one", "x " * 30 + "\n" + "x " * 30]
    got = features.quality_matrix(*buffers(pa.array(texts)))
    for t, row in zip(texts, got, strict=True):
        w, size = words(t), len(t.encode())
        lines = [x for x in t.split("\n") if len(x.encode()) > 1]
        letters = re.findall(r"[A-Za-zÀ-ÿ]", t)
        upper = re.findall(r"[A-ZÀ-Þ]", t)
        count = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {p for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
        signs = [c for c in t if 32 < ord(c) < 127 and not c.isalnum()]
        want = {
            "symbols": sum(c in "#*$%&|<>" for c in t) / len(w), "capitals": len(upper) / max(1, len(letters)), "exclamations": t.count("!") / len(w), "digits": len(re.findall("[0-9]", t)) / size,
            "stops": sum(c in ".,;:" for c in t) / len(w), "signs": len(signs) / size, "word_length": len(letters) / len(w), "log_words": np.log1p(len(w)), "repeated": len(again) / len(w),
            "lines_again": (len(lines) - len(set(lines))) / max(1, len(lines)), "stutter": sum(a == b for a, b in zip(w, w[1:], strict=False)) / len(w),
            "distinct": len(set(w)) / max(1, min(len(w), 400 + np.sqrt(len(w)))), "line_words": np.log1p(len(w) / max(1, len(lines))),
        }
        assert tuple(want) == features.QUALITY
        assert np.allclose(row, list(want.values())), [(k, a, b) for (k, a), b in zip(want.items(), row, strict=True) if abs(a - b) > 1e-9]


# Trees and calibration.


def test_a_split_is_the_one_of_greatest_gain():
    rnd = np.random.default_rng(5)
    x = rnd.integers(0, 12, (300, 3)).astype(float)
    y = ((x[:, 1] > 5) ^ (rnd.random(300) < 0.2)).astype(float)
    ridge = 2.0
    model = toxicity.boost(x, y, rounds=2, depth=1, rate=0.5, ridge=ridge)
    score = np.full(len(y), model.base)
    for tree in model.trees:
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)

        def gain(left, g=g, h=h):
            parts = [(g[m].sum(), h[m].sum()) for m in (left, ~left)]
            return sum(a * a / (b + ridge) for a, b in parts) - g.sum() ** 2 / (h.sum() + ridge) if min(b for _, b in parts) >= 0.5 else 0

        best = max(gain(x[:, j] <= c) for j in range(3) for c in np.unique(x[:, j]))
        own = x[:, tree.feature[0]] <= tree.cut[0]
        assert abs(gain(own) - best) < 1e-9
        for leaf, mask in ((1, own), (2, ~own)):
            assert abs(tree.value[leaf] - 0.5 * g[mask].sum() / (h[mask].sum() + ridge)) < 1e-9
        score = score + np.where(own, tree.value[1], tree.value[2])
    assert np.allclose(model.raw(x), score)


def test_isotonic_by_minima_of_maxima():
    rnd = np.random.default_rng(8)
    score, y = rnd.permutation(80).astype(float), (rnd.random(80) < 0.5).astype(float)
    knots, values = toxicity.isotonic(score, y)
    at = y[np.argsort(score)]
    for i in range(80):
        want = max(min(at[a : b + 1].mean() for b in range(i, 80)) for a in range(i + 1))
        assert abs(np.interp(float(i), knots, values) - want) < 1e-9


def test_lexicon_by_brute_force(spark):
    rnd = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(30)] + ["Nasty!", "nasty", "vile"]
    rows = []
    for h in range(160):
        label = int(h % 3 == 0)
        chosen = rnd.choice(vocabulary[:30], 8).tolist() + (rnd.choice(vocabulary[30:], 2).tolist() if label and rnd.random() < 0.8 else [])
        rows.append((" ".join(chosen), label, h % 4, h))
    *_, got = toxicity.learn_lexicons(spark.createDataFrame(rows, "text string, label int, part int, h long"), 4)
    seen = defaultdict(lambda: [0, 0])
    for text, label, *_ in rows:
        own = {toxicity.bare(x) for x in words(text)} - {""}
        for t in {"w" + x for x in own} | {"b" + x[:n] for x in own for n in range(3, 9) if len(x) > n}:
            seen[t][label != 1] += 1
    n_toxic = sum(r[1] for r in rows)
    n_clean = len(rows) - n_toxic
    found = set()
    for t, (a, b) in seen.items():
        odds = np.log((a + 0.5) / (n_toxic + 1)) - np.log((b + 0.5) / (n_clean + 1))
        if a >= 3 and odds > 1.2 and odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) > 2.3:
            found.add(t)
    assert {"wnasty", "wvile"} <= found
    assert got.words == set(toxicity.INSULTS) | {t[1:] for t in found if t[0] == "w"} and got.beginnings == {t[1:] for t in found if t[0] == "b"}


def test_folds_by_brute_force(spark):
    rows = spark.range(-20, 200).selectExpr("id AS doc_id").withColumn("k", labelled.fold("doc_id", 3)).collect()
    assert all(r.k == zlib.crc32(str(r.doc_id).encode()) % 3 for r in rows)


# The pipeline.


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage on what the one before kept: name -> {doc_id: text}."""
    sf = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    out["documents"] = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        out[name] = {r.doc_id: r.text for r in docs.collect()}
    out["packing"] = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    out["model"] = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), labels(spark, sf))
    return out


def test_toxicity_stage(stages):
    before, model = stages["documents"], stages["model"]
    ids = sorted(before)
    x = model.lexicon.matrix(*buffers(pa.array([before[i] for i in ids])))
    raw = np.array([model.trees.base + sum(leaf(t, row) for t in model.trees.trees) for row in x])
    level = np.interp(raw, model.knots, model.values)
    score = 0.998 * level + 0.002 / (1 + np.exp(-raw))
    assert set(stages["toxicity"]) == {i for i, s in zip(ids, score, strict=True) if s < 0.7}


def leaf(tree, row):
    node = 0
    while tree.feature[node] >= 0:
        node = 2 * node + 1 + int(row[tree.feature[node]] > tree.cut[node])
    return tree.value[node]


def failed_rules(t):
    t = t or ""
    w, lines = words(t), [x for x in t.split("\n") if words(x)]
    n = len(w)
    count = Counter(tuple(w[i : i + 5]) for i in range(n - 4))
    repeated = len({p for i in range(n - 4) if count[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)})
    upper, letters = sum(c.isupper() for c in t), sum(c.isalpha() for c in t)
    again = len(lines) - len(set(lines))
    chars = sum(map(len, w))
    checks = (
        n < 10, 100 * repeated > 20 * n, 100 * sum(c in "#*$%&|<>" for c in t) > 10 * n, len(lines) >= 4 and 100 * again > 50 * len(lines), 100 * upper > 50 * letters, 100 * t.count("!") > 30 * n,
        chars < 2 * n or chars > 20 * n, 100 * sum(a == b for a, b in zip(w, w[1:], strict=False)) > 20 * n,
    )
    return sum(1 << i for i, bad in enumerate(checks) if bad)


def test_quality_stage(spark, stages):
    before = stages["toxicity"]
    assert set(stages["quality_rules"]) == {i for i, t in before.items() if not failed_rules(t)}
    book = rules.ledger(spark.createDataFrame(list(before.items()), "doc_id long, text string"))
    assert {r.doc_id: r.failure_bits for r in book.collect()} == {i: failed_rules(t) for i, t in before.items()}


def test_near_duplicate_stage(stages):
    before = stages["quality_rules"]
    ids = sorted(before)
    sets = {i: frozenset(shingle_counts(before[i])) for i in ids}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (common := len(sets[a] & sets[b])) and 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(stages["near_duplicates"]) == {find(i) for i in ids} and len(set(map(find, ids))) < len(ids)


def test_repeats_stage(stages):
    before, after = stages["near_duplicates"], stages["repeated_spans"]
    count = Counter(tuple(w[i : i + 35]) for w in map(words, before.values()) for i in range(len(w) - 34))
    assert set(after) == set(before)
    for i, t in before.items():
        w = words(t)
        gone = {p for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for p in range(k, k + 35)}
        assert after[i] == (" ".join(x for p, x in enumerate(w) if p not in gone) if gone else t)


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    from paragram.llm.queries import tokenizer_path

    tool = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    parts, places = defaultdict(list), defaultdict(list)
    for r in stages["packing"]:
        parts[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert set(parts) == set(stages["repeated_spans"])
    for i, own in parts.items():
        ids = np.array([*tool.encode(stages["repeated_spans"][i] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == 4096 or at & (at - 1) == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_have_a_row_for_each_document(spark, name):
    sf = "/root/testdata/sf0.001"
    got = QUERIES[name](spark, sf)
    if name != "rule_ablation":
        assert {r.doc_id for r in got.select("doc_id").collect()} == {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
