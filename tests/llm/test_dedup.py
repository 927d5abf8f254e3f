import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import SCHEMA, corpus, frame, shingle_counts, words

from paragram.llm import debruijn, ngram_join, weighted_sampling
from paragram.llm.components import components


def removed_by_brute_force(texts, k=35):
    count = Counter(tuple(w[i : i + k]) for w in map(words, texts) for i in range(len(w) - k + 1))
    out = []
    for t in texts:
        w = words(t)
        gone = set()
        for i in range(len(w) - k + 1):
            if count[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings(spark, seed):
    rows = corpus(seed=seed)
    rnd = random.Random(seed)
    few = ["a", "b", "c"]
    rows += [(1000 + i, " ".join(rnd.choices(few, k=300)), "en", "s", 1, "a", 7, 8, 9, "w") for i in range(3)]
    rows += [(2000 + i, (" ".join(["z", "y"] * 30) + " end") * (i + 1), "en", "s", 1, "a", 7, 8, 9, "w") for i in range(3)]
    want = Counter((r[0], *x) for r, x in zip(rows, removed_by_brute_force([r[1] for r in rows]), strict=True))
    got = debruijn.deduplicated(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_substrings_cleaned(spark):
    rows = corpus()
    got = debruijn.cleaned(frame(spark, rows))
    assert got.columns == [f.split(" ")[0] for f in SCHEMA.split(", ")]
    sha = {r[0]: x[2] for r, x in zip(rows, removed_by_brute_force([r[1] for r in rows]), strict=True)}
    for r in got.collect():
        if r.doc_id is not None:
            assert hashlib.sha256(" ".join(words(r.text)).encode()).hexdigest() == sha[r.doc_id] and r.n_chars == (None if r.text is None else len(r.text))
    assert debruijn.deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0


def links_by_brute_force(rows):
    """Per id: links and class, of rows with an id; rows that share an id are compared as rows."""
    sets = [(r[0], frozenset(shingle_counts(r[1]))) for r in rows if r[0] is not None]
    links, root = Counter(), {i: i for i in range(len(sets))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a][1] & sets[b][1])
            if common and 5 * common >= 4 * (len(sets[a][1]) + len(sets[b][1]) - common):
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    members = defaultdict(list)
    for i in range(len(sets)):
        members[find(i)].append(sets[i][0])
    return Counter((sets[i][0], min(members[find(i)]), links[i]) for i in range(len(sets)))


@pytest.mark.parametrize("block", [1024, 3])
def test_join(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", block)
    rows = corpus()
    base = " ".join(f"w{i}" for i in range(100)).split(" ")
    for i in range(9):
        base[i * 11] = f"v{i}"
        rows.append((500 + i, " ".join(base), "en", "s", 1, "a", 7, 8, 9, "w"))
    got = ngram_join.joined(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got if r.doc_id is not None) == links_by_brute_force(rows)
    assert [(r.class_id, r.n_links) for r in got if r.doc_id is None] == [(None, 0)] * 2
    assert ngram_join.joined(spark.createDataFrame([], SCHEMA)).count() == 0


def test_representatives(spark):
    rows = corpus()
    kept = ngram_join.representatives(frame(spark, rows)).collect()
    firsts = {c for _, c, _ in links_by_brute_force(rows)}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(firsts)
    # Of the two rows without an id one is a copy of a document.
    assert sum(r.doc_id is None for r in kept) == 1 and len(kept[0]) == 10


def test_bands_reach_the_recall():
    b = ngram_join.bands_for(0.8, 0.999, 4)
    assert 1 - (1 - 0.8**4) ** b >= 0.999 > 1 - (1 - 0.8**4) ** (b - 1)


def test_components(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + rnd.randrange(30), 100 + rnd.randrange(30)) for _ in range(20)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(80):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups(got) == [g for g in groups({k: root[k] for k in root if any(k in e and e[0] != e[1] for e in edges)})]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_weighted_sampling_rate():
    """The collision rate of the signatures is the generalised Jaccard similarity."""
    rnd = np.random.default_rng(3)
    off = []
    for _ in range(40):
        terms = rnd.integers(1, 2**63, 60, dtype=np.uint64)
        a, b = rnd.integers(0, 4, 60), rnd.integers(0, 4, 60)
        row = np.concatenate([np.zeros((a > 0).sum()), np.ones((b > 0).sum())]).astype(np.int64)
        codes = weighted_sampling.signatures(row, np.concatenate([terms[a > 0], terms[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2)
        off.append(weighted_sampling.likeness(codes[0], codes[1]) - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.03 and np.std(off) < 0.1


def test_gamma_draws():
    h = np.random.default_rng(1).integers(1, 2**63, 200_000, dtype=np.uint64)
    value, _ = weighted_sampling.weighted_samples(h, np.full(len(h), 3.0), 5)
    assert abs(value.mean() - 1 / 3) < 0.01 and abs((value > 1 / 3).mean() - math.exp(-1)) < 0.01  # exponential of rate 3


def test_edited_fingerprints(spark):
    rows = [r for r in corpus(30) if r[0] is not None]
    seen, ordered = set(), []
    for r in sorted(rows, key=lambda r: r[0]):
        ordered.append((r[0], r[1] or ""))
        seen.add(r[0])
    got = defaultdict(list)
    for r in weighted_sampling.edited_fingerprints(frame(spark, rows), slice_chars=3000).collect():
        got[r.doc_id].append(r)
    same, off = {}, []
    for i, (d, t) in enumerate(ordered):
        nxt = ordered[(i + 1) % len(ordered)][1]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = next(x for x in got[d] if x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest())
        got[d].remove(r)
        assert r.n_chars == len(t) and same.setdefault(t, r.fingerprint) == r.fingerprint
        a, b = shingle_counts(t), shingle_counts(edited)
        if a and b:
            off.append(r.near_edited - sum((a & b).values()) / sum((a | b).values()))
    assert not any(got.values()) and abs(np.mean(off)) < 0.03
    one = weighted_sampling.edited_fingerprints(frame(spark, [(5, "a b c d e f", "", "", 1, "", 1, 1, 1, "")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert weighted_sampling.edited_fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    plain = {r.doc_id: r.fingerprint for r in weighted_sampling.fingerprint(frame(spark, rows)).collect()}
    assert plain[0] == same[next(t for d, t in ordered if d == 0)]
