import random
import statistics

from pyspark.sql import functions as F

from paragram.operators import align, archive, dataset, dedup, metrics, retrieval, scoring, stats
from paragram.plans import expansion, importing, pages
from paragram.plans.profiles import V41, V42, V51


def test_zip_stops_at_the_shorter_side(spark):
    df = spark.createDataFrame([(1, "aaaaa\nbbbbb\nccccc", "ddddd.eeeee"), (2, None, "x"), (3, "", "")], "ord int, src string, tgt string")
    got = align.unit_pairs(df).collect()
    assert sorted((r.pos, r.src, r.tgt) for r in got) == [(0, "aaaaa", "ddddd"), (1, "bbbbb", "eeeee")]


def test_proportional_chunks_match_the_loop(spark):
    random.seed(11)
    rows = []
    for i in range(120):
        src = " ".join(f"w{j}" for j in range(random.randint(1, 12)))
        tgt = " ".join("Ab" + "c" * random.randint(0, 20) + random.choice(".!?") for _ in range(random.randint(1, 6)))
        rows.append((i, src, tgt))
    got = {}
    for r in align.proportional_chunks(spark.createDataFrame(rows, "i int, src string, tgt string")).collect():
        got.setdefault(r.i, []).append((r.k, r.src, r.tgt))
    for i, src, tgt in rows:
        sents, words, at, want = tgt.split(" "), src.split(), 0, []
        if len(sents) < 2:
            assert i not in got
            continue
        for s in sents:
            end = min(at + max(1, round(len(words) * (len(s) / len(tgt)))), len(words))
            want.append([" ".join(words[at:end]), s])
            at = end
        want[-1][0] = (want[-1][0] + " " + " ".join(words[at:])).strip()
        chunks = [list(x[1:]) for x in sorted(got[i])]
        assert chunks == want and " ".join(c[0] for c in chunks if c[0]) == src


def test_rank_percentiles(spark):
    random.seed(2)
    for n in (1, 2, 7, 99, 100):
        values = [random.randint(0, 20) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in values], "v int")
        r = stats.rank_percentiles(df, "v", {"a": 0.15, "b": 0.85}).first()
        assert (r.a, r.b) == tuple(sorted(values)[int(p * n)] for p in (0.15, 0.85))


def test_stats_and_ties(spark):
    pairs = [("a b c", "d e"), ("a", "b c d e"), ("a b", "c d")]
    r = stats.baseline_stats(spark.createDataFrame(pairs, "src string, tgt string"), 0.15, 0.85).first()
    assert r.ratio_med == statistics.median([2 / 3, 4.0, 1.0]) and r.src_min == 1 and r.tgt_max == 4
    c = stats.token_counts(spark.createDataFrame([(1, ["b", "a", "a", "b"]), (2, ["c", "c"])], "o int, t array<string>"), "t", "o")
    assert [x.token for x in stats.most_common(c, 2).collect()] == ["b", "a"]


def test_dedup(spark):
    df = spark.createDataFrame([("k", 2, "x"), ("k", 1, "y"), ("j", 3, None)], "k string, o int, v string")
    assert {r.k: r.v for r in dedup.keep_first(df, ["k"], "o").collect()} == {"k": "y", "j": None}
    assert {r.k: r.v for r in dedup.keep_last(df, ["k"], "o").collect()} == {"k": "x", "j": None}
    left = dedup.new_only(df.where("v is not null"), spark.createDataFrame([("k", "x")], "k string, v string"), ["k", "v"])
    assert [r.v for r in left.collect()] == ["y"]


def test_near_and_greedy_lines(spark):
    lines = spark.createDataFrame([(1, i, "e" if i in (0, 3, 5) else "s") for i in range(7)] + [(2, 0, "s")], "p int, line_no int, line string")
    near = align.near_lines(lines.where("line = 's'"), lines.where("line = 'e'"), ["p"], 3)
    assert {(r.line_no, r.b_no) for r in near.collect()} == {(1, 0), (2, 3), (4, 3), (6, 5)}
    page = spark.createDataFrame([(1, [(1, "s"), (2, "t"), (4, "u")], [(0, "e"), (3, "f")])], "p int, s array<struct<i:int,line:string>>, e array<struct<i:int,line:string>>")
    assert [(r.a, r.b) for r in align.greedy_lines(page, ["p"], "s", "e").collect()] == [(1, 0), (2, 3)]


def test_confidence_profiles(spark):
    """Hand-computed scores: the source side, the English side and the bands added up."""
    src, tgt = "a-na ku-li qí-bi um-ma x y", "say to kuli, the man and the woman are here."
    df = spark.createDataFrame([(src, tgt)], "src string, tgt string")
    one = df.crossJoin(spark.createDataFrame([(3, 20, 6, 30, 5 / 3, 1.7)], "src_min int, src_max int, tgt_min int, tgt_max int, ratio_med double, ratio_avg double"))
    assert scoring.scored(one, V51).first().confidence == (2 + 2 + 1 + 1) + (2 + 1 + 2 + 1 + 1 - 0) + 2 + 2 + 3
    assert scoring.scored(one, V42).first().confidence == (2 + 2 + 1 + 1 + 1 + 1) + (2 + 1 + 2 + 1 + 1) + 2 + 2 + 3
    assert scoring.scored(one, V41).first().confidence == (2 + 1 + 1 + 1 + 1 + 1) + (2 + 1 + 1 + 1 + 1 + 1) + 2 + 1 + 1


def test_noise_without_division(spark):
    df = spark.createDataFrame([("", "abc"), ("abc", "ab"), ("abcd", "efgh")], "src string, tgt string")
    assert [r[0] for r in df.select(scoring.char_ratio_noise(F.col("src"), F.col("tgt"), V42)).collect()] == [True, True, False]


def test_expansion_invariants(spark, sf):
    from paragram import fixtures as X
    from paragram.plans.profiles import V4

    e = X.exchanges(spark, sf)
    base, new, all_ = align.baseline_pairs(e, ["conv_id", "turn"]), expansion.expand(e, ["conv_id", "turn"], V4), expansion.merged_corpus(e, ["conv_id", "turn"], V4)
    assert base.count() + new.count() == all_.count() == all_.select("src", "tgt").distinct().count()


def test_archive(spark):
    published = spark.createDataFrame([(0, "A", "x, 1|Y", "k1 ", "t0"), (1, "B", "X1;z", "k2", "t1"), (2, "C", None, None, "t2")], "ord int, ref_id string, aliases string, excavation_no string, transliteration string")
    literals = spark.createDataFrame([(0, "alias", " X 1", "a-\nb"), (1, "excavation", "k1", "c"), (2, "excavation", "k2", "again"), (3, "alias", "none", "d")], "ord int, source_kind string, match_key string, translation string")
    got = archive.archive_pairs(literals, published, spark.createDataFrame([("A",)], "ref_id string")).collect()
    assert sorted((r.source, r.ref_id, r.is_new, r.translation) for r in got) == [("archive_alias", "B", True, "ab"), ("excavation_match", "A", False, "c")]


def test_import_counts(spark, sf):
    from paragram import fixtures as X

    x = X.external(spark, sf)
    active = importing.imported(x, x.select("src", "tgt").limit(0)).select("src", "tgt").limit(3)
    r = importing.import_stats(x, active).first()
    assert r.external_unique == r.already_in_active + r.filtered_out + r.imported_new
    assert r.imported_new == r.train_kept + r.valid_kept + r.test_kept == importing.imported(x, active).count()


def test_split_sizes_and_vocabulary(spark):
    df = spark.createDataFrame([(i, f"w{i % 7} w{i % 3} rare{i}") for i in range(90)], "i int, t string").withColumn("key", dataset.shuffle_key(42, "t"))
    s = dataset.split(df, "key", ["i"], 1 << 62).collect()
    assert sorted(r["rank"] for r in s) == list(range(90))
    assert [sum(r.part == p for r in s) for p in ("train", "valid", "test")] == [int(90 * 0.7), int(90 * 0.15), 90 - int(90 * 0.7) - int(90 * 0.15)]
    v = dataset.vocabulary(df, "t", ["i"], 8, 2)
    ids = {r.token: r.id for r in v.collect()}
    assert ids["<pad>"] == 0 and ids["w0"] == 4 and len(ids) == 8 and "rare1" not in ids
    e = dataset.encode(spark.createDataFrame([(1, "w0 zz"), (2, "")], "i int, t string"), ["i"], "t", v, bos=True, eos=True)
    assert {r.i: r.ids for r in e.collect()} == {1: [2, 4, 1, 3], 2: [2, 3]}
    back = dataset.decode(spark.createDataFrame([(1, [2, 1, 4, 3, 4])], "i int, ids array<int>"), ["i"], "ids", v)
    assert back.first().text == "<unk> w0"
    p = dataset.padded(spark.createDataFrame([(0, [4]), (1, [4, 5]), (2, [6])], "rank int, ids array<int>"), "rank", 2, "ids")
    assert {r["rank"]: (r.ids, r.ids_length) for r in p.collect()} == {0: ([4, 0], 1), 1: ([4, 5], 2), 2: ([6], 1)}


def test_metrics(spark):
    import math

    df = spark.createDataFrame([(1, "a b c d", "a b c d"), (2, "a a", "a b c")], "k int, p string, r string")
    got = metrics.corpus_bleu(df, ["k"], "p", "r").first().bleu
    prec = [(5 + 1) / (6 + 1), (3 + 1) / (4 + 1), (2 + 1) / (2 + 1), (1 + 1) / (1 + 1)]
    assert abs(got - math.exp(1 - 7 / 6) * math.exp(sum(map(math.log, prec)) / 4) * 100) < 1e-9
    r = metrics.accuracy(df, "p", "r").first()
    assert r.exact_match == 0.5 and abs(r.token_accuracy - 5 / 7) < 1e-12
    assert metrics.corpus_bleu(df.limit(0), ["k"], "p", "r").first().bleu == 0.0
    assert metrics.weighted_loss(spark.createDataFrame([(30.0, 1)], "l double, n int"), "l", "n").first().perplexity == math.exp(20)


def test_retrieval(spark):
    refs = spark.createDataFrame([(0, "alpha beta gamma\ndelta alpha", "kt 1"), (1, "beta beta zeta", "")], "ref long, ref_text string, aliases string")
    w = retrieval.reference_windows(refs, "ref", "ref_text")
    assert w.count() == 4  # two lines and their pair; one line
    idf = {r.token: r.idf for r in retrieval.idf_table(w).collect()}
    assert idf["zeta"] > idf["beta"]
    c = spark.createDataFrame([(1, ["zeta", "beta", "nope"])], "k int, tokens array<string>")
    pool = retrieval.retrieve(c, ["k"], "tokens", w, retrieval.idf_table(w))
    best = pool.where("pool_rank = 1").first()
    assert best.ref_id == 4_000_000 + 1_000_000
    coarse = retrieval.rerank_coarse(c, ["k"], "tokens", pool, w, retrieval.idf_table(w)).where("coarse_rank = 1").first()
    assert coarse.shared == 2


def test_mined_pages(spark):
    rows = [(1, "Letter KT 1\na-na ku-li qí-bi ma\nSay to the man and the woman of the city."), (2, "nothing here"), (3, None)]
    p = spark.createDataFrame(rows, "page_id int, page_text string")
    assert [(r.src, r.tgt) for r in pages.mined_greedy(p).collect()] == [("a-na ku-li qí-bi ma", "say to the man and the woman of the city.")]
    refs = spark.createDataFrame([("a-na ku-li qí-bi ma um-ma",)], "ref_text string")
    got = pages.mined_substring(p, refs, spark.createDataFrame([("KT 1",)], "alias string")).first()
    assert (got.tgt, got.score) == ("letter kt 1", 5 + 3 + 2 + 1)  # the line before wins the tie, and is not English
