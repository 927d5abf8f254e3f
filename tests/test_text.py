import random
import re
import unicodedata

from pyspark.sql import functions as F

from paragram.functions import lang as L
from paragram.functions import similarity, split as S
from paragram.functions import text as T


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("v")).first()["v"]


def test_unicode_white_space(spark):
    assert one(spark, T.clean_text, "A\xa0\u2003b\x1cc ") == "a b c"
    assert one(spark, T.words, " a\u3000b \n") == ["a", "b"]
    assert one(spark, T.words, "") == []


def test_markup_and_signs(spark):
    assert one(spark, T.strip_markup, "ab <big> {x}[y] (12) fig. 3 p12q") == "ab <gap> x y p12q"
    assert one(spark, T.normalize_signs, "a — b–c, d/e|f... g!") == "a-b-c d e f g"
    assert one(spark, T.normalize_transliteration, "[...] x x x sz Ḫa") == "<gap> <gap> š Ha"
    assert one(spark, T.normalize_transliteration, None) == ""
    assert one(spark, T.normalize_id, " KT, a/k  12 | other") == "kta/k12"
    assert one(spark, T.clean_translation, "a\r\nrev. b\n12\nc-\nd\n 3 e") == "a b c" + "d e"


def test_letters(spark):
    assert one(spark, T.has_letter, "Š") is True
    assert one(spark, T.only_signs, "1... [2]") is True
    assert abs(one(spark, T.alpha_ratio, "ab 1") - 2 / 3) < 1e-12
    assert one(spark, T.alpha_ratio, " ") == 0.0


def test_tokens(spark):
    assert one(spark, S.lexical_tokens, "(sig₅) <gap> a-b, --") == ["sig5", "<gap>", "a-b"]
    assert set(one(spark, S.variants, "a-bc")) == {"a-bc", "abc", "a", "bc"}
    assert one(spark, S.sentences, 'A b. C d! "E" f? g. “H') == ["A b.", "C d!", '"E" f? g.', "“H"]
    assert one(spark, S.sentences, " ") == []
    assert one(spark, S.units, "a.b\n c ") == ["a", "b", "c"]
    assert one(spark, lambda c: S.ngrams(F.split(c, " "), 3), "a b") == []


def test_edge_strip_matches_python(spark):
    random.seed(3)
    signs = [chr(i) for i in range(33, 0x250) if unicodedata.category(chr(i))[0] in "LNPS"]
    tokens = ["".join(random.choices(signs, k=random.randint(1, 6))) for _ in range(400)]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i int, t string").orderBy("i").select(T.edge_strip(F.col("t"))).collect()]
    assert got == [re.sub(r"^[^\w<]+|[^\w>]+$", "", t) for t in tokens]


def test_line_windows_and_rejoin(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, ["x", "y", "z"])], "k int, l array<string>")
    got = sorted((r.k, r.window_size, r.start, r.window_text) for r in S.line_windows(df, "l").collect())
    assert got == [(1, 1, 0, "a"), (1, 1, 1, "b"), (1, 2, 0, "a b"), (3, 1, 0, "x"), (3, 1, 1, "y"), (3, 1, 2, "z"), (3, 2, 0, "x y"), (3, 2, 1, "y z"), (3, 3, 0, "x y z")]
    random.seed(5)
    rows = [(i, random.choices("abc", k=random.randint(1, 9))) for i in range(150)]
    forms = {"a-b", "b-c", "a-a"}
    want = {}
    for i, t in rows:
        out, j = [], 0
        while j < len(t):
            if j + 1 < len(t) and f"{t[j]}-{t[j + 1]}" in forms:
                out.append(f"{t[j]}-{t[j + 1]}")
                j += 2
            else:
                out.append(t[j])
                j += 1
        want[i] = " ".join(out)
    got = S.rejoin_hyphens(spark.createDataFrame(rows, "k int, t array<string>"), ["k"], "t", spark.createDataFrame([(f,) for f in forms], "form string"))
    assert {r.k: r.rejoined for r in got.collect()} == want


def test_languages(spark):
    assert one(spark, L.detect_language, "the cat and dog") == "en"
    assert one(spark, L.detect_language, "der hund und die katze") == "de"
    assert one(spark, L.detect_language, "xx yy zz") == "unknown"
    assert one(spark, L.detect_language, "the") == "unknown"
    assert one(spark, L.english_or_none, "le chat et la table") is None
    assert one(spark, L.is_surface, "um-ma x") is True and one(spark, L.is_surface, "UM-MA") is False
    assert one(spark, L.is_surface_any_case, "UM-MA") is True
    assert one(spark, L.sentence_like_v3, "12 34 56.") is True and one(spark, L.sentence_like_v32, "12 34 56.") is False


def test_similarity(spark):
    from difflib import SequenceMatcher

    pairs = [("tide", "diet"), ("diet", "tide"), ("", ""), ("abc", "abcd"), ("ab" * 150, "ab" * 140), ("a", "bbbbbbbbbb")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r, (a, b) in zip(df.select(similarity.fuzzy_ratio(F.col("a"), F.col("b")).alias("r"), similarity.ratio_bound(F.col("a"), F.col("b")).alias("u"), similarity.fuzzy_ratio(F.col("a"), F.col("b"), 0.8).alias("g")).collect(), pairs, strict=True):
        want = SequenceMatcher(None, a, b).ratio()
        assert r.r == want and r.u >= want and (r.g > 0.8) == (want > 0.8)


def test_references_and_numbers_are_bounded_by_ascii_words(spark):
    """As \\b of the SQL: a letter beyond ASCII ends a word."""
    assert one(spark, T.normalize_signs, "ción 4879548823211410 ñ é12 a12 12b") == "ció ñ é a12 12b"
    assert one(spark, S.lexical_tokens, "nació n 77 osción 5é") == ["nació", "osció", "é"]


def test_plain_functions_match_the_columns(spark):
    from paragram.functions import plain

    random.seed(9)
    signs = list("abcnz šṣḫñéÄ 12 45 ₃² <>[](){} -—– .,;:!?/| \"'_\n\t\xa0　\x00﻿") + ["fig. 12", "n 7", "the ", "note 3", " - ", "table", "<big>", "ción"]
    texts = ["".join(random.choices(signs, k=random.randint(0, 40))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    c = F.col("t")
    made = {
        plain.signs: T.normalize_signs(c), plain.canonical: T.canonical(c), plain.clean: T.clean_text(c), plain.clean_marks: T.clean_text_marks(c), plain.clean_digits: T.clean_text_digits(c), plain.tokens: S.lexical_tokens(c),
        lambda x: plain.tokens(x, plain.clean_marks): S.lexical_tokens(c, T.clean_text_marks), plain.lines: S.lines(c), plain.units: S.units(c), plain.english_score: L.english_score(c), plain.alpha_ratio: T.alpha_ratio(c),
        lambda x: plain.units(x, plain.clean_marks): S.normalized_units(c, T.clean_text_marks), lambda x: [plain.variants(w) for w in plain.tokens(x)]: F.transform(S.lexical_tokens(c), S.variants),
        lambda x: plain.sentence_and_english(x, "v3"): L.sentence_like_v3(c) & L.english_like_share(c), lambda x: plain.sentence_and_english(x, "v31"): L.sentence_like_v31(c) & L.english_like_alpha(c),
        lambda x: plain.sentence_and_english(x, "v32"): L.sentence_like_v32(c) & L.english_like_alpha(c, L.ENGLISH_33, 0.60),
    }
    rows = df.orderBy("i").select(*[v.alias(f"v{k}") for k, v in enumerate(made.values())]).collect()
    for k, f in enumerate(made):
        assert [f(x) for x in texts] == [r[k] for r in rows], k
