"""Texts that meet in a polynomial hash modulo 2**64 stay apart everywhere, and a cache hit is compared byte by byte."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import words

from paragram.llm import chunks, debruijn, ngram_join, packing, prefix_counts, sstable, storage, suffix_matching, textbytes, tokens
from paragram.llm.queries import tokenizer_path
from paragram.llm.textbytes import buffers, words_of

A = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))  # the Thue-Morse word
B = A.translate(str.maketrans("ab", "ba"))
SEQUENCES = (" ".join(A), " ".join(B))
PIECES = tokenizer_path("piece_bpe_32k.model")


def test_spans_and_sequences_differ():
    for pair in ((A, B), SEQUENCES):
        w = words_of(*buffers(pa.array(pair)))
        for seed in (textbytes.ONE, textbytes.TWO):
            h = w.hashes(seed)
            sums = textbytes.range_hashes(h, w.first[:-1], w.first[1:])
            assert sums[0] != sums[1]
        assert len(set(ngram_join.text_keys(w).tolist())) == 2 == len(set(zip(*(k.tolist() for k in debruijn.text_keys(textbytes.word_digests(w))), strict=True)))


def test_span_hashes_depend_on_the_span_alone():
    rnd = np.random.default_rng(1)
    texts = ["".join(rnd.choice(list("abé\x00"), n)) for n in (0, 1, 7, 8, 9, 16, 63, 64, 65, 200) for _ in range(3)]
    joined = [t for t in texts for _ in range(2)]
    rnd.shuffle(joined)
    raw, offsets = buffers(pa.array(joined))
    found = {}
    for t, h in zip(joined, textbytes.span_hashes(raw, offsets[:-1], offsets[1:]).tolist(), strict=True):
        assert found.setdefault(t, h) == h
    assert len(set(found.values())) == len(found)
    same = textbytes.same_spans(raw, offsets[:-1], offsets[1:], raw, np.roll(offsets[:-1], 1), np.roll(offsets[1:], 1))
    assert same.tolist() == [joined[i] == joined[i - 1] for i in range(len(joined))]
    h = textbytes.span_hashes(raw, offsets[:-1], offsets[1:])
    assert textbytes.window_hashes(h, 5).tolist() == textbytes.range_hashes(h, np.arange(len(h) - 4), np.arange(5, len(h) + 1)).tolist()


def test_a_cache_compares_the_bytes(monkeypatch):
    monkeypatch.setattr(chunks, "span_hashes", lambda raw, start, end: np.zeros(len(start), dtype=np.uint64))
    cache = chunks.ChunkCache(np.int32, 100)
    make = lambda texts: (np.array([ord(c) for t in texts for c in t]), np.array([len(t) for t in texts]))
    for batch in (["ab", "c", "ab", "", "c"], ["c", "ab", "d" * 900, "ab"], ["d" * 900, "d" * 899 + "e"]):
        raw, offsets = buffers(pa.array(batch))
        values, at = cache.rows(raw, offsets[:-1], offsets[1:], make)
        assert ["".join(map(chr, values[at[i] : at[i + 1]])) for i in range(len(batch))] == batch


@pytest.mark.parametrize("pair", [(A, B), SEQUENCES])
def test_tokens(spark, pair):
    import sentencepiece
    from tokenizers import Tokenizer

    df = spark.createDataFrame(list(enumerate(pair)), "doc_id long, text string").coalesce(1)
    want = lambda name: {i: [*Tokenizer.from_file(tokenizer_path(name)).encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(pair)}
    folder = storage.scratch(spark, "t")
    rows = sstable.read_shards(spark, folder, sstable.write_shards(df, folder, tokenizer_path("byte_bpe_50k.json"), 2)).collect()
    assert {r.doc_id: r.ids_crc32 for r in rows} == {i: tokens.crc(np.array(x)) for i, x in want("byte_bpe_50k.json").items()}
    got = {}
    for r in sorted(packing.pack(df, tokenizer_path("word_bpe_49k.json"), 2, with_ids=True).collect(), key=lambda r: r.start):
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, dtype="<u4").tolist())
    assert got == want("word_bpe_49k.json")
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert {r.doc_id: list(r.ids) for r in suffix_matching.encode(df, PIECES).collect()} == {i: lib.encode(t) for i, t in enumerate(pair)}
    assert {r.doc_id: r.n_tokens for r in prefix_counts.prefix_counts(prefix_counts.stored_tables(df, PIECES)).collect()} == {i: len(lib.encode(t)) for i, t in enumerate(pair)}


def test_duplicates(spark):
    around = [f"w{i}" for i in range(40)]
    texts = [" ".join([*around[:20], x, *around[20:]]) for x in (A, B)]
    got = debruijn.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.n_words, r.n_removed) for r in got} == {(41, 0)}
    assert {r.kept_sha256 for r in got} == {hashlib.sha256(t.encode()).hexdigest() for t in texts}
    for pair in ((A, B), SEQUENCES):
        rows = ngram_join.joined(spark.createDataFrame(list(enumerate(pair)), "doc_id long, text string")).collect()
        alike = len({*words(pair[0])}) == 2  # the sequences have the same few shingles, but are no copies
        assert {r.n_copies for r in rows} == {1} and len({r.class_id for r in rows}) == (1 if alike else 2)


def test_one_cache_of_a_process_holds_something():
    make = lambda texts: (np.zeros(len(texts)), np.ones(len(texts), dtype=np.int64))
    raw, offsets = buffers(pa.array(["a", "b"]))
    one, two = chunks.ChunkCache(np.int8), chunks.ChunkCache(np.int8)
    one.rows(raw, offsets[:-1], offsets[1:], make)
    assert len(one.keys) == 2
    two.rows(raw, offsets[:-1], offsets[1:], make)
    assert len(one.keys) == 0 and len(two.keys) == 2
