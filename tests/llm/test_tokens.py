import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import SCHEMA, corpus, frame

from paragram.llm import packing, pieces, prefix_counts, sstable, storage, suffix_matching, tokens
from paragram.llm.queries import tokenizer_path
from paragram.llm.textbytes import buffers

PIECES = tokenizer_path("piece_bpe_32k.model")


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def library(name, texts):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokenizer_path(name))
    return [e.ids for e in tool.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunked_ids_are_the_librarys(name):
    odd = ["", None, "  a  b\n\n c\t", "<|endoftext|> x <|startoftext|>y", "é  b \u3000\u3000 c", "á ́b  x\r\n\r\ny  ", "I'll don't 123 ### \x1c \x85 z", "ΑΣ Σ ΟΔΟΣ İ", "x" * 3000, "日本語 。 b", "a <| b |>"]
    column = pa.array(odd + [r[1] for r in corpus()])
    got = [ids[b[i] : b[i + 1]].tolist() for _, ids, b in tokens.encoded_rows(column, tokenizer_path(name), 2) for i in range(len(b) - 1)]
    assert got == [ids + [2] for ids in library(name, column.to_pylist())]


def test_sstable_round_trip_and_lookup(spark):
    df, path = frame(spark), tokenizer_path("byte_bpe_50k.json")
    folder = storage.scratch(spark, "t")
    manifest = sstable.write_shards(df, folder, path, 2)
    rows = sstable.read_shards(spark, folder, manifest).orderBy("start").collect()
    docs = [(r[0], r[1]) for r in corpus()]
    want = {}
    for (i, _), ids in zip(docs, library("byte_bpe_50k.json", [t for _, t in docs]), strict=True):
        want.setdefault(i, []).append(crc([*ids, 2]))
    got, start = {}, 0
    for r in rows:
        assert r.start == start
        start += r.n_tokens
        got.setdefault(r.doc_id, []).append(r.ids_crc32)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    keys = [r.doc_id for r in rows]
    assert keys == sorted(keys, key=lambda x: (x is not None, x or 0))
    fs, base = storage.filesystem(folder)
    found = {}
    for m in manifest:
        shard = sstable.Shard(fs.open_input_file(m["path"]))
        for key in {*want, 10**9, -5}:
            found.setdefault(key, []).extend(crc(v) for v in shard.get(key))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()} | {10**9: [], -5: []}
    assert sstable.write_shards(df.limit(0), storage.scratch(spark, "t"), path, 2) == []
    assert sstable.read_shards(spark, folder, []).count() == 0


def test_shard_blocks_and_order(tmp_path, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 64)
    with open(tmp_path / "s", "wb") as f:
        w = sstable.ShardWriter(f, 2)
        for i in range(-50, 500):
            w.add(sstable.key_of(i), np.arange(i % 7, dtype="<u2").tobytes())
        with pytest.raises(ValueError):
            w.add(sstable.key_of(3), b"")
        w.finish()
    with open(tmp_path / "s", "rb") as f:
        s = sstable.Shard(f)
        assert len(s.index) > 20 and s.documents == 550
        assert all([v.tolist() for v in s.get(i)] == [list(range(i % 7))] for i in range(-50, 500))
        assert sum(s.may_hold(sstable.key_of(i)) for i in range(1000, 3000)) < 100


def check_pack(rows, texts, capacity):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    padding = sum(0 if (n := sum(x[1] for x in p)) & (n - 1) == 0 else capacity - n for p in by_seq.values())
    assert padding == 0
    assert sum(r.length for r in rows) == sum(len(ids) + 1 for ids in library("word_bpe_49k.json", texts))


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing(spark, capacity):
    texts = [r[1] for r in corpus()]
    got = packing.pack(frame(spark), tokenizer_path("word_bpe_49k.json"), 2, capacity, with_ids=True).collect()
    check_pack(got, texts, capacity)
    assert all(crc(np.frombuffer(r.ids, dtype="<u4")) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got)
    pieces_ = {}
    for r in sorted((r for r in got if r.doc_id is not None and r.doc_id != 3), key=lambda r: (r.doc_id, r.start)):
        pieces_.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, dtype="<u4").tolist())
    docs = [(r[0], r[1]) for r in corpus() if r[0] is not None and r[0] != 3]
    assert pieces_ == {i: [*ids, 2] for (i, _), ids in zip(docs, library("word_bpe_49k.json", [t for _, t in docs]), strict=True)}
    assert packing.pack(frame(spark).limit(0), tokenizer_path("word_bpe_49k.json"), 2).count() == 0


def test_shards_by_key_range_and_lookup(spark):
    folder = storage.scratch(spark, "t")
    df = spark.range(400).selectExpr("id * 3 - 600 AS doc_id", "concat('text ', id) AS text").repartition(3)
    manifest = sstable.write_shards(df, folder, tokenizer_path("byte_bpe_50k.json"), 2)
    ranges = [(sstable.id_of(bytes(m["first_key"])), sstable.id_of(bytes(m["last_key"]))) for m in manifest]
    assert ranges[0][0] == -600 and ranges[-1][1] == 597 and all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert all(r.looked_up for r in sstable.read_shards(spark, folder, manifest).collect())
    got = {r.doc_id: r.ids for r in sstable.lookup(spark, folder, manifest, [-600, -599, 0, 597, 10**12, None]).collect()}
    want = library("byte_bpe_50k.json", [f"text {(i + 600) // 3}" for i in (-600, 0, 597)])
    assert got == {i: [*ids, 2] for i, ids in zip((-600, 0, 597), want, strict=True)}
    assert sstable.lookup(spark, folder, manifest, [10**12]).count() == 0


def test_one_row_repeated_is_split_over_shards(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(4000).selectExpr("5L AS doc_id", "'same text' AS text")
    folder = storage.scratch(spark, "t")
    manifest = sstable.write_shards(df, folder, tokenizer_path("byte_bpe_50k.json"), 2)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(manifest) > 1 and sum(m["documents"] for m in manifest) == 4000
    rows = sstable.read_shards(spark, folder, manifest).collect()
    assert len(rows) == 4000 and all(r.looked_up for r in rows) and len({r.start for r in rows}) == 4000


def test_few_ids_are_left_to_the_end():
    rnd = np.random.default_rng(6)
    packer, whole = packing.Packer(4096, 0, False), 0
    for i in range(5000):
        ids = np.zeros(int(rnd.lognormal(6.3, 1.1)) + 1, dtype=np.uint16)
        whole += len(ids)
        packer.add(i, ids)
    assert packer.bins.n_open <= packing.MOST_OPEN == int(packer.bins.levels.sum()) + packing.MOST_OPEN - packer.bins.n_open
    packer.finish()
    assert packer.placed == whole and packer.recut <= packing.MOST_OPEN * 4096 and packer.recut < 0.02 * whole


def test_bounded_placement_by_brute_force():
    rnd = np.random.default_rng(7)
    bins, levels = packing.SumOfSquares(12, 3), {}
    squares = lambda v: sum(c * c for c in np.bincount([x for x in v if x < 12], minlength=12))
    for _ in range(500):
        size, before = int(rnd.integers(1, 13)), dict(levels)
        parts = bins.place(size)
        assert sum(p[2] for p in parts) == size and all(before.get(w, 0) == o for w, o, _ in parts)
        for w, o, n in parts:
            levels[w] = o + n
        levels = {w: v for w, v in levels.items() if v < 12}
        assert len(levels) <= 3
        if size == 12:
            continue
        options = []
        for w, v in before.items():
            others = [x for k, x in before.items() if k != w]
            if v + size <= 12:
                options.append(([*others, v + size], False))
            elif len(before) == 3 and not any(x + size <= 12 for x in before.values()):
                options.append(([*others, v + size - 12], True))
        if len(before) < 3:
            options.append(([*before.values(), size], False))
        assert squares(levels.values()) == min(squares(o) for o, _ in options) and (len(parts) == 2) == options[0][1]


def test_sum_of_squares_by_brute_force():
    import random

    random.seed(4)
    bins, levels = packing.SumOfSquares(12, 10**9), {}
    for _ in range(400):
        size = random.randint(1, 12)
        before = list(levels.values())

        def cost(h, size=size, before=before):
            counts = [0] * 13
            for v in before:
                counts[v] += 1
            if h:
                counts[h] -= 1
            if h + size < 12:
                counts[h + size] += 1
            return sum(c * c for c in counts[1:12])

        ((window, level, _),) = bins.place(size)
        assert levels.get(window, 0) == level
        options = {h for h in before if h and h + size <= 12} | {0}
        if size < 12:
            assert cost(level) == min(cost(h) for h in options)
        levels[window] = level + size
        if levels[window] == 12:
            del levels[window]


ODD = ["", None, "  a  b\n\n c\t", "<s> x </s> <unk> <0x0A>", "é  b \u3000 c", "▁▁a ▁ b▁", " " * 35 + "x" + " " * 40, "\n", " ", "日本語 😀😀 b\x00c", "x" * 900, "aaaaaaabbbb", "12345 678", " " * 17]


def test_piece_counts_of_every_prefix():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = ODD + [r[1] for r in corpus(10)][:25]
    table, at = prefix_counts.counter(PIECES).batch(*buffers(pa.array(texts)))
    for i, t in enumerate(texts):
        own = table[at[i] : at[i + 1]].tolist()
        assert len(own) == len(t or "") + 1 and own[-1] == len(lib.encode(t or ""))
        for p in {*range(min(60, len(own))), len(own) // 2}:
            assert own[p] == len(lib.encode((t or "")[:p]))


def test_prefix_query(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    stored = prefix_counts.stored_tables(frame(spark), PIECES)
    got = prefix_counts.prefix_counts(stored, 20).collect()
    texts = {r[0]: r[1] or "" for r in corpus() if r[0] is not None}
    tables = {r.doc_id: r.table for r in stored.collect()}
    for r in got:
        if r.doc_id is None:
            continue
        t = texts[r.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), len(lib.encode(t)), len(lib.encode(t)) > 20)
        table = tables[r.doc_id]
        assert len(table) == len(t) + 1 and prefix_counts.longest_within(table, 20) == r.fits_chars and prefix_counts.count_at(table, len(t)) == r.n_tokens
        assert prefix_counts.count_at(table, r.fits_chars) <= 20 == min(20, len(lib.encode(t[: r.fits_chars + 1])) + 20 * (r.fits_chars == len(t)))
    assert len(got) == len(corpus())


def test_suffix_matching_is_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = ODD + [r[1] for r in corpus()]
    matcher, decoder = suffix_matching.tools(PIECES)
    ids, at = matcher.batch(*buffers(pa.array(texts)))
    for i, t in enumerate(texts):
        own = ids[at[i] : at[i + 1]].tolist()
        assert own == lib.encode(t or "") and decoder.decode(own).decode("utf-8", "replace") == lib.decode(own)
    df = frame(spark)
    encoded = suffix_matching.encode(df, PIECES)
    back = {r.doc_id: r.text for r in suffix_matching.decode(encoded, PIECES).collect()}
    for r in suffix_matching.digest(df, PIECES).collect():
        text = next(x[1] for x in corpus() if x[0] == r.doc_id) or ""
        if r.doc_id is not None:
            assert r.ids_crc32 == crc(lib.encode(text)) and back[r.doc_id] == lib.decode(lib.encode(text)) and r.round_trip == ("▁" not in text)
    assert suffix_matching.digest(df.limit(0), PIECES).count() == 0 == prefix_counts.prefix_counts(prefix_counts.stored_tables(spark.createDataFrame([], SCHEMA), PIECES)).count()


def test_stored_tables_of_large_steps():
    for table in ([0], [0, 1, 2, 2, 3, 1], [0, 200, 100, 5000]):
        data = prefix_counts.packed(np.array(table))
        assert prefix_counts.unpacked(data).tolist() == table and [prefix_counts.count_at(data, i) for i in range(len(table))] == table


def test_suffix_edges_by_brute_force():
    matcher, _ = suffix_matching.tools(PIECES)
    text = "▁the▁other▁thing\x00▁théâtre\x00日本"
    got = set(zip(*(x.tolist() for x in matcher.edges(np.array([ord(c) for c in text]))), strict=True))
    model = pieces.load(PIECES)
    assert got == {(i, n, model.id[text[i : i + n]]) for i in range(len(text)) for n in range(1, 17) if i + n <= len(text) and text[i : i + n] in model.reached}
