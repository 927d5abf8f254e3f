"""Removal of long repeated spans, by compacting a sparse De Bruijn graph of word k-mers.

A window is WINDOW consecutive words of one document.  Every word covered by a
window whose words also start anywhere else (same document included) goes.

Graph.  Of the NODE-word k-mers in each window the one of least hash is a node
(a sparse De Bruijn graph); as the choice depends on the window's words alone,
equal windows hold the same node at the same place.  The words from a node to
the end of the next node of its document are an edge.  One aggregation by node
finds the repeated nodes, and those of them that do not branch: all their
occurrences have the same edge before and the same edge after.

Compaction.  Unbranching nodes that follow one another are one path.  Joins of
the node table with itself, each over twice the distance of the one before,
give every unbranching node how many words its path reaches to either side, as
far as a window can need (so that cycles, and paths of any length, end after a
fixed number of rounds).  A join gives every document its own repeated nodes
with their paths.  Then, with the source text at hand,

* a window whose node is not repeated occurs once;
* a window that lies in the compacted path around its node is repeated, because
  every occurrence of its node spells the same path;
* the few other windows, at branches and ends of paths, are verified by their
  source coordinates: the hash of the words there is counted over the corpus
  and joined back.

Nodes and edges are told apart by 64 bits each (a false path needs both to
meet), windows by 128 bits from two independent hashes of each word, texts by
the first 128 bits of the SHA-256 of their words.  Documents of the same words
are handled once: if they have a window, all of their words go.

Null texts have no words.  Null and repeated ids get a row each; other columns
are ignored; an empty table gives no row; a very long text is one row like any
other.  All aggregations combine before the shuffle, and joins are from many
rows to one, which adaptive execution splits where a node, window or text is
very frequent.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paragram.llm import storage, workers
from paragram.llm.textbytes import TWO, Words, buffers, expand, mix64, range_hashes, slices, window_hashes, word_digests, words_of

WINDOW, NODE = 35, 8
_EMPTY = hashlib.sha256(b"").hexdigest()
_LEAST = -(1 << 63)
_NO_EDGE = np.uint64(0x5851F42D4C957F2D)
_TIMES = np.uint64(0x9FB21C651E98DF25)
#: Bits of a reach in a flag; a path counts up to a window and an edge to either side.
_REACH_BITS = 7


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


class Graph:
    """Nodes of a batch of texts."""

    def __init__(self, w: Words) -> None:
        self.w, self.hashes = w, w.hashes()
        total, none = len(self.hashes), np.empty(0, dtype=np.int64)
        self.window, self.node_of, self.nodes, self.key = none, none, none, none.view(np.uint64)
        if total >= WINDOW:
            first = np.arange(total - WINDOW + 1)
            room = np.repeat(w.first[1:], w.counts())[: len(first)]
            self.window = first[first + WINDOW <= room]
        if len(self.window):
            grams = window_hashes(self.hashes, NODE)
            views = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - NODE + 1)
            at = np.concatenate([views[self.window[i : i + 50_000]].argmin(axis=1) for i in range(0, len(self.window), 50_000)]) + self.window
            self.nodes, self.node_of = np.unique(at, return_inverse=True)
            self.key = grams[self.nodes]
        self.row = np.searchsorted(w.first, self.nodes, side="right") - 1

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each node: a hash of the edges before and after it, the next node (0 without), and the words to the next and from the last node (next + last << 16)."""
        n = len(self.nodes)
        before, after = np.full(n, _NO_EDGE), np.full(n, _NO_EDGE)
        following, gaps = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.int32)
        if n > 1:
            same = np.flatnonzero(self.row[1:] == self.row[:-1])
            edge = range_hashes(self.hashes, self.nodes[same], self.nodes[same + 1] + NODE)
            after[same], before[same + 1] = edge, edge
            following[same] = self.key[same + 1]
            gap = (self.nodes[same + 1] - self.nodes[same]).astype(np.int32)
            gaps[same] += gap
            gaps[same + 1] += gap << 16
        return mix64(mix64(before * _TIMES) + after), following, gaps


def covered(total: int, windows: np.ndarray) -> np.ndarray:
    """Which of `total` words the windows cover."""
    change = np.zeros(total + 1, dtype=np.int64)
    np.add.at(change, windows, 1)
    np.add.at(change, windows + WINDOW, -1)
    return np.cumsum(change)[:-1] > 0


def text_keys(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The first 128 bits of each digest."""
    halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 4)
    return halves[:, 0].copy(), halves[:, 1].copy()


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def _scan(batches):
    """Ids, text keys, words, digest of all words, and nodes of every document."""
    for batch in batches:
        raw, offsets = buffers(batch.column(1))
        for a, b in slices(offsets, 1 << 20):
            w = words_of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            g = Graph(w)
            whole = word_digests(w)
            bounds = np.searchsorted(g.nodes, w.first)
            t, u = text_keys(whole)
            context, following, gaps = g.edges()
            columns = [
                batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(t), pa.array(u), pa.array(w.counts()), pa.array(whole),
                _lists((g.nodes - w.first[g.row]).astype(np.int32), bounds, pa.int32()), _lists(_signed(g.key), bounds, pa.int64()),
                _lists(_signed(context), bounds, pa.int64()), _lists(_signed(following), bounds, pa.int64()), _lists(gaps, bounds, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "x", "t", "u", "n_words", "whole", "pos", "node", "ctx", "next", "gaps"])


def _cut(words: list[bytes], gone: np.ndarray) -> tuple[int, bytes, list[dict]]:
    """How many words go, the digest of the others, and the spans that go."""
    kept = list(compress(words, ~gone))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    spans = [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()]
    return len(words) - len(kept), hashlib.sha256(b" ".join(kept)).digest(), spans


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_LEFT = pa.list_(pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("p", pa.int32())]))
_PATH_NAMES = ["t", "u", "n_removed", "kept", "spans", "text", "sure", "open"]
_PATH_SCHEMA = "t long, u long, n_removed long, kept binary, spans array<struct<start: int, end: int>>, text string, sure array<int>, open array<struct<h1: long, h2: long, p: int>>"


def _follow(batches):
    """Windows in compacted paths, and those to verify.  Columns in: t, u, text, flags (place of a repeated node, its path's reach to the left and right, whether it doesn't branch)."""
    for batch in batches:
        raw, offsets = buffers(batch.column(2))
        for a, b in slices(offsets, 1 << 20):
            part = raw[offsets[a] : offsets[b]]
            w = words_of(part, offsets[a : b + 1] - offsets[a])
            g = Graph(w)
            t, u = text_keys(word_digests(w))
            t_in, u_in = (np.asarray(batch.column(k))[a:b] for k in (0, 1))
            flag_lists = batch.column(3).slice(a, b - a)
            flags = np.asarray(flag_lists.flatten())
            place = (flags >> 2 * _REACH_BITS + 1) + np.repeat(w.first[:-1], np.asarray(flag_lists.value_lengths().fill_null(0)))
            state, low, high = (np.zeros(len(g.hashes) + 1, dtype=np.int64) for _ in range(3))
            inside = place < len(state)  # always, but where another text has the same id and hash
            place, flags = place[inside], flags[inside]
            most = (1 << _REACH_BITS) - 1
            state[place] = 1 + (flags & 1)
            low[place], high[place] = place - (flags >> _REACH_BITS + 1 & most), place + (flags >> 1 & most) + NODE
            node = g.nodes[g.node_of] if len(g.nodes) else g.nodes
            sure = (state[node] == 2) & (g.window >= low[node]) & (g.window + WINDOW <= high[node])
            open_ = (state[node] > 0) & ~sure
            sure_at, open_at = g.window[sure], g.window[open_]
            h1 = _signed(range_hashes(g.hashes, open_at, open_at + WINDOW))
            h2 = _signed(range_hashes(w.hashes(TWO), open_at, open_at + WINDOW))
            sure_cut, open_cut = np.searchsorted(sure_at, w.first), np.searchsorted(open_at, w.first)
            gone = covered(len(g.hashes), sure_at)
            data, cuts = part.tobytes(), w.offsets.tolist()
            named = (t == t_in) & (u == u_in)  # else another text under the same id and hash
            none = np.diff(open_cut) == 0
            early, late = np.flatnonzero(named & none), np.flatnonzero(named & ~none)
            if len(early):
                rows = [_cut(data[cuts[i] : cuts[i + 1]].split(), gone[w.first[i] : w.first[i + 1]]) for i in early.tolist()]
                n, kept, spans = zip(*rows, strict=True)
                done = [pa.array(n, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, _SPANS), *(pa.nulls(len(n), k) for k in (pa.string(), pa.list_(pa.int32()), _LEFT))]
                yield pa.RecordBatch.from_arrays([pa.array(t_in[early]), pa.array(u_in[early]), *done], _PATH_NAMES)
            if len(late):
                s_size, o_size = np.diff(sure_cut)[late], np.diff(open_cut)[late]
                at_s, at_o = expand(sure_cut[late], s_size), expand(open_cut[late], o_size)
                sure_p = (sure_at[at_s] - np.repeat(w.first[late], s_size)).astype(np.int32)
                open_p = (open_at[at_o] - np.repeat(w.first[late], o_size)).astype(np.int32)
                left = pa.StructArray.from_arrays([pa.array(h1[at_o]), pa.array(h2[at_o]), pa.array(open_p)], fields=list(_LEFT.value_type))
                text = pa.array([data[cuts[i] : cuts[i + 1]].decode() for i in late.tolist()], pa.string())
                bounds = lambda size: pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
                wait = [*(pa.nulls(len(late), k) for k in (pa.int64(), pa.binary(), _SPANS)), text, pa.ListArray.from_arrays(bounds(s_size), pa.array(sure_p)), pa.ListArray.from_arrays(bounds(o_size), left)]
                yield pa.RecordBatch.from_arrays([pa.array(t_in[late]), pa.array(u_in[late]), *wait], _PATH_NAMES)


def _finish(batches):
    """Columns in: t, u, text, sure, hits."""
    for batch in batches:
        rows = []
        for t, u, text, sure, hits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = text.encode().split()
            at = np.array([*(sure or []), *(hits or [])], dtype=np.int64)
            rows.append((t, u, *_cut(words, covered(len(words), at))))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), _SPANS)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["t", "u", "n_removed", "kept", "spans"])


def compacted(repeated: DataFrame) -> DataFrame:
    """node, unbranching, left, right: the words that each node's path reaches before and after it (0 where it branches).

    repeated: node, unbranching, next, gap_next, gap_last.  Pointer jumping: in each round a node's reach grows by that of
    the node that it points to, and it points on from there, until the path ends or is as long as a window.
    """
    most = WINDOW
    solid = repeated.where("unbranching = 1")
    before = solid.where("gap_next > 0").select(F.col("next").alias("node"), F.col("node").alias("last"))
    # An unbranching node has one node before it; a branching one isn't asked.
    paths = solid.join(before, "node", "left").select(
        "node", F.col("gap_next").alias("right"), F.when(F.col("gap_next") > 0, F.col("next")).alias("to"),
        F.col("gap_last").alias("left"), F.when(F.col("gap_last") > 0, F.col("last")).alias("back"),
    )
    paths = storage.written(paths, "paths")
    for _ in range((most - 1).bit_length()):  # an edge has a word at least
        if paths.where("to IS NOT NULL OR back IS NOT NULL").isEmpty():
            break
        ahead = paths.select(F.col("node").alias("to"), F.col("right").alias("right2"), F.col("to").alias("to2"))
        behind = paths.select(F.col("node").alias("back"), F.col("left").alias("left2"), F.col("back").alias("back2"))
        on = paths.join(ahead, "to", "left").join(behind, "back", "left")
        right, left = (F.col(c) + F.coalesce(f"{c}2", F.lit(0)) for c in ("right", "left"))
        grown = on.select(
            "node", F.least(right, F.lit(2 * most)).alias("right"), F.when(right < most, F.col("to2")).alias("to"),
            F.least(left, F.lit(2 * most)).alias("left"), F.when(left < most, F.col("back2")).alias("back"),
        )
        longer = storage.written(grown, "paths")
        storage.release(paths)
        paths = longer
    out = repeated.select("node", "unbranching").join(paths.select("node", "left", "right"), "node", "left")
    return out.select("node", "unbranching", F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("right", F.lit(0)).alias("right"))


def _flag() -> Column:
    """A repeated node in its text, as one number."""
    by = 1 << _REACH_BITS
    return ((F.col("pos").cast("long") * by + F.col("left")) * by + F.col("right")) * 2 + F.col("unbranching")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, text_hash (xxhash64 of its text), n_words, n_removed, spans (removed word ranges), kept_sha256."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("x"))
    schema = "doc_id long, x long, t long, u long, n_words long, whole binary, pos array<int>, node array<long>, ctx array<long>, next array<long>, gaps array<int>"
    scanned = storage.written_by(docs, _scan, schema, "scanned")

    # Nodes: repeated (at two places or more; copies of a text are one place), and unbranching.
    nodes = scanned.select("t", F.inline(F.arrays_zip("pos", "node", "ctx", "next", "gaps"))).withColumn("place", F.xxhash64("t", "pos"))
    ends = [f(c).alias(f"{c}{i}") for c in ("place", "ctx") for i, f in enumerate((F.min, F.max))]
    twice = nodes.groupBy("node").agg(*ends, F.min("next").alias("next"), F.min("gaps").alias("gaps")).where("place0 <> place1")
    gap = F.col("gaps")
    repeated = twice.select("node", (F.col("ctx0") == F.col("ctx1")).cast("int").alias("unbranching"), "next", gap.bitwiseAND(0xFFFF).alias("gap_next"), F.shiftright(gap, 16).alias("gap_last"))
    repeated = storage.written(repeated, "repeated")
    # Written, so that the joins with it are between two shuffles, of which adaptive execution splits hot keys.
    paths = storage.written(compacted(repeated), "compacted")
    storage.release(repeated)

    # Each text's own repeated nodes (at most one for each word), with one row of it to read the text from.
    own = scanned.select("t", "u", F.inline(F.arrays_zip("pos", "node"))).join(paths, "node")
    own = own.groupBy("t", "u").agg(F.collect_set(_flag()).alias("flags"))
    key = F.struct(F.coalesce("doc_id", F.lit(_LEAST)).alias("id"), "x")
    texts = scanned.groupBy("t", "u").agg(F.count("*").alias("copies"), F.min(key).alias("k")).select("t", "u", "copies", "k.id", "k.x")
    flagged = storage.written(own.join(texts, ["t", "u"]).select("id", "x", "t", "u", "flags"), "flags")
    storage.release(paths)

    # Paths, with the text at hand.
    source = docs.select(F.coalesce("doc_id", F.lit(_LEAST)).alias("id"), "x", "text")
    followed = source.join(flagged, ["id", "x"]).select("t", "u", "text", "flags")
    followed = storage.written_by(followed, _follow, _PATH_SCHEMA, "followed")
    storage.release(flagged)

    # The windows left, by their source coordinates (text and place).
    left = followed.where("text IS NOT NULL").select("t", F.inline("open"))
    spots = left.withColumn("place", F.xxhash64("t", "p")).groupBy("h1", "h2").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    again = storage.written(spots.where("first <> last").select("h1", "h2"), "again")
    hits = left.join(again, ["h1", "h2"]).groupBy("t").agg(F.collect_set("p").alias("hits"))
    late = followed.where("text IS NOT NULL").select("t", "u", "text", "sure").join(hits, "t", "left").select("t", "u", "text", "sure", "hits")
    late = late.mapInArrow(workers.task(_finish), "t long, u long, n_removed long, kept binary, spans array<struct<start: int, end: int>>")
    early = followed.where("text IS NULL").select("t", "u", "n_removed", "kept", "spans")
    results = early.unionByName(late).dropDuplicates(["t", "u"])
    results = storage.written(texts.select("t", "u", "copies").join(results, ["t", "u"], "left"), "removed")
    storage.release(followed, again)

    out = scanned.select("doc_id", "x", "t", "u", "n_words", "whole").join(results, ["t", "u"])
    copied = (F.col("copies") > 1) & (F.col("n_words") >= WINDOW)
    everything = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    none = F.array().cast("array<struct<start: int, end: int>>")
    return out.select(
        "doc_id", F.col("x").alias("text_hash"), "n_words", F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, everything).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(copied, F.lit(_EMPTY)).otherwise(F.lower(F.hex(F.coalesce("kept", "whole")))).alias("kept_sha256"),
    )


def cleaned(df: DataFrame) -> DataFrame:
    """All rows and columns, with removed words taken out of text (the others joined by one space where any goes) and n_chars to match.

    Null texts stay null; an emptied text is empty.  Columns may have any names; rows that are repeated stay repeated.
    """
    found = deduplicated(df).where("n_removed > 0").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("x"), "spans")
    # Equal rows have equal spans; one of them is enough.
    found = found.dropDuplicates(["id", "x"])
    marked = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col("doc_id").cast("long").alias("own"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h"))
    rows = marked.join(found, F.col("own").eqNullSafe(F.col("id")) & (F.col("h") == F.col("x")), "left").select("row", "spans")
    names, kind = df.columns, df.schema
    at = names.index("text")

    def run(batches):
        for batch in batches:
            row = batch.column(0)
            columns, spans = row.flatten(), batch.column(1)
            out = []
            for text, cuts in zip(columns[at].to_pylist(), spans.to_pylist(), strict=True):
                if cuts:
                    words = text.encode().split()
                    keep = np.ones(len(words), dtype=bool)
                    for c in cuts:
                        keep[c["start"] : c["end"]] = False
                    text = b" ".join(compress(words, keep)).decode()
                out.append(text)
            columns[at] = pa.array(out, columns[at].type)
            if "n_chars" in names:
                k = names.index("n_chars")
                size = pa.array([None if t is None else len(t) for t in out], pa.int64()).cast(columns[k].type)
                columns[k] = pc.if_else(pc.is_null(spans), columns[k], size)
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(workers.task(run), kind)


#: The same for DuckDB.
SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT r, p, md5(array_to_string(w[p:p + 34], ' ')) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM docs WHERE len(w) >= 35)),
again AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY k) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT r, p + o AS p FROM again, range(35) t(o)),
word AS (SELECT r, unnest(w) AS v, generate_subscripts(w, 1) AS p FROM docs),
kept AS (SELECT r, string_agg(v, ' ' ORDER BY p) AS s, count(*) AS n FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""
