"""Document fingerprints by consistent weighted sampling.

A document is a weighted set: its five-word shingles, each weighted by how
often it occurs.  For every term and sample there are r and c of Gamma(2, 1)
and b of Uniform(0, 1), the same in every document.  At weight w, with
t = floor(ln(w) / r + b) and y = exp(r (t - b)), the term's value is
c / (y exp(r)); the term of least value, with its t, is the sample.  Two
documents' samples agree with the probability of their generalised Jaccard
similarity (sum of the lesser weights over sum of the greater).

The draws are made so that weight 1, which nearly all shingles have, is cheap:
a1 = -ln u1, c = a1 - ln u2, e = ln(c / a1), r = e - ln u3, b = 1 - e / r.
That gives c and r Gamma(2, 1), b uniform, all independent, and the value at
weight 1 is a1 itself, so there only the greatest u1 has to be found.

A fingerprint is SAMPLES codes of 16 bits in hexadecimal; likeness is the share
of equal codes.  A text without words has all codes zero.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragram.llm import storage, workers
from paragram.llm.shingles import counted, shingles
from paragram.llm.textbytes import buffers, mix64, words_of

SAMPLES = 64
_SEEDS = np.random.default_rng(64_029).integers(1, 2**63, (3, SAMPLES), dtype=np.uint64) | np.uint64(1)
_SCALE = 2.0**-53
#: Terms handled at a time, so that the arrays stay in the cache.
_BLOCK = 40_000


def _draw(h: np.ndarray, seed: np.uint64) -> np.ndarray:
    x = h * seed
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * _SCALE


def weighted_samples(h: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Value and identity of each term at weight w, in sample k."""
    x = _draw(h, _SEEDS[0, k])
    a1 = -np.log(_uniform(x))
    c = a1 - np.log(_uniform(_draw(h, _SEEDS[1, k])))
    e = np.log(c / a1)
    r = e - np.log(_uniform(_draw(h, _SEEDS[2, k])))
    b = 1 - e / r
    t = np.floor(np.log(w) / r + b)
    identity = np.where(t == 0, x, mix64(x + t.astype(np.int64).astype(np.uint64)))
    return c * np.exp(-r * (t - b + 1)), identity


def signatures(row: np.ndarray, h: np.ndarray, count: np.ndarray, rows: int) -> np.ndarray:
    """rows x SAMPLES codes (uint16) of the rows' weighted terms; terms in order of row."""
    out = np.zeros((rows, SAMPLES), dtype=np.uint16)
    light = count == 1
    lr, lh = row[light], h[light]
    hr, hh, hw = row[~light], h[~light], count[~light].astype(np.float64)
    edges = np.searchsorted(lr, np.arange(rows + 1))
    heavy_rows, heavy_at = np.unique(hr, return_index=True)
    best = np.zeros((rows, SAMPLES), dtype=np.uint64)  # identity
    value = np.full((rows, SAMPLES), np.inf)
    first = 0
    while first < rows:
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + _BLOCK, side="right")) - 1)
        own = lh[edges[first] : edges[last]]
        full = np.flatnonzero(np.diff(edges[first : last + 1])) + first
        if len(full):
            starts = edges[full] - edges[first]
            for k in range(SAMPLES):
                best[full, k] = np.maximum.reduceat(_draw(own, _SEEDS[0, k]), starts)
            value[full] = -np.log(_uniform(best[full]))
        first = last
    if len(hh):
        ends = np.append(heavy_at[1:], len(hh))
        for k in range(SAMPLES):
            a, identity = weighted_samples(hh, hw, k)
            low = np.minimum.reduceat(a, heavy_at)
            at = np.flatnonzero(a == np.repeat(low, ends - heavy_at))
            who = np.zeros(len(heavy_rows), dtype=np.uint64)
            who[np.searchsorted(heavy_rows, hr[at])] = identity[at]
            better = low < value[heavy_rows, k]
            best[heavy_rows[better], k] = who[better]
    some = np.bincount(row, minlength=rows) > 0
    out[some] = (mix64(best[some]) >> np.uint64(48)).astype(np.uint16)
    return out


def fingerprints(texts: list[str]) -> np.ndarray:
    raw, offsets = buffers(pa.array(texts, pa.large_string()))
    w = words_of(raw, offsets)
    return signatures(*counted(*shingles(w)), len(texts))


def as_text(codes: np.ndarray) -> list[str]:
    data = codes.astype(">u2").tobytes().hex()
    n = 4 * SAMPLES
    return [data[i : i + n] for i in range(0, len(data), n)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint.  No shuffle.  Null counts as empty; other columns are ignored."""

    def run(batches):
        for batch in batches:
            texts, n = batch.column(1).to_pylist(), batch.num_rows
            for a in range(0, n, 500):
                part = [t or "" for t in texts[a : a + 500]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(part)), pa.array(as_text(fingerprints(part)))], ["doc_id", "fingerprint"])

    return df.selectExpr(f"CAST(`{id_col}` AS LONG) AS id", f"CAST(`{text_col}` AS STRING) AS text").mapInArrow(workers.task(run), "doc_id long, fingerprint string")


class _Ranges:
    """Ranges of (known, id, hash of the text): a row is in range r if r cuts are not above it.

    Everything is compared as integers.  known is 0 for a null id, whose id then is the least integer.
    """

    def __init__(self, cuts: list[tuple[int, int, int]]) -> None:
        self.cuts = sorted(set(cuts))
        self.ids = np.array([c[1] for c in self.cuts if c[0]], dtype=np.int64)
        self.nulls = len(self.cuts) - len(self.ids)

    def of(self, known: np.ndarray, ids: np.ndarray, h: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.ids, ids, side="left"), np.searchsorted(self.ids, ids, side="right")
        out = self.nulls + low
        for i in np.flatnonzero((known == 0) | (low < high)).tolist():  # nulls, and ids that a cut has
            out[i] = bisect_right(self.cuts, (int(known[i]), int(ids[i]), int(h[i])))
        return out


#: Rows that are sampled for each cut between ranges.
_FOR_EACH_CUT = 40


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slice_chars: int = 2_000_000) -> DataFrame:
    """The fingerprint of every document and of its text with the last half replaced by the start of the next document.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.  Documents go in ascending
    order of doc_id (nulls first; of equal ids, by a hash of the text); the first follows the last.  Documents are dealt
    out by ranges of the id, with cuts from a sample of the rows (they only balance the tasks), and the first of each range
    goes to the range before it too.  One document alone follows itself; an empty table gives no row; null counts as empty;
    rows that repeat an id and a text are rows of their own, all in one range; other columns are ignored.  A very long text
    is handled whole.
    """
    spark, least = df.sparkSession, -(1 << 63)
    id_, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(id_.isNotNull().cast("int").alias("known"), F.coalesce(id_, F.lit(least)).alias("id"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    parts = storage.partitions(df)
    ranges = 3 * parts
    share = min(1.0, _FOR_EACH_CUT * ranges / max(1, df.count()))
    drawn = rows.where(F.rand(11) < share).select("known", "id", "h").collect()  # about 40 rows a range
    sample = sorted((x["known"], x["id"], x["h"]) for x in drawn)
    deal = _Ranges([sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else [])

    def heads(batches):
        found: dict[int, tuple[int, int, int]] = {}
        for batch in batches:
            known, ids, h = (np.asarray(batch.column(i)) for i in range(3))
            if not len(ids):
                continue
            r = deal.of(known, ids, h)
            order = np.lexsort((h, ids, known, r))
            first = order[np.unique(r[order], return_index=True)[1]]
            for i in first.tolist():
                own = (int(known[i]), int(ids[i]), int(h[i]))
                found[int(r[i])] = min(own, found.get(int(r[i]), own))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), *(pa.array([v[k] for v in found.values()], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64())))], ["r", "known", "id", "h"])

    # A row for each range.
    top = rows.select("known", "id", "h").mapInArrow(workers.task(heads), "r long, known int, id long, h long").groupBy("r").agg(F.min(F.struct("known", "id", "h")).alias("head")).collect()
    first = {x["r"]: tuple(x["head"]) for x in top}
    filled = sorted(first)
    before = {r: filled[i - 1] for i, r in enumerate(filled)}
    names = ["r", "ahead", "known", "id", "text", "h"]

    def place(batches):
        for batch in batches:
            known, ids, h = (np.asarray(batch.column(k)) for k in (0, 1, 3))
            r = deal.of(known, ids, h)
            again = [i for i, x in enumerate(zip(known.tolist(), ids.tolist(), h.tolist(), strict=True)) if first.get(int(r[i])) == x]
            yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(np.zeros(len(r), dtype=bool)), *batch.columns], names)
            if again:
                more = batch.take(pa.array(again))
                yield pa.RecordBatch.from_arrays([pa.array([before[int(r[i])] for i in again], pa.int64()), pa.array([True] * len(again)), *more.columns], names)

    def finish(held: list[tuple]):
        """Rows of all but the last, each followed by the next."""
        texts = [t for _, _, t in held]
        edited = []
        for a, b in zip(texts[:-1], texts[1:], strict=True):
            half = len(a) // 2
            edited.append(a[: len(a) - half] + b[:half])
        codes = fingerprints(texts + edited)
        own, changed, n = codes[: len(texts)], codes[len(texts) :], len(edited)
        columns = [
            pa.array([i for _, i, _ in held[:-1]], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()), pa.array(as_text(own[:n])), pa.array(as_text(changed)),
            pa.array(likeness(own[:n], changed)), pa.array(likeness(own[:n], own[1:])),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches):
        held: list[tuple] = []  # of one range: range, id, text
        chars, done = 0, False
        for batch in batches:
            for r, ahead, known, i, text in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if held and held[-1][0] != r:  # the range before ended with its row from ahead
                    if len(held) > 1:
                        yield finish(held)
                    held, chars, done = [], 0, False
                if done:
                    continue
                held.append((r, i if known else None, text))
                done = ahead
                chars += len(text)
                if chars > slice_chars and len(held) > 1:
                    yield finish(held)
                    held, chars = held[-1:], len(text)
        if len(held) > 1:
            yield finish(held)

    placed = rows.select("known", "id", "text", "h").mapInArrow(workers.task(place), "r long, ahead boolean, known int, id long, text string, h long")
    ordered = placed.repartition(parts, "r").sortWithinPartitions("r", "ahead", "known", "id", "h").select("r", "ahead", "known", "id", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(workers.task(run), schema) if filled else spark.createDataFrame([], schema)
