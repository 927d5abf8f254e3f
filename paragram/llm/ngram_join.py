"""N-gram Jaccard self-join by MinHash banding.

Documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or
more are linked.  Documents with the same words are copies and are compared
once.  Every distinct text gets BANDS bands of ROWS MinHash values, chosen so
that a pair at the threshold is found with the target recall.  Band hashes are
shuffled as counts first; only buckets with two texts or more go on, and of
buckets with the same members one (the band of least number).  Their texts are
compared on the full shingle sets, each pair in the first band it shares, in
blocks: a large bucket is cut into blocks by a hash, and every pair of blocks
is a group of its own, so no task holds a whole bucket and no pair is ever a
row.  A text goes to as many groups as its bucket has blocks: up to MOST_BLOCKS
of them blocks stay at BLOCK_TEXTS texts, beyond that they grow, up to
BLOCK_CHARS characters; within a group pairs are compared tile by tile, so
memory doesn't grow with the square of a block.  What comes back is, per text,
its number of links and one edge to its group's root; components of these edges
are the classes.

A text of fewer than five words has one shingle, of all its words.  Texts
without words (null, empty, white space) have no shingles: no links, a class
of their own.  Rows with a null doc_id take no part (class null, no links).
Rows that repeat an id are a document each, and copies where their words are
the same.  A very long text is a block by itself.  Other columns are ignored.
An empty table gives no row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragram.llm import storage
from paragram.llm.components import components
from paragram.llm.shingles import shingles
from paragram.llm.textbytes import Words, buffers, expand, mix64, slices, words_of

THRESHOLD, RECALL, ROWS = 0.8, 0.99999, 4
#: Texts of a block of a bucket, blocks up to which that holds, and characters of a block at most.
BLOCK_TEXTS, MOST_BLOCKS, BLOCK_CHARS = 512, 64, 8_000_000
#: Texts that are compared with as many others at a time.
TILE = 512
_BAND_BITS = 6


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """The number of bands with which a pair at the threshold shares one with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


BANDS = bands_for()
_SEEDS = np.random.default_rng(90_901).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def _minima(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """rows x (BANDS * ROWS) MinHash values; rows without shingles stay 0."""
    out = np.zeros((rows, len(_SEEDS)), dtype=np.uint64)
    edges = np.searchsorted(row, np.arange(rows + 1))
    first = 0
    while first < rows:
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + 40_000, side="right")) - 1)
        own = h[edges[first] : edges[last]]
        full = np.flatnonzero(np.diff(edges[first : last + 1])) + first
        if len(full):
            starts = edges[full] - edges[first]
            for k, seed in enumerate(_SEEDS):
                x = own * seed
                x ^= x >> np.uint64(32)
                x *= np.uint64(0xD6E8FEB86659FD93)
                out[full, k] = np.minimum.reduceat(x, starts)
        first = last
    return out


def band_hashes(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """rows x BANDS hashes, the band's number in their lowest bits."""
    low = _minima(row, h, rows).reshape(rows, BANDS, ROWS)
    out = np.zeros((rows, BANDS), dtype=np.uint64)
    for k in range(ROWS):
        out = mix64(out + low[:, :, k])
    return (out << np.uint64(_BAND_BITS) | np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def text_keys(w: Words) -> np.ndarray:
    """A hash (xxh3) of each row's words, joined by one space."""
    data, cuts = w.raw.tobytes(), w.offsets.tolist()
    return np.array([xxhash.xxh3_64_intdigest(b" ".join(data[x:y].split())) for x, y in zip(cuts[:-1], cuts[1:], strict=True)], dtype=np.uint64).view(np.int64)


def _named(df: DataFrame, id_col: str, text_col: str, nameless: bool) -> DataFrame:
    """id, text, raw (a hash of the text as it is), nameless of every row; rows with a null id go, or get an id made of the text."""
    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("raw"), F.col(id_col).isNull().alias("nameless"))
    return rows.withColumn("id", F.coalesce("id", F.xxhash64("text", F.lit(5)))) if nameless else rows.where("id IS NOT NULL")


def signed(rows: DataFrame) -> DataFrame:
    """doc_id, text_key (null without words), chars, bands, raw, nameless of what ``_named`` gives; a written table."""

    def run(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            for a, b in slices(offsets, 1 << 20):
                w = words_of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                bands = band_hashes(*shingles(w), w.rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel()))
                keys = pa.array(text_keys(w), mask=w.counts() == 0)
                own = [batch.column(k).slice(a, b - a) for k in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([own[0], keys, pa.array(np.diff(w.offsets)), lists, *own[1:]], ["doc_id", "text_key", "chars", "bands", "raw", "nameless"])

    return storage.written_by(rows, run, "doc_id long, text_key long, chars long, bands array<long>, raw long, nameless boolean", "signed")


class _Sets:
    """Distinct shingles of texts, by text; those that only one text has are left out, but count in the sizes."""

    def __init__(self, row: np.ndarray, h: np.ndarray, n: int) -> None:
        self.sizes = np.bincount(row, minlength=n).astype(np.float32)
        _, column, count = np.unique(h, return_inverse=True, return_counts=True)
        shared = count[column] > 1
        order = np.argsort(row[shared], kind="stable")
        row, self.column = row[shared][order], column[shared][order]
        self.first = np.searchsorted(row, np.arange(n + 1))

    def _of(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.first[texts + 1] - self.first[texts]
        return np.repeat(np.arange(len(texts)), size), self.column[expand(self.first[texts], size)]

    def linked(self, one: np.ndarray, two: np.ndarray, threshold: float) -> np.ndarray:
        """Which of the texts `one` and `two` have at least the threshold's similarity."""
        (r1, c1), (r2, c2) = self._of(one), self._of(two)
        both = np.intersect1d(c1, c2)
        common = np.zeros((len(one), len(two)), dtype=np.float32)
        step = max(64, 2_000_000 // max(len(one), len(two)))
        for lo in range(0, len(both), step):
            part = both[lo : lo + step]
            dense = []
            for r, c, n in ((r1, c1, len(one)), (r2, c2, len(two))):
                at = np.minimum(np.searchsorted(part, c), len(part) - 1)
                own = part[at] == c
                matrix = np.zeros((n, len(part)), dtype=np.float32)
                matrix[r[own], at[own]] = 1
                dense.append(matrix)
            common += dense[0] @ dense[1].T
        union = self.sizes[one][:, None] + self.sizes[two][None, :] - common
        return common >= threshold * union - 1e-6


def _verify(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Links among the texts of two blocks of a bucket: text_key, links, root."""
    bucket, left, right = (k.as_py() for k in key)
    raw, offsets = buffers(table["text"])
    # Word by word in slices of the group; what stays is its distinct shingles.
    names, rows_of, hashes_of = [], [], []
    for a, b in slices(offsets, 1 << 20):
        w = words_of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        names.append(text_keys(w))
        row, h = shingles(w)
        first = np.unique(mix64(h ^ mix64(row.astype(np.uint64))), return_index=True)[1]  # of each distinct shingle of a text
        rows_of.append(row[first] + a)
        hashes_of.append(h[first])
    n_rows, own_keys, row, h = len(offsets) - 1, np.concatenate(names), np.concatenate(rows_of), np.concatenate(hashes_of)
    # A doc_id may stand for several texts; only the one that the key names is meant, once.
    keys = np.asarray(table["text_key"].combine_chunks())
    good = np.flatnonzero(own_keys == keys)
    good = good[np.unique(keys[good], return_index=True)[1]]
    n = len(good)
    place = np.full(n_rows, -1)
    place[good] = np.arange(n)
    row = place[row]
    sets = _Sets(row[row >= 0], h[row >= 0], n)
    keys, block = keys[good], np.asarray(table["block"].combine_chunks())[good]
    copies = np.asarray(table["copies"].combine_chunks())[good]
    bands = np.asarray(table["bands"].combine_chunks().flatten()).reshape(n_rows, -1)[good]
    earlier = bucket & (1 << _BAND_BITS) - 1
    links, root = np.zeros(n, dtype=np.int64), list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    one, two = np.flatnonzero(block == left), np.flatnonzero(block == right)
    for a in range(0, len(one), TILE):
        mine = one[a : a + TILE]
        for b in range(a if left == right else 0, len(two), TILE):
            other = two[b : b + TILE]
            linked = sets.linked(mine, other, THRESHOLD)
            same = left == right and a == b
            if same:
                np.fill_diagonal(linked, False)
            for k in range(earlier):  # pairs that an earlier band has are its groups'
                linked &= bands[mine, k][:, None] != bands[other, k][None, :]
            if not linked.any():
                continue
            links[mine] += linked @ copies[other]
            if not same:
                links[other] += linked.T @ copies[mine]
            # Least numbers along links until nothing changes; then one join for each text of the tile.
            low, back = mine.copy(), other.copy()
            while True:
                on = np.minimum(back, np.where(linked, low[:, None], n).min(axis=0))
                to = np.minimum(low, np.where(linked, on[None, :], n).min(axis=1))
                if (on == back).all() and (to == low).all():
                    break
                low, back = to, on
            for x, y in (*zip(mine.tolist(), low.tolist(), strict=True), *zip(other.tolist(), back.tolist(), strict=True)):
                x, y = top(x), top(y)
                root[max(x, y)] = min(x, y)
    some = np.flatnonzero(links)
    roots = np.array([top(x) for x in some.tolist()], dtype=np.int64)
    return pa.table({"text_key": pa.array(keys[some]), "links": pa.array(links[some]), "root": pa.array(keys[roots])})


def _classes(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The signed documents; and of every distinct text: text_key, root (of its class), class_id, n_links, copies."""
    docs = signed(named)
    texts = docs.where("text_key IS NOT NULL").groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.any_value("chars").alias("chars"), F.any_value("bands").alias("bands"))
    texts = storage.written(texts, "texts")

    # Buckets as counts, then one bucket for each set of members.
    buckets = texts.select("text_key", "chars", F.explode("bands").alias("bucket"))
    full = buckets.groupBy("bucket").agg(
        F.count("*").alias("n"), F.sum("chars").alias("chars"), F.bit_xor(F.xxhash64("text_key")).alias("x1"), F.bit_xor(F.xxhash64("text_key", F.lit(1))).alias("x2")
    ).where("n > 1")
    band = F.col("bucket").bitwiseAND(F.lit((1 << _BAND_BITS) - 1))
    kept = full.groupBy("n", "x1", "x2").agg(F.min(F.struct(band.alias("band"), "bucket", "chars")).alias("b"))
    blocks = F.greatest(F.least(F.ceil(F.col("n") / BLOCK_TEXTS), F.lit(MOST_BLOCKS)), F.least("n", F.ceil(F.col("b.chars") / BLOCK_CHARS))).cast("int")
    kept = kept.select("b.bucket", blocks.alias("blocks"))
    member = buckets.join(kept, "bucket").groupBy("text_key").agg(F.collect_list(F.struct("bucket", "blocks")).alias("groups"))  # at most BANDS
    member = storage.written(member.join(texts, "text_key").select("text_key", "doc_id", "copies", "bands", "groups"), "members")

    # Texts of the members, once for each block pair they are in.
    body = named.select(F.col("id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = member.join(body, "doc_id").select("text_key", "copies", "bands", "text", F.inline("groups"))
    own = F.pmod(F.xxhash64("text_key", F.lit(7)), F.col("blocks")).cast("int")
    rows = rows.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    found = rows.groupBy("bucket", "i", "j").applyInArrow(_verify, "text_key long, links long, root long")
    found = storage.written(found, "links")
    storage.release(member)

    links = found.groupBy("text_key").agg(F.sum("links").alias("n_links"))
    roots = components(found, "text_key", "root").select(F.col("node").alias("text_key"), "root")
    least = texts.select("text_key", "doc_id", "copies")
    classed = least.join(links, "text_key", "left").join(roots, "text_key", "left").withColumn("root", F.coalesce("root", "text_key"))
    names = classed.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    texts_out = classed.join(names, "root").select("text_key", "root", "class_id", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies")
    out = storage.written(texts_out, "classes")  # so that adaptive execution can split the documents of a very frequent text
    storage.release(texts, found, roots)
    return docs, out


def joined(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), n_links (other documents at the threshold, copies included), n_copies (documents with the same words)."""
    docs, texts_out = _classes(_named(df, id_col, text_col, False))
    out = docs.select("doc_id", "text_key").join(texts_out, "text_key", "left")
    out = out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("n_copies"))
    nameless = df.where(F.col(id_col).isNull()).select(*[F.lit(v).cast("long").alias(k) for k, v in (("doc_id", None), ("class_id", None), ("n_links", 0), ("n_copies", 1))])
    return out.unionByName(nameless)


def representatives(df: DataFrame) -> DataFrame:
    """The rows of one text (of the least doc_id, a null one last) of each class, with all their columns, whatever their names.

    A doc_id may stand for several texts; each is kept or not by its own class.  Rows with a null doc_id are compared like
    others.  Rows that share an id and a text count as one, and so does each text without words.
    """
    docs, texts = _classes(_named(df, "doc_id", "text", True))
    own = ["nameless", "doc_id", "raw"]
    first = docs.where("text_key IS NOT NULL").join(texts.select("text_key", "root"), "text_key").groupBy("root").agg(F.min(F.struct(*own)).alias("f")).select("f.*")
    first = first.unionByName(docs.where("text_key IS NULL").select(*own)).distinct()
    text, id_ = F.col("text").cast("string"), F.col("doc_id").cast("long")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), id_.isNull().alias("nameless"), F.coalesce(id_, F.xxhash64(text, F.lit(5))).alias("doc_id"), F.xxhash64(text).alias("raw"))
    return rows.join(first, own).dropDuplicates(own).select("row.*")


#: The same for DuckDB, over all pairs with a common shingle.
SQL = r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, md5(array_to_string(w[p:p + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM docs WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS d, doc_id AS r FROM docs UNION SELECT link.b AS d, reach.r FROM reach JOIN link ON link.a = reach.d),
class AS (SELECT d AS doc_id, min(r) AS class_id FROM reach GROUP BY 1),
links AS (SELECT a AS doc_id, count(*) AS n_links FROM link GROUP BY 1)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, CASE WHEN len(w) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY w) END AS n_copies
FROM docs JOIN class USING (doc_id) LEFT JOIN links USING (doc_id)
"""
