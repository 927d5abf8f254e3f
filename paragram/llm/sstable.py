"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order: data blocks of entries whose
keys are prefix-compressed against the entry before, each block compressed by
itself; a sparse index with the first key, place and size of every block; a
Bloom filter over the keys; a fixed footer.  A lookup reads the footer, asks
the filter, finds its block by binary search in the index, and decodes that
block only.

Keys: one byte 0 for a null id, or 1 and the id as a big-endian integer with
its sign bit flipped, so that byte order is id order with nulls first.  Rows
with the same id are entries of their own, next to each other (in order of a
hash of the text).  Null and empty texts have the end id alone.  A text longer
than a block has a block of its own size.  Other columns of the input are
ignored.  An empty table gives no shard.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paragram.llm import storage, workers
from paragram.llm.textbytes import mix64
from paragram.llm.tokens import crc, encoded_rows

_MAGIC = b"PGSST\x00\x01\n"
#: index offset, bloom offset, bloom bits, documents, tokens, bytes an id, magic
_FOOTER = struct.Struct("<QQQQQI8s")
_BLOCK_ROW = struct.Struct("<QII")
_CODEC = pa.Codec("zstd", compression_level=3)
BLOCK_BYTES = 128 << 10
BITS_A_KEY, PROBES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", (int(doc_id) + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def _probes(keys: list[bytes], bits: int) -> np.ndarray:
    base = np.array([zlib.crc32(k) << 32 | zlib.crc32(k, 0x5BD1E995) for k in keys], dtype=np.uint64)
    one, two = mix64(base), mix64(base ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)
    steps = np.arange(PROBES, dtype=np.uint64)
    return (one[:, None] + steps * two[:, None]) % np.uint64(bits)


class ShardWriter:
    """Writes one shard to a binary stream; keys must arrive in ascending order."""

    def __init__(self, out, width: int) -> None:
        self.out, self.width, self.place = out, width, 0
        self.block, self.block_first, self.last = bytearray(), b"", b""
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[bytes] = []
        self.documents = self.tokens = 0

    def add(self, key: bytes, value: bytes) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        if not self.block:
            self.block_first, self.last = key, b""
        shared = 0
        while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.documents += 1
        self.tokens += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = _CODEC.compress(bytes(self.block), asbytes=True)
            self.out.write(data)
            self.index.append((self.block_first, self.place, len(data), len(self.block)))
            self.place += len(data)
            self.block = bytearray()

    def finish(self) -> None:
        self._flush()
        index_at = self.place
        index = struct.pack("<I", len(self.index)) + b"".join(_varint(len(k)) + k + _BLOCK_ROW.pack(*rest) for k, *rest in self.index)
        bits = max(64, BITS_A_KEY * len(self.keys))
        flags = np.zeros(bits, dtype=bool)
        for i in range(0, len(self.keys), 10_000):
            flags[_probes(self.keys[i : i + 10_000], bits).ravel().astype(np.int64)] = True
        self.out.write(index)
        self.out.write(np.packbits(flags).tobytes())
        self.out.write(_FOOTER.pack(index_at, index_at + len(index), bits, self.documents, self.tokens, self.width, _MAGIC))


class Shard:
    """Reads a shard from a seekable file."""

    def __init__(self, file) -> None:
        self.file = file
        size = file.seek(0, 2) if not hasattr(file, "size") else file.size()
        file.seek(size - _FOOTER.size)
        self.index_at, self.bloom_at, self.bits, self.documents, self.tokens, self.width, magic = _FOOTER.unpack(file.read(_FOOTER.size))
        if magic != _MAGIC:
            raise ValueError("not a shard")
        file.seek(self.index_at)
        data = file.read(self.bloom_at - self.index_at)
        at, self.index = 4, []
        for _ in range(struct.unpack_from("<I", data)[0]):
            n, at = _read_varint(data, at)
            self.index.append((data[at : at + n], *_BLOCK_ROW.unpack_from(data, at + n)))
            at += n + _BLOCK_ROW.size
        self.type = np.dtype(f"<u{self.width}")
        self._held, self._of_key = -1, {}  # the block that the last lookup decoded
        file.seek(self.bloom_at)
        self.bloom = file.read((self.bits + 7) // 8)

    def _block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, place, size, plain = self.index[i]
        self.file.seek(place)
        data = _CODEC.decompress(self.file.read(size), plain, asbytes=True)
        at, key = 0, b""
        while at < plain:
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, np.frombuffer(data, dtype=self.type, count=length // self.width, offset=at)
            at += length

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self._block(i)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p // 8] >> (7 - p % 8) & 1 for p in _probes([key], self.bits)[0].tolist())

    def entries(self, doc_id: int | None) -> Iterator[np.ndarray]:
        """The ids of every entry with this key, in the shard's order; found by the filter and binary search."""
        key = key_of(doc_id)
        if not self.index or not self.may_hold(key):
            return
        lo, hi = 0, len(self.index)
        while lo < hi:  # the first block whose first key is not below the key
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.index[mid][0] < key else (lo, mid)
        for i in range(max(0, lo - 1), len(self.index)):
            if self.index[i][0] > key:
                break
            if self._held != i:
                self._of_key, self._held = {}, i
                for k, v in self._block(i):
                    self._of_key.setdefault(k, []).append(v)
            yield from self._of_key.get(key, ())

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry with this key (none: an empty list)."""
        return list(self.entries(doc_id))


#: first_key and last_key bound the shard's keys.
_MANIFEST = "shard long, path string, documents long, tokens long, first_key binary, last_key binary"


def write_shards(df: DataFrame, directory: str, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> list:
    """Writes the documents' ids as shards in `directory`, by ranges of the id; returns a manifest row for each shard.

    A task writes under a name of its own and renames, so a repeated task replaces its shard whole.
    The manifest has a row for each shard, not for each document.
    """

    def write(batches):
        fs, base = storage.filesystem(directory)
        part = TaskContext.get().partitionId()
        name, own = f"{base}/part-{part:06d}.sst", f"{base}/.{part:06d}-{uuid.uuid4().hex}"
        out = writer = None
        for batch in batches:
            keys = [key_of(x) for x in batch.column(0).to_pylist()]
            for a, ids, bounds in encoded_rows(batch.column(1), tokenizer, end):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(own)
                    writer = ShardWriter(out, ids.dtype.itemsize)
                at = bounds.tolist()
                for i in range(len(at) - 1):
                    writer.add(keys[a + i], ids[at[i] : at[i + 1]].tobytes())
        if writer is not None:
            writer.finish()
            out.close()
            fs.move(own, name)
            yield pa.RecordBatch.from_pydict({"shard": [part], "path": [name], "documents": [writer.documents], "tokens": [writer.tokens], "first_key": [writer.keys[0]], "last_key": [writer.keys[-1]]})

    # The random last column splits rows with one id and text over several shards, where they are very many.
    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"), F.rand(1).alias("s"))
    ordered = rows.repartitionByRange(F.col("id").asc_nulls_first(), "h", "s").sortWithinPartitions(F.col("id").asc_nulls_first(), "h")
    return sorted(ordered.select("id", "text").mapInArrow(workers.task(write, tokenizer), _MANIFEST).collect())


def read_shards(spark: SparkSession, directory: str, manifest: list) -> DataFrame:
    """Per document, from the shards: doc_id, start, n_tokens, ids_crc32, shard, looked_up.  In ascending order within a shard.

    looked_up: whether a lookup of the id (filter, binary search in the index, one block) gives the entries of the scan.
    """
    todo, before = [], 0
    for r in manifest:
        todo.append((r["shard"], r["path"], before))
        before += r["tokens"]

    def read(batches):
        fs, _ = storage.filesystem(directory)
        for batch in batches:
            for shard, path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows: list[tuple] = []
                found: list[bool] = []
                with fs.open_input_file(path) as file:
                    table = Shard(file)
                    for key, ids in table.scan():
                        rows.append((id_of(key), start, len(ids), crc(ids), shard))
                        start += len(ids)
                    for doc_id, own in groupby(rows, key=lambda r: r[0]):
                        want = [(r[2], r[3]) for r in own]
                        found += [want == [(len(ids), crc(ids)) for ids in table.entries(doc_id)]] * len(want)
                columns = [*(pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), pa.array(found)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "looked_up"])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, looked_up boolean"
    if not todo:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(todo, "shard long, path string, start long").repartition(len(todo)).mapInArrow(workers.task(read), schema)


def lookup(spark: SparkSession, directory: str, manifest: list, doc_ids: list[int | None]) -> DataFrame:
    """doc_id, ids of every entry of a list of ids; only shards whose key range holds one of them are opened, one task each."""
    keys = sorted({(key_of(x), x) for x in doc_ids}, key=lambda k: k[0])
    todo = []
    for r in manifest:
        own = [x for k, x in keys if bytes(r["first_key"]) <= k <= bytes(r["last_key"])]
        if own:
            todo.append((r["path"], own))

    def read(batches):
        fs, _ = storage.filesystem(directory)
        for batch in batches:
            for path, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(path) as file:
                    table = Shard(file)
                    rows = [(x, ids.tolist()) for x in own for ids in table.entries(x)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], ["doc_id", "ids"])

    if not todo:
        return spark.createDataFrame([], "doc_id long, ids array<int>")
    return spark.createDataFrame(todo, "path string, own array<long>").repartition(len(todo)).mapInArrow(read, "doc_id long, ids array<int>")
