"""Token ids in sorted-string-table shards.

A shard is one file, ascending by document id:

    data blocks | block index | Bloom filter | footer

* A key is the id as 8 big-endian bytes with the sign bit turned, so that bytes sort as numbers; a null id is the empty key.
* A block holds entries of about BLOCK bytes: varint length shared with the key before, varint length of the rest, varint number of
  ids, the rest of the key, the ids as little-endian unsigned 32-bit integers. It is compressed as a whole by zstd.
* The index has for each block its last key, offset, stored and plain length and the checksum of what is stored. The filter has BITS_PER_KEY bits a key.
* The footer is fixed: offsets and lengths of index and filter, numbers of entries and ids, the checksum of index and filter and the magic
  bytes. Every read compares checksums.

A task writes one range of ids to a name of its own and renames it when the file is whole, so tasks may be retried or run twice; the
manifest names the files of the tasks that won, with their first and last id, so that a lookup opens one shard. Blocks leave memory as they fill.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideglass.llm.common import documents, scratch, written
from tideglass.llm.tokens import END_ID, encoder, model_path, slices
from tideglass.sources.scratch import qualified

BLOCK, BITS_PER_KEY, PROBES, CODEC, MAGIC = 64 * 1024, 10, 7, "zstd", b"TGSST002"
FOOTER, BLOCK_AT = struct.Struct("<QQQQQQI8s"), struct.Struct("<QIII")
SHARD_BYTES = 16_000_000
MANIFEST = "shard int, path string, first_id long, last_id long, n_docs long, n_tokens long"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + 2**63) % 2**64)


def id_of(key: bytes) -> int | None:
    return None if not key else struct.unpack(">Q", key)[0] - 2**63


def varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * b) % bits for i in range(PROBES)]


def file_system(path: str):
    """The store and the path in it, for reading and writing in tasks. path has a scheme; Hadoop writes local ones with one slash."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)


class Writer:
    """Writes entries in ascending order of keys; equal keys are allowed."""

    def __init__(self, path: str) -> None:
        self.fs, self.path = file_system(path)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out, self.at = self.fs.open_output_stream(self.temp), 0
        self.block, self.size, self.last, self.index = [], 0, b"", []
        self.keys: list[bytes] = []
        self.n_docs = self.n_tokens = 0

    def add(self, key: bytes, ids: bytes) -> None:
        if self.size >= BLOCK:
            self._flush()
        shared = 0
        while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        entry = varint(shared) + varint(len(key) - shared) + varint(len(ids) // 4) + key[shared:] + ids
        self.block.append(entry)
        self.size += len(entry)
        self.last = key
        self.keys.append(key)
        self.n_docs += 1
        self.n_tokens += len(ids) // 4

    def _put(self, data: bytes) -> tuple[int, int]:
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return at, len(data)

    def _flush(self) -> None:
        if self.block:
            plain = b"".join(self.block)
            stored = pa.compress(plain, codec=CODEC, asbytes=True)
            self.index.append((self.last, *self._put(stored), len(plain), zlib.crc32(stored)))
            self.block, self.size, self.last = [], 0, b""  # the first key of a block is whole

    def close(self) -> None:
        self._flush()
        index = b"".join(varint(len(k)) + k + BLOCK_AT.pack(*rest) for k, *rest in self.index)
        bits = max(64, BITS_PER_KEY * len(self.keys))
        bloom = bytearray(-(-bits // 8))
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        filter_ = struct.pack("<Q", bits) + bytes(bloom)
        self.out.write(FOOTER.pack(*self._put(index), *self._put(filter_), self.n_docs, self.n_tokens, zlib.crc32(filter_, zlib.crc32(index)), MAGIC))
        self.out.close()
        self.fs.move(self.temp, self.path)


class Reader:
    """Reads a shard: in order, or one key by binary search. Only the block that is asked for is in memory."""

    def __init__(self, path: str) -> None:
        self.uri = path
        self.fs, self.path = file_system(path)
        self.file = self.fs.open_input_file(self.path)
        size = self.file.size()
        if size < FOOTER.size:
            raise ValueError(f"{path} is not a whole shard")
        *at, self.n_docs, self.n_tokens, checksum, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a whole shard")
        data, raw = self.file.read_at(at[1], at[0]), self.file.read_at(at[3], at[2])
        if zlib.crc32(raw, zlib.crc32(data)) != checksum:
            raise ValueError(f"{path}: index and filter do not have their checksum")
        self.index, i = [], 0
        while i < len(data):
            n, i = read_varint(data, i)
            self.index.append((data[i : i + n], *BLOCK_AT.unpack_from(data, i + n)))
            i += n + BLOCK_AT.size
        self.bits, self.bloom = struct.unpack_from("<Q", raw)[0], raw[8:]

    def _block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, stored, plain, checksum = self.index[k]
        raw = self.file.read_at(stored, at)
        if zlib.crc32(raw) != checksum:
            raise ValueError(f"{self.path}: block {k} does not have its checksum")
        data = pa.decompress(raw, decompressed_size=plain, codec=CODEC, asbytes=True)
        i, key = 0, b""
        while i < len(data):
            shared, i = read_varint(data, i)
            rest, i = read_varint(data, i)
            n, i = read_varint(data, i)
            key = key[:shared] + data[i : i + rest]
            i += rest
            yield key, data[i : i + 4 * n]
            i += 4 * n

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.index)):
            yield from self._block(k)

    def get(self, doc_id: int | None) -> list[bytes]:
        """The ids of all entries with this document id."""
        key, found = key_of(doc_id), []
        if any(not self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return found
        k = bisect.bisect_left(self.index, key, key=lambda x: x[0])
        while k < len(self.index):
            for other, ids in self._block(k):
                if other == key:
                    found.append(ids)
                elif other > key:
                    return found
            k += 1
        return found

    def close(self) -> None:
        self.file.close()


def write_shards(docs: DataFrame, folder: str, *, tokenizer: str | None = None, end_id: int = END_ID, shards: int | None = None, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts, append the end id, write them to shards in folder, and return the manifest: shard, path, first_id, last_id, n_docs, n_tokens.

    Shards are ranges of ids in ascending order; their number follows the bytes of text, shard_bytes each. Null ids come first. Rows that
    repeat an id are all written; among equal ids the order is that of the texts' hashes. A null or empty text is the end id alone. An empty table gives an
    empty manifest. folder must lie where all executors write, and be one that pyarrow's file systems open; without a scheme it is on the
    default file system of the cluster.
    """
    path, folder = tokenizer or model_path(), qualified(docs.sparkSession, folder)
    n = shards or max(1, -(-(docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0) // shard_bytes))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("tie"))
    ranged = rows.repartitionByRange(n, F.col("id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("id").asc_nulls_first(), "tie").select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, out, encode, first = TaskContext.get().partitionId(), None, encoder(path, end_id), None
        name = f"{folder}/shard-{shard:06d}-{TaskContext.get().taskAttemptId()}.sst"
        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, ids in zip(part.column("id").to_pylist(), encode(part.column("text").to_pylist()), strict=True):
                    if out is None:
                        out, first = Writer(name), doc_id
                    out.add(key_of(doc_id), ids)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [name], "first_id": pa.array([first], pa.int64()), "last_id": pa.array([doc_id], pa.int64()), "n_docs": [out.n_docs], "n_tokens": [out.n_tokens]})

    return written(ranged.mapInArrow(write, MANIFEST), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Per document, in the order of the files: doc_id, start, n_tokens and ids (binary, little-endian unsigned 32-bit).

    start counts the ids of all documents before it; equal and null ids are documents like any other. An empty manifest gives no row.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                source, rows, size = Reader(path), [], 0
                for key, ids in source:
                    rows.append((id_of(key), at, len(ids) // 4, ids))
                    at, size = at + len(ids) // 4, size + len(ids)
                    if size > 8_000_000 or len(rows) >= 5_000:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)
                source.close()

    # one row a shard; the order of shards is the order of ids
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    shards = max(1, manifest.count())
    return manifest.withColumn("before", before).repartition(shards, "shard").select("path", "before").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def lookup(manifest: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id and ids of each entry whose id is in wanted, once for each row of wanted; ids that no shard has give no row. Null finds null.

    The last ids of the shards, one number each, go to the tasks, which find a wanted id's shards by binary search; each shard is opened
    by the task that its path is dealt to, and a filter and a binary search over its blocks find the entry.
    """
    shards = sorted((key_of(r.last_id), key_of(r.first_id), r.path) for r in manifest.select("first_id", "last_id", "path").collect())

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc_id in batch.column("doc_id").to_pylist():
                key = key_of(doc_id)
                k = bisect.bisect_left(shards, key, key=lambda x: x[0])
                while k < len(shards) and shards[k][1] <= key:
                    found.append((doc_id, shards[k][2]))
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.string())], ["doc_id", "path"])

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = None
        for batch in batches:
            rows = []
            for doc_id, path in zip(batch.column("doc_id").to_pylist(), batch.column("path").to_pylist(), strict=True):
                if source is None or source.uri != path:
                    if source:
                        source.close()
                    source = Reader(path)
                rows += [(doc_id, ids) for ids in source.get(doc_id)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["doc_id", "ids"])

    at = wanted.select(F.col(id_col).cast("long").alias("doc_id")).mapInArrow(locate, "doc_id long, path string")
    return at.repartition("path").sortWithinPartitions("path").mapInArrow(get, "doc_id long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc_id, start, n, ids = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


def digest(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of what read_shards() gives."""
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read_shards(write_shards(documents(spark, sf_dir), scratch(spark, "sstable"))))
