"""Token-id output: documents in key order as raw id payloads with a minimal perfect hash index.

File format.  A token folder holds

``raw/NAME.ids``
    ids of one shard, little endian, ``width`` bytes each, documents one after another;
``raw/NAME.mph``
    the shard's index: one 32-bit displacement for each bucket of the hash, one
    (fingerprint u32, offset u64, length u64) for each document, then keys (i64)
    and a byte for each key that is null, in payload order;
``directory``
    a small Parquet table, one row for each shard: its name, place (part, seq),
    smallest and largest key, documents, tokens, width, and the buckets of its hash.

The hash sends a key to a bucket, the bucket's displacement sends it to its slot,
the fingerprint tells a foreign key, and (offset, length) cut the payload.  A
keyed read takes one displacement, one slot and the document's own ids, by their
byte offsets, whatever the shard holds.  A key that repeats is indexed with its
occurrence number, so every row stays reachable; null keys are indexed likewise
(with a mark of their own) and come first.

Tasks write raw files under names that nobody else uses; the directory, which
Spark commits, names those that count.  A task that runs twice leaves files that
no reader sees.  Raw files go through Arrow's file systems (local or mounted
folders, hdfs, s3, gs, abfs), which executors must reach.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specgraph.llm.encoders import default_path, encoder, small_batches

#: Ids after which a shard is closed; one document is never split.
SHARD_TOKENS = 2_000_000
#: Most tasks that read a folder; beyond so many shards a task reads several, one after another.
MOST_TASKS = 100_000
#: Code points of a text that help to deal out the rows of a key that repeats.
PREFIX = 32
SLOT = np.dtype([("print", "<u4"), ("offset", "<u8"), ("length", "<u8")])
DIRECTORY = "part int, seq int, name string, low long, high long, nulls long, docs long, n_tokens long, width int, buckets long"

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _B
        x = (x ^ (x >> np.uint64(27))) * _C
        return x ^ (x >> np.uint64(31))


def _hashed(keys: np.ndarray, occurrence: np.ndarray, null=False) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(_mix(keys.astype(np.int64).view(np.uint64) + _A) + occurrence.astype(np.uint64) * _A + np.where(null, _B, np.uint64(0)))


def _place(h: np.ndarray, seed, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mix(h + np.asarray(seed, np.uint64) * _C) % np.uint64(n)).astype(np.int64)


def occurrences(keys: np.ndarray) -> np.ndarray:
    """0, 1, ... for the repeats of each key, in order."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    first = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
    run = np.arange(len(s)) - np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
    out = np.empty(len(s), np.int64)
    out[order] = run
    return out


def build_hash(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seeds, slot of each key): hash and displace, largest buckets first."""
    n = len(h)
    buckets = max(1, -(-n // 4))
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    seeds, slot, free = np.zeros(buckets, "<u4"), np.empty(n, np.int64), np.ones(n, bool)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    tries = np.arange(256, dtype=np.uint64)
    for b in np.argsort(-np.diff(ends), kind="stable"):
        own = order[ends[b] : ends[b + 1]]
        if not len(own):
            break
        start = np.uint64(0)
        while True:
            at = _place(h[own][None, :], (start + tries)[:, None], n)
            ok = free[at].all(1)
            if len(own) > 1:
                s = np.sort(at, 1)
                ok &= (s[:, 1:] != s[:, :-1]).all(1)
            if ok.any():
                k = int(np.argmax(ok))
                seeds[b], slot[own] = start + tries[k], at[k]
                free[at[k]] = False
                break
            start += np.uint64(256)
    return seeds, slot


def build_index(keys: np.ndarray, nulls: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """(seeds, slots); a null key counts as 0 with a mark."""
    occurrence = np.where(nulls, np.cumsum(nulls) - 1, 0)
    occurrence[~nulls] = occurrences(keys[~nulls])
    h = _hashed(keys, occurrence, nulls)
    seeds, slot = build_hash(h)
    table = np.zeros(len(keys), SLOT)
    table["print"][slot] = (h >> np.uint64(32)).astype("<u4")
    table["length"][slot] = lengths
    table["offset"][slot] = np.cumsum(lengths) - lengths
    return seeds.tobytes(), table.tobytes()


def store(path: str) -> tuple[FileSystem, str]:
    """(file system, folder) of a path or URI; an error where Arrow doesn't know its kind."""
    if path.startswith("file:"):
        return LocalFileSystem(), "/" + path[5:].lstrip("/")
    return FileSystem.from_uri(path)


class Shard:
    """One shard, read by byte offsets; ``bytes_read`` counts what was asked for."""

    def __init__(self, path: str, name: str, docs: int, width: int, buckets: int):
        self.fs, base = store(path)
        self.ids_at, self.index_at = f"{base}/raw/{name}.ids", f"{base}/raw/{name}.mph"
        self.docs, self.width, self.buckets, self.bytes_read = docs, width, buckets, 0

    def _read(self, path: str, at: int = 0, n: int | None = None) -> bytes:
        with self.fs.open_input_file(path) as f:
            f.seek(at)
            out = f.read(n)
        self.bytes_read += len(out)
        return out

    def find(self, key: int | None, occurrence: int = 0) -> tuple[int, int] | None:
        """(offset, length) in ids of one row of a key, None where the fingerprint shows that the shard lacks it."""
        h = _hashed(np.array([key or 0]), np.array([occurrence]), key is None)
        seed = np.frombuffer(self._read(self.index_at, 4 * int(h[0] % np.uint64(self.buckets)), 4), "<u4")
        slot = int(_place(h, seed, self.docs)[0])
        got = np.frombuffer(self._read(self.index_at, 4 * self.buckets + SLOT.itemsize * slot, SLOT.itemsize), SLOT)[0]
        return (int(got["offset"]), int(got["length"])) if got["print"] == int(h[0]) >> 32 else None

    def ids(self, offset: int, length: int) -> np.ndarray:
        return np.frombuffer(self._read(self.ids_at, offset * self.width, length * self.width), f"<u{self.width}")

    def rows(self, key: int | None):
        """Ids of every row of a key."""
        occurrence = 0
        while (at := self.find(key, occurrence)) is not None:
            yield self.ids(*at)
            occurrence += 1

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, keys, nulls, offset, length) of the whole shard, each document found through the index."""
        index, ids = self._read(self.index_at), np.frombuffer(self._read(self.ids_at), f"<u{self.width}")
        slots_at, keys_at = 4 * self.buckets, 4 * self.buckets + SLOT.itemsize * self.docs
        seeds, table = np.frombuffer(index[:slots_at], "<u4"), np.frombuffer(index[slots_at:keys_at], SLOT)
        keys = np.frombuffer(index[keys_at : keys_at + 8 * self.docs], "<i8")
        nulls = np.frombuffer(index[keys_at + 8 * self.docs :], np.uint8).astype(bool)
        occurrence = np.where(nulls, np.cumsum(nulls) - 1, 0)
        occurrence[~nulls] = occurrences(keys[~nulls])
        h = _hashed(keys, occurrence, nulls)
        got = table[_place(h, seeds[(h % np.uint64(self.buckets)).astype(np.int64)], self.docs)]
        if (got["print"] != (h >> np.uint64(32)).astype("<u4")).any():
            raise ValueError("token folder: an index misses a key of its shard")
        return ids, keys, nulls, got["offset"].astype(np.int64), got["length"].astype(np.int64)


def _shards(path: str, tokenizer: str, end_id: int, shard_tokens: int):
    def make(batches):
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        width, part, seq = enc.dtype.itemsize, TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        ids: list[bytes] = []
        size = 0

        def close():
            fs, base = store(path)
            fs.create_dir(f"{base}/raw", recursive=True)
            name = uuid.uuid4().hex
            lengths, nulls = np.array([len(x) // width for x in ids], np.int64), np.array([k is None for k in keys])
            known = np.array([k or 0 for k in keys], "<i8")
            seeds, slots = build_index(known, nulls, lengths)
            for kind, data in (("ids", b"".join(ids)), ("mph", seeds + slots + known.tobytes() + nulls.astype(np.uint8).tobytes())):
                with fs.open_output_stream(f"{base}/raw/{name}.{kind}") as f:
                    f.write(data)
            some = known[~nulls]
            row = [part, seq, name, int(some.min()) if len(some) else None, int(some.max()) if len(some) else None, int(nulls.sum()), len(keys), int(lengths.sum()), width, len(seeds) // 4]
            kinds = [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 5, pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["part", "seq", "name", "low", "high", "nulls", "docs", "n_tokens", "width", "buckets"])

        for batch in small_batches(batches):
            for key, own in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1))):
                keys.append(key)
                ids.append(own.tobytes() + end)
                size += len(own) + 1
                if size >= shard_tokens:
                    yield close()
                    keys, ids, size, seq = [], [], 0, seq + 1
        if keys:
            yield close()

    return make


def write_token_table(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode ``docs`` and write them in ascending key order as a token folder.

    Texts cross one range shuffle and are encoded behind it, so ids are never
    shuffled.  The rows of a key that repeats are dealt on by the start of their
    text and a random number, so a hot key takes many tasks.  Null texts are empty
    (just the end id); null keys come first; repeated keys keep all their rows; an
    empty table gives an empty folder.
    """
    store(path)  # an unknown kind of store is an error here, not in a task
    own = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    first = F.col("key").asc_nulls_first()
    dealt = own.withColumns({"prefix": F.substring("text", 1, PREFIX), "lot": F.rand(1)}).repartitionByRange(first, F.col("prefix").asc_nulls_first(), "lot")
    ordered = dealt.select("key", "text").sortWithinPartitions(first, "text")
    ordered.mapInArrow(_shards(path, tokenizer or default_path(), end_id, shard_tokens), DIRECTORY).write.parquet(f"{path}/directory")


def directory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DIRECTORY).parquet(f"{path}/directory")


def shard_starts(shards: DataFrame) -> DataFrame:
    """(name, base): ids before each shard.  The unpartitioned window sees one row for each writing task only."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("own"))
    before = parts.select("part", (F.sum("own").over(W.orderBy("part")) - F.col("own")).alias("before"))
    inner = shards.select("part", "name", (F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq")) - F.col("n_tokens")).alias("inside"))
    return inner.join(before, "part").select("name", (F.col("before") + F.col("inside")).alias("base"))


def _documents(path: str):
    def run(batches):
        for batch in batches:
            for name, docs, width, buckets, base in zip(*(batch.column(i).to_pylist() for i in range(5))):
                ids, keys, nulls, offset, length = Shard(path, name, docs, width, buckets).all()
                crc = [zlib.crc32(ids[o : o + n].astype("<u4").tobytes()) for o, n in zip(offset.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64(), mask=nulls), pa.array(base + offset, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return run


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, cut from the raw files through the index; a task holds one shard at a time."""
    shards = directory(spark, path)
    based = shards.join(shard_starts(shards), "name").select("name", "docs", "width", "buckets", "base")
    many = max(1, shards.count())  # rows are small and stand for large files: one task a shard, not what their own size suggests
    return based.repartition(min(many, MOST_TASKS), "name").mapInArrow(_documents(path), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _fetch(path: str):
    def run(batches):
        for batch in batches:
            for want, name, docs, width, buckets in zip(*(batch.column(i).to_pylist() for i in range(5))):
                shard = Shard(path, name, docs, width, buckets)
                found = [(k, ids.astype(np.int64)) for k in want for ids in shard.rows(k)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in found], pa.int64()), pa.array([i for _, i in found], pa.list_(pa.int64())), pa.array([shard.bytes_read] * len(found), pa.int64())], ["doc_id", "ids", "bytes_read"]
                )

    return run


def fetch(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """(doc_id, ids, bytes_read) of all rows of the wanted keys; keys that the folder lacks give no row.

    ``keys`` is a stated list of the caller.  Only shards whose key range holds one
    of them are opened, and of these only index entries and the documents' own ids
    are read; bytes_read is what the shard's task has read for all of its keys.
    """
    wanted = F.array(*[F.lit(int(k)).cast("long") for k in sorted(set(keys))]) if keys else F.array().cast("array<long>")
    inside = F.filter(wanted, lambda k: (k >= F.col("low")) & (k <= F.col("high")))
    return directory(spark, path).withColumn("want", inside).where(F.size("want") > 0).select("want", "name", "docs", "width", "buckets").mapInArrow(_fetch(path), "doc_id long, ids array<long>, bytes_read long")
