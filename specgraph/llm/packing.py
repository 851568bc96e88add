"""Best-fit packing of tokenized documents into sequences of a fixed length.

Only the lengths of the pieces decide a packing, and there are at most
``capacity`` different lengths.  The histogram of lengths therefore goes to the
driver (a table of at most ``capacity`` rows at any input size), the plan is made
there, and the pieces are numbered and placed by Spark:

1. exact complements: full pieces, then pairs, then triples of lengths that sum
   to the capacity are looked up by length and consumed as often as the counts
   allow;
2. the rest is packed best fit, longest first, on whole groups of equal bins.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specgraph.llm.encoders import default_path, encoder, small_batches
from specgraph.storage import write

CAPACITY = 2048
#: Rows of the counts by task and length (24 bytes each) up to which Spark may broadcast them; beyond, both sides are shuffled.
BROADCAST_ROWS = 20_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of one bin, number of such bins)] that uses every piece once.

    >>> plan_packing({6: 1, 4: 2, 3: 2, 1: 1}, 10)
    [((6, 4), 1), ((4, 3, 3), 1), ((1,), 1)]
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} isn't in 1..{capacity}")
        left[length] += n
    plan: list[tuple[tuple[int, ...], int]] = []

    def consume(*lengths: int) -> None:
        uses = {x: lengths.count(x) for x in lengths}
        times = min(int(left[x]) // k for x, k in uses.items())
        if times:
            for x, k in uses.items():
                left[x] -= times * k
            plan.append((lengths, times))

    consume(capacity)
    for a in range(capacity - 1, capacity - capacity // 2 - 1, -1):
        if left[a] and left[capacity - a]:
            consume(a, capacity - a)
    for a in range(capacity - 2, 0, -1):
        if not left[a]:
            continue
        gap = capacity - a
        b = np.arange(min(a, gap - 1), (gap + 1) // 2 - 1, -1)
        if len(b):
            for x in b[(left[b] > 0) & (left[gap - b] > 0)]:
                consume(a, int(x), int(gap - x))
                if not left[a]:
                    break
    return plan + _best_fit(left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing on groups: bins with the same content are handled together."""
    gaps: list[int] = []  # open gaps, ascending
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(content: tuple[int, ...], n: int) -> None:
        gap = capacity - sum(content)
        if n:
            if gap not in bins:
                bins[gap] = []
                bisect.insort(gaps, gap)
            bins[gap].append((content, n))

    for x in range(capacity, 0, -1):
        n = int(left[x])
        while n:
            k = bisect.bisect_left(gaps, x)
            if k < len(gaps):
                gap = gaps[k]
                content, same = bins[gap].pop()
                if not bins[gap]:
                    del bins[gap]
                    gaps.pop(k)
            else:
                gap, content, same = capacity, (), -(-n // (capacity // x))
            each = gap // x
            filled = min(same, n // each)
            put(content + (x,) * each, filled)
            n -= filled * each
            if filled < same:
                part = min(n, each)
                if part:
                    put(content + (x,) * part, 1)
                    n -= part
                put(content, same - filled - (part > 0)) if content else None
    return [b for gap in gaps for b in bins[gap]]


class Placement:
    """Where the g-th piece of a length goes, as sorted arrays for each length."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]]):
        self.segments: dict[int, list[tuple[int, int, tuple[int, ...]]]] = {}
        used: dict[int, int] = {}
        self.sequences = 0
        for content, times in plan:
            at: dict[int, list[int]] = {}
            offset = 0
            for x in content:
                at.setdefault(x, []).append(offset)
                offset += x
            for x, offsets in at.items():
                self.segments.setdefault(x, []).append((used.get(x, 0), self.sequences, tuple(offsets)))
                used[x] = used.get(x, 0) + times * len(offsets)
            self.sequences += times

    def place(self, length: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(g), np.int64), np.empty(len(g), np.int64)
        for x in np.unique(length):
            rows = np.flatnonzero(length == x)
            parts = self.segments[int(x)]
            k = np.searchsorted([p[0] for p in parts], g[rows], "right") - 1
            for j in np.unique(k):
                begin, first, offsets = parts[j]
                own = rows[k == j]
                i = g[own] - begin
                sequence[own] = first + i // len(offsets)
                offset[own] = np.array(offsets)[i % len(offsets)]
        return sequence, offset


def _cut(path: str, end_id: int, capacity: int):
    def run(batches):
        enc = encoder(path)
        end = np.array([end_id], "<u4")
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in small_batches(batches):
            rows = []
            for key, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1))):
                ids = np.concatenate([ids.astype("<u4"), end])
                start, size = 0, (len(ids) - 1) % capacity + 1  # the first piece may be shorter
                piece = 0
                while start < len(ids):
                    rows.append((key, piece, start, size, zlib.crc32(ids[start : start + size].tobytes()), task, int(seen[size])))
                    seen[size] += 1
                    start, size, piece = start + size, capacity, piece + 1
            cols = list(zip(*rows)) or [[]] * 7
            types = (pa.int64(), pa.int32(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return run


def cut_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece; nth numbers the pieces of a length within the task that wrote them."""
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(_cut(tokenizer or default_path(), end_id, capacity), PIECE_SCHEMA)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ``docs`` with sequence_id and offset, gapless from 0 in each sequence.

    Null texts are empty documents of one end id.  Null and repeated keys are
    packed like any others, row by row.  An empty table gives no rows.
    """
    pieces = write(cut_pieces(docs, key, text, tokenizer, end_id, capacity), "pieces").df
    own = write(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "counts").df
    lengths = own.groupBy("length").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("tasks")).collect()  # at most ``capacity`` rows
    placement = Placement(plan_packing({int(r.length): int(r.n) for r in lengths}, capacity))
    before = own.select("task", "length", (F.sum("n").over(W.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    if sum(r.tasks for r in lengths) > BROADCAST_ROWS:  # one row for each task and length: it grows with the input
        before = before.hint("merge")

    def place(frames):
        for f in frames:
            sequence, offset = placement.place(f["length"].to_numpy(), f["g"].to_numpy())
            yield pd.DataFrame({**{c: f[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}, "sequence_id": sequence, "offset": offset})

    numbered = pieces.join(before, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("g"))
    return numbered.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _piece_ids(path: str, end_id: int):
    def run(batches):
        enc = encoder(path)
        for batch in small_batches(batches):
            ids = [np.append(x, x.dtype.type(end_id)) for x in enc.encode(batch.column(1))]
            sid, off, out = [], [], []
            for own, places in zip(ids, batch.column(2).to_pylist()):
                for p in places:
                    sid.append(p["sequence_id"])
                    off.append(p["offset"])
                    out.append(own[p["start"] : p["start"] + p["length"]].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), pa.array(off, pa.int64()), pa.array(out, pa.list_(pa.int32()))], ["sequence_id", "offset", "ids"])

    return run


def sequences(docs: DataFrame, placed: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """(sequence_id, ids) of the packed sequences; keys must be unique and not null here.

    A sequence holds ``capacity`` ids at most, so its group is bounded.
    """
    where = placed.groupBy(F.col("doc_id").alias("key")).agg(F.collect_list(F.struct("sequence_id", "offset", "start", "length")).alias("places"))
    joined = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(where, "key")
    parts = joined.mapInArrow(_piece_ids(tokenizer or default_path(), end_id), "sequence_id long, offset long, ids array<int>")
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
