"""Hard negatives of anchor vectors: exact integer inner products by subset-sum tables.

1. Components become whole numbers.  All rows are sorted by label into blocks; a block
   keeps its candidates as bit planes: for each plane and each group of eight dimensions
   one byte a candidate, the bits of the group's dimensions in that plane (two's complement).
2. For each anchor and group of eight dimensions the sums of all 256 subsets of the anchor's
   eight components are tabled (the Four-Russians trick): a candidate's byte is the index of
   its subset.  Summing the groups' entries gives a plane's share of the inner product, and
   shifting and adding planes from the highest down gives the whole score, exactly.
3. Two passes.  The first scores candidates of each anchor's own label and keeps the best as
   positives; the second scores the others and keeps, for each positive, the best whose score
   lies within the positive's window.  A task scores one block of candidates with one group
   of anchors and hands on a bounded number of rows for each anchor; Spark merges them.

Every anchor meets every row: nothing is pruned, sampled or approximated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specgraph.llm.encoders import small_batches
from specgraph.storage import arrow_rows, scratch, write

#: Candidates of a block, and anchors of a group (about: anchors are dealt by a hash).
BLOCK, ANCHORS = 16_384, 512
#: The table is cut into so many blocks at least, down to blocks of ``SMALL`` rows.
LEAST_BLOCKS, SMALL = 48, 256
#: Candidates and anchors whose scores are added up at once, so that they stay in a core's cache.
SLICE, ABREAST = 2048, 64
#: Components are below this in magnitude and vectors no longer than ``MOST_DIMENSIONS``, so that scores times ten fit in a long.
COMPONENT, MOST_DIMENSIONS = 1 << 23, 1 << 12
_POSITIVES = "anchor long, vec_id long, score long"
_NEGATIVES = "anchor long, place int, negative long, score long"
_PLANES = "block long, dim int, low long, high long, ids binary, labels binary, planes binary"


def whole_components(x: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as double."""
    return F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("int"))


def taking_part(vectors: DataFrame, key: str, embedding: str, label: str, scale: int) -> DataFrame:
    """(vec_id, label, q): the rows that anchors and candidates are taken from."""
    x = F.col(embedding)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < COMPONENT))
    own = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & F.size(x).between(1, MOST_DIMENSIONS) & fine)
    return own.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), whole_components(x, scale).alias("q"))


def bit_planes(q: np.ndarray) -> np.ndarray:
    """(planes, groups, rows) bytes of whole numbers (rows, dimensions); the last plane holds the signs."""
    n, dim = q.shape
    depth = max(int(max(q.max(initial=0), -(q.min(initial=0)) - 1)).bit_length() + 1, 2)
    padded = np.zeros((n, -(-dim // 8) * 8), np.int32)
    padded[:, :dim] = q
    out = np.empty((depth, padded.shape[1] // 8, n), np.uint8)
    for p in range(depth):
        out[p] = np.packbits(((padded >> p) & 1).astype(np.uint8), axis=1, bitorder="little").T
    return out


def subset_sums(anchors: np.ndarray, dtype: type) -> np.ndarray:
    """(groups, 256, anchors): for each group of eight dimensions the sum of each subset of an anchor's components."""
    a, dim = anchors.shape
    padded = np.zeros((a, -(-dim // 8) * 8), dtype)
    padded[:, :dim] = anchors
    parts = padded.reshape(a, -1, 8).transpose(1, 2, 0)
    out = np.zeros((parts.shape[0], 256, a), dtype)
    for bit in range(8):  # a subset with this bit as its highest is one without it, plus the component
        out[:, 1 << bit : 2 << bit] = out[:, : 1 << bit] + parts[:, bit : bit + 1]
    return out


def scores(planes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """(rows, anchors) inner products: table entries of all groups summed, planes shifted and added from the signs down."""
    depth, groups, n = planes.shape
    whole = np.zeros((n, tables.shape[2]), tables.dtype)
    for first in range(0, n, SLICE):
        out, own = whole[first : first + SLICE], planes[:, :, first : first + SLICE]
        part = np.empty_like(out)
        for p in range(depth - 1, -1, -1):
            out += out
            for g in range(groups):
                np.take(tables[g], own[p, g], axis=0, out=part, mode="clip")
                if p == depth - 1:
                    out -= part
                else:
                    out += part
    return whole


def _blocks(rows_of_block: int):
    """Rows sorted by length and label become blocks of one length; only one block is held."""

    def close(parts: list) -> pa.RecordBatch:
        ids, labels = (np.concatenate([p[i] for p in parts]) for i in range(2))
        q = np.concatenate([p[2] for p in parts])
        order = np.argsort(ids, kind="stable")  # ties inside a block then follow the ids
        row = [int(ids[0]), q.shape[1], int(labels.min()), int(labels.max()), ids[order].tobytes(), labels[order].tobytes(), bit_planes(q[order]).tobytes()]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 3]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["block", "dim", "low", "high", "ids", "labels", "planes"])

    def run(batches):
        parts, held = [], 0
        for batch in small_batches(batches):
            dims = batch.column(3).to_numpy()
            cuts = [0, *(np.flatnonzero(dims[1:] != dims[:-1]) + 1).tolist(), len(dims)]
            for first, last in zip(cuts[:-1], cuts[1:]):
                while first < last:
                    if parts and (held == rows_of_block or parts[0][2].shape[1] != dims[first]):
                        yield close(parts)
                        parts, held = [], 0
                    n = min(last - first, rows_of_block - held)
                    piece = batch.slice(first, n)
                    q = np.asarray(piece.column(2).flatten(), np.int32).reshape(n, -1)
                    parts.append((piece.column(0).to_numpy(), piece.column(1).to_numpy(), q))
                    held, first = held + n, first + n
        if parts:
            yield close(parts)

    return run


def _packed_anchors(anchors: DataFrame, groups: int) -> DataFrame:
    """(dim, share, anchors): groups of anchors, each with what a task must know of it."""
    share = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("share")
    return anchors.groupBy(F.size("q").alias("dim"), share).agg(F.collect_list(F.struct(*anchors.columns)).alias("anchors"))


def _cells(blocks: DataFrame, packed: DataFrame, groups: int, tasks: int) -> DataFrame:
    """One row for each block and group of anchors of the same length, dealt evenly over ``tasks``.

    The pairs are small rows made from the blocks' numbers; anchors and then the block's bytes join them by their own keys.
    A cell is little to ship and much to compute, so its size doesn't tell how many a task may take.
    """
    pairs = blocks.select("block", "dim", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("share"))
    return pairs.join(packed, ["dim", "share"]).join(blocks.drop("dim"), "block").repartition(tasks)


def _held(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
    return ids, labels, np.frombuffer(row["planes"], np.uint8).reshape(-1, -(-row["dim"] // 8), len(ids))


def _scored(row: dict, which: np.ndarray, q: np.ndarray, planes: np.ndarray):
    """(number of an anchor, its scores with all candidates of the block), a slice of anchors at a time."""
    depth = planes.shape[0]
    reach = int(np.abs(q).max(initial=1)) << (depth + int(row["dim"]).bit_length())
    dtype = np.int32 if reach < 1 << 30 else np.int64
    for first in range(0, len(which), ABREAST):
        own = which[first : first + ABREAST]
        found = np.ascontiguousarray(scores(planes, subset_sums(q[own], dtype)).T)
        yield from zip(own.tolist(), found)


def _best(score: np.ndarray, allowed: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest allowed scores, the smaller places among equals."""
    at = np.flatnonzero(allowed)
    if len(at) > most:
        own = score[at]
        last = np.partition(own, len(own) - most)[len(own) - most]
        above = at[own > last]
        at = np.concatenate([above, at[own == last][: most - len(above)]])
    return at


def _rows_of(batches):
    for batch in batches:
        yield from (row for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist())


def _anchor_arrays(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own = row["anchors"]
    return np.array([a["vec_id"] for a in own], np.int64), np.array([a["label"] for a in own], np.int64), np.array([a["q"] for a in own], np.int64)


def _as_batch(columns: list[list[np.ndarray]], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], k) for c, k in zip(columns, kinds)], names)


def _positive_cells(most: int):
    def run(batches):
        for row in _rows_of(batches):
            keys, own, q = _anchor_arrays(row)
            which = np.flatnonzero((own >= row["low"]) & (own <= row["high"]))
            if not len(which):
                continue
            ids, labels, planes = _held(row)
            out: list[list] = [[], [], []]
            for k, score in _scored(row, which, q, planes):
                at = _best(score, (labels == own[k]) & (ids != keys[k]), most)
                for c, v in zip(out, (np.full(len(at), keys[k]), ids[at], score[at].astype(np.int64))):
                    c.append(v)
            yield _as_batch(out, ["anchor", "vec_id", "score"], [pa.int64()] * 3)

    return run


def _negative_cells(most: int, low: int, high: int):
    def run(batches):
        for row in _rows_of(batches):
            keys, own, q = _anchor_arrays(row)
            which = np.flatnonzero(np.full(len(own), row["low"] != row["high"]) | (own != row["low"]))
            if not len(which):
                continue
            ids, labels, planes = _held(row)
            out: list[list] = [[], [], [], []]
            for k, score in _scored(row, which, q, planes):
                other = (labels != own[k]) & (ids != keys[k])
                for p in row["anchors"][k]["positives"]:
                    least, greatest = -(-low * p["score"] // 100), high * p["score"] // 100  # whole numbers within the window
                    if least > greatest:
                        continue
                    at = _best(score, other & (score >= least) & (score <= greatest), most)
                    for c, v in zip(out, (np.full(len(at), keys[k]), np.full(len(at), p["place"], np.int32), ids[at], score[at].astype(np.int64))):
                        c.append(v)
            yield _as_batch(out, ["anchor", "place", "negative", "score"], [pa.int64(), pa.int32(), pa.int64(), pa.int64()])

    return run


def hard_negatives(
    vectors: DataFrame, anchor: Column, key: str = "vec_id", embedding: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, block: int = BLOCK, anchors_of_group: int = ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``anchor`` names.

    Components become floor(scale * x); a score is the integer inner product with the anchor.  An anchor's positives are
    the ``positives`` best other rows of its label; each gets the ``negatives`` best rows of other labels with
    low * positive <= 100 * score <= high * positive.  Ties go to the smaller id.  A negative positive score has a window
    without whole numbers, so no negatives.

    Rows with a null id, label, vector or component, with a non-finite component or one of 2^23 or more after scaling, and
    vectors of no or over 4,096 components take no part.  Vectors of different lengths are not compared.  Rows that
    share an id: among anchors the one with the smallest (label, components) stands, among candidates each counts, and none
    is compared with an anchor of its id.  Tables without anchors, and empty ones, give no rows.  Other columns are passed over.
    """
    spark = vectors.sparkSession
    own = taking_part(vectors, key, embedding, label, scale)
    marked = taking_part(vectors.where(F.coalesce(anchor, F.lit(False))), key, embedding, label, scale)
    with scratch():
        chosen = write(marked.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.label", "r.q"), "anchors").df
        rows = own.count()
        groups = max(1, -(-chosen.count() // anchors_of_group))
        rows_of_block = max(1, min(block, max(SMALL, -(-rows // LEAST_BLOCKS))))
        cells = groups * max(1, -(-rows // rows_of_block))
        tasks = min(cells, max(4 * spark.sparkContext.defaultParallelism, cells // 32))
        # Sorted by label and id over all tasks: most blocks hold one label, and a label of any size is cut into many.
        sorted_rows = own.withColumn("dim", F.size("q")).repartitionByRange("dim", "label", "vec_id").sortWithinPartitions("dim", "label", "vec_id")
        packed = sorted_rows.mapInArrow(_blocks(rows_of_block), _PLANES).withColumn("block", F.monotonically_increasing_id())
        blocks = write(packed, "bit-planes").df
        with arrow_rows(spark, 4):
            near = write(_cells(blocks, _packed_anchors(chosen, groups), groups, tasks).mapInArrow(_positive_cells(positives), _POSITIVES), "positives").df
            first = F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("score"), "vec_id"))
            best = near.withColumn("place", first).where(F.col("place") <= positives)
            pairs = write(best, "pairs").df
            lists = pairs.groupBy(F.col("anchor").alias("vec_id")).agg(F.collect_list(F.struct("place", "score")).alias("positives"))
            found = write(_cells(blocks, _packed_anchors(chosen.join(lists, "vec_id"), groups), groups, tasks).mapInArrow(_negative_cells(negatives, low, high), _NEGATIVES), "negatives").df
        rank = F.row_number().over(W.partitionBy("anchor", "place").orderBy(F.desc("score"), "negative"))
        top = found.withColumn("rank", rank).where(F.col("rank") <= negatives).withColumnRenamed("score", "negative_score")
        joined = top.join(pairs.select("anchor", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor", "place"])
        return write(joined.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("negative").alias("negative_id"), "positive_score", "negative_score"), "hard-negatives", keep=True).df
