"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian verification, exact confirmation.

1. Each text becomes the set of its distinct word shingles; a task keeps only the
   set's size, a 128-bit key of the whole set, the band keys and one byte of each
   minimum.  Documents with equal sets form a class and go on as its smallest id.
2. Classes that share a band key are candidates.  First every class is held
   against the one pivot it meets in most bands, and the links found are contracted.
   Only buckets that still hold several components are looked at again: the pairs
   of small ones one by one, large ones as groups of blocks.  A block holds some
   hundred texts; two blocks are compared inside one task, which returns edges that
   hold the linked texts together and never the pairs.  Members of a group's largest
   component aren't compared with each other.  A group compares more than its buckets
   ask for (members that share no band), which can only find more of the links.
3. A candidate pair's signatures are compared in batches of hashes.  After each
   batch the pair is dropped if the posterior probability that its similarity
   reaches the threshold is below ``MISS``.
4. Survivors are confirmed on their full shingle sets, rebuilt from the texts.

At similarity 0.8 a pair shares no band of 4 among 32 with probability 5e-8.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgraph.llm.encoders import small_batches
from specgraph.llm.text_arrays import column_bytes, forget, mix, piece_hashes
from specgraph.operators.components import connected_components
from specgraph.storage import Written, arrow_rows, scratch, write

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BATCH = 32
MISS = 1e-7
#: Largest bucket whose pairs are written out; texts and shingles of a block.
SMALL, BLOCK_ROWS, BLOCK_SHINGLES = 16, 256, 50_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_RNG = np.random.default_rng(20_240_229)
_MUL = (_RNG.integers(0, 1 << 32, HASHES, np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _RNG.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)
_TURN = _RNG.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the shingles of each text in order, repeats included.

    A-Z are lower-cased; words are runs without the bytes 9 to 13 and 32.  A text of
    fewer words has its whole sequence as one shingle; without words it has none.
    """
    data, docs = column_bytes(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    data = _LOWER[data]
    inside = ~_SPACE[data]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    filled = docs[1:] > docs[:-1]
    before[docs[:-1][filled]] = False  # a word ends with its text
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[docs[1:][filled] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    word = piece_hashes(data, starts, ends)
    first = np.searchsorted(starts, docs)  # words before each text
    count = np.diff(first)
    out_count = np.where(count >= words, count - words + 1, (count > 0).astype(np.int64))
    offsets = np.append(0, np.cumsum(out_count))
    at = np.repeat(first[:-1] - offsets[:-1], out_count) + np.arange(offsets[-1])
    size = np.repeat(np.minimum(count, words), out_count)
    hashes = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for i in range(words):
            long = size > i
            hashes[long] = mix(hashes[long] + word[at[long] + i] * _TURN[i % 64])
    return hashes, offsets


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, offsets = shingle_hashes(column, words)
    return [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, HASHES) minima; sets must not be empty."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    short = (flat >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])]) if sets else np.zeros(0, np.int64)
    out = np.empty((len(sets), HASHES), np.uint32)
    with np.errstate(over="ignore"):
        for j in range(HASHES if sets else 0):
            out[:, j] = np.minimum.reduceat(short * _MUL[j] + _ADD[j], starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(sets, BANDS) 64-bit keys; equal keys of different bands don't meet."""
    rows = signature.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(40), rows.shape[:2])
    with np.errstate(over="ignore"):
        for i in range(ROWS):
            key = mix(key + rows[:, :, i] * _TURN[i])
    return key.view(np.int64)


def least_matches(percent: int, miss: float = MISS) -> list[int]:
    """For each batch the least number of equal hashes so far that keeps a pair.

    One byte of each minimum is kept, so hashes agree with probability
    p = s + (1 - s) / 256 at similarity s.  Under a uniform prior on p the chance
    that p reaches its value at the threshold, given m of n equal, is the chance
    of at most m successes in n + 1 draws.
    """
    t = percent / 100
    p = t + (1 - t) / 256
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
        out.append(m)
    return out


def _sketch(words: int):
    def run(batches):
        forget()
        for batch in small_batches(batches, 1 << 20):
            sets = shingle_sets(batch.column(1), words)
            filled = [s for s in sets if len(s)]
            sig = signatures(filled)
            keys, low = band_keys(sig), (sig & 0xFF).astype(np.uint8)
            row = iter(range(len(filled)))
            at = [next(row) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([None if i is None else keys[i] for i in at], pa.list_(pa.int64())), pa.array([None if i is None else low[i].tobytes() for i in at], pa.binary()),
                ],
                ["doc_id", "n_shingles", "set_key", "bands", "signature"],
            )

    return run


def sketch(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(_sketch(words), "doc_id long, n_shingles long, set_key binary, bands array<long>, signature binary")


def _prune(percent: int, miss: float):
    least = least_matches(percent, miss)

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, HASHES) for i in (2, 3))
            live = np.arange(batch.num_rows)
            equal = np.zeros(batch.num_rows, np.int64)
            for k, m in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                equal[live] += (a[live, part] == b[live, part]).sum(1)
                live = live[equal[live] >= m]
            yield batch.select(["a", "b"]).take(pa.array(live))

    return run


def _confirm(words: int, percent: int):
    def run(batches):
        forget()
        for batch in batches:
            for part in small_batches([batch], 1 << 20):
                sets_a, sets_b = shingle_sets(part.column(2), words), shingle_sets(part.column(3), words)
                both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(sets_a, sets_b)], np.int64)
                union = np.array([len(x) + len(y) for x, y in zip(sets_a, sets_b)], np.int64) - both
                yield part.select(["a", "b"]).filter(pa.array((100 * both >= percent * union) & (both > 0)))

    return run


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int, miss: float) -> Written:
    """Pairs (a, b) of class ids that are confirmed."""
    pairs = write(pairs, "pairs")
    side = lambda x: classes.select(F.col("id").alias(x), F.col("signature").alias(f"signature_{x}"))
    survivors = write(
        pairs.df.join(side("a"), "a").join(side("b"), "b").select("a", "b", "signature_a", "signature_b").mapInArrow(_prune(percent, miss), "a long, b long"), "survivors"
    )
    pairs.drop()
    text = lambda x: docs.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    with arrow_rows(docs.sparkSession, 200):
        confirmed = write(
            survivors.df.join(text("a"), "a").join(text("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirm(words, percent), "a long, b long"), "links"
        )
    survivors.drop()
    return confirmed


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, id, n, component): members of the buckets that hold several components."""
    labelled = write(members.join(labels, members.id == labels.node, "left").select("band", "id", "n", F.coalesce("component", "id").alias("component")), "labelled")
    mixed = write(labelled.df.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band"), "mixed")
    out = write(labelled.df.join(mixed.df, "band"), "open")
    labelled.drop()
    mixed.drop()
    return out.df


def _group_links(open_: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int, miss: float) -> Written:
    """Edges (a, b) that connect what is linked inside groups of buckets that share classes."""
    hubs = write(open_.groupBy("band").agg(F.min("id").alias("hub")), "hubs").df
    groups = connected_components(open_.join(hubs, "band").select("id", "hub"), "id", "hub").select(F.col("node").alias("id"), F.col("component").alias("group"))
    own = write(open_.select("id", "n", F.col("component").alias("own")).distinct().join(groups, "id"), "grouped").df
    main = own.groupBy("group", "own").agg(F.count(F.lit(1)).alias("rows")).groupBy("group").agg(F.max_by("own", F.struct("rows", -F.col("own"))).alias("main"))
    sided = write(own.join(main, "group").withColumn("side", F.when(F.col("own") == F.col("main"), 1).otherwise(0)), "sided").df
    sizes = sided.groupBy("group", "side").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    placed = sided.join(sizes, ["group", "side"]).select("id", "n", "own", "group", "side", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))
    full = placed.join(classes.select("id", "signature"), "id").join(docs.select(F.col("doc_id").alias("id"), "text"), "id")
    blocks = write(full.groupBy("group", "side", "part").agg(F.collect_list(F.struct("id", "own", "n", "signature", "text")).alias("rows")), "blocks").df
    keys = blocks.select("group", "side", "part")
    key = lambda s: keys.select("group", F.struct("side", "part").alias(f"key_{s}"))
    met = write(key("a").join(key("b"), "group").where((F.col("key_a") <= F.col("key_b")) & (F.col("key_a.side") == 0)), "block-pairs").df
    rows = lambda s: blocks.select("group", F.struct("side", "part").alias(f"key_{s}"), F.col("rows").alias(f"rows_{s}"))
    both = met.join(rows("a"), ["group", "key_a"]).join(rows("b"), ["group", "key_b"])
    with arrow_rows(docs.sparkSession, 2):
        return write(both.select("rows_a", "rows_b").mapInPandas(_compare_blocks(words, percent, miss), "a long, b long"), "links")


def block_links(a: list, b: list, words: int, percent: int, least: list[int]) -> np.ndarray:
    """Boolean matrix of the confirmed links between rows of different components of two blocks."""
    part = lambda rows, k: np.array([r[k] for r in rows], np.int64)
    sig_a, sig_b = (np.frombuffer(b"".join([bytes(r["signature"]) for r in rows]), np.uint8).reshape(-1, HASHES) for rows in (a, b))
    n_a, n_b = part(a, "n"), part(b, "n")
    live = part(a, "own")[:, None] != part(b, "own")[None, :]
    live &= 100 * np.minimum(n_a[:, None], n_b[None, :]) >= percent * np.maximum(n_a[:, None], n_b[None, :])
    equal = np.zeros(live.shape, np.int64)
    for k, m in enumerate(least):
        for j in range(k * BATCH, (k + 1) * BATCH):
            equal += sig_a[:, j][:, None] == sig_b[:, j][None, :]
        live &= equal >= m
        if not live.any():
            return live
    rows, cols = np.flatnonzero(live.any(1)), np.flatnonzero(live.any(0))
    sets_a = shingle_sets(pa.array([a[i]["text"] for i in rows], pa.string()), words)
    sets_b = shingle_sets(pa.array([b[j]["text"] for j in cols], pa.string()), words)
    common = np.intersect1d(np.concatenate(sets_a), np.concatenate(sets_b))
    both = np.zeros((len(rows), len(cols)), np.float32)
    for first in range(0, len(common), 4096):
        own = common[first : first + 4096]
        both += _incidence(sets_a, own) @ _incidence(sets_b, own).T  # whole numbers below 2 ** 24
    both = both.astype(np.int64)
    union = n_a[rows][:, None] + n_b[cols][None, :] - both
    live[np.ix_(rows, cols)] &= (100 * both >= percent * union) & (both > 0)
    return live


def _incidence(sets: list[np.ndarray], own: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(own)), np.float32)
    for i, s in enumerate(sets):
        s = s[np.searchsorted(s, own[0]) : np.searchsorted(s, own[-1], "right")]
        at = np.searchsorted(own, s)
        out[i, at[own[at] == s]] = 1
    return out


def holding_edges(linked: np.ndarray, id_a: np.ndarray, id_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An edge from each linked row to the smallest id that links reach inside the two blocks."""
    rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    small, a, b = linked[np.ix_(rows, cols)], id_a[rows], id_b[cols]
    far = np.iinfo(np.int64).max
    label_a, label_b = a.copy(), b.copy()
    while len(rows):
        new_b = np.minimum(label_b, np.where(small, label_a[:, None], far).min(0))
        new_a = np.minimum(label_a, np.where(small, new_b[None, :], far).min(1))
        if (new_a == label_a).all() and (new_b == label_b).all():
            break
        label_a, label_b = new_a, new_b
    ids, labels = np.concatenate([a, b]), np.concatenate([label_a, label_b])
    return ids[ids != labels], labels[ids != labels]


def _compare_blocks(words: int, percent: int, miss: float):
    least = least_matches(percent, miss)

    def run(frames):
        for frame in frames:
            for rows_a, rows_b in zip(frame["rows_a"], frame["rows_b"]):
                linked = block_links(list(rows_a), list(rows_b), words, percent, least)
                a, b = holding_edges(linked, np.array([r["id"] for r in rows_a], np.int64), np.array([r["id"] for r in rows_b], np.int64))
                yield pd.DataFrame({"a": a, "b": b})

    return run


def _fits(percent: int):
    """Similarity can't exceed the ratio of the set sizes."""
    return 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row.

    Documents are linked when 100 * |A & B| >= percent * |A | B| on their full sets
    of ``words``-word shingles; a component is what links reach, named by its
    smallest id, and kept marks that document.  Texts without words (null, empty)
    are linked with nothing.  Rows that share an id count as one document.  A null
    id has a null component and stays kept.  An empty table gives no rows.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    with arrow_rows(docs.sparkSession, 500):
        sketches = write(sketch(docs, "doc_id", "text", words), "sketches").df
    with scratch():
        named = _named_classes(sketches, docs, words, percent, miss)
    ids = sketches.select("doc_id", "n_shingles", "set_key")
    linked = ids.where("set_key is not null and doc_id is not null").join(named, "set_key").select("doc_id", "n_shingles", "component_id")
    alone = ids.where("set_key is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _named_classes(sketches: DataFrame, docs: DataFrame, words: int, percent: int, miss: float) -> DataFrame:
    """(set_key, component_id) of each class, written; what is written on the way goes with the caller's scratch block."""
    classes = write(
        sketches.where("set_key is not null and doc_id is not null")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("id"), F.min_by(F.struct("n_shingles", "bands", "signature"), "doc_id").alias("own"))
        .select("set_key", "id", "own.*"),
        "classes",
    ).df
    banded = classes.select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    buckets = write(banded.groupBy("band").agg(F.min(F.struct("id", "n")).alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets").df
    members = write(banded.join(buckets, "band").select("band", "size", "id", "n", F.col("pivot.id").alias("pivot"), F.col("pivot.n").alias("pivot_n")), "members").df

    # Round one: each class against the pivot it meets in most bands.
    met = members.where("id <> pivot").select("id", "pivot", F.col("n").alias("n_a"), F.col("pivot_n").alias("n_b")).where(_fits(percent))
    best = met.groupBy("id", "pivot").agg(F.count(F.lit(1)).alias("times")).groupBy("id").agg(F.max_by("pivot", F.struct("times", -F.col("pivot"))).alias("pivot"))
    links = _links(best.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")), classes, docs, words, percent, miss)
    found = links.df
    labels = write(connected_components(found, "a", "b"), "labels").df

    # Round two: pairs of different components in small buckets.
    open_ = _open(members.where(F.col("size") <= SMALL), labels)
    side = lambda x: open_.select("band", F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("component").alias(f"component_{x}"))
    pairs = side("a").join(side("b"), "band").where((F.col("a") < F.col("b")) & (F.col("component_a") != F.col("component_b")) & _fits(percent)).select("a", "b").distinct()
    found = found.union(_links(pairs, classes, docs, words, percent, miss).df)
    labels = write(connected_components(found, "a", "b"), "labels").df

    # Round three: large buckets as groups of blocks.
    open_ = _open(members.where(F.col("size") > SMALL), labels)
    if not open_.isEmpty():
        found = found.union(_group_links(open_, classes, docs, words, percent, miss).df)
        labels = write(connected_components(found, "a", "b"), "labels").df

    joined = classes.select("set_key", "id").join(labels, F.col("id") == F.col("node"), "left").select("set_key", F.coalesce("component", "id").alias("component_id"))
    return write(joined, "named", keep=True).df
