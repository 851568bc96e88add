"""Near-duplicate embeddings: exact cosine links by PCA-ordered tiled comparison.

1. Equal vectors become one row with a count; unusable ones (null, zero, null or
   non-finite components) are set aside.
2. A principal-component basis orders the dimensions.  Unit vectors are rotated
   into it inside tasks; a rotation leaves dot products as they are.
3. A tree of median cuts along the leading components, made from a bounded sample,
   deals rows to tiles of similar vectors.  A leaf that outgrows a tile is dealt on
   by a hash before rows are shuffled, so no group of rows is unbounded.  A tile is
   packed to one row of byte strings and cut into blocks by finer leaves.
4. Tiles whose bounding boxes in the leading components are further apart than the
   threshold allows are never compared, and neither are blocks of near tiles.  For the others, dot products accumulate
   the leading components first; what is left is bounded by the product of the
   suffix norms, and rows that can't reach the threshold any more stop there.
5. A comparison returns for each row its number of links and the smallest id that
   links reach inside the two tiles, never the links themselves.

The basis and the cuts decide only how much is skipped, never which links are found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgraph.llm.encoders import small_batches
from specgraph.operators.components import connected_components
from specgraph.storage import arrow_rows, scratch, write

#: Rows of a tile, and of one of its blocks; tables are cut into ``LEAST_TILES`` tiles at least.
TILE, TILE_BLOCK, LEAST_TILES = 16_384, 4096, 8
#: Rows that the basis and the cuts are made from; the tree has no more than twice as many leaves.
SAMPLE = 20_000
#: Rows compared with a block at once; components of a bounding box; leading ones whose grid finds near boxes.
BLOCK, BOX, GRID = 1024, 16, 3
#: Products this close to the threshold are settled by the plain formula.
CLOSE = 1e-9
NEIGHBOURS = "code binary, n long, edges array<struct<src:long,dst:long>>"
NO_ID = np.iinfo(np.int64).max


def _usable(v: str):
    x = F.col(v)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(x.isNull(), False).otherwise(F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(x, lambda c: c != 0), F.lit(False)))


def _cuts(points: np.ndarray, leaves: int) -> list:
    """Nested (axis, value, below, above); a leaf is None.  Cuts go along the widest leading component."""
    if leaves <= 1 or len(points) < 2:
        return None
    axis = int(np.argmax(points[:, :BOX].var(0)))
    value = float(np.median(points[:, axis]))
    low = points[:, axis] < value
    if low.all() or not low.any():
        return None
    return [axis, value, _cuts(points[low], leaves // 2), _cuts(points[~low], leaves - leaves // 2)]


def _leaf_of(points: np.ndarray, tree, leaf: int = 1) -> np.ndarray:
    out = np.full(len(points), leaf, np.int64)
    if tree:
        low = points[:, tree[0]] < tree[1]
        out[low], out[~low] = _leaf_of(points[low], tree[2], 2 * leaf), _leaf_of(points[~low], tree[3], 2 * leaf + 1)
    return out


def _stack(column: pa.Array) -> np.ndarray:
    n = len(column)
    return np.asarray(column.flatten(), np.float64).reshape(n, -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _compare(a: np.ndarray, b: np.ndarray, threshold: float, raw_a: np.ndarray, raw_b: np.ndarray) -> np.ndarray:
    """Boolean matrix of links between rotated unit rows a and b, leading components first."""
    dim = a.shape[1]
    ends = sorted({-(-dim // 4), -(-dim // 2), dim})
    suffix = lambda x: {e: np.sqrt(np.maximum((x[:, e:] * x[:, e:]).sum(1), 0)) for e in ends}
    rest_a, rest_b = suffix(a), suffix(b)
    out = np.zeros((len(a), len(b)), bool)
    for first in range(0, len(a), BLOCK):
        live_a, live_b = np.arange(first, min(first + BLOCK, len(a))), np.arange(len(b))
        total, at = np.zeros((len(live_a), len(b))), 0
        for end in ends:
            total += a[live_a, at:end] @ b[live_b, at:end].T
            at = end
            if end < dim:
                can = np.outer(rest_a[end][live_a], rest_b[end][live_b])
                can += total
                can = can >= threshold - CLOSE
                rows, cols = can.any(1), can.any(0)
                if not rows.all() or not cols.all():
                    live_a, live_b, total = live_a[rows], live_b[cols], total[np.ix_(rows, cols)]
                if not total.size:
                    break
        if not total.size:
            continue
        linked = total >= threshold
        for i, j in zip(*np.nonzero(np.abs(total - threshold) < CLOSE)):
            x, y = raw_a[live_a[i]], raw_b[live_b[j]]
            linked[i, j] = float(x @ y) / (float(np.sqrt(x @ x)) * float(np.sqrt(y @ y))) >= threshold
        out[np.ix_(live_a, live_b)] = linked
    return out


def near_vectors(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", threshold: float = 0.9, tile: int = TILE, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row.

    Rows are linked when the cosine of their vectors, in double precision, is at
    least ``threshold``; n_links counts the other rows linked directly, equal ones
    included.  Vectors that are null, zero or hold null or non-finite components
    link with nothing, and so do vectors of different lengths with each other.  A
    null id is counted by its neighbours but joins no component and stays kept; rows that share an id are one
    vertex of the components but are counted row by row.  An empty table gives no rows.
    """
    own = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).alias("x")).withColumn("usable", _usable("x"))
    rows = write(own.select("vec_id", "usable", F.when(F.col("usable"), F.col("x")).alias("x"), F.when(F.col("usable"), F.unhex(F.md5(F.array_join(F.col("x"), ",")))).alias("code")), "vectors").df
    with scratch():
        named = _named_vectors(rows, threshold, tile, sample)
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = rows.where("usable").select("vec_id", "code").join(named, "code").select("vec_id", "n_links", "component_id")
    return linked.union(alone).select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.col("component_id")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )


def _named_vectors(rows: DataFrame, threshold: float, tile: int, sample: int) -> DataFrame:
    """(code, n_links, component_id) of each different vector, written; what is written on the way goes with the caller's scratch block."""
    distinct = write(
        rows.where("usable").groupBy("code").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("id"), F.any_value("x").alias("x")).select("code", "copies", "id", "x", F.size("x").alias("dim")),
        "distinct",
    ).df
    outs = [_of_one_length(distinct.where(F.col("dim") == r.dim), int(r.dim), int(r.n), threshold, tile, sample) for r in distinct.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect()]
    found = rows.sparkSession.createDataFrame([], NEIGHBOURS)
    for o in outs:
        found = found.unionByName(o)
    with arrow_rows(rows.sparkSession, 2):
        found = write(found, "neighbours").df
    labels = connected_components(found.select(F.explode("edges").alias("e")).select("e.src", "e.dst"))
    per_row = found.groupBy("code").agg(F.sum("n").alias("n"))
    joined = distinct.select("code", "copies", "id").join(per_row, "code", "left").join(labels, F.col("id") == F.col("node"), "left")
    return write(joined.select("code", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "named", keep=True).df


def _of_one_length(distinct: DataFrame, dim: int, n: int, threshold: float, tile: int, sample: int) -> DataFrame:
    """(code, n, edges): links of each row to others of its length, and edges that hold its component together."""
    few = distinct.select("x") if n <= sample else distinct.select("x").sample(fraction=min(1.0, sample / n), seed=7)
    # The basis is fitted by Spark on the bounded sample; its rows come to the driver to cut the leading components.
    basis = np.linalg.qr(PCA(k=dim, inputCol="v", outputCol="p").fit(few.select(array_to_vector("x").alias("v"))).pc.toArray())[0] if n > 1 else np.eye(dim)
    points = np.array([r.x for r in few.limit(2 * sample).collect()], np.float64).reshape(-1, dim)
    rows_of_tile = min(tile, max(tile // 32, -(-n // LEAST_TILES)))
    tree = _cuts(_unit(points) @ basis, -(-4 * n // rows_of_tile))
    kind = distinct.schema["x"].dataType.simpleString()
    width = "<f4" if kind == "array<float>" else "<f8"

    def deal(batches):
        for batch in small_batches(batches):
            leaf = _leaf_of(_unit(_stack(batch.column(3))) @ basis, tree)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], ["code", "copies", "id", "x", "leaf"])

    dealt = write(distinct.select("code", "copies", "id", "x").mapInArrow(deal, f"code binary, copies long, id long, x {kind}, leaf long"), "dealt").df
    coarse = F.greatest(F.shiftright("leaf", 2), F.lit(1))
    sizes = dealt.groupBy(coarse.alias("coarse")).agg(F.count(F.lit(1)).alias("rows"))
    # One row for each leaf of a tree made from the sample: 2 * SAMPLE at most, whatever the table's size.
    spread = dealt.withColumn("coarse", coarse).join(F.broadcast(sizes), "coarse").withColumn("tile", F.xxhash64("coarse", F.pmod(F.xxhash64("code"), F.ceil(F.col("rows") / rows_of_tile))))
    packed = spread.select("tile", "leaf", "code", "copies", "id", "x").repartition("tile").sortWithinPartitions("tile", "leaf", "code")
    tiles = write(packed.mapInArrow(_pack(basis, width), "tile long, low array<double>, high array<double>, codes binary, copies binary, ids binary, x binary"), "tiles").df
    # Boxes of tiles are small rows, one for each ``tile`` rows of the table.  Boxes that come close enough share a cell
    # of a grid over the leading components: a box lies in the cells it covers, and in those within reach on one side.
    reach = float(np.sqrt(2.0 - 2.0 * threshold)) + 1e-6
    boxes = tiles.select("tile", "low", "high")

    def celled(s: str, margin: float) -> DataFrame:
        out = boxes.select(F.col("tile").alias(f"tile_{s}"), F.col("low").alias(f"low_{s}"), F.col("high").alias(f"high_{s}"))
        for i in range(min(GRID, dim)):
            first, last = (F.floor((F.col(f"{e}_{s}")[i] + m) / reach) for e, m in (("low", -margin), ("high", margin)))
            out = out.withColumn(f"cell{i}", F.explode(F.sequence(first, last)))
        return out

    gaps = F.zip_with(F.zip_with("low_a", "high_b", lambda x, y: x - y), F.zip_with("low_b", "high_a", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    near = write(
        celled("a", reach).join(celled("b", 0.0), [f"cell{i}" for i in range(min(GRID, dim))])
        .where((F.col("tile_a") <= F.col("tile_b")) & (F.aggregate(gaps, F.lit(0.0), lambda t, g: t + g * g) <= reach * reach))
        .select("tile_a", "tile_b").distinct(),
        "tile-pairs",
    ).df

    side = lambda s: tiles.select(F.col("tile").alias(f"tile_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in _PACKED])
    both = near.join(side("a"), "tile_a").join(side("b"), "tile_b").select("tile_a", "tile_b", *[f"{c}_{s}" for s in "ab" for c in _PACKED])
    return both.mapInArrow(_pairs(basis, width, threshold), NEIGHBOURS)


_PACKED = ["codes", "copies", "ids", "x"]


def _pack(basis: np.ndarray, width: str):
    """Rows sorted by tile become one row for each tile; only one tile is held."""

    def close(tile: int, parts: list) -> pa.RecordBatch:
        codes, copies, ids = (sum((p[i] for p in parts), []) for i in range(3))
        x = np.concatenate([p[3] for p in parts])
        box = (_unit(x) @ basis)[:, :BOX]
        known = [NO_ID if i is None else i for i in ids]
        row = [[tile], [box.min(0).tolist()], [box.max(0).tolist()], [b"".join(codes)], [np.array(copies, np.int64).tobytes()], [np.array(known, np.int64).tobytes()], [x.astype(width).tobytes()]]
        kinds = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["tile", "low", "high", *_PACKED])

    def run(batches):
        tile, parts = None, []
        for batch in batches:
            own = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if parts and own[a] != tile:
                    yield close(tile, parts)
                    parts = []
                tile = int(own[a])
                piece = batch.slice(a, b - a)
                parts.append((piece.column(2).to_pylist(), piece.column(3).to_pylist(), piece.column(4).to_pylist(), _stack(piece.column(5))))
        if parts:
            yield close(tile, parts)

    return run


class _Tile:
    """A packed tile, its rows rotated block by block."""

    def __init__(self, codes: bytes, copies: bytes, ids: bytes, x: bytes, basis: np.ndarray, width: str):
        self.codes, self.copies, self.ids = codes, np.frombuffer(copies, np.int64), np.frombuffer(ids, np.int64)
        self.x = np.frombuffer(x, width).reshape(len(self.ids), -1).astype(np.float64)
        self.rotated = _unit(self.x) @ basis
        self.cuts = [slice(a, min(a + TILE_BLOCK, len(self.ids))) for a in range(0, len(self.ids), TILE_BLOCK)]
        self.boxes = [(r.min(0), r.max(0)) for r in (self.rotated[c, :BOX] for c in self.cuts)]


def _pairs(basis: np.ndarray, width: str, threshold: float):
    reach = 2.0 - 2.0 * threshold + 1e-6

    def run(batches):
        for batch in batches:
            for tile_a, tile_b, *rest in zip(*(batch.column(i).to_pylist() for i in range(10))):
                same = tile_a == tile_b
                a = _Tile(*rest[:4], basis, width)
                yield from _tile_links(a, a if same else _Tile(*rest[4:], basis, width), threshold, reach, same)

    return run


def _tile_links(a: _Tile, b: _Tile, threshold: float, reach: float, same: bool):
    """(code, n, edges) of the rows of both tiles that have links."""
    counts = {id(t): np.zeros(len(t.ids), np.int64) for t in (a, b)}
    edges: dict[int, dict[int, set]] = {id(t): {} for t in (a, b)}
    for i, (cut_a, box_a) in enumerate(zip(a.cuts, a.boxes)):
        for j, (cut_b, box_b) in enumerate(zip(b.cuts, b.boxes)):
            gap = np.maximum(np.maximum(box_a[0] - box_b[1], box_b[0] - box_a[1]), 0.0)
            if (same and j < i) or gap @ gap > reach:
                continue
            own = same and i == j
            linked = _compare(a.rotated[cut_a], b.rotated[cut_b], threshold, a.x[cut_a], b.x[cut_b])
            if own:
                np.fill_diagonal(linked, False)
            rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
            if not len(rows):
                continue
            small, at_a, at_b = linked[np.ix_(rows, cols)], rows + cut_a.start, cols + cut_b.start
            label_a, label_b = _reached(small, a.ids[at_a], b.ids[at_b], own)
            for t, at, labels, n in [(a, at_a, label_a, small @ b.copies[at_b]), (b, at_b, label_b, a.copies[at_a] @ small)][: 1 if own else 2]:
                counts[id(t)][at] += n
                for r, k in zip(at.tolist(), labels.tolist()):
                    if k != t.ids[r]:
                        edges[id(t)].setdefault(r, set()).add(k)
    for t in [a] if same else [a, b]:
        rows = np.flatnonzero(counts[id(t)]).tolist()
        lists = [[{"src": int(t.ids[r]), "dst": k} for k in sorted(edges[id(t)].get(r, ()))] for r in rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array([t.codes[16 * r : 16 * r + 16] for r in rows], pa.binary()), pa.array(counts[id(t)][rows], pa.int64()), pa.array(lists, pa.list_(pa.struct([("src", pa.int64()), ("dst", pa.int64())])))],
            ["code", "n", "edges"],
        )


def _reached(linked: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id that links between the two sides reach from each row, by min-label propagation."""
    label_a, label_b = ids_a.copy(), ids_b.copy()
    known = linked & (ids_a != NO_ID)[:, None] & (ids_b != NO_ID)[None, :]
    while True:
        new_b = np.minimum(label_b, np.where(known, label_a[:, None], NO_ID).min(0))
        new_a = np.minimum(label_a, np.where(known, (new_b)[None, :], NO_ID).min(1))
        if same:
            new_a = new_b = np.minimum(new_a, new_b)
        if (new_a == label_a).all() and (new_b == label_b).all():
            return label_a, label_b
        label_a, label_b = new_a, new_b
