"""Clusters from edges: members, DBSCAN, summaries, look-ups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgraph.operators.components import connected_components
from specgraph.operators import tiles
from specgraph.operators.folded import times
from specgraph.storage import write


def members(edges: DataFrame) -> DataFrame:
    """(cluster_id, node_id): components of the edges, named by their smallest node."""
    return connected_components(edges).select(F.col("component").alias("cluster_id"), F.col("node").alias("node_id"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node_id"), F.col("dst").alias("other")).union(edges.select(F.col("dst"), F.col("src")))


def degrees(edges: DataFrame) -> DataFrame:
    """(node_id, degree); of folded edges (``operators.folded``) the degree of each record that a node stands for."""
    if "src_n" not in edges.columns:
        return both_ways(edges).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))
    apart, own = edges.where("src <> dst"), edges.where("src = dst").select(F.col("src").alias("node_id"), (F.col("src_n") - 1).alias("n"))
    ways = apart.select(F.col("src").alias("node_id"), F.col("dst_n").alias("n")).union(apart.select("dst", "src_n")).union(own)
    return ways.groupBy("node_id").agg(F.sum("n").alias("degree"))


def links(thin: DataFrame) -> DataFrame:
    """(src, dst) of rows ``tiles.THIN``: edges enough to tell what hangs together."""
    return thin.where(F.col("what") == tiles.LINK).select("src", "dst")


def lists_of_links(inside: DataFrame, rows: int = 10_000) -> DataFrame:
    """(cluster_id, src, dst) of (cluster_id, src, dst), about ``rows`` of them as lists in one row."""
    parts = inside.groupBy("cluster_id").agg(F.ceil(F.count(F.lit(1)) / rows).alias("parts"))
    dealt = inside.join(parts, "cluster_id").withColumn("part", F.pmod(F.xxhash64("src", "dst"), F.col("parts")))
    packed = dealt.groupBy("cluster_id", "part").agg(F.collect_list(F.struct("src", "dst")).alias("e"))
    return packed.select("cluster_id", F.col("e.src").alias("src"), F.col("e.dst").alias("dst"))


def thin_degrees(thin: DataFrame) -> DataFrame:
    """(node_id, degree) of rows ``tiles.THIN``, over all edges; written."""
    return write(thin.where(F.col("what") == tiles.DEGREE).groupBy(F.col("src").alias("node_id")).agg(F.sum("n").alias("degree")), "degrees").df


def extremes(thin: DataFrame, what: int, member: DataFrame) -> DataFrame:
    """(cluster_id, src, dst, dp) of rows ``tiles.WEAKEST`` or ``tiles.LAST``."""
    rows = thin.where(F.col("what") == what).select("src", "dst", "dp")
    return rows.join(member.select("cluster_id", F.col("node_id").alias("src")), "src").select("cluster_id", "src", "dst", "dp")


def point_types(edges: DataFrame, min_points: int = 3, degree: DataFrame | None = None) -> DataFrame:
    """(node_id, degree, point_type): 2 core (degree >= min_points - 1), 1 border (a core neighbour), 0 noise.

    With ``degree`` (node_id, degree) of all edges, ``edges`` may be links made with ``least=min_points - 1`` (``tiles.thinned``).
    """
    degree = degrees(edges) if degree is None else degree
    core = degree.where(F.col("degree") >= min_points - 1).select(F.col("node_id").alias("other"))
    beside = both_ways(edges).join(core, "other", "left_semi").select("node_id").distinct().withColumn("beside", F.lit(True))
    kind = F.when(F.col("degree") >= min_points - 1, 2).when(F.col("beside"), 1).otherwise(0)
    return degree.join(beside, "node_id", "left").select("node_id", "degree", kind.alias("point_type"))


def dbscan(edges: DataFrame, min_points: int = 3, degree: DataFrame | None = None) -> DataFrame:
    """(cluster_id, node_id, point_type): components of the core nodes; each border node goes to its smallest core neighbour.

    Core nodes without core neighbours stand alone unless border nodes join them; clusters of one node are dropped.
    Of folded edges (``operators.folded``) the rows are those of the nodes that stand for others: copies are of one type and
    in one cluster, and only a node that stands for itself can be alone.  ``degree`` is as in ``point_types``.
    """
    types = write(point_types(edges, min_points, degree), "point-types").df
    core = types.where("point_type = 2").select("node_id")
    side = lambda s: core.select(F.col("node_id").alias(s))
    inner = edges.select("src", "dst").join(side("src"), "src", "left_semi").join(side("dst"), "dst", "left_semi")
    labels = connected_components(inner).select(F.col("node").alias("node_id"), F.col("component").alias("cluster_id"))
    cores = core.join(labels, "node_id", "left").select(F.coalesce("cluster_id", "node_id").alias("cluster_id"), "node_id", F.lit(2).alias("point_type"))
    first_core = both_ways(edges).join(side("other"), "other", "left_semi").join(types.where("point_type = 1").select("node_id"), "node_id", "left_semi").groupBy("node_id").agg(F.min("other").alias("core"))
    borders = first_core.join(cores.select(F.col("node_id").alias("core"), "cluster_id"), "core").select("cluster_id", "node_id", F.lit(1).alias("point_type"))
    found = write(cores.union(borders), "dbscan").df
    large = found.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cluster_id")
    if "src_n" in edges.columns:  # an edge of a node to itself: copies that are linked
        large = large.union(found.join(edges.where("src = dst").select(F.col("src").alias("node_id")), "node_id", "left_semi").select("cluster_id")).distinct()
    return found.join(large, "cluster_id", "left_semi")


def inner_edges(edges: DataFrame, member: DataFrame) -> DataFrame:
    """(cluster_id, src, dst, dp): edges whose ends are in the same cluster, with ``src_n`` and ``dst_n`` of folded ones."""
    side = lambda s: member.select(F.col("node_id").alias(s), F.col("cluster_id").alias(f"cluster_{s}"))
    return edges.join(side("src"), "src").join(side("dst"), "dst").where("cluster_src = cluster_dst").select(F.col("cluster_src").alias("cluster_id"), "src", "dst", "dp", *[c for c in ("src_n", "dst_n") if c in edges.columns])


#: Edges of a packed row.
PACKED = 65_536
ADJACENCY = "cluster_id long, part int, nodes array<long>, offsets array<int>, others array<long>, dps array<double>"


def adjacency(inside: DataFrame, packed: int = PACKED) -> DataFrame:
    """(cluster_id, part, nodes, offsets, others, dps) of (cluster_id, src, dst, dp): the neighbours of ``nodes[i]`` that follow it are ``others[offsets[i]:offsets[i + 1]]``.

    Each edge stands once, at its smaller end.  A cluster's edges are dealt by hash to rows of about ``packed``, so no row grows with its cluster.
    """

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        own = frame.sort_values(["src", "dst"])
        nodes, first = np.unique(own["src"].to_numpy(), return_index=True)
        row = {"cluster_id": key[0], "part": key[1], "nodes": [nodes.tolist()], "offsets": [[*first.tolist(), len(own)]], "others": [own["dst"].tolist()], "dps": [own["dp"].tolist()]}
        return pd.DataFrame(row)

    parts = inside.groupBy("cluster_id").agg(F.ceil(F.count(F.lit(1)) / packed).cast("int").alias("parts"))
    dealt = inside.join(parts, "cluster_id").select("cluster_id", F.pmod(F.xxhash64("src", "dst"), F.col("parts")).cast("int").alias("part"), "src", "dst", F.col("dp").cast("double").alias("dp"))
    return dealt.groupBy("cluster_id", "part").applyInPandas(pack, ADJACENCY)


def unpacked(rows: DataFrame) -> DataFrame:
    """(cluster_id, src, dst, dp) of packed rows."""
    at = rows.select("cluster_id", F.posexplode("nodes").alias("i", "src"), "offsets", "others", "dps")
    own = at.select("cluster_id", "src", *[F.slice(c, F.get("offsets", F.col("i")) + 1, F.get("offsets", F.col("i") + 1) - F.get("offsets", F.col("i"))).alias(c) for c in ("others", "dps")])
    return own.select("cluster_id", "src", F.explode(F.arrays_zip("others", "dps")).alias("e")).select("cluster_id", "src", F.col("e.others").alias("dst"), F.col("e.dps").alias("dp"))


def edge_counts(inside: DataFrame) -> DataFrame:
    """(cluster_id, num_edges); a folded edge counts as often as records repeat it."""
    return inside.groupBy("cluster_id").agg((F.sum(times()) if "src_n" in inside.columns else F.count(F.lit(1))).alias("num_edges"))


def edges_by_degree(degree: DataFrame, member: DataFrame) -> DataFrame:
    """(cluster_id, num_edges) of clusters that hold all edges of their nodes."""
    return member.join(degree, "node_id").groupBy("cluster_id").agg((F.sum("degree") / 2).cast("long").alias("num_edges"))


def summary(edges: DataFrame, member: DataFrame, index: DataFrame) -> DataFrame:
    """(cluster_id, num_nodes, num_edges, mass_avg); for edges (node_id, degree) may stand where clusters are components."""
    nodes = member.join(index.select("node_id", "mass"), "node_id").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("num_nodes"), F.avg(F.col("mass").cast("double")).alias("mass_avg"))
    inside = edges_by_degree(edges, member) if "degree" in edges.columns else edge_counts(inner_edges(edges, member))
    return nodes.join(inside, "cluster_id", "left").select("cluster_id", "num_nodes", F.coalesce("num_edges", F.lit(0)).alias("num_edges"), "mass_avg")


def size_histogram(member: DataFrame) -> DataFrame:
    """(num_nodes, clusters)"""
    return member.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("num_nodes")).groupBy("num_nodes").agg(F.count(F.lit(1)).alias("clusters"))


def largest(summaries: DataFrame) -> DataFrame:
    """The cluster of most nodes; of equal ones the smallest id."""
    return summaries.agg(F.max_by(F.struct("cluster_id", "num_nodes", "num_edges"), F.struct("num_nodes", -F.col("cluster_id"))).alias("c")).select("c.*")


def weakest_edges(inside: DataFrame) -> DataFrame:
    """For each cluster its edge of the lowest dot product; ties go to the smallest ends."""
    return inside.groupBy("cluster_id").agg(F.min(F.struct("dp", "src", "dst")).alias("e")).select("cluster_id", "e.src", "e.dst", "e.dp")


def exists(clusters: DataFrame, cluster_id: int) -> bool:
    return not clusters.where(F.col("cluster_id") == cluster_id).limit(1).isEmpty()
