"""Connected components by repeated contraction.

Every round hooks each vertex to the smallest vertex of its closed
neighbourhood, flattens the resulting forest by pointer jumping, and replaces
the end points of the edges by their roots.  Edges inside a tree vanish, so the
edge table shrinks fast; a star collapses in one round.  Aggregations combine on
the map side and every join reads written tables on both sides, which lets
adaptive execution split a hub's partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgraph.storage import Written, write


def _hooks(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("src").alias("v"), F.col("dst").alias("p")).union(
        edges.select(F.col("dst").alias("v"), F.col("src").alias("p"))
    )
    return both.groupBy("v").agg(F.min("p").alias("p")).select("v", F.least("v", "p").alias("p"))


def _flatten(forest: Written) -> Written:
    """Pointer jumping until every vertex points at a root."""
    while True:
        up = forest.df.select(F.col("v").alias("p"), F.col("p").alias("g"))
        jumped = write(
            forest.df.join(up, "p", "left").select("v", F.coalesce("g", "p").alias("p"), (F.col("g") != F.col("p")).alias("moved")),
            "forest",
        )
        moved = not jumped.df.where("moved").isEmpty()
        forest.drop()
        forest = jumped
        if not moved:
            return forest


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of every vertex that has an edge; component = smallest vertex id.

    Null end points are ignored; self loops and repeated edges change nothing.
    An empty edge table gives an empty result.
    """
    left = write(
        edges.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"))
        .where("src is not null and dst is not null")
        .select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .distinct(),
        "edges",
    )
    labels: Written | None = None
    while True:
        forest = _flatten(write(_hooks(left.df), "hooks"))
        root = forest.df.select(F.col("v").alias("at"), F.col("p").alias("root"))
        if labels is None:
            nxt = write(forest.df.select(F.col("v").alias("node"), F.col("p").alias("component")), "labels")
        else:
            nxt = write(
                labels.df.join(root, labels.df.component == root.at, "left").select("node", F.coalesce("root", "component").alias("component")),
                "labels",
            )
            labels.drop()
        labels = nxt
        rest = write(
            left.df.join(root, left.df.src == root.at).select(F.col("root").alias("src"), "dst")
            .join(root.select(F.col("at").alias("at2"), F.col("root").alias("root2")), F.col("dst") == F.col("at2"))
            .where("src <> root2")
            .select(F.least("src", "root2").alias("src"), F.greatest("src", "root2").alias("dst"))
            .distinct(),
            "edges",
        )
        left.drop()
        forest.drop()
        left = rest
        if left.df.isEmpty():
            left.drop()
            return labels.df
