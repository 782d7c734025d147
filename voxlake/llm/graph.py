"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); ids should be in random order, such as hashes.

    Each round points every node to its smallest neighbour, or to itself if it is smaller, and contracts the edges; with
    ids in random order the nodes of a component fall by a constant factor a round. No task holds a component: the steps
    are grouped minima and joins.
    """
    edges = cut_lineage(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        step = near.select("node", F.least("node", "m").alias("up"))
        # Two steps up at once; the second looks up where the first leads.
        step = cut_lineage(step.join(step.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", F.col("top").alias("up")))
        maps.append(step)
        a, b = (step.select(F.col("node").alias(x), F.col("up").alias(f"up_{x}")) for x in ("a", "b"))
        moved = edges.join(a, "a").join(b, "b").filter("up_a <> up_b")
        # A node two steps up may have lost the edge to the node between; that one's own edge is kept by its own map.
        edges = cut_lineage(moved.select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct())
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[-1].select("node", F.col("up").alias("root"))
    for step in reversed(maps[:-1]):
        later = out.select(F.col("node").alias("up"), F.col("root"))
        out = step.join(later, "up", "left").select("node", F.coalesce("root", "up").alias("root"))
    return out
