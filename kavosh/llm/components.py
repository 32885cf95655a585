"""Connected components of an undirected graph by contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _stars(parents: DataFrame) -> DataFrame:
    """a, p of parents(a, p < a), with p the last node of a's chain of parents: chains halve with each step."""
    while True:
        up = parents.select(F.col("a").alias("_a"), F.col("p").alias("_p"))
        parents = written(parents.join(up, F.col("p") == F.col("_a"), "left").select("a", F.coalesce("_p", "p").alias("p"), F.col("_p").isNotNull().alias("moved")), "parents")
        moved = parents.where("moved").limit(1).count()
        parents = parents.select("a", "p")
        if not moved:
            return parents


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of edges(a long, b long); the root is the component's smallest node.

    A round points each node to its smallest neighbour, if that is smaller, follows the pointers to their ends, and
    contracts the graph to these ends, so edges vanish with their nodes and later rounds are small. Rounds are written to
    the shared folder, so a lost executor costs no more than one. Minima by node are combined before the shuffle, and a
    hub's pointer is one row that its edges are joined with, so no node's neighbours meet in one task.
    """
    larger, smaller = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    left = written(edges.where("a <> b").select(larger, smaller).groupBy("a", "b").agg(F.lit(1).alias("_")).select("a", "b"), "edges")
    nodes = left.select(F.col("a").alias("node")).union(left.select("b")).groupBy("node").agg(F.lit(1).alias("_"))
    roots = written(nodes.select("node", F.col("node").alias("root")), "roots")
    while left.limit(1).count():
        stars = _stars(left.groupBy("a").agg(F.min("b").alias("p")))
        to = lambda column: stars.select(F.col("a").alias(f"_{column}"), F.col("p").alias(f"{column}_to"))  # noqa: E731, B023
        moved = left.join(to("a"), F.col("a") == F.col("_a")).join(to("b"), F.col("b") == F.col("_b"), "left").select(F.col("a_to").alias("a"), F.coalesce("b_to", "b").alias("b"))
        left = written(moved.where("a <> b").select(larger, smaller).groupBy("a", "b").agg(F.lit(1).alias("_")).select("a", "b"), "edges")
        roots = written(roots.join(to("root"), F.col("root") == F.col("_root"), "left").select("node", F.coalesce("root_to", "root").alias("root")), "roots")
    return roots
