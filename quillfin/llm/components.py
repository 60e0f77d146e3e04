"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfin.llm.shared import discard, staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): each node of the edges (a, b) and the least node it is connected with. Self-links are allowed; nulls are not. Rounds grow as the logarithm of the longest chain; after most_rounds an error is raised."""
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    now = staged(edges.filter("a <> b").distinct(), "cc")
    for _ in range(most_rounds):
        after = staged(_small_star(_large_star(now)), "cc")
        discard(now)
        now = after
        # Edges go from a to a smaller b. Done when every node has one b at most and no b has one of its own: stars around the least nodes.
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
        done = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in")).filter("out > 1 or (out > 0 and in > 0)").isEmpty()
        if done:
            break
    else:
        raise RuntimeError(f"connected components are not settled after {most_rounds} rounds")
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes (node, root) after further links (a, b); nodes that classes lack begin as classes of their own. Only links between roots are followed."""
    root = lambda c, r: classes.select(F.col("node").alias(c), F.col("root").alias(r))
    j = staged(links.join(root("a", "ra"), "a", "left").join(root("b", "rb"), "b", "left").select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb")), "cc-links")
    edges = j.filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    if edges.isEmpty():
        return classes
    moved = components(edges).select(F.col("node").alias("root"), F.col("root").alias("to"))
    ends = j.select(F.col("a").alias("node"), F.col("ra").alias("root")).unionByName(j.select(F.col("b").alias("node"), F.col("rb").alias("root")))
    every = classes.unionByName(ends).distinct()
    return staged(every.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "classes")
