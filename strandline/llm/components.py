"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two aggregations and two joins over the edges. A node with very many neighbours is
aggregated with map-side combination. The least neighbours are written before they are joined, so that
both sides of the join are plain shuffles, and adaptive execution can split the node's rows over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.plans.runtime import cut, discard


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    out = cut(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "edges")
    discard(edges, least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = cut(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = cut(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    discard(edges, least)
    return out


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: every node has one edge down, or only edges from above."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1)))
    each = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not each.filter("down > 1 or (down = 1 and up = 1)").agg(F.count("*")).first()[0]


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v long): label is the least node it reaches.

    Self loops and nulls are dropped; an empty table gives an empty result. Rounds repeat until the
    edges are stars; they are about the logarithm of the longest path in number, and none if they are stars to begin with.
    """
    now = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(now):
            break
        now = _small_star(_large_star(now))
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)


def extended_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (node, label) as they are once ``edges`` (u, v long) have been added.

    Each component counts as one node of a smaller graph, so that the rounds go over the new edges only.
    """
    for name in ("u", "v"):
        own = labels.select(F.col("node").alias(name), F.col("label").alias(f"of_{name}"))
        edges = edges.join(own, name, "left")
    merged = connected_components(edges.select(F.coalesce("of_u", "u").alias("u"), F.coalesce("of_v", "v").alias("v")))
    moved = merged.select(F.col("node").alias("label"), F.col("label").alias("to"))
    known = labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return cut(known.unionByName(merged.join(labels, "node", "left_anti")), "labels")
