"""Groups from pairwise matches: large-star and small-star edge rewrites until nothing changes.

Large-star links every larger neighbour of a node to the smallest node of its neighbourhood, small-star does so for
the node and its smaller neighbours. Each keeps the components; alternated they end in stars around the minimum.
Edges move through joins on one node, where a node of very high degree is a skewed key of the side with the edges
and a single row on the side with the minima, so that adaptive execution can split it; the minima themselves are
partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.where("v > u").join(least, "u")
    return out.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    out = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.distinct()


def _state(edges: DataFrame) -> tuple:
    """Number of edges and an order-free checksum of them: one row, whatever the size."""
    r = edges.select(F.xxhash64("a", "b").alias("h")).agg(F.count("*"), F.expr("bit_xor(h)"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """node, component for every node with at least one edge to another; component is its group's smallest node.

    Null ends, loops and repeated pairs are ignored; the direction of a pair doesn't matter. Nodes may be integers or
    strings. Empty input gives no rows. Raises if ``most_rounds`` don't suffice, rather than return split groups.
    """
    space = Workspace(edges.sparkSession, "components")
    now = edges.select(F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y")).where("x is not null and y is not null and x <> y")
    now = space.replace(now.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        now = space.replace(_small_star(_large_star(now)), "edges")
        after = _state(now)
        if after == before or not after[0]:
            break
        before = after
    else:
        raise RuntimeError(f"components not stable after {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def groups_from_lists(lists: DataFrame, members: str, known: DataFrame, node: str) -> DataFrame:
    """Components of nodes that rows list together.

    Of each list the nulls and the nodes that aren't in ``known`` are left out, and what remains is joined to its
    smallest node, so that a list of n nodes gives n - 1 links and not all its pairs.
    """
    one = lists.select(F.array_sort(F.array_distinct(F.filter(F.col(members), lambda x: x.isNotNull()))).alias("list")).where("size(list) > 1").distinct()
    each = one.select(F.sha2(F.array_join(F.col("list").cast("array<string>"), ","), 256).alias("list_id"), F.explode("list").alias("x")).join(known.select(F.col(node).alias("x")).where("x is not null").distinct(), "x", "left_semi")
    # A list comes from one row, so putting it together again takes no more room than that row.
    stars = each.groupBy("list_id").agg(F.collect_list("x").alias("xs")).where("size(xs) > 1")
    stars = stars.select(F.explode("xs").alias("x"), F.array_min("xs").alias("m")).where("x <> m")
    return components(stars, "x", "m")
