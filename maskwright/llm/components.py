"""Connected components of a link table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_split, release, stored

MAX_ROUNDS = 60


def connected(links: DataFrame) -> DataFrame:
    """links: a, b (long; rows with a null or with a = b count for nothing). node, root: for each node in a link, the smallest node it can reach.

    Alternating large-star and small-star rounds: each round hangs a node's neighbours on
    the smallest of them, so long chains shrink by a factor each time, until every node
    hangs on one that hangs on none. Minima are aggregated before they are shuffled; the
    minima of nodes with many neighbours are broadcast to where their links are (see
    join_split), so no node's links are gathered in one task. Each round is written, so
    nothing is recomputed. An empty table gives an empty one.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", merged=True)
    for _ in range(MAX_ROUNDS):
        # done when every node has one link to a smaller one, and that has none
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
        state = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).agg(F.sum("down").alias("n"), F.max((F.col("down") + F.col("up") > 1).cast("int") * F.col("down")).alias("open")).first()
        if not state["open"]:
            break
        total = 2 * int(state["n"])
        # large star: every larger neighbour of u goes to the smallest node next to u
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_split(both, least, "u", "n", total).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        lowest = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_split(large, lowest, "u", "n", total)
        moved = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v")))
        before, edges = edges, stored(moved.distinct(), "edges", merged=True)
        discard(before)
        release(edges.sparkSession)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
