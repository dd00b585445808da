"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root): the least node of each node's component, from links (a, b) of longs.

    Large-star and small-star steps in turn: each only joins links to the
    least neighbour of a node, which is counted with map-side combining. The
    links of a node with very many are dealt over several tasks for that
    join. Each round's links are written to the shared folder. Ends when
    nothing changes, after a number of rounds that grows with the logarithm
    of the longest path; repeated links and links to oneself do nothing, and
    an empty table gives an empty one.
    """
    links = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = join_hot(both.where("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small-star: a node's lower neighbours and itself go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = join_hot(large, low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        links = materialize(small.where("a != b").distinct(), "links")
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
