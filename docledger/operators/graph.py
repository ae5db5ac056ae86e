"""Graphs over rows: chains of any length by pointer doubling, and connected groups. Each round is written before the next."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.sources import scratch


def nearest_up(nodes: DataFrame, group: str, node: str, up: str, value: str) -> DataFrame:
    """(group, node, value, circular): the first value that isn't null on the way from a node up, its own included.

    After each round a node that has none yet points twice as far up, so a chain of n nodes takes log2(n) rounds. A chain that ends, or
    names a node that isn't there, gives null. What still points on once it has gone past every node of its group is on a circle or leads
    to one: circular. Of repeated nodes the one with the smallest (up, value) counts.
    """
    at = nodes.groupBy(group, node).agg(F.min(F.struct(F.col(up).alias("up"), F.col(value).alias("v"))).alias("x")).select(group, node, "x.up", "x.v")
    at = scratch.written(at.withColumn("up", F.when(F.col("v").isNull(), F.col("up"))))
    most = at.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    far = 1
    while far <= most and not at.where("up is not null").isEmpty():
        still = at.where("up is not null")
        above = at.select(group, F.col(node).alias("up"), F.col("up").alias("_up"), F.col("v").alias("_v"))
        moved = still.join(above, [group, "up"], "left").select(group, node, F.col("_up").alias("up"), F.col("_v").alias("v"))
        before, at = at, scratch.written(at.where("up is null").unionByName(moved))
        scratch.drop(before)
        far *= 2
    return at.select(group, node, F.col("v").alias(value), F.col("up").isNotNull().alias("circular"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of undirected edges (a, b): root is the smallest node of the group. Nodes without an edge to another aren't there.

    Rounds of two halves: every node's larger neighbours are hung on its smallest one, then every node and its smaller neighbours are.
    They shrink all groups at once, however long a chain one of them is.
    """
    pairs = scratch.written(edges.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct())
    seen = None
    while True:
        n, mark = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("x", "y"))).first()
        if (n, mark) == seen or n == 0:
            break
        seen = (n, mark)
        both = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        hung = scratch.written(both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct())
        least = hung.groupBy("x").agg(F.min("y").alias("m"))
        down = hung.join(least, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        old, pairs = pairs, scratch.written(down.unionByName(least.select("x", F.col("m").alias("y"))).distinct())
        scratch.drop(old, hung)
    roots = pairs.select(F.col("x").alias("node"), F.col("y").alias("root")).unionByName(pairs.select(F.col("y").alias("node"), F.col("y").alias("root")))
    return roots.groupBy("node").agg(F.min("root").alias("root"))
