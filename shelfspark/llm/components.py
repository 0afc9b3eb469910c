"""Connected components of a distributed edge list, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_IDS, broadcast_if_small, cut

#: Edges that a task takes at least. Rounds over few edges in many tasks leave more files than data behind.
EDGES_IN_TASK = 50_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a long, b long); component is the smallest node reachable.

    Each round links every node's larger neighbours to its smallest neighbour (large star), then its smaller ones
    (small star). Edges never grow in number. A node with a great many neighbours is only ever the key of a minimum,
    combined before the shuffle, and of a join with the minima: these are written first, so that they are broadcast while
    they are few, and else joined between two exchanges whose skewed partitions Spark splits. Rounds grow with the
    logarithm of the longest path. Each ends in a checkpoint, so neither lineage nor lost executors matter. Tasks go by
    the number of edges, which is counted anyway. Null ends and loops are ignored; no edges give no rows.
    """
    pairs = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    now, before = _state(pairs), None
    while now != before:
        tasks, before = max(1, -(-now[0] // EDGES_IN_TASK)), now
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(tasks)
        least = broadcast_if_small(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).coalesce(tasks), SMALL_IDS)
        large = cut(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct().coalesce(tasks))
        least = broadcast_if_small(large.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks), SMALL_IDS)
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        pairs = cut(small.where("a <> b").coalesce(tasks).distinct().coalesce(tasks))
        now = _state(pairs)
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(pairs.coalesce(tasks).select("b", "b").distinct().coalesce(tasks))


def _state(pairs: DataFrame) -> tuple[int, object]:
    """Number and hash of edges; rounds that leave both as they are change nothing."""
    few = pairs.coalesce(pairs.sparkSession.sparkContext.defaultParallelism)
    return tuple(few.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
