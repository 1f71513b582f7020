"""Connected components of an edge table, by alternating star contractions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.llm.common import cut


#: A node is hot from this many edges on, or from a share of all edges that at most HOT nodes can have.
LEAST, HOT = 256, 50_000
#: A round runs in a task for about so many edges, and in TASKS at least, however many partitions shuffles have.
EDGES, TASKS = 1 << 16, 8


def _dealt(df: DataFrame, count: int) -> DataFrame:
    """The rows in no more partitions than ``count`` edges need: the driver keeps a record of every task."""
    return df.coalesce(max(TASKS, -(-count // EDGES)))


def _with_least(edges: DataFrame, count: int) -> DataFrame:
    """Edges ``a, b`` with ``m``, the least ``b`` of each ``a``.

    The edges of hot nodes meet it by a broadcast, so that no task gets all edges of a node; there are at most HOT of them,
    as no more than that many nodes can have as many edges. The least of a node is found by partial minima.
    """
    least = cut(_dealt(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), count))
    if count <= LEAST:
        return _dealt(edges.join(least.select("a", "m"), "a"), count)
    hot = F.broadcast(least.where(F.col("n") > max(LEAST, count // HOT)).select("a", "m"))
    cold = edges.join(hot.select("a"), "a", "left_anti").join(least.select("a", "m"), "a")
    return _dealt(edges.join(hot, "a").unionByName(cold), count)


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both, 2 * count).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(edges: DataFrame, count: int) -> DataFrame:
    return _with_least(edges, count).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """The smallest reachable id of every node of the undirected edges ``(a, b)``.

    Returns ``(node, component)`` for nodes that have an edge to another node. Self-loops, repeated and reversed
    edges and nulls change nothing; no edges give no rows. Only sums travel to the driver; the number of rounds
    is logarithmic in the longest path, and each round is written to the checkpoint folder.
    """
    one_way = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    now = cut(one_way)
    before = None
    count = 0
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if state == before or not state[0]:
            break
        before, count = state, state[0]
        large = cut(_dealt(_large_star(_dealt(now, count), count).where("a <> b").distinct(), count))
        now = cut(_dealt(_small_star(large, count).where("a <> b").distinct(), count))
    roots = _dealt(now.select(F.col("b").alias("node")).distinct(), count).withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
