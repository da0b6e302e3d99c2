"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobledger.llm.shared import remove, saved_at


def _both_ways(edges: DataFrame) -> DataFrame:
    """Each link from both ends, one scan."""
    ends = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    return edges.select(F.inline(ends))


def _large_star(edges: DataFrame) -> tuple[DataFrame, str]:
    """Larger neighbours of each node are tied to the least of its neighbours and itself. The folder of the least ones is given too."""
    both = _both_ways(edges)
    least, path = saved_at(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))  # as a table: joins can then split a hot node
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), path


def _small_star(edges: DataFrame) -> tuple[DataFrame, str]:
    """Smaller neighbours of each node, and the node, are tied to the least of them. The folder of the least ones is given too."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least, path = saved_at(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least, "u").select(F.inline(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))))
    return moved.where("a <> b").distinct(), path


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of integers -> ``(node, component)`` for every node with a link; component is its least node.

    Each round writes the contracted links to the shared folder. Rounds grow with the logarithm of the longest
    path; the loop ends when a round changes nothing, and raises when ``most_rounds`` did not suffice. Tables of rounds before the last are deleted.
    Self-links and nulls are ignored; no links give an empty table.
    """
    spark = edges.sparkSession
    now, kept = saved_at(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(most_rounds):
        large, first = _large_star(now)
        small, second = _small_star(large)
        now, path = saved_at(small)
        for old in (kept, first, second):
            remove(spark, old)
        kept = path
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = state
    raise RuntimeError("components did not settle")
