"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import reliable_checkpoint


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long) -> one row per node that has an edge: node, root (the least
    node it can reach). Nulls and loops link nothing; an empty table gives no rows.

    Each round is two joins on the node (a hub's rows are an ordinary skewed join) and a
    reliable checkpoint; it ends when no edge moves, after O(log^2 n) rounds.
    """
    now = reliable_checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                              .where("a <> b").distinct())
    before = _state(now)
    while before[0]:
        now = reliable_checkpoint(_small_star(_large_star(now).distinct()).where("a <> b").distinct())
        after = _state(now)
        if tuple(after) == tuple(before):
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
