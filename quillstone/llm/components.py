"""Connected components of an edge list, by large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def _is_done(edges: DataFrame) -> bool:
    """Whether every node hangs on one root and no root hangs on another: what the steps end in."""
    roles = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(edges.select("b", F.lit(0), F.lit(1)))
    counts = roles.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return counts.where("down > 1 or (down > 0 and up > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): for each node of edges (a, b), the least node of its component.

    Every round's edges go to the shared checkpoint folder. Neither edges nor
    nodes come to the driver, only whether a round has ended it.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _is_done(edges):
        edges = cut(_small_star(_large_star(edges)))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(edges.select("b", "b").distinct())
