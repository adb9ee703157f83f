"""Connected components of a graph given by edges, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, materialize, skew_safe_left_join


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (any order, no nulls). Returns node, root: the smallest node that can be reached, for nodes that have edges.

    Alternates the large-star and small-star steps, which keep the components and end in stars in a number of rounds
    about the logarithm of the longest path; it goes on until a round changes nothing. Neighbours are summed up by an
    aggregate, never listed.
    """
    star = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges")
    before, state = None, _state(star)
    while state != before:
        size = 2 * state[0]
        both = star.union(star.select("u", "v")).toDF("x", "y")
        low = both.groupBy("x").agg(F.min("y").alias("m"), F.count(F.lit(1)).alias("c")).withColumn("m", F.least("x", "m"))
        large = _joined(both.where("y > x"), low, "x", size).select(F.col("y").alias("v"), F.col("m").alias("u")).where("u <> v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("c"))
        small = _joined(large, low, "v", size)
        small = small.select(F.col("u").alias("v"), F.col("m").alias("u")).union(small.select("v", "m")).where("u <> v").distinct()
        old, star = star, materialize(small, "edges")
        discard(old)
        before, state = state, _state(star)
    roots = star.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return star.select(F.col("v").alias("node"), F.col("u").alias("root")).union(roots)


def _joined(left: DataFrame, right: DataFrame, key: str, size: int) -> DataFrame:
    """left with right, which has every key of it once and at most `size` rows. The centre of a large star is a hot key."""
    if size <= BROADCAST_ROWS // 8:
        return left.join(F.broadcast(right), key)
    return skew_safe_left_join(left, right, [key], "c", size)


def _state(star: DataFrame) -> tuple:
    return tuple(star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
