"""Connected components by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable


#: Links that a file of a round holds; their number does not grow from round to round.
EDGES_A_FILE = 250_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def connected(edges: DataFrame, tag: str) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches.

    edges has long columns a and b.  Nulls and self links are dropped; repeated and
    reversed links count once; no edges give no rows.  Rounds go on until one changes
    nothing, which takes about the square of the logarithm of the longest chain.  Every
    round is written to the shared folder, and only three numbers a round come to the driver.
    """
    state = durable(
        edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag
    )
    seen, digest = None, ()
    while digest != seen:
        seen, before = digest, state
        pairs = _both_ways(state)
        low = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = pairs.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        state = durable(small.filter("a != b").distinct().coalesce(1 + (digest[0] // EDGES_A_FILE if digest else before.count() // EDGES_A_FILE)), tag)
        discard(before)
        digest = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
    roots = state.select(F.col("b").alias("node")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
