"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _stars(pairs: DataFrame) -> DataFrame:
    """Hang every row's ``v`` on the least node of its ``u``: the least value is aggregated first, so a node with many links is only joined with one row."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return pairs.join(least, "u")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root): each node that has an edge, with the least node that it reaches.

    Every round hangs larger neighbours on the least one (large star), then smaller ones (small star); the rounds grow with
    the logarithm of the number of nodes. Rows with a null end and loops are ignored; an empty table gives an empty one.
    """
    work = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    work, before = materialise(work, "edges"), None
    while True:
        state = work.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).first()
        if state == before or not state[0]:
            return work.select(F.col("u").alias("node"), F.col("v").alias("root")).union(work.select("v", "v").distinct())
        before = state
        both = work.union(work.select("v", "u"))
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        stars = _stars(large)
        small = stars.select(F.col("v").alias("u"), F.col("m").alias("v")).union(stars.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        work = materialise(small, "stars")
