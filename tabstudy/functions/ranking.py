"""Running totals and ranks over a whole table without a single-partition window.

The input is first reduced to one row per distinct value (ties and hot values collapse there).
They are cut into equal-depth value ranges with approximate quantile boundaries; each range
is summed, the few range totals are turned into offsets, and the exact running total inside a range
is a window partitioned by range.  Boundaries only balance the work; the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_RANGE = 1_000_000
EDGES = 512  # approximate quantiles that come with the count; more ranges than that take a second pass


def rows_per_range(df: DataFrame) -> int:
    """Distinct values that one task orders; ``tabstudy.rowsPerRange`` changes the work of a task, never a result."""
    return max(2, int(df.sparkSession.conf.get("tabstudy.rowsPerRange", str(ROWS_PER_RANGE))))


def _with_range(df: DataFrame, order_col: str) -> DataFrame:
    """Add ``_range``: index of the value range, monotone in ``order_col``."""
    numeric = df.withColumn("_o", F.col(order_col).cast("double"))

    def edges(pieces: int):
        return F.percentile_approx("_o", [i / pieces for i in range(1, pieces)], F.lit(10 * pieces))

    row = numeric.agg(F.count(F.lit(1)).alias("n"), edges(EDGES).alias("e")).first()
    pieces = max(2, -(-row["n"] // rows_per_range(df)))
    found = row["e"] or []
    if pieces > EDGES:
        found = numeric.agg(edges(pieces).alias("e")).first()["e"] or []
    else:
        found = found[EDGES // pieces - 1::max(1, EDGES // pieces)]
    splits = [float("-inf"), *sorted({float(e) for e in found if math.isfinite(e)}), float("inf")]
    if len(splits) < 3:
        splits = [float("-inf"), 0.0, float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_o", outputCol="_range", handleInvalid="keep")
    return cut.transform(numeric).drop("_o")


def running_totals(df: DataFrame, order_col: str, sums: Sequence[str], by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Add ``cum_<c>``: inclusive running sum of each column in order of ``order_col`` within ``by``.

    ``df`` has one row per (by, order_col); ``order_col`` is numeric or temporal and not null.
    """
    by = list(by)
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    cut = _with_range(df, order_col)
    range_order = F.col("_range").desc() if descending else F.col("_range").asc()
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy(range_order).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    offsets = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums])
    keys = [*by, "_range"]
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    # Both sides are partitioned by (by, range), so the join and the window share one shuffle.
    joined = cut.alias("c").join(offsets.alias("o"), [F.col(f"c.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys], "inner")
    picked = joined.select(*[F.col(f"c.{c}").alias(c) for c in cut.columns], *[F.col(f"o._b_{c}").alias(f"_b_{c}") for c in sums])
    return picked.select(*df.columns, *[(F.sum(c).over(inside) + F.col(f"_b_{c}")).alias(f"cum_{c}") for c in sums])


def value_ranks(df: DataFrame, value_col: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., value, n, rank): average rank of every distinct value, nulls left out."""
    counts = (
        df.where(F.col(value_col).isNotNull())
        .groupBy(*by, F.col(value_col).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    cum = running_totals(counts, "value", ["n"], by)
    return cum.select(*by, "value", "n", (F.col("cum_n") - (F.col("n") - 1) / 2).alias("rank"))


def add_ranks(df: DataFrame, cols: Sequence[str], prefix: str = "rank_") -> DataFrame:
    """Append the average rank of each column; rows with nulls get a null rank.

    Ranks live on distinct values, so the join back is an equi-join on the value; hot values are
    split by AQE's skew join because each has exactly one partner row.
    """
    out = df
    for c in cols:
        ranks = value_ranks(df, c).select(F.col("value").alias(f"_v_{c}"), F.col("rank").alias(f"{prefix}{c}"))
        out = out.join(ranks, F.col(c) == F.col(f"_v_{c}"), "left").drop(f"_v_{c}")
    return out
