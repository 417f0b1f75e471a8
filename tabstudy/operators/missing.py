"""Missing-data patterns and whether missingness goes with the target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pvalues as P
from ..functions.ranking import running_totals

HIGH_MISSING = 0.05


def high_missing(df: DataFrame, cols: Sequence[str], limit: int | None = None) -> list[str]:
    """Columns with more than 5% missing, in table order; ``limit`` keeps the first of them."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(str(i)) for i, c in enumerate(cols)]).first()
    found = [c for i, c in enumerate(cols) if (row[i] or 0.0) > HIGH_MISSING]
    return found[:limit] if limit else found


def _flags(df: DataFrame, cols: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep..., column, is_missing): one row per data row and checked column."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).isNull().alias("is_missing")) for c in cols]))
    return df.select(*keep, cells.alias("_c")).select(*keep, "_c.column", "_c.is_missing")


def target_by_missing(df: DataFrame, target: str, cols: Sequence[str], parametric: bool = True) -> DataFrame:
    """Numeric target when a column is missing or not: means, gap, t or Mann-Whitney statistic and p."""
    rows = _flags(df.where(F.col(target).isNotNull()), cols, [target])
    t = F.col(target).cast("double")
    if parametric:
        sides = rows.groupBy("column").agg(*[
            f.alias(f"{name}{k}") for k, hit in ((1, F.col("is_missing")), (0, ~F.col("is_missing")))
            for name, f in (("n", F.count_if(hit)), ("m", F.avg(F.when(hit, t))), ("v", F.var_samp(F.when(hit, t))))])
        pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2)
        stat = F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n0"))))
        out = sides.where("n1 >= 2 and n0 >= 2").withColumn("statistic", stat).withColumn("test", F.lit("t"))
        out = out.withColumn("p", P.p_t(F.col("statistic"), F.col("n1") + F.col("n0") - 2))
    else:
        counts = rows.groupBy("column", F.col(target).cast("double").alias("value")).agg(
            F.count(F.lit(1)).alias("n"), F.count_if("is_missing").alias("k"))
        cum = running_totals(counts, "value", ["n"], ["column"])
        rank = F.col("cum_n") - (F.col("n") - 1) / 2
        sides = cum.groupBy("column").agg(
            F.sum("k").alias("n1"), F.sum(F.col("n") - F.col("k")).alias("n0"), F.sum(F.col("k") * rank).alias("r1"),
            F.sum(F.col("k") * F.col("value")).alias("s1"), F.sum((F.col("n") - F.col("k")) * F.col("value")).alias("s0"),
            F.sum(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n")).alias("ties"))
        sides = sides.withColumn("m1", F.try_divide("s1", "n1")).withColumn("m0", F.try_divide("s0", "n0"))
        u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
        total = (F.col("n1") + F.col("n0")).cast("double")
        sd = F.sqrt(F.col("n1") * F.col("n0") / 12.0 * ((total + 1) - F.col("ties") / (total * (total - 1))))
        z = F.greatest(F.abs(u - F.col("n1") * F.col("n0") / 2.0) - 0.5, F.lit(0.0)) / sd
        out = sides.where("n1 >= 2 and n0 >= 2").withColumn("statistic", u).withColumn("test", F.lit("mannwhitney")).withColumn("p", P.p_normal(z))
    return out.select("column", "n1", "n0", F.col("m1").alias("mean_missing"), F.col("m0").alias("mean_observed"),
                      F.abs(F.col("m1") - F.col("m0")).alias("difference"), "test", "statistic", "p").orderBy(F.desc("difference"), "column")


def class_by_missing(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """Class target against a null flag: chi-square (Yates on 2x2) or Fisher when a 2x2 cell is under 5."""
    cells = _flags(df.where(F.col(target).isNotNull()), cols, [target]).groupBy("column", F.col(target).cast("string").alias("class")).agg(
        F.count_if("is_missing").alias("a"), F.count_if(~F.col("is_missing")).alias("b"))
    margins = cells.groupBy("column").agg(F.sum("a").alias("n1"), F.sum("b").alias("n0"), F.count(F.lit(1)).alias("k"),
                                          F.array_sort(F.collect_list(F.struct("class", "a", "b"))).alias("cells"))
    # At most one entry per class: a contingency table, not data rows.
    total = (F.col("n1") + F.col("n0")).cast("double")

    def term(cell, count, side):
        expected = F.col(side) * (cell["a"] + cell["b"]) / total
        gap = F.abs(count - expected)
        gap = F.when(F.col("k") == 2, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
        return gap * gap / expected

    chi2 = F.aggregate("cells", F.lit(0.0), lambda acc, c: acc + term(c, c["a"], "n1") + term(c, c["b"], "n0"))
    low = F.aggregate("cells", F.lit(2**62), lambda acc, c: F.least(acc, c["a"], c["b"]))
    share = F.aggregate("cells", F.lit(0.0), lambda acc, c: F.greatest(acc, F.abs(c["a"] / F.col("n1") - c["b"] / F.col("n0"))))
    two, few = F.col("k") == 2, low < 5
    first, second = F.get("cells", F.lit(0)), F.get("cells", F.lit(1))
    odds = F.try_divide((first["a"] * second["b"]).cast("double"), first["b"] * second["a"])
    out = margins.where("n1 > 0 and n0 > 0").select(
        "column", "n1", "n0", share.alias("max_share_difference"), F.when(two & few, "fisher").otherwise("chi2").alias("test"),
        F.when(two & few, odds).otherwise(chi2).alias("statistic"), (F.col("k") - 1).alias("dof"),
        first["a"].alias("a"), first["b"].alias("b"), second["a"].alias("c"), second["b"].alias("d"))
    p = F.when(F.col("test") == "fisher", P.p_fisher(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).otherwise(P.p_chi2(F.col("statistic"), F.col("dof")))
    return out.select("column", "n1", "n0", "max_share_difference", "test", "statistic", p.alias("p")).orderBy(F.desc("max_share_difference"), "column")


def missing_patterns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(pattern, n_missing, n): every combination of missing columns with its row count."""
    names = list(cols or df.columns)
    listed = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in names])
    k = sum((F.col(c).isNull().cast("int") for c in names), F.lit(0))
    return df.groupBy(listed.alias("pattern"), k.alias("n_missing")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "pattern")
