"""Audit of a table: size, missing cells, duplicates, cardinality, types, distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles, quantile_values
from .columns import is_numeric, numeric_names, per_column, to_number


def adjusted_skewness(c: Column) -> Column:
    """Sample-adjusted skewness G1; Spark's ``skewness`` is the population g1."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def adjusted_kurtosis(c: Column) -> Column:
    """Sample-adjusted excess kurtosis G2."""
    n = F.count(c).cast("double")
    return F.when(n > 3, F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def moments(df: DataFrame, c: str) -> list[Column]:
    v = F.col(c).cast("double")
    return [
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
        F.max(v).alias("max"), adjusted_skewness(v).alias("skewness"), adjusted_kurtosis(v).alias("kurtosis"),
    ]


def column_stats(df: DataFrame, cols: Sequence[str], make, probs: Sequence[float]) -> DataFrame:
    """``per_column`` statistics plus ``q`` (array of exact quantiles)."""
    cols = list(cols)
    quantiles = exact_quantiles(df, cols, probs).select("column", "q")
    return per_column(df, cols, make).join(F.broadcast(quantiles), "column", "left")


def overview(df: DataFrame) -> DataFrame:
    """(n_rows, n_columns, missing_cells, missing_pct, numeric_columns, duplicate_rows) from one grouping by row."""
    nulls = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    numeric = numeric_names(df)
    # Grouping identical rows first gives duplicates, and every other count as weighted sums.
    rows = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    has_value = [F.max(F.col(c).isNotNull().cast("int")) for c in numeric]
    filled = sum((F.coalesce(h, F.lit(0)) for h in has_value), F.lit(0))
    cells = F.col("n_rows") * F.lit(len(df.columns))
    return rows.agg(
        F.sum("_n").alias("n_rows"), F.sum(nulls * F.col("_n")).alias("missing_cells"),
        filled.cast("bigint").alias("numeric_columns"), F.sum(F.col("_n") - 1).alias("duplicate_rows"),
    ).select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"), "missing_cells",
        F.coalesce(F.try_divide(F.col("missing_cells") * 100.0, cells), F.lit(0.0)).alias("missing_pct"),
        "numeric_columns", "duplicate_rows")


def duplicate_summary(df: DataFrame) -> DataFrame:
    """(n_rows, duplicate_rows, duplicate_rate): every copy after the first counts."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("duplicate_rows")).withColumn(
        "duplicate_rate", F.try_divide(F.col("duplicate_rows"), F.col("n_rows")))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Every member of a group of identical rows, the first included.

    Repeated rows are found by a partial aggregate and looked up with a semi join, which AQE can
    split when one row has very many copies; no group is gathered in a task.
    """
    repeated = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    same = [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in df.columns]
    return df.alias("a").join(repeated.alias("b"), same, "left_semi")


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def _distinct(approximate: bool):
    return F.approx_count_distinct if approximate else F.count_distinct


def cardinality(df: DataFrame, approximate: bool = False) -> DataFrame:
    """(column, n_unique, pct_unique, class)."""
    distinct = _distinct(approximate)
    stats = per_column(df, df.columns, lambda c: [distinct(F.col(c)).alias("n_unique"), F.count(F.lit(1)).alias("n_rows")])
    u, n = F.col("n_unique"), F.col("n_rows")
    pct = F.coalesce(F.try_divide(u * 100.0, n), F.lit(0.0))
    kind = (
        F.when(u == 1, "Constant").when(u == 2, "Binary").when(u == n, "Unique").when(u <= 10, "Low")
        .when(u <= 50, "Moderate").when(pct > 90, "High near-unique").otherwise("High")
    )
    return stats.select("column", "n_unique", pct.alias("pct_unique"), kind.alias("cardinality_class"))


def dtypes(df: DataFrame, samples: int = 3, approximate: bool = False) -> DataFrame:
    """(column, dtype, non_null, nulls, n_unique, sample, issues) in one pass.

    Sample values are the smallest distinct ones, so the answer does not depend on partitioning.
    """
    distinct = _distinct(approximate)
    types = dict(df.dtypes)

    def stats(c):
        text = types[c] == "string"
        numbers = F.count(to_number(c)) if text else F.lit(0).cast("bigint")
        return [
            F.lit(types[c]).alias("dtype"), F.count(c).alias("non_null"), F.count_if(F.col(c).isNull()).alias("nulls"),
            distinct(F.col(c)).alias("n_unique"), numbers.alias("numbers"), F.min(F.col(c)).cast("string").alias("sample"),
        ]

    table = per_column(df, df.columns, stats)
    mixed = (F.col("numbers") > 0) & (F.col("numbers") < F.col("non_null"))
    parts = F.concat_ws(", ", F.when(F.col("nulls") > 0, F.concat(F.col("nulls").cast("string"), F.lit(" missing"))),
                        F.when(mixed, F.lit("mixed types")))
    return table.select("column", "dtype", "non_null", "nulls", "n_unique", "sample",
                        F.when(parts == "", "OK").otherwise(parts).alias("issues"))


def missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, missing, missing_rate, over_5, over_10, over_50), most missing first."""
    stats = per_column(df, list(cols or df.columns), lambda c: [F.count_if(F.col(c).isNull()).alias("missing"), F.count(F.lit(1)).alias("n_rows")])
    rate = F.coalesce(F.try_divide(F.col("missing").cast("double"), F.col("n_rows")), F.lit(0.0))
    return stats.select("column", "missing", rate.alias("missing_rate"), (rate > 0.05).alias("over_5"),
                        (rate > 0.10).alias("over_10"), (rate > 0.50).alias("over_50")).orderBy(F.desc("missing"), "column")


def describe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, n, mean, std, min, q25, q50, q75, max, skewness, kurtosis)."""
    stats = column_stats(df, list(cols or numeric_names(df)), lambda c: moments(df, c), [0.25, 0.5, 0.75])
    return stats.select("column", "n", "mean", "std", "min", F.get("q", F.lit(0)).alias("q25"), F.get("q", F.lit(1)).alias("q50"),
                        F.get("q", F.lit(2)).alias("q75"), "max", "skewness", "kurtosis")


def value_counts(df: DataFrame, c: str, top: int | None = None) -> DataFrame:
    """(value, n) by falling count, ties by value; the top-k is the feature."""
    counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ordered = counts.orderBy(F.desc("n"), "value")
    return ordered.limit(top) if top else ordered


def inspect(df: DataFrame, c: str, top: int = 10) -> DataFrame:
    """(item, text, number): the single-column summary card."""
    n = F.count(F.lit(1))
    if is_numeric(df, c):
        q = column_stats(df, [c], lambda c: [n.alias("rows"), F.count(c).alias("n"), F.count_distinct(F.col(c)).alias("unique"),
                                            F.avg(c).alias("mean"), F.min(c).cast("double").alias("min"),
                                            F.max(c).cast("double").alias("max"), F.stddev_samp(c).alias("std")], [0.5])
        items = [("unique", F.col("unique")), ("missing", F.col("rows") - F.col("n")), ("mean", F.col("mean")), ("min", F.col("min")),
                 ("median", F.get("q", F.lit(0))), ("max", F.col("max")), ("std", F.col("std"))]
        packed = F.array(*[F.struct(F.lit(k).alias("item"), F.lit(None).cast("string").alias("text"), v.cast("double").alias("number")) for k, v in items])
        return q.select(F.inline(packed))
    counts = df.groupBy(F.col(c).cast("string").alias("text")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.count("text").alias("unique"), F.coalesce(F.sum(F.when(F.col("text").isNull(), F.col("n"))), F.lit(0)).alias("missing"))
    facts = totals.select(F.inline(F.array(*[F.struct(F.lit(k).alias("item"), F.lit(None).cast("string").alias("text"),
                                                      F.col(k).cast("double").alias("number")) for k in ("unique", "missing")])))
    best = counts.where("text is not null").orderBy(F.desc("n"), "text").limit(top)
    return facts.unionByName(best.select(F.lit("top").alias("item"), "text", F.col("n").cast("double").alias("number")))


def histogram(df: DataFrame, c: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, n): equal-width bins, the last closed, empty bins included."""
    edge = df.agg(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).first()
    if edge.lo is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n bigint")
    lo, hi = edge.lo, edge.hi
    width = (hi - lo) / bins
    if width == 0:
        index = F.lit(0)
    else:
        index = F.least(F.floor((F.col(c) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(c).isNotNull()).groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = frame.join(F.broadcast(counts), "bin", "left")
    return full.select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("low"),
                       (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("high"), F.coalesce("n", F.lit(0)).alias("n")).orderBy("bin")


FIVE = [0.0, 0.25, 0.5, 0.75, 1.0]


def _five(frame: DataFrame, keep: Sequence[str]) -> DataFrame:
    names = ["min", "q25", "median", "q75", "max"]
    return frame.select(*keep, "n", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(names)])


def box_summary(df: DataFrame, c: str, by: str | None = None) -> DataFrame:
    """(group, n, min, q25, median, q75, max) of a column, per group when asked."""
    if by is None:
        return _five(exact_quantiles(df, [c], FIVE), ["column"])
    return _five(exact_quantiles(df.withColumn("group", F.col(by).cast("string")).select("group", c), [c], FIVE, ["group"]), ["group"])


def tertile(df: DataFrame, c: str) -> Column:
    """Low / Mid / High by the column's own tertiles (right-closed, as quantile cuts are)."""
    a, b = quantile_values(df, [c], [1 / 3, 2 / 3])[c]
    return F.when(F.col(c) <= F.lit(a), "Low").when(F.col(c) <= F.lit(b), "Mid").when(F.col(c).isNotNull(), "High")


def box_by_tertile(df: DataFrame, c: str, by: str) -> DataFrame:
    cut = df.withColumn("group", tertile(df, by)).where("group is not null")
    return _five(exact_quantiles(cut.select("group", c), [c], FIVE, ["group"]), ["group"])


