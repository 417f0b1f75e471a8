"""Column kinds, coercion, and row filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantiles import quantile_values

TEXT_LIKE_RATIO = 0.8


def is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


def is_categorical(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (T.StringType, T.BooleanType))


def is_temporal(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))


def numeric_names(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    return [c for c in (cols or df.columns) if is_numeric(df, c)]


def categorical_names(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    return [c for c in (cols or df.columns) if is_categorical(df, c)]


def per_column(df: DataFrame, cols: Sequence[str], make, **names) -> DataFrame:
    """One row per column from a single aggregate: ``make(c)`` gives the list of aliased statistics."""
    packed = F.array(*[F.struct(F.lit(c).alias("column"), *make(c)) for c in cols])
    return df.agg(packed.alias("_s")).select(F.inline("_s"))


def _kept(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, non_null bigint")
    return per_column(df, cols, lambda c: [F.count(c).alias("non_null")]).where("non_null > 0")


def numeric_columns(df: DataFrame) -> DataFrame:
    """(column, non_null) of numeric columns with at least one value."""
    return _kept(df, numeric_names(df))


def categorical_columns(df: DataFrame) -> DataFrame:
    return _kept(df, categorical_names(df))


def selectable_columns(df: DataFrame) -> DataFrame:
    return _kept(df, [c for c in df.columns if is_numeric(df, c) or is_categorical(df, c)])


def validate_selection(df: DataFrame, target: str, features: Sequence[str], task: str | None = None) -> DataFrame:
    """(check, column, ok): every condition a target and feature list must meet."""
    rows = [("target_exists", target, target in df.columns), ("has_features", None, bool(features)),
            ("target_not_a_feature", target, target not in features)]
    rows += [("feature_exists", f, f in df.columns) for f in features]
    present = [c for c in dict.fromkeys([target, *features]) if c in df.columns]
    usable = {r["column"] for r in selectable_columns(df.select(*present)).collect()} if present else set()
    rows += [("has_usable_values", c, c in usable) for c in present]
    if task == "regression" and target in df.columns:
        rows.append(("target_is_numeric", target, is_numeric(df, target)))
    return df.sparkSession.createDataFrame(rows, "check string, column string, ok boolean")


def reconcile(columns: Sequence[str], target: str | None, features: Sequence[str]) -> tuple[str | None, list[str], list[str]]:
    """(target, features, dropped) after columns have vanished or the target was listed as a feature."""
    target_left = target if target in columns else None
    kept = [f for f in features if f in columns and f != target_left]
    return target_left, kept, [f for f in features if f not in kept]


def column_kinds(df: DataFrame, approximate: bool = False) -> DataFrame:
    """(column, kind): numeric, categorical, text_like (mostly distinct strings) or datetime."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct

    def stats(c):
        if isinstance(df.schema[c].dataType, T.StringType):
            ratio = distinct(F.col(c)) / F.count(F.lit(1))
            kind = F.when(ratio > TEXT_LIKE_RATIO, "text_like").otherwise("categorical")
        else:
            fixed = ("numeric" if is_numeric(df, c) else "categorical" if is_categorical(df, c)
                     else "datetime" if is_temporal(df, c) else "other")
            kind = F.lit(fixed)
        return [kind.alias("kind")]

    return per_column(df, df.columns, stats)


def to_number(c: str | Column) -> Column:
    """Numeric value of a text column; text that is no number becomes null."""
    return (F.col(c) if isinstance(c, str) else c).try_cast("double")


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: to_number(c) for c in cols})


def mixed_types(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, non_null, numeric_values, mixed) for text columns."""
    texts = [c for c in (cols or df.columns) if isinstance(df.schema[c].dataType, T.StringType)]
    stats = per_column(df, texts, lambda c: [F.count(c).alias("non_null"), F.count(to_number(c)).alias("numeric_values")])
    return stats.withColumn("mixed", (F.col("numeric_values") > 0) & (F.col("numeric_values") < F.col("non_null")))


# ---- row filters -------------------------------------------------------------------------------

def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(F.col(target).isNotNull())


def trim_target(df: DataFrame, target: str, lower: float, upper: float) -> DataFrame:
    """Keep rows whose target lies within its own quantiles; the bounds become scan-side literals."""
    low, high = quantile_values(df, [target], [lower, upper])[target]
    return df.where(F.col(target).between(F.lit(low), F.lit(high)))


def plausible_rows(df: DataFrame, bounds: Mapping[str, tuple], factors: Mapping[str, float] | None = None) -> DataFrame:
    """Keep rows inside every interval after unit conversion; a null fails the test."""
    keep = F.lit(True)
    for c, (low, high) in bounds.items():
        value = F.col(c) * F.lit(float((factors or {}).get(c, 1.0)))
        if low is not None:
            keep = keep & F.coalesce(value >= F.lit(float(low)), F.lit(False))
        if high is not None:
            keep = keep & F.coalesce(value <= F.lit(float(high)), F.lit(False))
    return df.where(keep)


def constant_names(df: DataFrame) -> list[str]:
    """Columns with exactly one distinct non-null value; min equals max needs no distinct count."""
    comparable = [c for c in df.columns if not isinstance(df.schema[c].dataType, (T.MapType,))]
    stats = per_column(df, comparable, lambda c: [F.coalesce(F.min(c) == F.max(c), F.lit(False)).alias("constant")])
    return [r["column"] for r in stats.where("constant").collect()]


def drop_constant(df: DataFrame) -> DataFrame:
    constant = constant_names(df)
    return df.drop(*constant) if len(constant) < len(df.columns) else df


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def pairwise_complete(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.dropna(subset=[a, b])


def flow_counts(df: DataFrame, exclusions: Mapping[str, Column], target: str, split: Column | None = None) -> DataFrame:
    """(step, n): total, excluded per reason (first reason wins), missing target, analysed, then per split."""
    remaining = F.lit(True)
    items = [("total", F.count(F.lit(1)))]
    for reason, condition in exclusions.items():
        hit = F.coalesce(condition, F.lit(False))
        items.append((f"excluded: {reason}", F.count_if(remaining & hit)))
        remaining = remaining & ~hit
    items.append(("excluded", F.count_if(~remaining)))
    items.append(("after exclusions", F.count_if(remaining)))
    items.append(("missing target", F.count_if(remaining & F.col(target).isNull())))
    analysed = remaining & F.col(target).isNotNull()
    items.append(("analysed", F.count_if(analysed)))
    if split is not None:
        items += [(s, F.count_if(analysed & (split == s))) for s in ("train", "val", "test")]
    packed = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(s).alias("step"), e.alias("n")) for i, (s, e) in enumerate(items)])
    return df.agg(packed.alias("_s")).select(F.inline("_s")).orderBy("position")
