"""Feature, target and dataset profiles, rule findings, cohort structure, summary tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantiles import exact_quantiles
from . import hypothesis as H
from .audit import adjusted_skewness, column_stats
from .columns import categorical_names, is_numeric, is_temporal, numeric_names, per_column
from .outliers import bounds, flag

LEVELS = ("critical", "scarce", "limited", "adequate", "abundant")  # worst first


def _lit(v, kind: str):
    return F.lit(v).cast(kind)


# ---- per feature -------------------------------------------------------------------------------

def feature_profile(df: DataFrame, cols: Sequence[str] | None = None, outlier_method: str = "iqr") -> DataFrame:
    """One row per column: missing, distinct, moments, outliers, and the flags drawn from them.

    Two scans: all statistics of all columns, then all outlier counts against the learned bounds.
    """
    cols = list(cols or df.columns)
    numeric = numeric_names(df, cols)
    types = dict(df.dtypes)

    def stats(c):
        v = F.col(c).cast("double") if is_numeric(df, c) else _lit(None, "double")
        return [
            F.count(F.lit(1)).alias("rows"), F.count(c).alias("n"), F.count_distinct(F.col(c)).alias("n_unique"), F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), adjusted_skewness(v).alias("skewness"),
        ]

    base = per_column(df, cols, stats)
    if numeric:
        medians = exact_quantiles(df, numeric, [0.5]).select("column", F.get("q", F.lit(0)).alias("median"))
        learned = bounds(df, numeric, outlier_method)
        counts = per_column(df, numeric, lambda c: [F.count_if(flag(c, learned, outlier_method)).alias("outliers")])
        base = base.join(F.broadcast(medians), "column", "left").join(F.broadcast(counts), "column", "left")
    else:
        base = base.withColumns({"median": _lit(None, "double"), "outliers": _lit(None, "bigint")})
    kinds = df.sparkSession.createDataFrame(
        [(i, c, types[c], c in numeric, types[c] in ("int", "bigint")) for i, c in enumerate(cols)],
        "position int, column string, dtype string, is_numeric boolean, is_integer boolean")
    out = base.join(F.broadcast(kinds), "column")
    ratio = F.coalesce(F.try_divide(F.col("n_unique").cast("double"), F.col("rows")), F.lit(0.0))
    rate = F.when(F.col("is_numeric"), F.coalesce(F.try_divide(F.col("outliers").cast("double"), F.col("n")), F.lit(0.0)))
    return out.select(
        "column", "dtype", "is_numeric", (F.col("rows") - F.col("n")).alias("missing"),
        F.coalesce(F.try_divide((F.col("rows") - F.col("n")).cast("double"), F.col("rows")), F.lit(0.0)).alias("missing_rate"),
        "n_unique", ratio.alias("cardinality_ratio"), "mean", "std", "min", "median", "max", "skewness", "outliers", rate.alias("outlier_rate"),
        F.coalesce(rate > 0.01, F.lit(False)).alias("has_outliers"),
        (~F.col("is_numeric") & ((ratio > 0.5) | (F.col("n_unique") > 50))).alias("high_cardinality"),
        (F.col("n_unique") <= 1).alias("is_constant"),
        ((F.col("n_unique") == F.col("rows")) & F.col("is_integer")).alias("is_id_like"), "position",
    ).orderBy("position").drop("position")


def top_categories(df: DataFrame, cols: Sequence[str] | None = None, top: int = 5) -> DataFrame:
    """(column, rank, value, n): most frequent values of every categorical column in one grouping.

    The row_number filter becomes a per-task top-k before the shuffle by column.
    """
    cols = list(cols or categorical_names(df))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]))
    counts = df.select(cells.alias("_c")).select("_c.*").where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top).select("column", "rank", "value", "n")


# ---- target ------------------------------------------------------------------------------------

def target_profile(df: DataFrame, target: str, task: str, outlier_method: str = "iqr") -> DataFrame:
    """One row about the target: moments and outliers, or class balance."""
    if task == "regression":
        learned = bounds(df, [target], outlier_method)
        stats = column_stats(df, [target], lambda c: [
            F.count(c).alias("n"), F.count_distinct(F.col(c)).alias("n_unique"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
            F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), adjusted_skewness(F.col(c).cast("double")).alias("skewness"),
            F.count_if(flag(c, learned, outlier_method)).alias("outliers")], [0.5])
        rate = F.coalesce(F.try_divide(F.col("outliers").cast("double"), F.col("n")), F.lit(0.0))
        return stats.select("column", "n", "n_unique", "mean", "std", "min", F.get("q", F.lit(0)).alias("median"), "max", "skewness",
                            rate.alias("outlier_rate"), (rate > 0.05).alias("has_outliers"))
    counts = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_classes"), F.min("n").alias("minority_size"), F.max("n").alias("majority_size"))
    ratio = F.try_divide(F.col("majority_size").cast("double"), F.col("minority_size"))
    severity = F.when(ratio > 10, "severe").when(ratio > 5, "moderate").when(ratio > 2, "mild").otherwise("none")
    return row.select(F.lit(target).alias("column"), "n", "n_classes", "minority_size", "majority_size", ratio.alias("balance_ratio"),
                      F.try_divide(F.col("majority_size").cast("double"), F.col("n")).alias("majority_share"), severity.alias("imbalance"))


def infer_task(df: DataFrame, target: str) -> str:
    """Classification for at most 20 distinct values making up under 5% of the rows."""
    row = df.agg(F.count_distinct(F.col(target)).alias("u"), F.count(F.lit(1)).alias("n")).first()
    return "classification" if row.u <= 20 and row.u < row.n * 0.05 else "regression"


def task_type(df: DataFrame, target: str) -> DataFrame:
    """(target, n_unique, unique_ratio, detected, confidence)."""
    kind = df.schema[target].dataType
    u, n = F.col("n_unique"), F.col("n")
    ratio = F.coalesce(F.try_divide(u.cast("double"), n), F.lit(0.0))
    stats = df.agg(F.count_distinct(F.col(target)).alias("n_unique"), F.count(F.lit(1)).alias("n"),
                   *([F.min(target).alias("lo"), F.max(target).alias("hi")] if isinstance(kind, (T.IntegerType, T.LongType)) else []))
    if isinstance(kind, (T.StringType, T.BooleanType)):
        detected, confidence = F.lit("classification"), F.lit("high")
    elif isinstance(kind, (T.IntegerType, T.LongType)):
        binary = (u == 2) & (F.col("lo") == 0) & (F.col("hi") == 1)
        detected = F.when(binary | (u <= 10) | (ratio < 0.02), "classification").otherwise("regression")
        confidence = F.when(binary, "high").when(u <= 5, "med").when(u <= 10, "low").otherwise("med")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        detected = F.when((u <= 10) | (ratio < 0.02), "classification").otherwise("regression")
        confidence = F.when(u <= 10, "med").when(ratio < 0.02, "low").otherwise("high")
    else:
        detected, confidence = F.lit("regression"), F.lit("low")
    return stats.select(F.lit(target).alias("target"), "n_unique", ratio.alias("unique_ratio"), detected.alias("detected"), confidence.alias("confidence"))


# ---- dataset -----------------------------------------------------------------------------------

def sufficiency_columns(n, p, minority=None):
    """Level from sample size, then the worse of that and the p/n and events-per-variable levels."""
    rank = lambda name: F.lit(LEVELS.index(name))
    by_n = (F.when(n < 50, rank("critical")).when(n < 100, rank("scarce")).when(n < 500, rank("limited"))
            .when(n < 5000, rank("adequate")).otherwise(rank("abundant")))
    ratio = F.try_divide(p.cast("double"), n)
    by_ratio = F.when(ratio > 1.0, rank("critical")).when(ratio > 0.5, rank("scarce")).otherwise(rank("abundant"))
    worst = F.least(by_n, by_ratio)
    epv = _lit(None, "double")
    if minority is not None:
        epv = F.try_divide(minority.cast("double"), p)
        worst = F.least(worst, F.when(epv < 5, rank("critical")).when(epv < 10, rank("scarce")).otherwise(rank("abundant")))
    level = F.element_at(F.array(*[F.lit(x) for x in LEVELS]), worst + 1)
    return level, ratio, epv


def sufficiency(df: DataFrame, features: Sequence[str], target: str | None = None, task: str = "regression") -> DataFrame:
    """(n_rows, n_features, p_n_ratio, minority_size, epv, level)."""
    p = F.lit(len(features))
    if task == "classification" and target is not None:
        counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("c"))
        row = counts.agg(F.sum("c").alias("n_rows"), F.min(F.when(F.col(target).isNotNull(), F.col("c"))).alias("minority_size"))
        level, ratio, epv = sufficiency_columns(F.col("n_rows"), p, F.col("minority_size"))
    else:
        row = df.agg(F.count(F.lit(1)).alias("n_rows"), _lit(None, "bigint").alias("minority_size"))
        level, ratio, epv = sufficiency_columns(F.col("n_rows"), p)
    return row.select("n_rows", p.alias("n_features"), ratio.alias("p_n_ratio"), "minority_size", epv.alias("epv"), level.alias("level"))


def dataset_profile(df: DataFrame, target: str | None = None, features: Sequence[str] | None = None, task: str | None = None,
                    outlier_method: str = "iqr") -> DataFrame:
    """One row rolled up from the feature profile: totals, column lists, task, sufficiency."""
    features = list(features or [c for c in df.columns if c != target])
    kind = task or (infer_task(df, target) if target else "regression")
    profile = feature_profile(df, features, outlier_method)

    def listed(condition):
        return F.array_join(F.array_sort(F.collect_list(F.when(condition, F.col("column")))), ", ")

    roll = profile.agg(
        F.count_if("is_numeric").alias("n_numeric"), F.count_if(~F.col("is_numeric")).alias("n_categorical"),
        F.sum("missing").alias("missing_cells"), F.count_if(F.col("missing") > 0).alias("columns_missing"),
        F.count_if(F.col("missing_rate") > 0.1).alias("columns_high_missing"), F.count_if(F.col("missing_rate") > 0.5).alias("columns_critical_missing"),
        listed(F.col("high_cardinality")).alias("high_cardinality"), listed(F.col("is_constant")).alias("constant"),
        listed(F.col("is_id_like")).alias("id_like"), listed(F.col("has_outliers")).alias("with_outliers"),
        listed(F.abs("skewness") > 1.0).alias("skewed"))
    size = sufficiency(df, features, target, kind)
    row = roll.withColumn("_k", F.lit(0)).join(size.withColumn("_k", F.lit(0)), "_k").drop("_k")
    cells = F.col("n_rows") * F.lit(len(features))
    return row.withColumn("missing_cell_rate", F.coalesce(F.try_divide(F.col("missing_cells").cast("double"), cells), F.lit(0.0))).withColumn("task", F.lit(kind))




def _finding(condition, id_, category, severity, columns, value, threshold):
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(condition, F.struct(
        F.lit(id_).alias("id"), F.lit(category).alias("category"), severity.alias("severity"), columns.cast("string").alias("columns"),
        value.cast("double").alias("value"), F.lit(float(threshold)).alias("threshold")))


def _rows(frame: DataFrame, findings) -> DataFrame:
    return frame.select(F.inline(F.filter(F.array(*findings), lambda x: x.isNotNull())))


def warnings(df: DataFrame, target: str | None = None, features: Sequence[str] | None = None, task: str | None = None,
             implausible: Sequence[str] = ()) -> DataFrame:
    """Finding rows: sample size, dimensionality, imbalance, missingness, cardinality, outliers, plausibility."""
    p = dataset_profile(df, target, features, task)
    none = F.lit("")
    balance = _lit(None, "double")
    if target and (task or infer_task(df, target)) == "classification":
        t = target_profile(df, target, "classification").select("balance_ratio").withColumn("_k", F.lit(0))
        p = p.withColumn("_k", F.lit(0)).join(t, "_k")
        balance = F.col("balance_ratio")
    count = lambda c: F.when(F.col(c) == "", 0).otherwise(F.size(F.split(F.col(c), ", ")))
    n, r = F.col("n_rows"), F.col("p_n_ratio")
    return _rows(p, [
        _finding(n < 500, "sample_size", "sample_size", F.when(n < 100, "critical").otherwise("warning"), none, n, 500),
        _finding(r > 0.5, "dimensionality", "dimensionality", F.when(r > 1, "critical").otherwise("warning"), none, r, 0.5),
        _finding(balance > 2, "imbalance", "imbalance", F.when(balance > 10, "critical").when(balance > 5, "warning").otherwise("caution"), none, balance, 2),
        _finding(F.col("columns_high_missing") > 0, "missingness", "missingness",
                 F.when(F.col("columns_critical_missing") > 0, "critical").otherwise("warning"), none, F.col("columns_high_missing"), 0),
        _finding(count("high_cardinality") > 0, "cardinality", "cardinality", "caution", F.col("high_cardinality"), count("high_cardinality"), 0),
        _finding(count("with_outliers") > 0, "outliers", "outliers", "caution", F.col("with_outliers"), count("with_outliers"), 0),
        _finding(F.lit(len(implausible) > 0), "plausibility", "plausibility", "caution", F.lit(", ".join(implausible)), F.lit(len(implausible)), 0),
    ])


def opportunities(df: DataFrame, target: str, features: Sequence[str], task: str = "regression") -> DataFrame:
    """Finding rows: strong linear signal, non-linear relations, many rows per feature, balanced classes, skew."""
    numeric = [c for c in numeric_names(df, list(features)) if c != target]
    stats = [F.count(F.lit(1)).alias("n")]
    skews = [F.struct(F.lit(c).alias("c"), adjusted_skewness(F.col(c).cast("double")).alias("s")) for c in numeric]
    stats.append(F.array(*skews).alias("skews"))
    findings = []
    if task == "regression":
        stats.append(F.greatest(*[F.coalesce(F.abs(F.corr(F.col(c).cast("double"), F.col(target).cast("double"))), F.lit(0.0)) for c in numeric],
                                F.lit(0.0)).alias("top"))
    frame = df.agg(*stats).withColumn("_k", F.lit(0))
    if task == "regression":
        if len(numeric) >= 2:
            findings.append(_finding(F.col("top") > 0.7, "strong_signal", "relationship", "opportunity", F.lit(""), F.col("top"), 0.7))
        if len(numeric) >= 3:
            ranks = H.rank_correlations(df, [(c, target) for c in numeric]).select(F.col("a").alias("column"), F.abs("r").alias("s"))
            lines = per_column(df, numeric, lambda c: [F.abs(F.corr(F.col(c).cast("double"), F.col(target).cast("double"))).alias("l")])
            gaps = ranks.join(lines, "column").select((F.col("s") - F.col("l")).alias("gap"))
            frame = frame.join(gaps.agg(F.avg("gap").alias("gap")).withColumn("_k", F.lit(0)), "_k")
            findings.append(_finding(F.col("gap") > 0.08, "nonlinear", "relationship", "opportunity", F.lit(""), F.col("gap"), 0.08))
    else:
        balance = df.where(F.col(target).isNotNull()).groupBy(target).count().agg((F.min("count") / F.max("count")).alias("balance")).withColumn("_k", F.lit(0))
        frame = frame.join(balance, "_k")
        findings.append(_finding(F.col("balance") > 0.7, "balanced", "distribution", "opportunity", F.lit(""), F.col("balance"), 0.7))
    ratio = F.col("n") / F.lit(float(max(len(features), 1)))
    findings.append(_finding(ratio > 100, "high_np", "sufficiency", "opportunity", F.lit(""), ratio, 100))
    skewed = F.filter("skews", lambda x: F.abs(x["s"]) > 2.0)
    findings.append(_finding(F.size(skewed) > 0, "skew_group", "distribution", "info",
                             F.array_join(F.transform(skewed, lambda x: x["c"]), ", "), F.size(skewed), 0))
    return _rows(frame, findings)


def regime(df: DataFrame, features: Sequence[str], target: str | None = None) -> DataFrame:
    """One row: size class by features and rows, counts by kind, columns with missing values."""
    features = list(features)
    rates = F.array(*[F.avg(F.col(c).isNull().cast("double")) for c in features])
    row = df.agg(F.count(F.lit(1)).alias("n_rows"), rates.alias("rates"))
    p = len(features)
    width = "narrow" if p <= 15 else "medium" if p <= 50 else "wide" if p <= 200 else "ultra_wide"
    n = F.col("n_rows")
    rows = F.when(n < 100, "tiny").when(n < 10_000, "standard").when(n < 100_000, "large").otherwise("massive")
    target_type = None if target is None or target not in df.columns else "numeric" if is_numeric(df, target) else "categorical"
    return row.select(
        "n_rows", F.lit(p).alias("n_features"), F.lit(len(numeric_names(df, features))).alias("n_numeric"),
        F.lit(len(categorical_names(df, features))).alias("n_categorical"), F.lit(sum(is_temporal(df, c) for c in features)).alias("n_datetime"),
        F.size(F.filter("rates", lambda x: x > 0)).alias("columns_missing"), F.size(F.filter("rates", lambda x: x > 0.05)).alias("columns_high_missing"),
        F.lit(width).alias("feature_regime"), rows.alias("row_regime"), _lit(target_type, "string").alias("target_type"))


# ---- cohort ------------------------------------------------------------------------------------

# Name parts that point to an entity id, rule one out, or point to a time column.
ENTITY_NAMES = ("patient", "subject", "person", "respondent", "participant", "member", "mrn", "record", "encounter")
MEASUREMENT_NAMES = ("glucose", "triglyceride", "cholesterol", "bmi", "waist", "weight", "height", "bp", "blood_pressure", "kcal",
                     "hba1c", "insulin", "ldl", "hdl", "creatinine", "albumin")
TIME_NAMES = ("date", "time", "visit", "wave", "year", "month", "day", "baseline", "followup", "follow_up")
ROW_NAMES = ("index", "row", "row_number", "unnamed: 0")


def entity_names(df: DataFrame, patterns: Sequence[str] = ENTITY_NAMES) -> list[str]:
    return [c for c in df.columns if c.lower() not in ROW_NAMES and not any(m in c.lower() for m in MEASUREMENT_NAMES)
            and any(p in c.lower() for p in patterns)]


def time_names(df: DataFrame, patterns: Sequence[str] = TIME_NAMES) -> list[str]:
    """Time columns by name or type, or text whose values all parse as timestamps."""
    found = [c for c in df.columns if any(p in c.lower() for p in patterns) or is_temporal(df, c)]
    texts = [c for c in df.columns if isinstance(df.schema[c].dataType, T.StringType) and c not in found]
    if texts:
        row = df.agg(*[F.bool_and(F.when(F.col(c).isNotNull(), F.try_to_timestamp(F.col(c)).isNotNull())).alias(str(i)) for i, c in enumerate(texts)]).first()
        found += [c for i, c in enumerate(texts) if row[i]]
    return [c for c in df.columns if c in found]


def rows_per_entity(df: DataFrame, entity: str) -> DataFrame:
    """(entity, entities, median_rows, mean_rows, max_rows, repeat_rate)."""
    counts = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.count(F.lit(1)).alias("n"))
    # Counts of counts: entities collapse to one row per size before any median.
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    return sizes.agg(F.sum("k").alias("entities"), F.percentile(F.col("n"), 0.5, F.col("k")).alias("median_rows"),
                     (F.sum(F.col("n") * F.col("k")) / F.sum("k")).alias("mean_rows"), F.max("n").alias("max_rows"),
                     (F.sum(F.when(F.col("n") > 1, F.col("k")).otherwise(0)) / F.sum("k")).alias("repeat_rate")).select(F.lit(entity).alias("entity"), "*")


def rows_per_entity_histogram(df: DataFrame, entity: str) -> DataFrame:
    """(rows, entities): how many entities have how many rows."""
    return df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.count(F.lit(1)).alias("rows")).groupBy("rows").agg(
        F.count(F.lit(1)).alias("entities")).orderBy("rows")


def cohort(df: DataFrame, patterns: Sequence[str] = ENTITY_NAMES, min_ratio: float = 0.5, time_patterns: Sequence[str] = TIME_NAMES) -> DataFrame:
    """One row: longitudinal or cross-sectional, with the entity and time columns found.

    ``min_ratio`` is the least share of distinct values an id column must have.
    """
    names = [c for c in entity_names(df, patterns) if df.schema[c].dataType.simpleString() in ("int", "bigint", "string")]
    times = time_names(df, time_patterns)
    candidates = []
    if names:
        row = df.agg(*[F.struct(F.count_distinct(F.col(c)), F.count(F.lit(1))).alias(str(i)) for i, c in enumerate(names)]).first()
        candidates = [c for i, c in enumerate(names) if row[i][1] and row[i][0] / row[i][1] >= min_ratio]
    best, median, repeat = None, 0.0, 0.0
    for c in candidates:
        r = rows_per_entity(df, c).first()
        if (r.median_rows >= 2 or r.repeat_rate > 0.1) and (r.median_rows > median or r.repeat_rate > repeat):
            best, median, repeat = c, r.median_rows, r.repeat_rate
    if best:
        detected, confidence = "longitudinal", "high" if median >= 2 else "med"
    elif not candidates and times:
        others = [c for c in df.columns if c not in times]
        repeats = df.agg(*[(F.count_distinct(F.col(c)) < F.count(c)).alias(str(i)) for i, c in enumerate(others)]).first() if others else []
        detected, confidence = ("longitudinal" if any(repeats) else "cross_sectional"), "med"
    else:
        detected, confidence = "cross_sectional", "med"
    rows = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.select("n_rows", F.lit(detected).alias("detected"), F.lit(confidence).alias("confidence"), F.lit(", ".join(candidates)).alias("entity_candidates"),
                       _lit(best, "string").alias("entity"), F.lit(float(median)).alias("median_rows"), F.lit(float(repeat)).alias("repeat_rate"),
                       F.lit(", ".join(times)).alias("time_columns"))


# ---- stratified summary ------------------------------------------------------------------------

OVERALL = "Overall"


def _with_overall(df: DataFrame, group: str | None) -> DataFrame:
    if group is None:
        return df.withColumn("_g", F.lit(OVERALL))
    tags = F.array_compact(F.array(F.lit(OVERALL), F.col(group).cast("string")))
    return df.withColumn("_g", F.explode(tags))


def summary_continuous(df: DataFrame, cols: Sequence[str], group: str | None = None) -> DataFrame:
    """(variable, stratum, n, missing, mean, sd, q25, q50, q75) overall and by group."""
    tagged = _with_overall(df, group).select("_g", *cols)
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.count(c).alias("n"), F.count_if(F.col(c).isNull()).alias("missing"),
                               F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd")) for c in cols])
    moments = tagged.groupBy(F.col("_g").alias("stratum")).agg(cells.alias("_s")).select("stratum", F.inline("_s"))
    q = exact_quantiles(tagged, list(cols), [0.25, 0.5, 0.75], ["_g"]).select(
        F.col("_g").alias("stratum"), F.col("column").alias("variable"), *[F.get("q", F.lit(i)).alias(k) for i, k in enumerate(("q25", "q50", "q75"))])
    return moments.join(q, ["stratum", "variable"], "left").select("variable", "stratum", "n", "missing", "mean", "sd", "q25", "q50", "q75")


def summary_categorical(df: DataFrame, cols: Sequence[str], group: str | None = None) -> DataFrame:
    """(variable, level, stratum, n, share) with shares of the non-missing rows of the stratum."""
    tagged = _with_overall(df, group)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in cols]))
    counts = tagged.select("_g", cells.alias("_c")).select(F.col("_g").alias("stratum"), "_c.*").where("level is not null").groupBy(
        "variable", "level", "stratum").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("variable", "stratum").agg(F.sum("n").alias("_t"))
    return counts.join(total, ["variable", "stratum"]).select("variable", "level", "stratum", "n", (F.col("n") / F.col("_t")).alias("share"))


def smd(df: DataFrame, cols: Sequence[str], group: str, levels: Sequence) -> DataFrame:
    """(variable, smd): absolute standardised mean difference of two groups, all variables in one scan."""
    def stats(c):
        sides = [F.when(F.col(group) == F.lit(x), F.col(c).cast("double")) for x in levels]
        return [e.alias(f"{k}{i}") for i, s in enumerate(sides) for k, e in (("n", F.count(s)), ("m", F.avg(s)), ("v", F.var_samp(s)))]

    row = per_column(df, list(cols), stats)
    n0, n1 = F.col("n0"), F.col("n1")
    pooled = F.sqrt(((n0 - 1) * F.col("v0") + (n1 - 1) * F.col("v1")) / (n0 + n1 - 2))
    d = F.when((n0 >= 2) & (n1 >= 2), F.when(pooled == 0, 0.0).otherwise(F.abs(F.col("m0") - F.col("m1")) / pooled))
    return row.select(F.col("column").alias("variable"), d.alias("smd"))


def format_p(p):
    return F.when(p.isNull(), "—").when(p < 0.001, "<0.001").when(p < 0.01, F.format_string("%.3f", p)).otherwise(F.format_string("%.2f", p))


def table_one(df: DataFrame, continuous: Sequence[str], categorical: Sequence[str] = (), group: str | None = None,
              with_p: bool = True, decimals: int = 1) -> DataFrame:
    """(variable, level, stratum, text, n, missing, mean, sd, q25, q50, q75, share, test, p, p_text).

    Continuous variables read as mean ± SD when normal overall and as median [IQR] otherwise.
    """
    null = lambda kind, name: _lit(None, kind).alias(name)
    number = f"%.{decimals}f"
    parts = []
    if continuous:
        normal = {c: bool(H.normality(df, c).first().normal) for c in continuous}
        table = summary_continuous(df, continuous, group)
        is_normal = F.col("variable").isin([c for c, ok in normal.items() if ok] or [""])
        text = F.when(F.col("n") == 0, "—").when(is_normal, F.format_string(f"{number} ± {number}", "mean", "sd")).otherwise(
            F.format_string(f"{number} [{number}, {number}]", "q50", "q25", "q75"))
        parts.append(table.select("variable", null("string", "level"), "stratum", text.alias("text"), "n", "missing", "mean", "sd", "q25", "q50", "q75",
                                  null("double", "share")))
    if categorical:
        table = summary_categorical(df, categorical, group)
        text = F.format_string("%d (%.1f%%)", F.col("n"), F.col("share") * 100)
        parts.append(table.select("variable", "level", "stratum", text.alias("text"), "n", null("bigint", "missing"),
                                  *[null("double", k) for k in ("mean", "sd", "q25", "q50", "q75")], "share"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if group is None or not with_p:
        return out
    tests = [H.compare_groups(df, c, group).select(F.lit(c).alias("variable"), "test", "p") for c in continuous]
    tests += [H.compare_classes(df, c, group).select(F.lit(c).alias("variable"), "test", "p") for c in categorical]
    return out.join(F.broadcast(H.union_tests(tests)), "variable", "left").withColumn("p_text", format_p(F.col("p")))


