"""Evaluation of predictions held as a table.

Every operator takes a predictions DataFrame and grouping columns (usually the model), so many models
are scored in one pass.  Curves work on distinct scores; bootstrap replicates are grouped sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pvalues as P
from ..functions.hashing import FOLD_MULTIPLIER, FOLD_SHIFT, MODULUS, POISSON_CDF, ROUND_DIVISOR, ROUND_MULTIPLIER, ROUND_OFFSETS, START, row_key
from ..functions.quantiles import exact_quantiles, quantile_values, select_ranks
from ..functions.ranking import running_totals
from ..functions.resample import replicate_auc, replicate_medians, replicate_sums


def _num(c: str) -> Column:
    return F.col(c).cast("double")


# ---- regression --------------------------------------------------------------------------------

def join_groups(a: DataFrame, b: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Columns of two tables that have one row per group; a null group meets the null group. Without groups both have one row."""
    by = list(by)
    if not by:
        return a.withColumn("_k", F.lit(0)).join(b.withColumn("_k", F.lit(0)), "_k").drop("_k")
    keyed = b.select(*[F.col(k).alias(f"_j{i}") for i, k in enumerate(by)], *[c for c in b.columns if c not in by])
    return a.join(keyed, [F.col(k).eqNullSafe(F.col(f"_j{i}")) for i, k in enumerate(by)], how).drop(*[f"_j{i}" for i in range(len(by))])


def regression_metrics(df: DataFrame, y: str = "y", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, mae, rmse, r2, median_ae)."""
    e = _num(y) - _num(pred)
    by = list(by)
    base = df.groupBy(*by).agg(F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
                               (1 - F.try_divide(F.avg(e * e), F.var_pop(_num(y)))).alias("r2"))
    medians = exact_quantiles(df.select(*by, F.abs(e).alias("e")), ["e"], [0.5], by).select(*by, F.get("q", F.lit(0)).alias("median_ae"))
    return join_groups(base, medians, by)


RESIDUAL_PROBS = [0.05, 0.25, 0.5, 0.75, 0.95]


def residuals(df: DataFrame, y: str = "y", pred: str = "pred", by: Sequence[str] = (), extended: bool = False) -> DataFrame:
    """Residual summary: mean, population SD, min, max, median; extended adds skew, IQR, quantiles, correlation with the prediction."""
    by = list(by)
    work = df.select(*by, (_num(y) - _num(pred)).alias("e"), _num(pred).alias("p")).where("e is not null")
    base = work.groupBy(*by).agg(F.count("e").alias("n"), F.avg("e").alias("mean_residual"), F.stddev_pop("e").alias("std_residual"),
                                 F.min("e").alias("min_residual"), F.max("e").alias("max_residual"), F.skewness("e").alias("skew"),
                                 F.coalesce(F.corr("e", "p"), F.lit(0.0)).alias("corr_with_predicted"))
    q = exact_quantiles(work, ["e"], RESIDUAL_PROBS, by)
    at = lambda i: F.get("q", F.lit(i))
    q = q.select(*by, at(2).alias("median_residual"), (at(3) - at(1)).alias("iqr"), at(0).alias("q5"), at(1).alias("q25"), at(3).alias("q75"), at(4).alias("q95"))
    out = join_groups(base, q, by)
    short = [*by, "n", "mean_residual", "std_residual", "min_residual", "max_residual", "median_residual"]
    return out if extended else out.select(*short)


def predicted_vs_actual(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """One row: correlation, mean bias in each fifth of the target, extremes."""
    edges = quantile_values(df, [y], [0.2, 0.4, 0.6, 0.8])[y]
    e = _num(pred) - _num(y)
    bins = [F.lit(None), *[F.lit(v) for v in edges], F.lit(None)]
    bias = []
    for i in range(5):
        inside = F.lit(True)
        if i > 0:
            inside = inside & (F.col(y) >= bins[i])
        if i < 4:
            inside = inside & (F.col(y) < bins[i + 1])
        bias.append(F.coalesce(F.avg(F.when(inside, e)), F.lit(0.0)).alias(f"bias_q{i + 1}"))
    return df.agg(F.coalesce(F.corr(_num(y), _num(pred)), F.lit(0.0)).alias("correlation"), *bias, F.max(e).alias("max_overprediction"),
                  F.min(e).alias("max_underprediction"), F.avg(e).alias("mean_error"))


def stratified_residuals(df: DataFrame, y: str = "y", pred: str = "pred", bins: int = 5, edges: Sequence[float] | None = None) -> DataFrame:
    """(bin, low, high, n, mae, rmse, mean_bias, direction) by ranges of the target; fewer than three rows give none."""
    valid = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull() & ~F.isnan(_num(y)) & ~F.isnan(_num(pred))).select(_num(y).alias("y"), _num(pred).alias("p"))
    empty = "bin int, low double, high double, n bigint, mae double, rmse double, mean_bias double, direction string"
    top = valid.agg(F.max("y"), F.count(F.lit(1))).first()
    if top[1] < 3:
        return df.sparkSession.createDataFrame([], empty)
    if edges is None:
        edges = sorted(set(quantile_values(valid, ["y"], [i / bins for i in range(bins + 1)])["y"]))
    else:
        edges = sorted(float(v) for v in edges)
    edges[-1] = max(edges[-1], top[0] + 1e-9)
    index = F.lit(-1)
    for v in edges:
        index = index + (F.col("y") >= F.lit(v)).cast("int")
    e = F.col("p") - F.col("y")
    stats = valid.groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("mean_bias"))
    frame = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, low double, high double")
    out = frame.join(stats, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mae", "rmse", "mean_bias")])
    direction = F.when(F.col("mean_bias") > 0.1 * F.col("mae"), "over").when(F.col("mean_bias") < -0.1 * F.col("mae"), "under").otherwise("balanced")
    return out.withColumn("direction", direction).orderBy("bin")


def bland_altman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two predictions: mean difference, population SD, limits, share outside."""
    d = _num(a) - _num(b)
    row = df.agg(F.avg(d).alias("m"), F.stddev_pop(d).alias("s")).first()
    if not row.s:
        return df.sparkSession.createDataFrame([], "mean_diff double, std_diff double, loa_low double, loa_high double, n bigint, n_outside bigint, share_outside double")
    low, high = row.m - 1.96 * row.s, row.m + 1.96 * row.s
    outside = F.count_if((d < F.lit(low)) | (d > F.lit(high)))
    return df.agg(F.lit(row.m).alias("mean_diff"), F.lit(row.s).alias("std_diff"), F.lit(low).alias("loa_low"), F.lit(high).alias("loa_high"),
                  F.count(d).alias("n"), outside.alias("n_outside"), (outside / F.count(d)).alias("share_outside"))


def calibration_line(df: DataFrame, y: str = "y", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """(by..., slope, intercept, r2) of observed on predicted."""
    return df.groupBy(*by).agg(F.regr_slope(_num(y), _num(pred)).alias("slope"), F.regr_intercept(_num(y), _num(pred)).alias("intercept"),
                               F.regr_r2(_num(y), _num(pred)).alias("r2"))


# ---- classification ----------------------------------------------------------------------------

def confusion(df: DataFrame, y: str = "y", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(y).cast("string").alias("actual"), F.col(pred).cast("string").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def per_class(df: DataFrame, y: str = "y", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """(by..., label, support, precision, recall, f1) from the confusion counts."""
    cells = confusion(df, y, pred, by)
    sides = F.array(F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("called")),
                    F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("called")))
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    rows = cells.select(*by, hit.alias("hit"), F.posexplode(sides).alias("pos", "s")).select(*by, F.when(F.col("pos") == 0, F.col("hit")).otherwise(0).alias("hit"), "s.*")
    t = rows.groupBy(*by, "label").agg(F.sum("hit").alias("hit"), F.sum("support").alias("support"), F.sum("called").alias("called"))
    zero = lambda e: F.coalesce(e, F.lit(0.0))
    hits = F.col("hit").cast("double")
    return t.select(*by, "label", "support", zero(F.try_divide(hits, F.col("called"))).alias("precision"), zero(F.try_divide(hits, F.col("support"))).alias("recall"),
                    zero(F.try_divide(2 * hits, F.col("support") + F.col("called"))).alias("f1"))


def top_confusions(df: DataFrame, y: str = "y", pred: str = "pred", top: int = 5) -> DataFrame:
    return confusion(df, y, pred).where("actual <> predicted").orderBy(F.desc("n"), F.desc("actual"), F.desc("predicted")).limit(top)


PROBA_FLOOR = 2.220446049250313e-16


def class_metrics(df: DataFrame, y: str = "y", pred: str = "pred", proba: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, accuracy, f1, log_loss): weighted F1; log loss of a binary probability when given."""
    by = list(by)
    classes = per_class(df, y, pred, by)
    base = classes.groupBy(*by).agg(F.sum("support").alias("n"), (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"),
                                    (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"))
    if proba is None:
        return base
    p = F.least(F.greatest(_num(proba), F.lit(PROBA_FLOOR)), F.lit(1 - PROBA_FLOOR))
    loss = df.groupBy(*by).agg((-F.avg(_num(y) * F.log(p) + (1 - _num(y)) * F.log(1 - p))).alias("log_loss"))
    return join_groups(base, loss, by)


def score_curve(df: DataFrame, y: str = "y", score: str = "proba", by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(by..., score, pos, n, cum_pos, cum_n) from the highest score down: one row per distinct score."""
    by = list(by)
    w = F.lit(1) if weight is None else F.col(weight)
    counts = df.where(F.col(score).isNotNull()).groupBy(*by, _num(score).alias("score")).agg(F.sum(w * F.col(y).cast("int")).alias("pos"), F.sum(w).alias("n"))
    return running_totals(counts, "score", ["pos", "n"], by, descending=True)


def ranking_metrics(df: DataFrame, y: str = "y", score: str = "proba", by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(by..., auc, pr_auc) for a 0/1 target, ties handled by whole score groups."""
    by = list(by)
    c = score_curve(df, y, score, by, weight)
    pos, n, cp, cn = (F.col(k).cast("double") for k in ("pos", "n", "cum_pos", "cum_n"))
    t = c.groupBy(*by).agg(F.sum(pos).alias("p"), F.sum(n - pos).alias("m"), F.sum((n - pos) * (cp - pos / 2)).alias("wins"),
                           F.sum(F.coalesce(pos * F.try_divide(cp, cn), F.lit(0.0))).alias("ap"))
    return t.select(*by, F.try_divide(F.col("wins"), F.col("p") * F.col("m")).alias("auc"), F.try_divide(F.col("ap"), F.col("p")).alias("pr_auc"))


def auc_multiclass(df: DataFrame, y: str, scores: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., auc): mean of one-against-rest AUCs, all classes in one pass."""
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("class"), (F.col(y).cast("string") == F.lit(k)).cast("int").alias("hit"), _num(c).alias("s")) for k, c in scores.items()]))
    long = df.select(*by, cells.alias("_c")).select(*by, "_c.*")
    return ranking_metrics(long, "hit", "s", [*by, "class"]).groupBy(*by).agg(F.avg("auc").alias("auc"))


def curve_points(df: DataFrame, y: str = "y", score: str = "proba", by: Sequence[str] = ()) -> DataFrame:
    """(by..., threshold, fpr, tpr, precision): ROC and precision-recall points at every distinct score."""
    by = list(by)
    c = score_curve(df, y, score, by)
    totals = c.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("n").alias("_n"))
    joined = c.join(F.broadcast(totals), by) if by else c.withColumn("_k", F.lit(0)).join(F.broadcast(totals.withColumn("_k", F.lit(0))), "_k")
    d = lambda a, b: F.try_divide(a.cast("double"), b)
    return joined.select(*by, F.col("score").alias("threshold"), d(F.col("cum_n") - F.col("cum_pos"), F.col("_n") - F.col("_p")).alias("fpr"),
                         d(F.col("cum_pos"), F.col("_p")).alias("tpr"), d(F.col("cum_pos"), F.col("cum_n")).alias("precision"))


def calibration_bins(df: DataFrame, y: str = "y", proba: str = "proba", bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """(by..., bin, n, mean_score, observed_rate) over equal-width bins, 1.0 in the last."""
    index = F.least(F.floor(_num(proba) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(*by, index.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(_num(proba)).alias("mean_score"), F.avg(_num(y)).alias("observed_rate"))


def calibration_scores(df: DataFrame, y: str = "y", proba: str = "proba", bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """(by..., brier, ece, mce); the Brier sum rides along with the bin sums, so one scan suffices."""
    index = F.least(F.floor(_num(proba) * bins), F.lit(bins - 1)).cast("int")
    gap = _num(proba) - _num(y)
    cells = df.groupBy(*by, index.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(gap).alias("gap"), F.sum(gap * gap).alias("sq"))
    return cells.groupBy(*by).agg((F.sum("sq") / F.sum("n")).alias("brier"), (F.sum(F.col("n") * F.abs("gap")) / F.sum("n")).alias("ece"), F.max(F.abs("gap")).alias("mce"))


def recalibrate_platt(train: DataFrame, test: DataFrame, y: str = "y", proba: str = "proba") -> DataFrame:
    """Append ``calibrated``: logistic regression on the score, practically unpenalised."""
    vec = VectorAssembler(inputCols=[proba], outputCol="_v")
    model = LogisticRegression(featuresCol="_v", labelCol=y, regParam=0.0, maxIter=200, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c").fit(vec.transform(train))
    return model.transform(vec.transform(test)).withColumn("calibrated", F.get(vector_to_array("_p"), F.lit(1))).drop("_v", "_p", "_r", "_c")


def recalibrate_isotonic(train: DataFrame, test: DataFrame, y: str = "y", proba: str = "proba") -> DataFrame:
    """Append ``calibrated`` by isotonic regression, clipped outside the training range.

    Rows with equal scores are pooled before fitting, so the fit sees distinct scores with weights.
    """
    pooled = train.groupBy(_num(proba).alias("_s")).agg(F.avg(_num(y)).alias("_y"), F.count(F.lit(1)).cast("double").alias("_w"))
    vec = lambda df, c: VectorAssembler(inputCols=[c], outputCol="_v").transform(df)
    model = IsotonicRegression(featuresCol="_v", labelCol="_y", weightCol="_w", predictionCol="calibrated").fit(vec(pooled, "_s"))
    return model.transform(vec(test, proba)).drop("_v")


def decision_curve(df: DataFrame, y: str = "y", proba: str = "proba", by: Sequence[str] = ()) -> DataFrame:
    """(by..., threshold, net_benefit, treat_all, treat_none) at 0.01 .. 0.99.

    A score counts for every threshold up to its own percent step, so rows collapse to a hundred
    steps and the rest is a running total over those.
    """
    by = list(by)
    p = _num(proba)
    step = F.floor(p * 100)
    step = F.when((step + 1) * F.lit(0.01) <= p, step + 1).when(step * F.lit(0.01) > p, step - 1).otherwise(step)
    cells = df.groupBy(*by, F.least(F.greatest(step, F.lit(0)), F.lit(99)).cast("int").alias("step")).agg(F.sum(F.col(y).cast("int")).alias("pos"), F.count(F.lit(1)).alias("n"))
    totals = cells.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("n").alias("_n"))
    grid = totals.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(99))))
    # Scores under the first threshold only matter for the totals.
    filled = grid.join(cells, [*by, "step"], "left")
    back = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    tp, called = F.sum(F.coalesce("pos", F.lit(0))).over(back), F.sum(F.coalesce("n", F.lit(0))).over(back)
    t = F.col("step") * F.lit(0.01)
    odds = t / (1 - t)
    share = F.col("_p") / F.col("_n")
    return filled.select(*by, t.alias("threshold"), (tp / F.col("_n") - (called - tp) / F.col("_n") * odds).alias("net_benefit"),
                         (share - (1 - share) * odds).alias("treat_all"), F.lit(0.0).alias("treat_none"))


# ---- bootstrap ---------------------------------------------------------------------------------

def with_replicates(df: DataFrame, id_col: str, replicates: int) -> DataFrame:
    """Every row once per replicate with its Poisson weight ``w`` (0 for a row left out).

    The mix is staged in columns so that no step is evaluated twice.  Rows of weight 0 stay: a filter
    on the weight would be pushed down with all the stages written out inside it.
    """
    key = row_key(df, id_col)
    folded = F.pmod(F.pmod(key, F.lit(MODULUS)) + F.pmod(F.shiftright(key, FOLD_SHIFT), F.lit(MODULUS)) * FOLD_MULTIPLIER, F.lit(MODULUS))
    out = df.withColumn("_x", folded * START[0] + START[2]).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    out = out.withColumn("_x", (F.col("_x") + F.col("replicate").cast("bigint") * START[1]) % MODULUS)
    for offset in ROUND_OFFSETS:
        x = F.col("_x")
        out = out.withColumn("_x", ((x * x) % MODULUS + F.floor(x / ROUND_DIVISOR) * ROUND_MULTIPLIER + offset) % MODULUS)
    u = F.col("_x") / F.lit(float(MODULUS))
    weight = F.lit(0)
    for p in POISSON_CDF:
        weight = weight + (u >= F.lit(p)).cast("int")
    return out.withColumn("w", weight.cast("bigint")).drop("_x")


def _regression_from_sums(t: DataFrame, keep: Sequence[str]) -> DataFrame:
    spread = F.col("syy") - F.col("sy") * F.col("sy") / F.col("sw")
    return t.select(*keep, F.sqrt(F.col("see") / F.col("sw")).alias("rmse"), (F.col("sae") / F.col("sw")).alias("mae"), (1 - F.try_divide(F.col("see"), spread)).alias("r2"))


def bootstrap_regression(df: DataFrame, id_col: str, y: str = "y", pred: str = "pred", replicates: int = 200, by: Sequence[str] = (), centre: float = 0.0) -> DataFrame:
    """(by..., replicate, rmse, mae, r2).  ``centre`` near the mean of y keeps the sums of squares accurate."""
    by = list(by)
    e = _num(y) - _num(pred)
    c = _num(y) - F.lit(centre)
    sums = replicate_sums(df, row_key(df, id_col), [F.lit(1.0), e * e, F.abs(e), c, c * c], replicates, by).withColumnsRenamed({f"s{i}": n for i, n in enumerate(("sw", "see", "sae", "sy", "syy"))})
    return _regression_from_sums(sums, [*by, "replicate"])


def bootstrap_median_ae(df: DataFrame, id_col: str, y: str = "y", pred: str = "pred", replicates: int = 200, by: Sequence[str] = ()) -> DataFrame:
    """(by..., replicate, median_ae): weighted median of absolute errors."""
    by = list(by)
    if not by:
        values = replicate_medians(df, row_key(df, id_col), F.abs(_num(y) - _num(pred)), replicates)
        return df.sparkSession.createDataFrame([(b, None if v != v else float(v)) for b, v in enumerate(values)], "replicate int, median_ae double")
    rows = with_replicates(df.select(*by, id_col, F.abs(_num(y) - _num(pred)).alias("_a")), id_col, replicates)
    keys = [*by, "replicate"]
    cum = running_totals(rows.groupBy(*keys, "_a").agg(F.sum("w").alias("n")), "_a", ["n"], keys)
    total = cum.groupBy(*keys).agg(F.sum("n").alias("t"))
    start = F.col("cum_n") - F.col("n")
    inside = cum.join(total, keys)
    low, high = F.floor((F.col("t") - 1) / 2), F.ceil((F.col("t") - 1) / 2)
    at = lambda k: F.max(F.when((start <= k) & (k < F.col("cum_n")), F.col("_a")))
    return inside.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias("median_ae"))


def bootstrap_classification(df: DataFrame, id_col: str, y: str = "y", pred: str = "pred", replicates: int = 200, by: Sequence[str] = ()) -> DataFrame:
    """(by..., replicate, accuracy, f1): weighted confusion counts per replicate."""
    by = list(by)
    rows = df.select(*by, row_key(df, id_col).alias("_key"), F.col(y).cast("string").alias("a"), F.col(pred).cast("string").alias("p"))
    keys = [*by, "replicate"]
    cells = replicate_sums(rows, F.col("_key"), [F.lit(1.0)], replicates, [*by, "a", "p"]).select(*keys, "a", "p", F.col("s0").cast("bigint").alias("n"))
    sides = F.array(F.struct(F.col("a").alias("label"), F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("hit"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("called")),
                    F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("hit"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("called")))
    per = cells.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.*").groupBy(*keys, "label").agg(*[F.sum(c).cast("double").alias(c) for c in ("hit", "support", "called")])
    f1 = F.coalesce(F.try_divide(2 * F.col("hit"), F.col("support") + F.col("called")), F.lit(0.0))
    return per.groupBy(*keys).agg((F.sum("hit") / F.sum("support")).alias("accuracy"), (F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1"))


def bootstrap_auc(df: DataFrame, id_col: str, y: str = "y", score: str = "proba", replicates: int = 200, by: Sequence[str] = ()) -> DataFrame:
    """(by..., replicate, auc)."""
    if not by:
        values = replicate_auc(df, row_key(df, id_col), y, score, replicates)
        return df.sparkSession.createDataFrame([(b, None if v != v else float(v)) for b, v in enumerate(values)], "replicate int, auc double")
    rows = with_replicates(df.select(*by, id_col, y, score), id_col, replicates)
    return ranking_metrics(rows, y, score, [*by, "replicate"], "w").select(*by, "replicate", "auc")


def bca_interval(estimate: float, boots: Sequence[float], a: float, level: float = 0.95) -> tuple[float, float]:
    """Interval between two quantiles of the replicates, each moved by the bias and the acceleration ``a``.

    The bias is the normal score of the share of replicates below the estimate, ties counted half. Where it is infinite, or a moved
    score has passed the pole of the transform, the quantile is the end that it tends to.
    """
    b = np.array([x for x in boots if x is not None and x == x], dtype=float)
    if not len(b):
        return math.nan, math.nan
    bias = P.normal_ppf(below_share(estimate, b))

    def place(q: float) -> float:
        moved = bias + P.normal_ppf(q)
        if math.isinf(moved):
            return 0.0 if moved < 0 else 1.0
        room = 1 - a * moved
        return P.normal_cdf(bias + moved / room) if room > 0 else float(moved > 0)

    low, high = np.quantile(b, [place((1 - level) / 2), place((1 + level) / 2)])
    return float(low), float(high)


def below_share(estimate: float, boots: np.ndarray) -> float:
    """Share of replicates below the estimate, those equal to it counted half."""
    return float((np.sum(boots < estimate) + np.sum(boots == estimate) / 2) / len(boots))


def acceleration(left_out: Sequence[tuple[float, float]]) -> float:
    """From (leave-one-out value, number of rows that have it)."""
    value, n = (np.array(v, dtype=float) for v in zip(*left_out)) if left_out else (np.zeros(0), np.zeros(0))
    if not n.sum():
        return 0.0
    d = (value * n).sum() / n.sum() - value
    spread = (n * d * d).sum()
    return float((n * d ** 3).sum() / (6 * spread ** 1.5)) if spread > 0 else 0.0


def accelerations(df: DataFrame, left_out: Mapping[str, Column]) -> dict[str, float]:
    """Acceleration of each metric from its leave-one-out values of all rows, given as expressions on a row and the totals."""
    means = df.agg(*[F.avg(c).alias(m) for m, c in left_out.items()]).first()
    d = {m: F.lit(means[m]) - c for m, c in left_out.items()}
    sums = df.agg(*[F.struct(F.sum(x * x).alias("d2"), F.sum(x * x * x).alias("d3")).alias(m) for m, x in d.items()]).first()
    return {m: sums[m].d3 / (6.0 * sums[m].d2 ** 1.5) if sums[m].d2 else 0.0 for m in left_out}


def _median_left_out(df: DataFrame, value: Column) -> tuple[float, list[tuple[float, float]]]:
    """Median, and its leave-one-out values: they are means of the order statistics around the middle."""
    long = df.select(F.lit("v").alias("column"), value.cast("double").alias("value")).where("value is not null and not isnan(value)")
    n = long.count()
    if n < 2:
        return (long.first()["value"] if n else math.nan), []
    m = n // 2
    ranks = {r for r in (m - 1, m, m + 1) if 0 <= r < n}
    x = select_ranks(long, {("v",): ranks}, [])[("v",)]
    if n % 2 == 0:
        return (x[m - 1] + x[m]) / 2, [(x[m], m), (x[m - 1], m)]
    return x[m], [((x[m] + x[m + 1]) / 2, m), ((x[m - 1] + x[m + 1]) / 2, 1), ((x[m - 1] + x[m]) / 2, m)]


def _class_scores(cells: dict[tuple, float]) -> dict[str, float]:
    """Accuracy and support-weighted F1 of counts by (actual, predicted)."""
    n = sum(cells.values())
    labels = {x for pair in cells for x in pair}
    support = {v: sum(k for (a, _), k in cells.items() if a == v) for v in labels}
    called = {v: sum(k for (_, p), k in cells.items() if p == v) for v in labels}
    f1 = sum(2 * cells.get((v, v), 0) / (support[v] + called[v]) * support[v] for v in labels if support[v] + called[v])
    return {"accuracy": sum(cells.get((v, v), 0) for v in labels) / n, "f1": f1 / n}


def _class_left_out(df: DataFrame, y: str, pred: str) -> tuple[dict[str, float], dict[str, float]]:
    """Accuracy and F1, and their accelerations: every row of a cell leaves the same counts behind."""
    rows = df.groupBy(F.col(y).cast("string").alias("a"), F.col(pred).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    cells = {(r.a, r.p): r.n for r in rows}
    if sum(cells.values()) < 2:
        return (_class_scores(cells) if cells else {}), {"accuracy": 0.0, "f1": 0.0}
    without = {c: _class_scores({**cells, c: n - 1}) for c, n in cells.items()}
    return _class_scores(cells), {m: acceleration([(without[c][m], n) for c, n in cells.items()]) for m in ("accuracy", "f1")}


def _auc_left_out(df: DataFrame, y: str, score: str) -> tuple[float, float]:
    """AUC and its acceleration from placement values: a row leaves with the pairs that it wins or loses."""
    cells = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(_num(score).alias("s")).agg(F.sum(_num(y)).alias("pos"), F.count(F.lit(1)).cast("double").alias("n"))
    cells = cells.withColumn("neg", F.col("n") - F.col("pos")).select("s", "pos", "neg")
    p, n = cells.agg(F.sum("pos"), F.sum("neg")).first()
    if not p or not n or p < 2 or n < 2:
        return math.nan, 0.0
    cum = running_totals(cells, "s", ["pos", "neg"])
    won = F.col("cum_neg") - F.col("neg") / 2  # negatives below a positive
    lost = F.lit(p) - F.col("cum_pos") + F.col("pos") / 2  # positives above a negative
    pairs = cum.agg(F.sum(F.col("pos") * won)).first()[0]
    auc = pairs / (p * n)
    dp, dn = (pairs - won) / ((p - 1) * n) - F.lit(auc), (pairs - lost) / (p * (n - 1)) - F.lit(auc)
    m = cum.agg(*[F.sum(F.col("pos") * dp ** k + F.col("neg") * dn ** k).alias(f"m{k}") for k in (1, 2, 3)]).first()
    total = p + n
    mean = m.m1 / total
    spread = m.m2 - total * mean ** 2
    third = -(m.m3 - 3 * mean * m.m2 + 2 * total * mean ** 3)
    return auc, (third / (6 * spread ** 1.5) if spread > 0 else 0.0)


def bootstrap_intervals(df: DataFrame, id_col: str, y: str = "y", pred: str = "pred", replicates: int = 1000, level: float = 0.95, task: str = "regression", score: str | None = None) -> DataFrame:
    """(metric, estimate, ci_lower, ci_upper, below, acceleration): rmse, mae, r2, median_ae; for classes accuracy, f1, and auc where ``score`` is given (0/1 classes).

    below is the share of replicates below the estimate. The acceleration uses the leave-one-out values of all rows, none of which is refitted:
    they are totals minus a row, order statistics next to the median, cells less one, and placement values.
    """
    if task == "regression":
        estimate, bend, boots = _regression_parts(df, id_col, y, pred, replicates)
    else:
        estimate, bend = _class_left_out(df, y, pred)
        table = bootstrap_classification(df, id_col, y, pred, replicates).collect()
        boots = {m: [r[m] for r in table] for m in ("accuracy", "f1")}
        if score is not None:
            estimate["auc"], bend["auc"] = _auc_left_out(df, y, score)
            boots["auc"] = list(replicate_auc(df, row_key(df, id_col), y, score, replicates))
    rows = []
    for m, value in estimate.items():
        known = np.array([b for b in boots[m] if b is not None and b == b], dtype=float)
        rows.append((m, float(value), *bca_interval(value, known, bend[m], level), below_share(value, known) if len(known) else None, float(bend[m])))
    return df.sparkSession.createDataFrame(rows, "metric string, estimate double, ci_lower double, ci_upper double, below double, acceleration double")


def _regression_parts(df: DataFrame, id_col: str, y: str, pred: str, replicates: int) -> tuple[dict, dict, dict]:
    """Estimates, accelerations and replicate values of the regression metrics."""
    df = df.where(_num(y).isNotNull() & _num(pred).isNotNull())
    n_y = df.agg(F.avg(_num(y))).first()[0] or 0.0
    e, c = _num(y) - _num(pred), _num(y) - F.lit(n_y)
    t = df.agg(F.count(e).alias("n"), F.sum(e * e).alias("see"), F.sum(F.abs(e)).alias("sae"), F.sum(c).alias("sy"), F.sum(c * c).alias("syy")).first()
    if not t.n:
        return {}, {}, {}
    spread = t.syy - t.sy * t.sy / t.n
    estimate = {"rmse": math.sqrt(t.see / t.n), "mae": t.sae / t.n, "r2": 1 - t.see / spread if spread else math.nan}
    n1, see = F.lit(float(max(t.n - 1, 1))), F.lit(t.see) - e * e
    bend = accelerations(df, {"rmse": F.sqrt(F.greatest(see, F.lit(0.0)) / n1), "mae": (F.lit(t.sae) - F.abs(e)) / n1,
                              "r2": 1 - F.try_divide(see, F.lit(t.syy) - c * c - (F.lit(t.sy) - c) * (F.lit(t.sy) - c) / n1)})
    estimate["median_ae"], left_out = _median_left_out(df, F.abs(e))
    bend["median_ae"] = acceleration(left_out)
    table = bootstrap_regression(df, id_col, y, pred, replicates, centre=n_y).collect()
    boots = {m: [r[m] for r in table] for m in ("rmse", "mae", "r2")}
    boots["median_ae"] = list(replicate_medians(df, row_key(df, id_col), F.abs(e), replicates))
    return estimate, bend, boots


def percentile_intervals(boots: DataFrame, metrics: Sequence[str], by: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """(by..., metric, ci_lower, ci_upper) from a replicate table; any aggregate metric can be used."""
    tail = (1 - level) / 2
    q = exact_quantiles(boots, list(metrics), [tail, 1 - tail], list(by))
    return q.select(*by, F.col("column").alias("metric"), F.get("q", F.lit(0)).alias("ci_lower"), F.get("q", F.lit(1)).alias("ci_upper"))


def bootstrap_metric(df: DataFrame, id_col: str, metric: Callable[[Column, Column, Column], Column], y: str = "y", pred: str = "pred",
                     replicates: int = 200, by: Sequence[str] = ()) -> DataFrame:
    """(by..., replicate, metric) for a user metric written as an aggregate expression of (y, pred, weight)."""
    rows = with_replicates(df.select(*by, id_col, _num(y).alias("_y"), _num(pred).alias("_p")), id_col, replicates)
    return rows.groupBy(*by, "replicate").agg(metric(F.col("_y"), F.col("_p"), F.col("w")).alias("metric"))


def subgroups(df: DataFrame, id_col: str, group: str, y: str = "y", pred: str = "pred", replicates: int = 200, level: float = 0.95, least: int = 5) -> DataFrame:
    """(subgroup, n, rmse, ci_lower, ci_upper) overall and per group of at least five rows."""
    tags = F.array_compact(F.array(F.lit("Overall"), F.col(group).cast("string")))
    work = df.select(F.explode(tags).alias("subgroup"), id_col, y, pred)
    e = _num(y) - _num(pred)
    base = work.groupBy("subgroup").agg(F.count(e).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse")).where(F.col("n") >= least)
    intervals = percentile_intervals(bootstrap_regression(work, id_col, y, pred, replicates, ["subgroup"]), ["rmse"], ["subgroup"], level)
    return base.join(intervals.drop("metric"), "subgroup")


# ---- comparing models --------------------------------------------------------------------------

# How easily a model is read (0 best), used to prefer simpler models.
READABILITY = {"glm": 0, "ols": 0, "logit": 0, "ridge": 0, "lasso": 0, "elasticnet": 0, "logreg": 0, "huber": 0, "lda": 0, "gnb": 1, "rf": 1, "knn": 1, "linear_svc": 1,
               "gbt": 2, "mlp": 2}


def _readability() -> Column:
    level = F.lit(1)
    for m, v in READABILITY.items():
        level = F.when(F.lower("model") == m, v).otherwise(level)
    return level


def leaderboard(metrics: DataFrame, metric: str = "rmse", lower_is_better: bool = True, tolerance: float = 0.05) -> DataFrame:
    """Metrics in order, with rank, gap to the best, spread, and the simplest model within 5% of the best.

    One row per model, so the whole-table windows are a few rows long.
    """
    everything = Window.partitionBy(F.lit(0))
    value = F.col(metric) if lower_is_better else -F.col(metric)
    best = (F.min if lower_is_better else F.max)(metric).over(everything)
    worst = (F.max if lower_is_better else F.min)(metric).over(everything)
    near = F.col(metric) <= F.col("best") * (1 + tolerance) if lower_is_better else F.col(metric) >= F.col("best") * (1 - tolerance)
    out = metrics.withColumns({"best": best, "spread": F.abs(worst - best), "rank": F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(value.asc(), F.col("model")))})
    out = out.withColumn("competitive", near).withColumn("_l", _readability())
    first = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("competitive"), "_l", "rank"))
    return out.withColumn("simplest", first == 1).drop("_l").orderBy("rank")


def paired_cv(scores: DataFrame) -> DataFrame:
    """(model_a, model_b, n, mean_delta, statistic, p): paired t over folds for every two models.

    ``scores`` has (model, fold, score): folds times models rows.
    """
    a, b = scores.alias("a"), scores.alias("b")
    pairs = a.join(b, (F.col("a.fold") == F.col("b.fold")) & (F.col("a.model") < F.col("b.model"))).select(
        F.col("a.model").alias("model_a"), F.col("b.model").alias("model_b"), (F.col("a.score") - F.col("b.score")).alias("d"))
    t = pairs.groupBy("model_a", "model_b").agg(F.count("d").alias("n"), F.avg("d").alias("mean_delta"), F.stddev_samp("d").alias("s"))
    stat = F.try_divide(F.col("mean_delta") * F.sqrt("n"), F.col("s"))
    return t.where("n >= 2").select("model_a", "model_b", "n", "mean_delta", stat.alias("statistic"), P.p_t(stat, F.col("n") - 1).alias("p"))


def rank_agreement(importance: DataFrame, top: int = 5) -> DataFrame:
    """(model_a, model_b, n_features, spearman, top_overlap) from (model, feature, importance)."""
    per = Window.partitionBy("model")
    tied = F.count(F.lit(1)).over(Window.partitionBy("model", "importance"))
    ranked = importance.withColumn("r", F.rank().over(per.orderBy("importance")) + (tied - 1) / 2).withColumn("t", F.row_number().over(per.orderBy(F.desc("importance"), "feature")) <= top)
    a, b = ranked.alias("a"), ranked.alias("b")
    pairs = a.join(b, (F.col("a.feature") == F.col("b.feature")) & (F.col("a.model") < F.col("b.model")))
    return pairs.groupBy(F.col("a.model").alias("model_a"), F.col("b.model").alias("model_b")).agg(
        F.count(F.lit(1)).alias("n_features"), F.corr("a.r", "b.r").alias("spearman"), F.count_if(F.col("a.t") & F.col("b.t")).alias("top_overlap"))


def diagnose(metrics: DataFrame, task: str = "regression", tolerance: float = 0.05, gap: float = 0.10) -> DataFrame:
    """Finding rows (id, severity, model, value, threshold) over (model, rmse|f1, r2|auc, train_score, test_score, cv_std)."""
    lower = task == "regression"
    main, quality, floor = ("rmse", "r2", 0.15) if lower else ("f1", "auc", 0.60)
    level = _readability()
    pick = F.min_by if lower else F.max_by
    t = metrics.withColumn("_l", level).agg(
        (F.min if lower else F.max)(F.when(F.col("_l") == 0, F.col(main))).alias("simple"), (F.min if lower else F.max)(F.when(F.col("_l") == 2, F.col(main))).alias("complex"),
        pick("model", F.when(F.col("_l") == 0, F.col(main))).alias("simple_model"), F.max(quality).alias("quality"), F.max("cv_std").alias("cv"),
        (F.max(main) - F.min(main)).alias("spread"), F.count(main).alias("k"))
    margin = F.abs(F.col("simple") - F.col("complex")) / F.col("complex")
    near = F.col("simple") <= F.col("complex") * (1 + tolerance) if lower else F.col("simple") >= F.col("complex") * (1 - tolerance)
    usable = F.col("quality") >= 0 if lower else F.col("quality") > 0
    row = lambda ok, id_, severity, model, value, limit: F.when(ok, F.struct(
        F.lit(id_).alias("id"), F.lit(severity).alias("severity"), model.cast("string").alias("model"), value.cast("double").alias("value"), limit.cast("double").alias("threshold")))
    rules = F.array(row(near, "prefer_simpler", "warning", F.col("simple_model"), margin, F.lit(tolerance)),
                    row(usable & (F.col("quality") < floor), "low_performance", "opportunity", F.lit(None), F.col("quality"), F.lit(floor)),
                    row((F.col("k") >= 2) & (F.col("spread") > 0) & (F.col("cv") >= 0.5 * F.col("spread")), "cv_variance", "info", F.lit(None), F.col("cv"), 0.5 * F.col("spread")))
    overall = t.select(F.inline(F.filter(rules, lambda x: x.isNotNull())))
    fit_gap = F.col("train_score") - F.col("test_score")
    over = metrics.where(fit_gap > gap).select(F.lit("overfit").alias("id"), F.lit("warning").alias("severity"), "model", fit_gap.cast("double").alias("value"), F.lit(float(gap)).alias("threshold"))
    return overall.unionByName(over)
