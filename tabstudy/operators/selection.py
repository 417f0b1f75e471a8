"""Feature selection.  Linear paths and resampling run on cross-product matrices from one scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.gram import covariance, grams, lasso, means_of, solve_ols, squared_error
from ..functions.hashing import mix, mixed, row_key
from ..functions.logistic import logistic_fits
from ..functions.storage import written
from . import hypothesis as H
from .columns import numeric_names, per_column
from .features import standardised
from .relations import median_filled
from .splits import hash_folds

HIGH_MISSING = 0.20


def prepare(df: DataFrame, target: str, features: Sequence[str], keep: Sequence[str] = ()) -> tuple[DataFrame, list[str], DataFrame]:
    """(rows with target and median-filled numeric features, names, flags of columns over 20% missing)."""
    names = [c for c in numeric_names(df, list(features)) if c != target]
    rate = F.avg
    flags = per_column(df.where(F.col(target).isNotNull()), names, lambda c: [rate(F.col(c).isNull().cast("double")).alias("missing_rate")])
    return median_filled(df, names, target, keep), names, flags.withColumn("flagged", F.col("missing_rate") > HIGH_MISSING)


def _scaled(df: DataFrame, target: str, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    frame = df.where(F.col(target).isNotNull())
    out = standardised(frame, names, [*keep, F.col(target).cast("double").alias(target)])
    return out


def _parts(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    c = covariance(g)
    return c[:-1, :-1], c[:-1, -1], g[0, 1:] / g[0, 0]


def lasso_path(df: DataFrame, target: str, features: Sequence[str], id_col: str, penalties: int = 30, folds: int = 5, seed: int = 42) -> DataFrame:
    """(penalty, feature, coefficient, cv_error, best, selected) along log-spaced penalties.

    Cross products per fold are gathered in one scan; the training matrix of a fold is the total
    minus its own, so the whole cross-validated path costs no further pass.
    """
    names = list(features)
    work = _scaled(df, target, names, [id_col])
    names = [c for c in work.columns if c not in (id_col, target)]
    per_fold = grams(hash_folds(work, folds, id_col, seed), [*names, target], [0.0] * len(names) + [float(means_of(work, [target])[0])], "fold")
    total = sum(per_fold.values())
    cov, xy, _ = _parts(total)
    top = float(np.max(np.abs(xy))) or 1.0
    grid = np.logspace(np.log10(top), np.log10(top * 1e-3), penalties)
    errors = np.zeros(penalties)
    for g in per_fold.values():
        c, v, mean = _parts(total - g)
        beta = None
        for i, lam in enumerate(grid):
            beta = lasso(c, v, lam, beta)
            errors[i] += squared_error(g, np.concatenate([[mean[-1] - mean[:-1] @ beta], beta]))
    errors /= total[0, 0]
    best = int(np.argmin(errors))
    rows, beta = [], None
    for i, lam in enumerate(grid):
        beta = lasso(cov, xy, lam, beta)
        rows += [(float(lam), c, float(b), float(errors[i]), i == best, bool(i == best and abs(b) > 1e-10)) for c, b in zip(names, beta)]
    return df.sparkSession.createDataFrame(rows, "penalty double, feature string, coefficient double, cv_error double, best boolean, selected boolean")


def _classes(df: DataFrame, target: str, names: Sequence[str], id_col: str) -> tuple[DataFrame, list[str], list]:
    """Written table of (id, target as 0/1, standardised features), the names that vary, and both classes in order."""
    labels = sorted(r[0] for r in df.where(F.col(target).isNotNull()).select(target).distinct().limit(3).collect())
    if len(labels) != 2:
        raise ValueError(f"{target} has {'more than two classes' if len(labels) > 2 else 'one class'}; pass one class against the rest as 0 and 1")
    coded = df.where(F.col(target).isNotNull()).withColumn(target, (F.col(target) == F.lit(labels[1])).cast("int"))
    work = _scaled(coded, target, list(names), [id_col])
    return work, [c for c in work.columns if c not in (id_col, target)], labels


def lasso_class_path(df: DataFrame, target: str, features: Sequence[str], id_col: str, penalties: int = 30, folds: int = 5, seed: int = 42) -> DataFrame:
    """(penalty, feature, coefficient, cv_error, best, selected) of logistic fits along log-spaced L1 penalties of the mean log loss.

    ``target`` has two classes; cv_error is the mean log loss on the folds left out. All folds and penalties take their steps from the same scans.
    """
    work, names, _ = _classes(df, target, features, id_col)
    work, _path = written(hash_folds(work, folds, id_col, seed), "class_rows")
    mean = means_of(work, [target])[0]
    g = grams(work, [*names, target], [0.0] * len(names) + [float(mean)])[None]
    top = float(np.max(np.abs(g[1:-1, -1] / max(g[0, 0], 1.0)), initial=0.0)) or 1.0
    grid = np.logspace(np.log10(top), np.log10(top * 1e-3), penalties)
    uses = np.vstack([np.ones((1, folds), dtype=bool), ~np.eye(folds, dtype=bool)])
    start = np.zeros(((folds + 1) * penalties, len(names) + 1))
    start[:, 0] = np.log(mean / (1 - mean))
    fits = logistic_fits(work, names, target, "fold", np.repeat(uses, penalties, axis=0), np.tile(grid, folds + 1), np.zeros((folds + 1) * penalties), start=start)
    sizes = {r.fold: r.n for r in work.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    weights = np.array([sizes.get(f, 0) for f in range(folds)], dtype=float)
    losses = np.nan_to_num(fits.held_out_loss[penalties:].reshape(folds, penalties))
    errors = weights @ losses / weights.sum()
    best = int(np.argmin(errors))
    beta = fits.coefficients[:penalties, 1:]
    rows = [(float(lam), c, float(b), float(errors[i]), i == best, bool(i == best and abs(b) > 1e-10)) for i, lam in enumerate(grid) for c, b in zip(names, beta[i])]
    return df.sparkSession.createDataFrame(rows, "penalty double, feature string, coefficient double, cv_error double, best boolean, selected boolean")


def eliminate_classes(df: DataFrame, target: str, features: Sequence[str], id_col: str, folds: int = 5, seed: int = 42, ridge: float = 1.0) -> DataFrame:
    """As ``recursive_elimination`` for two classes: logistic fits with a ridge penalty on the summed loss, the fold error is the mean log loss."""
    work, names, _ = _classes(df, target, features, id_col)
    work, _path = written(hash_folds(work, folds, id_col, seed), "class_rows")
    sizes = {r.fold: r.n for r in work.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    weights = np.array([sizes.get(f, 0) for f in range(folds)], dtype=float)
    uses = np.vstack([np.ones((1, folds), dtype=bool), ~np.eye(folds, dtype=bool)])
    penalty = ridge / np.maximum(uses @ weights, 1.0)
    left, history, start = list(range(len(names))), [], None
    while left:
        free = np.zeros((folds + 1, len(names)), dtype=bool)
        free[:, left] = True
        fits = logistic_fits(work, names, target, "fold", uses, np.zeros(folds + 1), penalty, free, start)
        error = float(np.nan_to_num(fits.held_out_loss[1:]) @ weights / weights.sum())
        weakest = min(left, key=lambda f: abs(fits.coefficients[0, f + 1]))
        history.append((weakest, error, list(left)))
        left.remove(weakest)
        start = fits.coefficients.copy()
        start[:, weakest + 1] = 0.0
    return _elimination_table(df, names, history)


def recursive_elimination(df: DataFrame, target: str, features: Sequence[str], id_col: str, folds: int = 5, seed: int = 42, ridge: float = 1.0) -> DataFrame:
    """(feature, rank, cv_error, selected): drop the smallest coefficient again and again; rank 1 features are kept.

    ``cv_error`` is the fold error of the model whose weakest feature this was.
    """
    work = _scaled(df, target, list(features), [id_col])
    names = [c for c in work.columns if c not in (id_col, target)]
    per_fold = grams(hash_folds(work, folds, id_col, seed), [*names, target], [0.0] * len(names) + [float(means_of(work, [target])[0])], "fold")
    total = sum(per_fold.values())
    left, history = list(range(len(names))), []
    while left:
        pick = [0, *[i + 1 for i in left], len(names) + 1]
        sub = lambda m: m[np.ix_(pick, pick)]
        error = sum(squared_error(sub(g), solve_ols(sub(total - g), ridge)) for g in per_fold.values()) / total[0, 0]
        beta = solve_ols(sub(total), ridge)[1:]
        weakest = left[int(np.argmin(np.abs(beta)))]
        history.append((weakest, float(error), list(left)))
        left.remove(weakest)
    return _elimination_table(df, names, history)


def _elimination_table(df: DataFrame, names: Sequence[str], history: list[tuple[int, float, list[int]]]) -> DataFrame:
    best = min(history, key=lambda h: (h[1], len(h[2])))[2]
    dropped = [h[0] for h in history]
    rows = [(names[f], 1 if f in best else len(names) - dropped.index(f) - len(best) + 1, history[dropped.index(f)][1], f in best) for f in range(len(names))]
    return df.sparkSession.createDataFrame(rows, "feature string, rank int, cv_error double, selected boolean")


def univariate(df: DataFrame, target: str, features: Sequence[str], task: str = "regression", correction: str = "bh", alpha: float = 0.05) -> DataFrame:
    """(feature, statistic, p, p_adjusted, rejected): linear correlation for numbers, rank correlation for classes."""
    from ..functions.pvalues import p_corr

    names = [c for c in numeric_names(df, list(features)) if c != target]
    if task == "regression":
        table = per_column(df, names, lambda c: [F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias("r"), F.count(F.when(F.col(target).isNotNull(), F.col(c))).alias("n")])
        table = table.withColumnRenamed("column", "feature")
    else:
        table = H.rank_correlations(df, [(c, target) for c in names]).withColumnRenamed("a", "feature")
    scored = table.select("feature", F.coalesce(F.abs("r"), F.lit(0.0)).alias("statistic"), F.coalesce(p_corr(F.col("r"), F.col("n")), F.lit(1.0)).alias("p"))
    return H.adjust_bh(scored, alpha=alpha) if correction == "bh" else H.adjust_bonferroni(scored, alpha=alpha)


def _halves(buckets: int, rounds: int, seed: int) -> np.ndarray:
    """(rounds x buckets): which buckets each half sample takes, by the portable hash."""
    return np.array([[mixed(b, r + seed) % 2 == 1 for b in range(buckets)] for r in range(rounds)])


def stability(df: DataFrame, target: str, features: Sequence[str], id_col: str, rounds: int = 100, threshold: float = 0.6, penalty: float = 0.01, seed: int = 42, task: str = "regression", buckets: int = 1024) -> DataFrame:
    """(feature, probability, selected): how often L1 keeps a feature on half samples of the hash buckets that rows fall in.

    One scan sums a matrix for each bucket; a half sample is the sum of its buckets' matrices. For two classes each scan gives all half
    samples their Newton step. ``penalty`` is that of the mean squared error halved, or of the mean log loss.
    """
    if task == "regression":
        work = _scaled(df, target, list(features), [id_col])
        names = [c for c in work.columns if c not in (id_col, target)]
    else:
        work, names, _ = _classes(df, target, features, id_col)
    work = work.withColumn("_bucket", (mix(row_key(work, id_col), seed) % buckets).cast("int"))
    halves = _halves(buckets, rounds, seed)
    if task == "regression":
        shift = [0.0] * len(names) + [float(means_of(work, [target])[0])]
        cells = grams(work, [*names, target], shift, "_bucket")
        hits = np.zeros(len(names))
        for half in halves:
            own = [g for b, g in cells.items() if half[b]]
            if own:
                cov, xy, _ = _parts(sum(own))
                hits += np.abs(lasso(cov, xy, penalty)) > 1e-10
    else:
        table, _path = written(work, "class_rows")
        fits = logistic_fits(table, names, target, "_bucket", halves, np.full(rounds, penalty), np.zeros(rounds))
        hits = (np.abs(fits.coefficients[:, 1:]) > 1e-10).sum(axis=0)
    rows = [(c, float(h / rounds), bool(h / rounds >= threshold)) for c, h in zip(names, hits)]
    return df.sparkSession.createDataFrame(rows, "feature string, probability double, selected boolean")


def consensus(selections: Mapping[str, DataFrame], least: int = 2) -> DataFrame:
    """(feature, methods, n, chosen) from tables of selected features (one column ``feature``)."""
    rows = None
    for name, table in selections.items():
        one = table.select("feature", F.lit(name).alias("method")).distinct()
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("feature").agg(F.array_join(F.array_sort(F.collect_list("method")), ", ").alias("methods"), F.count(F.lit(1)).alias("n")).withColumn("chosen", F.col("n") >= least)
