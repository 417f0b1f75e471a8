"""Relations between columns, and diagnostics to run before any model."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.gram import covariance, doubles, grams, means_of, pairwise_correlations, solve_ols
from ..functions.pvalues import normal_ppf
from ..functions.quantiles import exact_quantiles, quantile_values
from ..functions.storage import written
from . import features as FE
from . import hypothesis as H
from .audit import box_by_tertile, box_summary
from .columns import is_categorical, is_numeric, numeric_names, per_column


def _d(c: str) -> Column:
    return F.col(c).cast("double")


# ---- correlation -------------------------------------------------------------------------------

def correlations(df: DataFrame, cols: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """(a, b, r, n) for every pair, on rows complete in that pair: one scan whatever the number of columns."""
    cols = list(cols or numeric_names(df))
    if method == "spearman":
        return H.rank_correlations(df, list(combinations(cols, 2)))
    r, n = pairwise_correlations(df, cols)
    rows = [(a, b, None if np.isnan(r[i, j]) else float(r[i, j]), int(n[i, j])) for (i, a), (j, b) in combinations(enumerate(cols), 2)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double, n long")


def top_pairs(table: DataFrame, top: int | None = None, threshold: float | None = None) -> DataFrame:
    """Strongest pairs first, by count or above a threshold."""
    strong = table.where(F.abs("r") > threshold) if threshold is not None else table.where("r is not null")
    ordered = strong.orderBy(F.desc(F.abs("r")), "a", "b")
    return ordered.limit(top) if top else ordered


def target_correlations(df: DataFrame, target: str, features: Sequence[str], top: int | None = None) -> DataFrame:
    """(feature, r, strength) by falling strength."""
    cols = [c for c in numeric_names(df, list(features)) if c != target]
    table = per_column(df, cols, lambda c: [F.corr(_d(c), _d(target)).alias("r")]).select(F.col("column").alias("feature"), "r", F.abs("r").alias("strength"))
    ordered = table.where("r is not null").orderBy(F.desc("strength"), "feature")
    return ordered.limit(top) if top else ordered


def leakage(df: DataFrame, target: str, features: Sequence[str], threshold: float = 0.95) -> DataFrame:
    return target_correlations(df, target, features).where(F.col("strength") > threshold)


def linearity(df: DataFrame, target: str, features: Sequence[str], top: int | None = 6) -> DataFrame:
    """(feature, test, statistic, n, p): rank or linear correlation of the ``top`` strongest features (None: all), by the target's normality."""
    rows, _path = written(df.select(*dict.fromkeys([target, *features])), "linearity")  # several scans: of the columns at hand, not of what made the table
    names = [r.feature for r in target_correlations(rows, target, features, top).collect()]
    out = ["feature", "test", "statistic", "n", "p"]
    if H.normality(rows, target).first().normal:
        return H.union_tests([H.pearson(rows, c, target).select(F.lit(c).alias("feature"), *out[1:]) for c in names])
    # Features without nulls, where the target has none either, share one table of the target's values; the others are ranked on their own complete rows.
    found = rows.agg(F.count(F.lit(1)), F.count(target), *[F.count(c) for c in names]).first()
    full = [c for i, c in enumerate(names) if found[0] == found[1] == found[2 + i]]
    tests = [H.rank_tests(rows, full, target).withColumnRenamed("column", "feature").select(*out)] if full else []
    tests += [H.spearman(rows, c, target).select(F.lit(c).alias("feature"), *out[1:]) for c in names if c not in full]
    place = F.array_position(F.array(*[F.lit(c) for c in names]), F.col("feature"))
    return H.union_tests(tests).orderBy(place)


# ---- binned information ------------------------------------------------------------------------

def _edges(df: DataFrame, cols: Sequence[str], bins: int) -> dict[str, list[float]]:
    q = quantile_values(df, cols, [i / bins for i in range(1, bins)])
    return {c: sorted({v for v in vs if v is not None}) for c, vs in q.items()}


def _right_closed(v: Column, edges: Sequence[float]) -> Column:
    index = F.lit(0)
    for e in edges:
        index = index + (v > F.lit(float(e))).cast("int")
    return F.when(v.isNotNull(), index)


CLASSES = 4096  # classes whose counts a task holds at once


def _information(df: DataFrame, values: dict[str, Column], edges: dict[str, Sequence[float]], label: Column, label_edges: Sequence[float] | None = None) -> DataFrame:
    """(feature, mi) from one grouping by (feature, bin, class), with bins closed on the right; classes are labels, or their bins where edges are given."""
    names = list(values)
    cuts = [np.array(edges[c], dtype=float) for c in names]
    width = max((len(e) for e in cuts), default=0) + 1
    kind = "int" if label_edges is not None else "string"

    def count(batches):
        held: dict = {}

        def out():
            n = np.stack(list(held.values()))
            k, j, bin_ = np.nonzero(n)
            classes = pa.array(list(held), of.type).take(pa.array(k))
            return pa.RecordBatch.from_arrays([pa.array(j.astype(np.int32)), pa.array(bin_.astype(np.int32)), classes, pa.array(n[k, j, bin_])], ["at", "bin", "class", "n"])

        for batch in batches:
            y = batch.column(0)
            if label_edges is not None:
                y = pa.array(np.searchsorted(label_edges, y.to_numpy(zero_copy_only=False), "left").astype(np.int32))
            codes = y.dictionary_encode()
            of, at = codes.dictionary, codes.indices.to_numpy(zero_copy_only=False)
            n = np.zeros((len(of), len(cuts), width), dtype=np.int64)
            for j, e in enumerate(cuts):
                v = batch.column(1 + j)
                there = v.is_valid().to_numpy(zero_copy_only=False)
                cell = at[there] * width + np.searchsorted(e, v.to_numpy(zero_copy_only=False)[there], "left")
                n[:, j] = np.bincount(cell, minlength=len(of) * width).reshape(len(of), width)
            for c, m in zip(of.to_pylist(), n):
                held[c] = held[c] + m if c in held else m
            if len(held) > CLASSES:
                yield out()
                held.clear()
        if held:
            yield out()

    rows = df.select(label.cast("double" if label_edges is not None else "string").alias("class"), *[v.cast("double").alias(f"_{j}") for j, v in enumerate(values.values())]).where("class is not null")
    counts = rows.mapInArrow(count, f"at int, bin int, class {kind}, n bigint").groupBy("at", "bin", "class").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("feature", F.get(F.array(*[F.lit(c) for c in names]), F.col("at")))
    # The table of bin-by-class counts is tiny; margins come from windows over it.
    whole, rows, cols = (F.sum("n").over(Window.partitionBy("feature", *k)).cast("double") for k in ((), ("bin",), ("class",)))
    n = F.col("n").cast("double")
    terms = counts.select("feature", (n / whole * F.log(n * whole / (rows * cols))).alias("t"))
    return terms.groupBy("feature").agg(F.sum("t").alias("mi"))


def mutual_information(df: DataFrame, target: str, features: Sequence[str], task: str = "classification", bins: int = 10, top: int | None = None) -> DataFrame:
    """(feature, mi) in nats between quantile bins of each feature and the target, over all rows."""
    edges = _edges(df, list(features), bins)
    table = _information(df, {c: F.col(c) for c in features}, edges, F.col(target), None if task == "classification" else _edges(df, [target], bins)[target])
    ordered = table.orderBy(F.desc("mi"), "feature")
    return ordered.limit(top) if top else ordered


def interactions(df: DataFrame, target: str, features: Sequence[str], task: str = "regression", singles: int | None = 10, top: int | None = 5, bins: int = 10) -> DataFrame:
    """(a, b, gain): product features that tell more about the target than the better of the two.

    Products are made of the ``singles`` most telling features, and the ``top`` best are returned; None takes all.
    """
    # Quantiles take many scans: of the columns at hand, not of what made the table; the target's are found along with the features'.
    rows, _path = written(df.select(*dict.fromkeys([target, *features])), "interactions")
    edges = _edges(rows, list(dict.fromkeys([*features, *([] if task == "classification" else [target])])), bins)
    label = (F.col(target), None if task == "classification" else edges[target])
    table = _information(rows, {c: F.col(c) for c in features}, edges, *label).orderBy(F.desc("mi"), "feature")
    single = {r.feature: r.mi for r in (table.limit(singles) if singles else table).collect()}
    pairs = list(combinations(single, 2))
    products = rows.select(target, *[(_d(a) * _d(b)).alias(f"{a}|{b}") for a, b in pairs])
    cuts = _edges(products, [f"{a}|{b}" for a, b in pairs], bins)
    table = _information(products, {c: F.col(f"`{c}`") for c in cuts}, cuts, *label)
    base = df.sparkSession.createDataFrame([(f"{a}|{b}", a, b, max(single[a], single[b])) for a, b in pairs], "feature string, a string, b string, best double")
    return table.join(F.broadcast(base), "feature").select("a", "b", (F.col("mi") - F.col("best")).alias("gain")).where("gain > 0").orderBy(F.desc("gain"), "a", "b").limit(top if top is not None else max(1, len(pairs)))


def dose_response(df: DataFrame, target: str, features: Sequence[str], top: int | None = 5, bins: int = 10, least: int = 30) -> DataFrame:
    """(feature, bin, low, high, middle, n, mean_target) over quantile bins of the ``top`` strongest features (None: all) with at least ``least`` values."""
    names = [r.feature for r in target_correlations(df, target, features, top).collect()]
    rows = {r["column"]: (r["n"], list(r["q"])) for r in exact_quantiles(df, names, [i / bins for i in range(bins + 1)]).collect()}
    edges = {c: sorted(set(q)) for c, (n, q) in rows.items() if n >= least and len(set(q)) > 1}
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), _right_closed(F.col(c), e[1:-1]).alias("bin")) for c, e in edges.items()]))
    stats = df.select(cells.alias("_c"), _d(target).alias("y")).select("_c.*", "y").where("bin is not null").groupBy("feature", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_target"))
    frame = df.sparkSession.createDataFrame([(c, i, a, b, (a + b) / 2) for c, e in edges.items() for i, (a, b) in enumerate(zip(e, e[1:]))],
                                            "feature string, bin int, low double, high double, middle double")
    return frame.join(stats, ["feature", "bin"]).select("feature", "bin", "low", "high", "middle", "n", "mean_target").orderBy("feature", "bin")


# Name parts of demographic columns.
DEMOGRAPHIC_NAMES = ("age", "sex", "gender", "bmi")


def by_demographics(df: DataFrame, target: str, cols: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """(column, group, n, min, q25, median, q75, max) of the target by category or tertile of demographic columns."""
    found = list(cols or [c for c in df.columns if any(k in c.lower() for k in DEMOGRAPHIC_NAMES) and (is_numeric(df, c) or is_categorical(df, c))])
    out = None
    for c in found[:limit]:
        table = (box_summary(df, target, c) if is_categorical(df, c) else box_by_tertile(df, target, c)).select(F.lit(c).alias("column"), "*")
        out = table if out is None else out.unionByName(table)
    return out


# ---- least squares -----------------------------------------------------------------------------

def median_filled(df: DataFrame, cols: Sequence[str], target: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    medians = quantile_values(df, list(cols), [0.5])
    rows = df.where(F.col(target).isNotNull()) if target else df
    filled = [F.coalesce(_d(c), F.lit(medians[c][0])).alias(c) for c in cols]
    return rows.select(*keep, *filled, *([_d(target).alias(target)] if target else []))


def ols(df: DataFrame, target: str, cols: Sequence[str], keep: Sequence[str] = ()):
    """(rows with fitted and residual, coefficients, shifts, cross products): one scan for the fit."""
    work = median_filled(df, cols, target, keep)
    shift = means_of(work, [*cols, target])
    g = grams(work, [*cols, target], shift)[None]
    beta = solve_ols(g)
    fitted = F.lit(float(beta[0] + shift[-1]))
    for b, c, s in zip(beta[1:], cols, shift):
        fitted = fitted + F.lit(float(b)) * (F.col(c) - F.lit(float(s)))
    rows = work.withColumn("fitted", fitted)
    return rows.withColumn("residual", F.col(target) - F.col("fitted")), beta, shift, g


def ols_residuals(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """Residual summary of a least-squares fit on median-imputed columns."""
    from .evaluate import residuals

    rows, *_ = ols(df, target, cols)
    return residuals(rows, target, "fitted", extended=True)


def influence(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """One row: largest leverage and Cook's distance, and how many rows pass 2k/n and 1.

    Leverage is a quadratic form in a small fixed matrix, evaluated row by row.
    """
    rows, _, shift, g = ols(df, target, cols)
    inverse, own = np.linalg.pinv(g[:-1, :-1]), np.array(shift[:len(cols)], dtype=float)
    k, n = len(cols) + 1, float(g[0, 0])

    def leverage(batches):
        for batch in batches:
            for part, x in doubles(batch):
                z = np.column_stack([np.ones(len(x)), x[:, 1:] - own])
                yield pa.RecordBatch.from_arrays([pa.array(np.einsum("ij,ij->i", z @ inverse, z)), part.column(0)], ["h", "residual"])

    mse = rows.agg(F.avg(F.col("residual") * F.col("residual"))).first()[0] + 1e-12
    scored = rows.select("residual", *[_d(c).alias(f"_{i}") for i, c in enumerate(cols)]).mapInArrow(leverage, "h double, residual double")
    cook = F.col("residual") * F.col("residual") / F.lit(k * mse) * (F.col("h") / ((1 - F.col("h")) * (1 - F.col("h"))))
    return scored.withColumn("cook", cook).agg(F.count(F.lit(1)).alias("n"), F.max("h").alias("max_leverage"), F.max("cook").alias("max_cooks"),
                                               F.count_if(F.col("h") > F.lit(2 * k / n)).alias("high_leverage"), F.count_if(F.col("cook") > 1).alias("high_cooks"))


def residual_normality(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    return H.normality(ols(df, target, cols)[0], "residual")


def qq_points(df: DataFrame, target: str, cols: Sequence[str], points: int = 99) -> DataFrame:
    """(p, theoretical, sample): residual quantiles against normal ones."""
    probs = [(i + 1) / (points + 1) for i in range(points)]
    sample = quantile_values(ols(df, target, cols)[0].select("residual"), ["residual"], probs)["residual"]
    return df.sparkSession.createDataFrame([(p, normal_ppf(p), s) for p, s in zip(probs, sample)], "p double, theoretical double, sample double")


INFINITE_VIF = 999.0


def vif(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, vif): diagonal of the inverse correlation matrix of median-imputed columns."""
    work = median_filled(df, cols)
    c = covariance(grams(work, cols, means_of(work, cols))[None])
    d = np.sqrt(np.diag(c))
    live = d > 0
    corr = c[np.ix_(live, live)] / np.outer(d[live], d[live])
    values = np.full(len(cols), np.nan)
    e, v = np.linalg.eigh(corr) if len(corr) else (np.zeros(0), np.zeros((0, 0)))
    null = e <= len(corr) * np.finfo(float).eps * max(e.max(initial=0), 1.0)
    # exactly dependent columns are those that take part in a vector which the matrix sends to zero
    inner = (v[:, ~null] ** 2 / e[~null]).sum(axis=1)
    values[live] = np.where(np.abs(v[:, null]).max(axis=1, initial=0) > 1e-7, np.inf, inner)
    rows = [(c, float(v) if np.isfinite(v) else INFINITE_VIF) for c, v in zip(cols, values)]
    return df.sparkSession.createDataFrame(rows, "feature string, vif double")


def scaling_check(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(feature, min, max, std, range, has_outliers, range_ratio, scaler): the last two describe the whole table."""
    from .audit import column_stats

    stats = column_stats(df, list(cols or numeric_names(df)), lambda c: [F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
                                                                        F.stddev_samp(c).alias("std")], [0.25, 0.75])
    low, high = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    reach = 1.5 * (high - low)
    out = stats.select(F.col("column").alias("feature"), "min", "max", "std", (F.col("max") - F.col("min")).alias("range"),
                       ((F.col("max") > high + reach) | (F.col("min") < low - reach)).alias("has_outliers"))
    every = Window.partitionBy(F.lit(0))  # one row per column
    positive = F.when(F.col("range") > 0, F.col("range"))
    ratio = F.when(F.count(positive).over(every) >= 2, F.max(positive).over(every) / F.min(positive).over(every))
    return out.withColumn("range_ratio", ratio).withColumn("scaler", F.when(F.max("has_outliers").over(every), "robust").otherwise("standard"))


# ---- shape -------------------------------------------------------------------------------------

def pca_summary(df: DataFrame, cols: Sequence[str], k: int | None = None) -> DataFrame:
    """(component, share, cumulative, components_90, feature, loading) of the standardised columns."""
    frame = FE.standardised(df, cols)
    names = frame.columns
    size = min(len(names), k or len(names))
    components, shares = FE.fit_pca(frame, names, size)
    cumulative = np.cumsum(shares)
    n90 = min(int(np.searchsorted(cumulative, 0.9)) + 1, size)
    rows = [(j + 1, float(shares[j]), float(cumulative[j]), n90, c, float(components[i, j])) for j in range(size) for i, c in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, "component int, share double, cumulative double, components_90 int, feature string, loading double")


def _components(pdf: pd.DataFrame) -> pd.DataFrame:
    """Connected components of occupied grid cells that touch, sides or corners."""
    cells = {(x, y): None for x, y in zip(pdf["cx"], pdf["cy"])}
    label = 0
    for start in sorted(cells):
        if cells[start] is not None:
            continue
        cells[start], stack = label, [start]
        while stack:
            x, y = stack.pop()
            for near in ((x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if near in cells and cells[near] is None:
                    cells[near] = label
                    stack.append(near)
        label += 1
    return pdf.assign(component=[cells[(x, y)] for x, y in zip(pdf["cx"], pdf["cy"])])[["interval", "cx", "cy", "n", "component"]]


def mapper(df: DataFrame, cols: Sequence[str], intervals: int = 10, overlap: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Mapper graph: nodes (node, interval, size, x, y) and edges (a, b, shared).

    The lens is the plane of the first two components; overlapping intervals cover the first.
    Density clusters of an interval are grid components at resolution eps = 1.5 spreads: points
    collapse to occupied cells, so only cells (not points, not pairs of points) meet in a task.
    ``overlap`` must be under one half, so a row lies in at most two intervals.
    """
    if not 0 <= overlap < 0.5:
        raise ValueError("overlap must be in [0, 0.5)")
    frame = FE.standardised(df, cols)
    names = frame.columns
    components, _ = FE.fit_pca(frame, names, 2)
    x, y = FE.pca_scores(names, components)
    lens = frame.select(x.alias("x"), y.alias("y"))
    low, high = lens.agg(F.min("x"), F.max("x")).first()
    width = (high - low) / (intervals * (1 - overlap) + overlap) or 1.0
    step = width * (1 - overlap)
    last = F.greatest(F.lit(0), F.least(F.floor((F.col("x") - F.lit(low)) / F.lit(step)), F.lit(intervals - 1))).cast("int")
    first = F.when((last > 0) & (F.col("x") <= F.lit(low) + (last - 1) * F.lit(step) + F.lit(width)), last - 1)
    spread = F.explode(F.array_compact(F.array(last, first)))
    eps = {r.interval: r.e for r in lens.select("y", "x", spread.alias("interval")).groupBy("interval").agg(
        (1.5 * (F.stddev_pop("x") + F.stddev_pop("y")) / 2).alias("e")).collect()}
    side = F.lit(0.5)
    sides = F.create_map(*[F.lit(v) for i, e in eps.items() for v in (i, e if e and e > 1e-10 else 0.5)])

    def cell(i: Column, v: str) -> Column:
        return F.floor(F.col(v) / F.coalesce(F.try_element_at(sides, i), side)).cast("int")

    tagged = lens.withColumns({"i1": last, "i2": first})
    slots = F.explode(F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.col(k).alias("interval"), cell(F.col(k), "x").alias("cx"), cell(F.col(k), "y").alias("cy"))) for k in ("i1", "i2")])))
    cells = tagged.select(slots.alias("s")).select("s.*").groupBy("interval", "cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    labelled = cells.groupBy("interval").applyInPandas(_components, "interval int, cx int, cy int, n bigint, component int")
    sizes = labelled.groupBy("interval", "component").agg(F.sum("n").alias("size")).withColumn("all", F.sum("size").over(Window.partitionBy("interval")))
    kept = sizes.where("size > 1 or all < 3").select("interval", "component")
    node = F.concat_ws(".", "interval", "component")
    names_of = labelled.join(kept, ["interval", "component"]).select("interval", "cx", "cy", node.alias("node"))

    def slot(frame: DataFrame, k: str, name: str) -> DataFrame:
        look = names_of.select(F.col("interval").alias("_i"), F.col("cx").alias("_x"), F.col("cy").alias("_y"), F.col("node").alias(name))
        return frame.join(look, (F.col(k) == F.col("_i")) & (cell(F.col(k), "x") == F.col("_x")) & (cell(F.col(k), "y") == F.col("_y")), "left").drop("_i", "_x", "_y")

    placed = slot(slot(tagged, "i1", "n1"), "i2", "n2")
    members = placed.select("x", "y", F.explode(F.array_compact(F.array("n1", "n2"))).alias("node"))
    nodes = members.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    edges = placed.where("n1 is not null and n2 is not null and n1 <> n2").groupBy(F.least("n1", "n2").alias("a"), F.greatest("n1", "n2").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    return nodes, edges
