"""Classical hypothesis tests from distributed sufficient statistics.

Executors reduce the data to a handful of numbers per group; test statistics are column
expressions on that reduced frame and p-values are computed on its rows.  Rank tests use the
large-sample normal or chi-square approximation with tie correction at every sample size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pvalues as P
from ..functions.ranking import add_ranks, rows_per_range, running_totals
from ..functions.storage import written


def _d(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


# ---- correlation -------------------------------------------------------------------------------

def _corr_row(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    row = df.where(both).agg(F.corr(_d(a), _d(b)).alias("statistic"), F.count(F.lit(1)).alias("n"))
    ok = F.col("n") >= 3
    r = F.when(ok, F.col("statistic"))
    return row.select(F.lit(name).alias("test"), r.alias("statistic"), "n", P.p_corr(r, F.col("n")).alias("p"), (r * r).alias("effect"))


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    """(test, statistic r, n, p, effect r squared); fewer than three pairs give nulls."""
    return _corr_row(df, a, b, "pearson")


def rank_tests(rows: DataFrame, cols: Sequence[str], y: str) -> DataFrame:
    """(column, test, statistic r, n, p, effect): Spearman correlation of each column with ``y``; none of them has nulls.

    Ranks of the columns are looked up by value. Rows then collapse to the distinct values of ``y`` with sums of those ranks, once for
    all columns: the same table gives the ranks of ``y``, and pairs of values are never formed.
    """
    ranked, sums = rows, [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        # Written, so that neither the count of ranges nor the look-up counts the rows again, and a short list of values is known to be short.
        counts, _path = written(rows.groupBy(_d(c).alias("value")).agg(F.count(F.lit(1)).alias("n")), "values")
        ranks = running_totals(counts, "value", ["n"]).select(F.col("value").alias(f"_v{i}"), (F.col("cum_n") - (F.col("n") - 1) / 2).alias(f"_r{i}"))
        ranks, _path = written(ranks, "ranks")
        ranked = ranked.join(ranks, _d(c) == F.col(f"_v{i}"))
        sums += [F.sum(f"_r{i}").alias(f"x{i}"), F.sum(F.col(f"_r{i}") * F.col(f"_r{i}")).alias(f"xx{i}")]
    cells, _path = written(ranked.groupBy(_d(y).alias("_y")).agg(*sums), "cells")
    w, rank = F.col("n").cast("double"), F.col("cum_n") - (F.col("n") - 1) / 2
    each = [e for i in range(len(cols)) for e in (F.sum(f"x{i}").alias(f"sx{i}"), F.sum(f"xx{i}").alias(f"sxx{i}"), F.sum(F.col(f"x{i}") * rank).alias(f"sxy{i}"))]
    s = running_totals(cells, "_y", ["n"]).agg(F.sum("n").alias("n"), F.sum(w * rank).alias("sy"), F.sum(w * rank * rank).alias("syy"), *each)
    n = F.col("n").cast("double")

    def r(i: int) -> Column:
        cov = F.col(f"sxy{i}") - F.col(f"sx{i}") * F.col("sy") / n
        return F.try_divide(cov, F.sqrt((F.col(f"sxx{i}") - F.col(f"sx{i}") ** 2 / n) * (F.col("syy") - F.col("sy") ** 2 / n)))

    results = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.when(F.col("n") >= 3, r(i)).alias("statistic"), F.coalesce("n", F.lit(0)).alias("n")) for i, c in enumerate(cols)]))
    statistic = F.col("statistic")
    return s.select(results).select("column", F.lit("spearman").alias("test"), "statistic", "n", P.p_corr(statistic, F.col("n")).alias("p"), (statistic * statistic).alias("effect"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation of average ranks over complete pairs."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(_d(a).alias("a"), _d(b).alias("b"))
    return rank_tests(pairs, ["a"], "b").drop("column")


def rank_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(a, b, r, n): Spearman correlation of many column pairs.

    Columns without nulls are ranked once and shared by all their pairs; a pair with nulls is ranked
    on its own complete rows.
    """
    cols = list(dict.fromkeys(c for pair in pairs for c in pair))
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"_{i}") for i, c in enumerate(cols)]).first()
    full = {c for i, c in enumerate(cols) if counts[i + 1] == counts["rows"]}
    shared = [p for p in pairs if set(p) <= full]
    parts = []
    if shared:
        used = [c for c in cols if any(c in p for p in shared)]
        ranked = add_ranks(df.select(*[_d(c).alias(c) for c in used]), used)
        cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(f"rank_{a}", f"rank_{b}").alias("r"), F.count(F.lit(1)).alias("n")) for a, b in shared]
        parts.append(ranked.agg(F.array(*cells).alias("_s")).select(F.inline("_s")))
    parts += [spearman(df, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col("statistic").alias("r"), "n") for a, b in pairs if not {a, b} <= full]
    return reduce(DataFrame.unionByName, parts)


def _signed_pairs(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Sum of w_i w_j sign(x_i - x_j) sign(y_i - y_j) over pairs, by divide and conquer on x."""
    codes = np.unique(x, return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    codes, y, w = codes[order], y[order], w[order]
    total = 0.0
    stack = [(0, len(codes))]
    while stack:
        a, b = stack.pop()
        if b - a < 2 or codes[a] == codes[b - 1]:
            continue
        middle = (codes[a] + codes[b - 1] + 1) // 2
        m = a + int(np.searchsorted(codes[a:b], middle, side="left"))
        by_y = np.argsort(y[a:m], kind="stable")
        ys = y[a:m][by_y]
        cum = np.concatenate([[0.0], np.cumsum(w[a:m][by_y])])
        less = cum[np.searchsorted(ys, y[m:b], side="left")]
        more = cum[-1] - cum[np.searchsorted(ys, y[m:b], side="right")]
        total += float(np.sum(w[m:b] * (less - more)))
        stack += [(a, m), (m, b)]
    return total


def _cuts(cells: DataFrame, c: str, pieces: int) -> list[float]:
    """Depth-balanced cut values; a value heavy enough to repeat among them gets a cell of its own."""
    probs = [i / pieces for i in range(1, pieces)]
    edges = cells.agg(F.percentile_approx(c, probs, F.lit(20 * pieces)).alias("e")).first()["e"] or []
    repeated = {e for i, e in enumerate(edges) if i and e == edges[i - 1]}
    return sorted({float(e) for e in edges} | {float(np.nextafter(e, np.inf)) for e in repeated})


def _signed_sum(cells: DataFrame, limit: int) -> DataFrame:
    """One row ``s``: sum of the signs of all pairs of weighted cells (x, y, w).

    Cells are cut into depth-balanced x and y blocks, and every pair falls in exactly one of three classes: same x block (solved
    inside the block), same y block but different x block (solved inside the y block with x reduced to its block number), or
    different blocks in both: these are pairs of the block totals, cells of the same kind again, until few enough are left.
    """
    from pyspark.ml.feature import Bucketizer

    def solve(x, y):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"s": [_signed_pairs(pdf[x].to_numpy(), pdf[y].to_numpy(), pdf["w"].to_numpy())]})
        return run

    parts = None
    while True:
        pieces = cells.count() // limit + 1
        if pieces == 1:
            last = cells.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(solve("x", "y"), "s double")  # at most ``limit`` cells
            parts = last if parts is None else parts.union(last)
            return parts.agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"))
        blocked = cells
        for c, out in (("x", "xb"), ("y", "yb")):
            splits = [-float("inf"), *_cuts(cells, c, pieces), float("inf")]
            blocked = Bucketizer(splits=splits, inputCol=c, outputCol=out).transform(blocked) if len(splits) > 2 else blocked.withColumn(out, F.lit(0.0))

        def mixed(group, other):  # blocks with a single value of their own axis hold ties only
            live = blocked.groupBy(group).agg(F.min(other).alias("lo"), F.max(other).alias("hi")).where("lo < hi").select(F.col(group).alias("_g"))
            return blocked.join(F.broadcast(live), F.col(group) == F.col("_g"), "left_semi")  # one row for each block

        own = mixed("xb", "x").groupBy("xb").applyInPandas(solve("x", "y"), "s double").union(mixed("yb", "y").groupBy("yb").applyInPandas(solve("xb", "y"), "s double"))
        parts = own if parts is None else parts.union(own)
        cells = blocked.groupBy(F.col("xb").alias("x"), F.col("yb").alias("y")).agg(F.sum("w").alias("w"))


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """Exact tau-b without forming pairs of rows; equal pairs collapse first."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(_d(a).alias("x"), _d(b).alias("y")).agg(
        F.count(F.lit(1)).cast("double").alias("w"))
    s = _signed_sum(cells, rows_per_range(df))

    def ties(cols):
        t = F.col("t")
        return cells.groupBy(*cols).agg(F.sum("w").alias("t")).agg(
            F.sum(t).alias("n"), F.sum(t * (t - 1)).alias("a"), F.sum(t * (t - 1) * (t - 2)).alias("b"),
            F.sum(t * (t - 1) * (2 * t + 5)).alias("c"))

    tx = ties(["x"]).select(F.col("n"), F.col("a").alias("xa"), F.col("b").alias("xt"), F.col("c").alias("xc"), F.lit(0).alias("k"))
    ty = ties(["y"]).select(F.col("a").alias("ya"), F.col("b").alias("yt"), F.col("c").alias("yc"), F.lit(0).alias("k"))
    row = tx.join(ty, "k").join(s.withColumn("k", F.lit(0)), "k")
    n = F.col("n")
    all_pairs = n * (n - 1)
    tau = F.try_divide(2 * F.col("s"), F.sqrt((all_pairs - F.col("xa")) * (all_pairs - F.col("ya"))))
    variance = (n * (n - 1) * (2 * n + 5) - F.col("xc") - F.col("yc")) / 18 + F.col("xa") * F.col("ya") / (2 * all_pairs) \
        + F.try_divide(F.col("xt") * F.col("yt"), 9 * all_pairs * (n - 2))
    z = F.try_divide(F.col("s"), F.sqrt(variance))
    return row.select(F.lit("kendall").alias("test"), tau.alias("statistic"), n.cast("bigint").alias("n"), P.p_normal(z).alias("p"), tau.alias("effect"))


# ---- location tests ----------------------------------------------------------------------------

def t_test(df: DataFrame, value: str, group: str, levels: Sequence) -> DataFrame:
    """Two-sample t with pooled variance; effect is the standardised mean difference."""
    v = _d(value)
    sides = [F.col(group) == F.lit(x) for x in levels]
    row = df.where(F.col(value).isNotNull()).agg(*[e.alias(f"{k}{i}") for i, hit in enumerate(sides) for k, e in (
        ("n", F.count_if(hit)), ("m", F.avg(F.when(hit, v))), ("v", F.var_samp(F.when(hit, v))))])
    n0, n1 = F.col("n0"), F.col("n1")
    pooled = ((n0 - 1) * F.col("v0") + (n1 - 1) * F.col("v1")) / (n0 + n1 - 2)
    gap = F.col("m0") - F.col("m1")
    t = F.try_divide(gap, F.sqrt(pooled * (1 / n0 + 1 / n1)))
    return row.select(F.lit("t").alias("test"), t.alias("statistic"), (n0 + n1).alias("n"),
                      P.p_t(t, n0 + n1 - 2).alias("p"), F.try_divide(gap, F.sqrt(pooled)).alias("effect"))


def group_rank_sums(df: DataFrame, value: str, group: str) -> DataFrame:
    """(group, n, rank_sum) plus (total, ties) repeated on every row."""
    cells = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(_d(value).alias("value"), F.col(group).alias("group")).agg(
        F.count(F.lit(1)).alias("k"))
    counts = cells.groupBy("value").agg(F.sum("k").alias("n"))
    ranks = running_totals(counts, "value", ["n"]).select(
        F.col("value").alias("_v"), (F.col("cum_n") - (F.col("n") - 1) / 2).alias("rank"))
    sums = cells.join(ranks, F.col("value") == F.col("_v")).groupBy("group").agg(
        F.sum("k").alias("n"), F.sum(F.col("k") * F.col("rank")).alias("rank_sum")).withColumn("_k", F.lit(0))
    n = F.col("n").cast("double")
    whole = counts.agg(F.sum("n").alias("total"), F.sum(n * n * n - n).alias("ties")).withColumn("_k", F.lit(0))
    return sums.join(F.broadcast(whole), "_k").drop("_k")


def mann_whitney(df: DataFrame, value: str, group: str, levels: Sequence) -> DataFrame:
    """U of the first level, two-sided p with tie and continuity correction; effect is U / (n0 n1)."""
    sums = group_rank_sums(df.where(F.col(group).isin(*levels)), value, group)
    first = F.col("group") == F.lit(levels[0])
    row = sums.agg(F.sum(F.when(first, F.col("n"))).alias("n0"), F.sum(F.when(~first, F.col("n"))).alias("n1"),
                   F.sum(F.when(first, F.col("rank_sum"))).alias("r0"), F.max("total").alias("total"), F.max("ties").alias("ties"))
    n0, n1, n = F.col("n0").cast("double"), F.col("n1").cast("double"), F.col("total").cast("double")
    u = F.col("r0") - n0 * (n0 + 1) / 2
    sd = F.sqrt(n0 * n1 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    z = F.try_divide(F.greatest(F.abs(u - n0 * n1 / 2) - 0.5, F.lit(0.0)), sd)
    return row.select(F.lit("mannwhitney").alias("test"), u.alias("statistic"), F.col("total").alias("n"),
                      P.p_normal(z).alias("p"), F.try_divide(u, n0 * n1).alias("effect"))


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """One-way F; effect is eta squared."""
    v = _d(value)
    # Group variances are merged from stable per-group moments, not from raw sums of squares.
    groups = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("v")).withColumn("_k", F.lit(0))
    grand = groups.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g")).withColumn("_k", F.lit(0))
    row = groups.join(F.broadcast(grand), "_k").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("within"),
        F.sum(F.col("n") * (F.col("m") - F.col("g")) ** 2).alias("between"))
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    f = F.try_divide(F.col("between") * d2, F.col("within") * d1)
    return row.select(F.lit("anova").alias("test"), f.alias("statistic"), "n", P.p_f(f, d1, d2).alias("p"),
                      F.try_divide(F.col("between"), F.col("between") + F.col("within")).alias("effect"))


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """Kruskal-Wallis H with tie correction; effect is H / (n - 1)."""
    row = group_rank_sums(df, value, group).agg(
        F.count(F.lit(1)).alias("k"), F.max("total").alias("total"), F.max("ties").alias("ties"),
        F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("s"))
    n = F.col("total").cast("double")
    h = 12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    h = F.try_divide(h, 1 - F.col("ties") / (n * n * n - n))
    return row.select(F.lit("kruskal").alias("test"), h.alias("statistic"), F.col("total").alias("n"),
                      P.p_chi2(h, F.col("k") - 1).alias("p"), F.try_divide(h, n - 1).alias("effect"))


# ---- contingency -------------------------------------------------------------------------------

def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n): observed combinations of complete pairs, long form."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square of independence, Yates-corrected on 2x2; effect is Cramer's V."""
    cells = crosstab(df, a, b)
    ra = cells.groupBy("a").agg(F.sum("n").alias("ra"))
    rb = cells.groupBy("b").agg(F.sum("n").alias("rb"))
    size = ra.agg(F.count(F.lit(1)).alias("ka"), F.sum("ra").alias("n")).withColumn("_k", F.lit(0)).join(
        rb.agg(F.count(F.lit(1)).alias("kb")).withColumn("_k", F.lit(0)), "_k")
    # Observed cells only: an empty cell adds its expected count, and all expected counts sum to n.
    joined = cells.join(ra, "a").join(rb, "b").withColumn("_k", F.lit(0)).join(F.broadcast(size.withColumnRenamed("n", "total")), "_k")
    expected = F.col("ra").cast("double") * F.col("rb") / F.col("total")
    gap = F.abs(F.col("n") - expected)
    yates = (F.col("ka") == 2) & (F.col("kb") == 2)
    corrected = F.when(yates, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    row = joined.agg(F.sum(corrected * corrected / expected).alias("seen"), F.sum(expected).alias("seen_expected"), F.max("total").alias("n"),
                     F.max("ka").alias("ka"), F.max("kb").alias("kb"), F.count(F.lit(1)).alias("cells"))
    holes = F.col("ka") * F.col("kb") - F.col("cells")
    each = F.try_divide(F.col("n") - F.col("seen_expected"), holes)
    # Empty cells of a 2x2 table have equal expected counts, so the correction applies to each alike.
    trimmed = F.when((F.col("ka") == 2) & (F.col("kb") == 2), each - F.least(F.lit(0.5), each)).otherwise(each)
    empty = F.when(holes > 0, holes * trimmed * F.try_divide(trimmed, each)).otherwise(0.0)
    chi2 = F.col("seen") + empty
    dof = (F.col("ka") - 1) * (F.col("kb") - 1)
    v = F.sqrt(F.try_divide(chi2, F.col("n") * (F.least("ka", "kb") - 1)))
    return row.select(F.lit("chi2").alias("test"), chi2.alias("statistic"), "n", F.when(dof > 0, P.p_chi2(chi2, dof)).otherwise(1.0).alias("p"), v.alias("effect"))


def fisher(df: DataFrame, a: str, b: str, a_levels: Sequence, b_levels: Sequence) -> DataFrame:
    """Fisher's exact test on the 2x2 table of the given levels; statistic is the odds ratio."""
    cell = [F.count_if((F.col(a) == F.lit(x)) & (F.col(b) == F.lit(y))).alias(k)
            for k, (x, y) in zip("wxyz", [(p, q) for p in a_levels for q in b_levels])]
    row = df.agg(*cell)
    w, x, y, z = (F.col(k) for k in "wxyz")
    odds = F.try_divide(w.cast("double") * z, x.cast("double") * y)
    return row.select(F.lit("fisher").alias("test"), odds.alias("statistic"), (w + x + y + z).alias("n"), P.p_fisher(w, x, y, z).alias("p"), odds.alias("effect"))


# ---- normality ---------------------------------------------------------------------------------

def with_k_squared(moments: DataFrame) -> DataFrame:
    """Append K squared and Jarque-Bera, with p-values, to a frame of n, g1 (skewness), g2 (excess kurtosis).

    Each step is a column of its own, so no expression repeats another; n < 8 or no spread gives nulls.
    """
    n, g1, g2 = F.greatest(F.col("n"), F.lit(8)).cast("double"), F.col("g1"), F.col("g2")
    c = F.col
    steps = [
        ("_y", g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))),
        ("_beta", 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))),
        ("_w2", F.sqrt(2 * (c("_beta") - 1)) - 1),
        ("_zs", F.asinh(c("_y") / F.sqrt(2 / (c("_w2") - 1))) / F.sqrt(0.5 * F.log("_w2"))),
        ("_x", (g2 + 3 - 3 * (n - 1) / (n + 1)) / F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))),
        ("_rb", 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))),
        ("_a", 6 + 8 / c("_rb") * (2 / c("_rb") + F.sqrt(1 + 4 / (c("_rb") * c("_rb"))))),
        ("_den", 1 + c("_x") * F.sqrt(2 / (c("_a") - 4))),
        ("_tail", F.signum("_den") * F.cbrt((1 - 2 / c("_a")) / F.abs("_den"))),
        ("_zk", (1 - 2 / (9 * c("_a")) - c("_tail")) / F.sqrt(2 / (9 * c("_a")))),
        ("k2", F.when(F.col("n") >= 8, c("_zs") * c("_zs") + c("_zk") * c("_zk"))),
        ("k2_p", F.exp(-c("k2") / 2)),
        ("jarque_bera", F.col("n") / 6 * (g1 * g1 + g2 * g2 / 4)),
        ("jarque_bera_p", F.exp(-c("jarque_bera") / 2)),
    ]
    out = moments
    for name, step in steps:
        out = out.withColumn(name, step)
    return out.drop("g1", "g2", *[name for name, _ in steps if name.startswith("_")])


def normality(df: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """(group, n, k2, k2_p, jarque_bera, jarque_bera_p, normal at 5%)."""
    group = F.lit("all") if by is None else F.col(by).cast("string")
    v = _d(value)
    spread = F.stddev_pop(v) > 0
    moments = df.groupBy(group.alias("group")).agg(F.count(v).alias("n"), F.when(spread, F.skewness(v)).alias("g1"), F.when(spread, F.kurtosis(v)).alias("g2"))
    out = with_k_squared(moments)
    return out.withColumn("normal", F.coalesce(F.col("k2_p") > 0.05, F.lit(False)))


# ---- related samples ---------------------------------------------------------------------------

def friedman(df: DataFrame, block: str, treatment: str, value: str) -> DataFrame:
    """Friedman chi-square of k treatments measured once in every block, tie corrected."""
    in_block = Window.partitionBy(block)
    v = _d(value)
    # A block holds one row per treatment, so these windows are k rows long.
    ranked = df.select(block, treatment, v.alias("v")).withColumn("lo", F.rank().over(in_block.orderBy("v"))).withColumn(
        "t", F.count(F.lit(1)).over(Window.partitionBy(block, "v")))
    ranked = ranked.withColumn("rank", F.col("lo") + (F.col("t") - 1) / 2)
    per = ranked.groupBy(treatment).agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("n"), F.sum(F.col("t") * F.col("t") - 1).alias("ties"))
    row = per.agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n"), F.sum(F.col("r") * F.col("r")).alias("s"), F.sum("ties").cast("double").alias("ties"))
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    q = 12 / (n * k * (k + 1)) * F.col("s") - 3 * n * (k + 1)
    q = F.try_divide(q, 1 - F.col("ties") / (n * k * (k * k - 1)))
    return row.select(F.lit("friedman").alias("test"), q.alias("statistic"), "n", P.p_chi2(q, k - 1).alias("p"), F.try_divide(q, n * (k - 1)).alias("effect"))


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    d = _d(a) - _d(b)
    row = df.agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"))
    t = F.try_divide(F.col("m") * F.sqrt("n"), F.col("s"))
    return row.select(F.lit("paired_t").alias("test"), t.alias("statistic"), "n", P.p_t(t, F.col("n") - 1).alias("p"),
                      F.try_divide(F.col("m"), F.col("s")).alias("effect"))


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """Signed-rank test; zero differences are dropped; statistic is the smaller rank sum."""
    d = _d(a) - _d(b)
    cells = df.select(d.alias("d")).where("d is not null and d <> 0").groupBy(F.abs("d").alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("up"))
    cum = running_totals(cells, "value", ["n"])
    rank = F.col("cum_n") - (F.col("n") - 1) / 2
    n = F.col("n").cast("double")
    row = cum.agg(F.sum("n").alias("n"), F.sum(F.col("up") * rank).alias("plus"), F.sum((F.col("n") - F.col("up")) * rank).alias("minus"),
                  F.sum(n * n * n - n).alias("ties"))
    stat = F.least("plus", "minus")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    z = F.try_divide(stat - n * (n + 1) / 4, sd)
    effect = F.try_divide(F.col("plus") - F.col("minus"), F.col("plus") + F.col("minus"))
    return row.select(F.lit("wilcoxon").alias("test"), stat.alias("statistic"), F.coalesce("n", F.lit(0)).alias("n"), P.p_normal(z).alias("p"), effect.alias("effect"))


# ---- multiple testing --------------------------------------------------------------------------

def adjust_bh(tests: DataFrame, p: str = "p", key: str = "feature", alpha: float = 0.05) -> DataFrame:
    """Append Benjamini-Hochberg ``p_adjusted`` and ``rejected``; one row per test, so one small window."""
    order = Window.orderBy(F.asc(p), F.asc(key))
    ranked = tests.withColumn("_i", F.row_number().over(order)).withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    back = Window.orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    adjusted = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_i")).over(back))
    return ranked.withColumn("p_adjusted", adjusted).withColumn("rejected", F.col("p_adjusted") <= alpha).drop("_i", "_m")


def adjust_bonferroni(tests: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    m = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    return tests.withColumn("p_adjusted", F.least(F.lit(1.0), F.col(p) * m)).withColumn("rejected", F.col("p_adjusted") <= alpha)


# ---- choosing a test ---------------------------------------------------------------------------

def compare_groups(df: DataFrame, value: str, group: str) -> DataFrame:
    """t or Mann-Whitney for two groups, F or Kruskal-Wallis for more, by normality of every group."""
    groups = normality(df.where(F.col(group).isNotNull() & F.col(value).isNotNull()), value, group).collect()
    if len(groups) < 2:
        raise ValueError("need two groups with values")
    parametric = all(g.normal for g in groups)
    if len(groups) == 2:
        cast = df.withColumn(group, F.col(group).cast("string"))
        levels = sorted(g.group for g in groups)
        return t_test(cast, value, group, levels) if parametric else mann_whitney(cast, value, group, levels)
    return anova(df, value, group) if parametric else kruskal(df, value, group)


def compare_classes(df: DataFrame, a: str, b: str) -> DataFrame:
    """Fisher for a 2x2 table with a cell under 5, chi-square otherwise."""
    cast = df.withColumn(a, F.col(a).cast("string")).withColumn(b, F.col(b).cast("string"))
    shape = crosstab(cast, a, b).agg(F.count_distinct("a").alias("ka"), F.count_distinct("b").alias("kb"),
                                     F.min("n").alias("low"), F.count(F.lit(1)).alias("cells")).first()
    if shape.ka == 2 and shape.kb == 2 and (shape.low < 5 or shape.cells < 4):
        a_levels, b_levels = ([r[0] for r in cast.where(F.col(c).isNotNull()).select(c).distinct().orderBy(c).collect()] for c in (a, b))
        return fisher(cast, a, b, a_levels, b_levels)
    return chi_square(cast, a, b)


def union_tests(results: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, results)
