"""Outlier bounds, masks, rates and capping for numeric columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from .columns import is_numeric, numeric_names

# Detection thresholds and the constants that scale a MAD to a normal SD.
METHODS = ("iqr", "mad", "zscore", "percentile")
IQR_FACTOR = 1.5
MAD_THRESHOLD = 3.5
MAD_SCORE = 0.6745
MAD_SCALE = 1.4826
Z_THRESHOLD = 3.0
PERCENTILES = (0.01, 0.99)


def _quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict:
    return {r["column"]: (r["n"], list(r["q"]) if r["n"] else None) for r in exact_quantiles(df, cols, probs).collect()}


def _deviation_median(df: DataFrame, medians: Mapping[str, float]) -> dict[str, float]:
    gaps = df.select(*[F.abs(F.col(c) - F.lit(m)).alias(c) for c, m in medians.items()])
    return {c: q[0] for c, (n, q) in _quantiles(gaps, list(medians), [0.5]).items() if n}


def bounds(df: DataFrame, cols: Sequence[str], method: str = "iqr", threshold: float | None = None,
           percentiles: Sequence[float] = PERCENTILES) -> dict[str, tuple]:
    """{column: (lower, upper, centre, scale)} learned from the data; columns without a rule are left out.

    centre and scale are set for the two score methods (mad, zscore).  Fewer than three values or a
    zero spread give no bounds.  Only these few numbers reach the driver.
    """
    cols = [c for c in cols if is_numeric(df, c)]
    if not cols:
        return {}
    out: dict[str, tuple] = {}
    if method == "zscore":
        limit = Z_THRESHOLD if threshold is None else threshold
        row = df.agg(*[F.struct(F.count(c), F.avg(c), F.stddev_samp(c)).alias(str(i)) for i, c in enumerate(cols)]).first()
        for i, c in enumerate(cols):
            n, mean, sd = row[i]
            if n >= 3 and sd:
                out[c] = (float(mean) - limit * sd, float(mean) + limit * sd, float(mean), sd)
        return out
    if method == "mad":
        limit = MAD_THRESHOLD if threshold is None else threshold
        medians = {c: q[0] for c, (n, q) in _quantiles(df, cols, [0.5]).items() if n >= 3}
        if medians:
            for c, mad in _deviation_median(df, medians).items():
                if mad:
                    spread = limit * MAD_SCALE * mad
                    out[c] = (medians[c] - spread, medians[c] + spread, medians[c], mad)
        return out
    probs = [0.25, 0.75] if method == "iqr" else list(percentiles)
    for c, (n, q) in _quantiles(df, cols, probs).items():
        if n < 3:
            continue
        low, high = q
        if method == "iqr":
            spread = high - low
            if spread == 0:
                continue
            low, high = low - IQR_FACTOR * spread, high + IQR_FACTOR * spread
        out[c] = (low, high, None, None)
    return out


def flag(c: str, learned: Mapping[str, tuple], method: str = "iqr", threshold: float | None = None) -> Column:
    """True where the value is an outlier; nulls and columns without bounds give false."""
    if c not in learned:
        return F.lit(False)
    low, high, centre, scale = learned[c]
    if method == "mad":
        hit = F.abs(F.lit(MAD_SCORE) * (F.col(c) - F.lit(centre)) / F.lit(scale)) > F.lit(MAD_THRESHOLD if threshold is None else threshold)
    elif method == "zscore":
        hit = F.abs((F.col(c) - F.lit(centre)) / F.lit(scale)) > F.lit(Z_THRESHOLD if threshold is None else threshold)
    else:
        hit = (F.col(c) < F.lit(low)) | (F.col(c) > F.lit(high))
    return F.coalesce(hit, F.lit(False))


def mark_outliers(df: DataFrame, cols: Sequence[str], method: str = "iqr", suffix: str = "_outlier") -> DataFrame:
    learned = bounds(df, cols, method)
    return df.withColumns({c + suffix: flag(c, learned, method) for c in cols})


def outlier_rates(df: DataFrame, cols: Sequence[str] | None = None, methods: Sequence[str] = METHODS) -> DataFrame:
    """(column, method, lower, upper, n, outliers, rate): one counting scan for all pairs."""
    cols = list(cols or numeric_names(df))
    cells = []
    for m in methods:
        learned = bounds(df, cols, m)
        for c in cols:
            low, high = learned.get(c, (None, None))[:2]
            cells.append(F.struct(
                F.lit(c).alias("column"), F.lit(m).alias("method"), F.lit(low).cast("double").alias("lower"),
                F.lit(high).cast("double").alias("upper"), F.count(c).alias("n"), F.count_if(flag(c, learned, m)).alias("outliers")))
    table = df.agg(F.array(*cells).alias("_s")).select(F.inline("_s"))
    return table.withColumn("rate", F.coalesce(F.try_divide(F.col("outliers").cast("double"), F.col("n")), F.lit(0.0)))


def outlier_summary(df: DataFrame, c: str, method: str = "iqr") -> DataFrame:
    """The rate row of one column, for a regression target."""
    return outlier_rates(df, [c], [method])


def capping_bounds(df: DataFrame, cols: Sequence[str], method: str = "percentile", threshold: float = MAD_THRESHOLD,
                   percentiles: Sequence[float] = PERCENTILES) -> dict[str, tuple[float, float]]:
    """Clip limits learned on training rows.  A zero MAD clips to the median, as no spread was seen."""
    out = {}
    if method == "mad":
        medians = {c: q[0] for c, (n, q) in _quantiles(df, cols, [0.5]).items() if n}
        for c, mad in (_deviation_median(df, medians) if medians else {}).items():
            spread = threshold * MAD_SCALE * mad
            out[c] = (medians[c] - spread, medians[c] + spread)
        return out
    return {c: (q[0], q[1]) for c, (n, q) in _quantiles(df, cols, percentiles).items() if n}


def clip(c: str | Column, low: float | None, high: float | None) -> Column:
    """Value limited to [low, high]; null stays null (least and greatest would skip it)."""
    v = F.col(c) if isinstance(c, str) else c
    limited = v
    if high is not None:
        limited = F.least(limited, F.lit(high))
    if low is not None:
        limited = F.greatest(limited, F.lit(low))
    return F.when(v.isNotNull(), limited)


def cap(df: DataFrame, limits: Mapping[str, tuple]) -> DataFrame:
    return df.withColumns({c: clip(c, *lim) for c, lim in limits.items()})
