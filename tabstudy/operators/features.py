"""Feature engineering as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations, combinations_with_replacement

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import quantile_values
from ..functions.ranking import rows_per_range, running_totals
from .columns import per_column

LARGE, VERY_LARGE = 100, 500


def _product(cols: Sequence[str]) -> Column:
    out = F.col(cols[0]).cast("double")
    for c in cols[1:]:
        out = out * F.col(c)
    return out


def polynomial_terms(cols: Sequence[str], degree: int = 2, interaction_only: bool = False) -> list[tuple[str, ...]]:
    pick = combinations if interaction_only else combinations_with_replacement
    return [t for d in range(2, degree + 1) for t in pick(cols, d)]


def term_name(term: Sequence[str]) -> str:
    powers = {c: list(term).count(c) for c in dict.fromkeys(term)}
    return " ".join(c if k == 1 else f"{c}^{k}" for c, k in powers.items())


def polynomial(df: DataFrame, cols: Sequence[str], degree: int = 2, interaction_only: bool = False) -> DataFrame:
    """Append all products up to ``degree`` (no constant); the columns themselves stay as they are."""
    return df.withColumns({term_name(t): _product(t) for t in polynomial_terms(cols, degree, interaction_only)})


def polynomial_size(cols: Sequence[str], degree: int = 2, interaction_only: bool = False) -> tuple[int, str]:
    n = len(polynomial_terms(cols, degree, interaction_only))
    return n, "very large" if n > VERY_LARGE else "large" if n > LARGE else "ok"


def interaction(df: DataFrame, a: str, b: str | None = None, op: str = "multiply") -> DataFrame:
    """Append A x B, A / B (null where B is 0) or A squared; an existing name is left alone."""
    if op == "square":
        name, value = f"{a}_squared", F.col(a) * F.col(a)
    elif op == "multiply":
        name, value = f"{a}_x_{b}", F.col(a) * F.col(b)
    else:
        name, value = f"{a}_div_{b}", F.when(F.col(b) != 0, F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")))
    return df if name in df.columns else df.withColumn(name, value)


MATH = ("log", "log1p", "sqrt", "squared", "cubed", "inverse")


def math_transforms(df: DataFrame, cols: Sequence[str], kinds: Sequence[str] = MATH) -> DataFrame:
    """Append transforms whose domain holds for the whole column (a missing value fails a sign test)."""
    domain = {r["column"]: r for r in per_column(df, cols, lambda c: [
        F.min(c).cast("double").alias("low"), (F.count(c) == F.count(F.lit(1))).alias("full"), (F.count_if(F.col(c) == 0) > 0).alias("zero")]).collect()}
    out: dict[str, Column] = {}
    for c in cols:
        d, v = domain[c], F.col(c).cast("double")
        signed = d.full and d.low is not None
        if "log" in kinds and signed and d.low > 0:
            out[f"log_{c}"] = F.log(v)
        if "log1p" in kinds and signed and d.low >= 0:
            out[f"log1p_{c}"] = F.log1p(v)
        if "sqrt" in kinds and signed and d.low >= 0:
            out[f"sqrt_{c}"] = F.sqrt(v)
        if "squared" in kinds:
            out[f"{c}_squared"] = v * v
        if "cubed" in kinds:
            out[f"{c}_cubed"] = v * v * v
        if "inverse" in kinds and not d.zero:
            out[f"inv_{c}"] = F.lit(1.0) / v
    return df.withColumns(out) if out else df


def ratios(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Append num / den for denominators that are never zero."""
    dens = list(dict.fromkeys(d for _, d in pairs))
    zero = {r["column"]: r.zero for r in per_column(df, dens, lambda c: [(F.count_if(F.col(c) == 0) > 0).alias("zero")]).collect()}
    return df.withColumns({f"{n}_div_{d}": F.col(n).cast("double") / F.col(d).cast("double") for n, d in pairs if not zero[d]})


# ---- binning -----------------------------------------------------------------------------------

def bin_edges(df: DataFrame, c: str, bins: int, strategy: str = "quantile", seed: int = 42) -> list[float]:
    """Edges including both ends: quantiles, equal widths, or mid-points between 1-D cluster centres."""
    if strategy == "quantile":
        edges = quantile_values(df, [c], [i / bins for i in range(bins + 1)])[c]
        kept = [edges[0]]
        for e in edges[1:]:
            if e - kept[-1] > 1e-8:
                kept.append(e)
        return kept
    low, high = df.agg(F.min(c).cast("double"), F.max(c).cast("double")).first()
    if strategy == "uniform":
        return [low + (high - low) * i / bins for i in range(bins)] + [high]
    vectors = VectorAssembler(inputCols=[c], outputCol="_v", handleInvalid="skip").transform(df.select(F.col(c).cast("double").alias(c)))
    centres = sorted(float(x[0]) for x in KMeans(k=bins, seed=seed, featuresCol="_v").fit(vectors).clusterCenters())
    return [low, *[(a + b) / 2 for a, b in zip(centres, centres[1:])], high]


def bin_index(c: str | Column, edges: Sequence[float]) -> Column:
    """Zero-based bin; inner edges belong to the bin on their right; null stays null."""
    v = F.col(c) if isinstance(c, str) else c
    index = F.lit(0)
    for e in edges[1:-1]:
        index = index + (v >= F.lit(float(e))).cast("int")
    return F.when(v.isNotNull(), index)


def binned(df: DataFrame, c: str, bins: int = 5, strategy: str = "quantile", encode: str = "ordinal", seed: int = 42) -> DataFrame:
    edges = bin_edges(df, c, bins, strategy, seed)
    index = bin_index(c, edges)
    if encode == "ordinal":
        return df.withColumn(f"{c}_binned", index)
    return df.withColumns({f"{c}_bin_{i}": (index == i).cast("int") for i in range(len(edges) - 1)})


# ---- missing values as signal ------------------------------------------------------------------

def has_data(df: DataFrame, cols: Sequence[str] | None = None, threshold: float | None = None) -> DataFrame:
    """Append ``<c>_has_data``: 1 observed, 0 missing; with a threshold, only for columns missing at least that share."""
    names = list(cols or df.columns)
    if threshold is not None:
        rates = {r["column"]: r.rate for r in per_column(df, names, lambda c: [F.avg(F.col(c).isNull().cast("double")).alias("rate")]).collect()}
        names = [c for c in names if rates[c] >= threshold]
    return df.withColumns({f"{c}_has_data": F.col(c).isNotNull().cast("int") for c in names}) if names else df


def value_codes(df: DataFrame, c: str) -> DataFrame:
    """(value, code): distinct non-null values numbered 1..k in sort order.

    Values are numbered range by range. Ranges of strings are cut at quantiles of a hash sample of the distinct values, as many as
    keep a range to the rows that one task orders; the cuts only balance the work.
    """
    values = df.where(F.col(c).isNotNull()).select(F.col(c).alias("value")).distinct()
    if values.schema["value"].dataType.typeName() != "string":
        counted = running_totals(values.withColumn("one", F.lit(1)), "value", ["one"])
        return counted.select("value", F.col("cum_one").alias("code"))
    n = values.count()
    pieces = max(2, -(-n // rows_per_range(df)))
    each = max(1, n // (64 * pieces))
    drawn = sorted((r.value for r in values.where(F.pmod(F.xxhash64("value"), F.lit(each)) == 0).collect()), key=lambda v: v.encode())  # about 64 for each range
    cuts = sorted({drawn[len(drawn) * i // pieces] for i in range(1, pieces)}, key=lambda v: v.encode()) if drawn else []
    ranged = values.withColumn("_range", _position(F.array(*[F.lit(x) for x in cuts]), len(cuts), F.col("value")) if cuts else F.lit(0))
    totals = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = totals.select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("_b"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("value"))
    return ranged.join(before, "_range").select("value", (F.col("_b") + inside).alias("code"))


def _position(cuts: Column, n: int, value: Column) -> Column:
    """How many of the sorted cuts are at most the value, by bisection."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(cuts, at + step - 1) <= value), at + step).otherwise(at))


def conditional_ordinal(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Append ``<c>_ordinal``: 0 for missing, sorted categories from 1."""
    out = df
    for c in cols:
        codes = value_codes(df, c).select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_c_{c}"))
        out = out.join(codes, F.col(c) == F.col(f"_v_{c}"), "left").withColumn(f"{c}_ordinal", F.coalesce(F.col(f"_c_{c}"), F.lit(0))).drop(f"_v_{c}", f"_c_{c}")
    return out


# ---- components and clusters -------------------------------------------------------------------

def standardise_exprs(df: DataFrame, cols: Sequence[str]) -> dict[str, Column]:
    """Median-imputed, standardised expressions of the columns that vary."""
    medians = quantile_values(df, cols, [0.5])
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c][0])) for c in cols if medians[c][0] is not None}
    row = df.agg(*[F.struct(F.avg(v), F.stddev_pop(v)).alias(c) for c, v in filled.items()]).first()
    return {c: (v - F.lit(row[c][0])) / F.lit(row[c][1]) for c, v in filled.items() if row[c][1]}


def standardised(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    exprs = standardise_exprs(df, cols)
    return df.select(*keep, *[v.alias(c) for c, v in exprs.items()])


def fit_pca(frame: DataFrame, cols: Sequence[str], k: int):
    """Component matrix (len(cols) x k) with the largest loading of each component positive, and variance shares."""
    vectors = VectorAssembler(inputCols=list(cols), outputCol="_v").transform(frame.select(*cols))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(vectors)
    components = np.array(model.pc.toArray())
    signs = np.sign(components[np.abs(components).argmax(axis=0), range(components.shape[1])])
    return components * signs, list(model.explainedVariance)


def pca_scores(cols: Sequence[str], components: np.ndarray, scale: Sequence[float] | None = None) -> list[Column]:
    """Score expressions of centred columns: a weighted sum per component, no vectors needed."""
    out = []
    for j in range(components.shape[1]):
        score = F.lit(0.0)
        for i, c in enumerate(cols):
            score = score + F.col(c) * F.lit(float(components[i, j]))
        out.append(score / F.lit(float(scale[j])) if scale is not None else score)
    return out


def add_pca(df: DataFrame, cols: Sequence[str], k: int, prefix: str = "PCA_") -> DataFrame:
    """Append component scores of the standardised columns next to the originals."""
    exprs = standardise_exprs(df, cols)
    names = {c: f"_z_{c}" for c in exprs}
    work = df.withColumns({names[c]: v for c, v in exprs.items()})
    components, _ = fit_pca(work, list(names.values()), k)
    scores = pca_scores(list(names.values()), components)
    return work.withColumns({f"{prefix}{i + 1}": s for i, s in enumerate(scores)}).drop(*names.values())


def fit_kmeans(frame: DataFrame, cols: Sequence[str], k: int, seed: int = 42) -> list[list[float]]:
    vectors = VectorAssembler(inputCols=list(cols), outputCol="_v").transform(frame.select(*cols))
    return [[float(x) for x in c] for c in KMeans(k=k, seed=seed, featuresCol="_v").fit(vectors).clusterCenters()]


def centroid_distances(cols: Sequence[str], centres: Sequence[Sequence[float]]) -> list[Column]:
    out = []
    for centre in centres:
        total = F.lit(0.0)
        for c, m in zip(cols, centre):
            total = total + (F.col(c) - F.lit(m)) * (F.col(c) - F.lit(m))
        out.append(F.sqrt(total))
    return out


def add_kmeans(df: DataFrame, cols: Sequence[str], k: int = 5, distances: bool = True, onehot: bool = False, seed: int = 42) -> DataFrame:
    """Append distances to the cluster centres and, when asked, a one-hot cluster label."""
    exprs = standardise_exprs(df, cols)
    names = {c: f"_z_{c}" for c in exprs}
    work = df.withColumns({names[c]: v for c, v in exprs.items()})
    centres = fit_kmeans(work, list(names.values()), k, seed)
    dist = {f"kmeans_dist_cluster_{i}": d for i, d in enumerate(centroid_distances(list(names.values()), centres))}
    work = work.withColumns(dist)
    if onehot:
        nearest = F.array_position(F.array(*dist), F.array_min(F.array(*dist))) - 1
        work = work.withColumn("_n", nearest).withColumns({f"kmeans_cluster_{i}": (F.col("_n") == i).cast("int") for i in range(k)}).drop("_n")
    return work.drop(*names.values(), *([] if distances else dist))


def append(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Attach engineered columns; names already present are kept as they are."""
    return df.withColumns({n: v for n, v in columns.items() if n not in df.columns})


def array_columns(df: DataFrame, c: str, n: int, prefix: str) -> DataFrame:
    """First n elements of an array (or ML vector) column as double columns."""
    source = vector_to_array(F.col(c)) if df.schema[c].dataType.typeName() == "vectorudt" else F.col(c)
    return df.withColumns({f"{prefix}{i}": F.get(source, F.lit(i)).cast("double") for i in range(n)})
