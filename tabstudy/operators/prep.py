"""Preprocessing learned on training rows and applied anywhere.

``fit`` reads the training rows a few times and keeps constants (JSON-able) and, for encodings of any number of categories, written
tables. ``apply`` is a projection built from the constants and joins with those tables; it never reads the training rows again.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import row_key, uniform
from ..functions.quantiles import quantile_values
from ..functions.storage import written
from . import features as FE
from .outliers import capping_bounds, clip
from .plausibility import conversion_factors, gate, plausible_bounds

CATEGORY_LIMIT = 1000
MISSING_LABEL = "missing"


@dataclass(frozen=True)
class Recipe:
    """What to do with which columns; every field has the default of the plain recipe."""

    numeric: Sequence[str] = ()
    categorical: Sequence[str] = ()
    passthrough: Sequence[str] = ()
    harmonise_units: bool = False
    gate_implausible: bool = False
    impute: str = "median"            # mean | median | constant | iterative
    missing_flags: bool = False
    power: str = "none"               # none | log1p | yeo-johnson
    outliers: str = "none"            # none | percentile | mad
    scale: str = "standard"           # none | standard | robust | minmax
    cat_impute: str = "most_frequent"  # most_frequent | constant
    encode: str = "onehot"            # onehot | ordinal | target
    kmeans: int = 0
    kmeans_onehot: bool = False
    pca: float = 0                    # 0 none, >= 1 a count, < 1 a share of the variance
    whiten: bool = False
    seed: int = 42


# ---- single steps ------------------------------------------------------------------------------

def fill_values(df: DataFrame, cols: Sequence[str], how: str = "median") -> dict[str, float]:
    """Per-column fill constants."""
    if how == "constant":
        return {c: 0.0 for c in cols}
    if how == "mean":
        row = df.agg(*[F.avg(c).alias(str(i)) for i, c in enumerate(cols)]).first()
        return {c: row[i] for i, c in enumerate(cols)}
    return {c: q[0] for c, q in quantile_values(df, list(cols), [0.5]).items()}


def impute(df: DataFrame, fills: Mapping[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in fills.items() if v is not None})


def missing_names(df: DataFrame, cols: Sequence[str]) -> list[str]:
    row = df.agg(*[(F.count(c) < F.count(F.lit(1))).alias(str(i)) for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[i]]


def missing_flags(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({f"missingindicator_{c}": F.col(c).isNull().cast("int") for c in cols})


def log1p_positive(c: str | Column) -> Column:
    v = F.col(c) if isinstance(c, str) else c
    return F.when(v.isNotNull(), F.log1p(F.greatest(v.cast("double"), F.lit(0.0))))


def yeo_johnson(v: Column, lam: float) -> Column:
    up = F.log1p(v) if abs(lam) < 1e-9 else (F.pow(v + 1, F.lit(lam)) - 1) / F.lit(lam)
    down = -F.log1p(-v) if abs(lam - 2) < 1e-9 else -(F.pow(1 - v, F.lit(2 - lam)) - 1) / F.lit(2 - lam)
    return F.when(v >= 0, up).otherwise(down)


def yeo_johnson_inverse(v: Column, lam: float) -> Column:
    up = F.expm1(v) if abs(lam) < 1e-9 else F.pow(v * lam + 1, F.lit(1 / lam)) - 1
    down = 1 - F.exp(-v) if abs(lam - 2) < 1e-9 else 1 - F.pow(1 - (2 - lam) * v, F.lit(1 / (2 - lam)))
    return F.when(v >= 0, up).otherwise(down)


def box_cox(v: Column, lam: float) -> Column:
    return F.log(v) if abs(lam) < 1e-9 else (F.pow(v, F.lit(lam)) - 1) / F.lit(lam)


def box_cox_inverse(v: Column, lam: float) -> Column:
    return F.exp(v) if abs(lam) < 1e-9 else F.pow(v * lam + 1, F.lit(1 / lam))


def power_lambdas(df: DataFrame, cols: Sequence[str], method: str = "yeo-johnson") -> dict[str, float]:
    """Maximum-likelihood exponent per column.

    Each round evaluates one grid of exponents for all columns in a single aggregate and the next
    round refines around the best, so three scans give three decimals.
    """
    transform = yeo_johnson if method == "yeo-johnson" else box_cox
    grids = {c: [round(-2 + 0.2 * i, 6) for i in range(21)] for c in cols}
    best: dict[str, float] = {}
    for step in (0.2, 0.02, 0.002):
        exprs = []
        for i, c in enumerate(cols):
            v = F.col(c).cast("double")
            jacobian = F.signum(v) * F.log1p(F.abs(v)) if method == "yeo-johnson" else F.log(v)
            spreads = F.array(*[F.var_pop(transform(v, lam)) for lam in grids[c]])
            exprs.append(F.struct(F.avg(jacobian).alias("j"), spreads.alias("v")).alias(str(i)))
        row = df.agg(*exprs).first()
        for i, c in enumerate(cols):
            scores = [(-0.5 * math.log(v) + (lam - 1) * row[i].j, -abs(lam - 1), lam) for lam, v in zip(grids[c], row[i].v) if v and v > 0]
            best[c] = max(scores)[2] if scores else 1.0
            grids[c] = [round(best[c] + (k - 10) * step / 10, 6) for k in range(21)]
    return best


def scaling(df: DataFrame, cols: Sequence[str], how: str = "standard") -> dict[str, tuple[float, float]]:
    """{column: (shift, scale)}; a zero scale becomes 1."""
    if how == "robust":
        out = {c: (q[1], q[2] - q[0]) for c, q in quantile_values(df, list(cols), [0.25, 0.5, 0.75]).items() if q[1] is not None}
    else:
        pair = (lambda c: (F.avg(c), F.stddev_pop(c))) if how == "standard" else (lambda c: (F.min(c).cast("double"), (F.max(c) - F.min(c)).cast("double")))
        row = df.agg(*[F.struct(*pair(c)).alias(str(i)) for i, c in enumerate(cols)]).first()
        out = {c: (row[i][0], row[i][1]) for i, c in enumerate(cols) if row[i][0] is not None}
    return {c: (shift, scale if scale else 1.0) for c, (shift, scale) in out.items()}


def rescale(df: DataFrame, constants: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(s)) / F.lit(k) for c, (s, k) in constants.items()})


def modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    """Most frequent value per column, the smallest on ties."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]))
    counts = df.select(cells.alias("_c")).select("_c.*").where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.withColumn("_r", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where("_r = 1")
    return {r["column"]: r["value"] for r in best.collect()}


def categories(df: DataFrame, cols: Sequence[str], limit: int = CATEGORY_LIMIT) -> dict[str, list[str]]:
    """Sorted categories per column; refuses columns with more than ``limit`` (join encodings have no limit)."""
    out = {}
    for c in cols:
        values = [r[0] for r in df.where(F.col(c).isNotNull()).select(F.col(c).cast("string")).distinct().limit(limit + 1).collect()]
        if len(values) > limit:
            raise ValueError(f"{c} has more than {limit} categories; use encode='ordinal' or 'target', which have no limit")
        out[c] = sorted(values)
    return out


def onehot_columns(c: str, values: Sequence[str]) -> dict[str, Column]:
    """0/1 columns; a binary column keeps only its second category; unknown values are all zero."""
    kept = values[1:] if len(values) == 2 else values
    return {f"{c}_{v}": F.coalesce((F.col(c).cast("string") == F.lit(v)).cast("int"), F.lit(0)) for v in kept}


def onehot(df: DataFrame, cats: Mapping[str, Sequence[str]]) -> DataFrame:
    new = {n: e for c, values in cats.items() for n, e in onehot_columns(c, values).items()}
    return df.withColumns(new).drop(*cats)


def ordinal(df: DataFrame, train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace categories by their sorted code from 0; values unseen in training become -1."""
    out = df
    for c in cols:
        codes = FE.value_codes(train, c).select(F.col("value").alias(f"_v_{c}"), (F.col("code") - 1).alias(f"_c_{c}"))
        out = out.join(codes, F.col(c) == F.col(f"_v_{c}"), "left").withColumn(c, F.coalesce(F.col(f"_c_{c}"), F.lit(-1))).drop(f"_v_{c}", f"_c_{c}")
    return out


def label_encode(df: DataFrame, c: str, name: str | None = None) -> DataFrame:
    codes = FE.value_codes(df, c).select(F.col("value").alias("_v"), (F.col("code") - 1).alias("_c"))
    return df.join(codes, F.col(c) == F.col("_v"), "left").withColumn(name or f"{c}_code", F.col("_c")).drop("_v", "_c")


def _shrunk(n: Column, mean: Column, var: Column, overall: Column, overall_var: Column) -> Column:
    """Empirical-Bayes mean: weight n / (n + var / overall_var) on the category's own mean."""
    weight = F.try_divide(n, n + F.try_divide(var, overall_var))
    return F.when(overall_var == 0, overall).otherwise(weight * mean + (1 - weight) * overall)


def target_means(train: DataFrame, c: str, target: str) -> DataFrame:
    """(value, encoding, overall): shrunken target mean of every category."""
    y = F.col(target).cast("double")
    per = train.where(F.col(target).isNotNull()).groupBy(F.col(c).alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v")).withColumn("_k", F.lit(0))
    # Totals from the per-category moments: no second scan, and stable for large means.
    total = per.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g")).withColumn("_k", F.lit(0))
    joined = per.join(F.broadcast(total), "_k")
    spread = joined.agg((F.sum(F.col("n") * (F.col("v") + (F.col("m") - F.col("g")) ** 2)) / F.sum("n")).alias("gv")).withColumn("_k", F.lit(0))
    full = joined.join(F.broadcast(spread), "_k")
    return full.select("value", _shrunk(F.col("n"), F.col("m"), F.col("v"), F.col("g"), F.col("gv")).alias("encoding"), F.col("g").alias("overall"))


def target_encode(df: DataFrame, train: DataFrame, c: str, target: str, name: str | None = None) -> DataFrame:
    """Replace a category by its shrunken mean learned on ``train``; unseen values get the overall mean."""
    table = target_means(train, c, target)
    overall = table.select("overall").first()
    known = table.select(F.col("value").alias("_v"), F.col("encoding").alias("_e"))
    fallback = F.lit(overall[0] if overall else None).cast("double")
    return df.join(known, F.col(c).eqNullSafe(F.col("_v")), "left").withColumn(name or c, F.coalesce("_e", fallback)).drop("_v", "_e")


def target_encode_out_of_fold(train: DataFrame, c: str, target: str, id_col: str, k: int = 5, seed: int = 42, name: str | None = None) -> DataFrame:
    """Encode training rows from the other folds only.

    Sums per (category, fold) are subtracted from the category totals; the join back is on a small
    table of categories by folds.
    """
    fold = F.floor(uniform(row_key(train, id_col), seed) * k).cast("int")
    work = train.withColumn("_f", fold)
    y = F.col(target).cast("double")
    cells = work.where(F.col(target).isNotNull()).groupBy(F.col(c).alias("_v"), "_f").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q"))
    totals = cells.groupBy("_v").agg(*[F.sum(x).alias(f"t{x}") for x in "nsq"])
    per_fold = cells.groupBy("_f").agg(*[F.sum(x).alias(f"f{x}") for x in "nsq"]).withColumn("_k", F.lit(0))
    whole = per_fold.agg(*[F.sum(f"f{x}").alias(f"w{x}") for x in "nsq"]).withColumn("_k", F.lit(0))
    outside = per_fold.join(F.broadcast(whole), "_k").select("_f", *[(F.col(f"w{x}") - F.col(f"f{x}")).alias(f"o{x}") for x in "nsq"])
    on, os_, oq = F.col("on"), F.col("os"), F.col("oq")
    # Every category meets every fold (k rows each), also where it has no labelled row in that fold.
    wide = totals.withColumn("_f", F.explode(F.array(*[F.lit(i) for i in range(k)]))).alias("t")
    cell = cells.alias("c")
    grid = wide.join(cell, F.col("t._v").eqNullSafe(F.col("c._v")) & (F.col("t._f") == F.col("c._f")), "left").select(
        "t.*", *[F.coalesce(F.col(f"c.{x}"), F.lit(0)).alias(x) for x in "nsq"]).join(F.broadcast(outside), "_f")
    n, s, q = (F.col(f"t{x}") - F.col(x) for x in "nsq")
    g = os_ / on
    mean = F.try_divide(s, n)
    encoding = F.when(n > 0, _shrunk(n, mean, q / F.nullif(n, F.lit(0)) - mean * mean, g, oq / on - g * g)).otherwise(g)
    table = grid.select("_v", F.col("_f").alias("_g"), encoding.alias("_e"))
    joined = work.join(table, F.col(c).eqNullSafe(F.col("_v")) & (F.col("_f") == F.col("_g")), "left")
    return joined.withColumn(name or c, F.col("_e")).drop("_v", "_g", "_e", "_f")


# ---- chained imputation ------------------------------------------------------------------------

def fit_chained(df: DataFrame, cols: Sequence[str], rounds: int = 10, tolerance: float = 1e-3) -> dict:
    """Regress every incomplete column on all others, repeatedly, from mean-filled starts.

    One scan per round gathers the cross products of all columns over the rows where each target is
    observed; the small systems are solved on the driver.  All columns of a round use the values of
    the round before.
    """
    cols = list(cols)
    means = fill_values(df, cols, "mean")
    holes = missing_names(df, cols)
    fitted: dict = {"cols": cols, "means": means, "holes": holes, "rounds": []}
    if not holes or len(cols) < 2:
        return fitted
    previous = None
    for _ in range(rounds):
        filled = df.withColumn("_s", _chained_state(fitted))
        centred = {o: F.get("_s", F.lit(i)) for i, o in enumerate(cols)}
        exprs = []
        for j, c in enumerate(holes):
            seen = F.col(c).isNotNull()
            parts = [F.lit(1.0), *[centred[o] for o in cols if o != c], F.col(c) - F.lit(means[c])]
            sums = [F.sum(F.when(seen, a * b)) for i, a in enumerate(parts) for b in parts[i:]]
            exprs.append(F.array(*sums).alias(str(j)))
        row = filled.agg(*exprs).first()
        step = {}
        size = len(cols) + 1
        for j, c in enumerate(holes):
            gram = np.zeros((size, size))
            gram[np.triu_indices(size)] = row[j]
            gram = gram + np.triu(gram, 1).T
            ridge = 1e-9 * np.trace(gram[:-1, :-1]) / (size - 1)
            beta = np.linalg.solve(gram[:-1, :-1] + ridge * np.eye(size - 1), gram[:-1, -1])
            step[c] = [float(b) for b in beta]
        fitted["rounds"].append(step)
        flat = np.concatenate([step[c] for c in holes])
        if previous is not None and np.max(np.abs(flat - previous)) < tolerance * max(1.0, np.max(np.abs(previous))):
            break
        previous = flat
    return fitted


def _chained_state(fitted: Mapping) -> Column:
    """Array of centred, filled values: the rounds folded over each row inside one expression."""
    cols, means = fitted["cols"], fitted["means"]
    raw = F.array(*[F.col(c).cast("double") - F.lit(means[c]) for c in cols])
    start = F.array(*[F.coalesce(F.col(c).cast("double") - F.lit(means[c]), F.lit(0.0)) for c in cols])
    if not fitted["rounds"]:
        return start
    rounds = []
    for step in fitted["rounds"]:
        matrix = []
        for c in cols:
            weights = iter(step[c][1:]) if c in step else None
            matrix.append([step[c][0] if c in step else 0.0] + [0.0 if o == c or weights is None else float(next(weights)) for o in cols])
        rounds.append(matrix)

    def advance(state, matrix):
        def value(row, j):
            terms = F.zip_with(F.slice(row, 2, len(cols)), state, lambda w, x: w * x)
            return F.coalesce(F.get(raw, j), F.get(row, F.lit(0)) + F.aggregate(terms, F.lit(0.0), lambda t, x: t + x))
        return F.transform(matrix, value)

    return F.aggregate(F.lit(rounds), start, advance)


def apply_chained(df: DataFrame, fitted: Mapping) -> DataFrame:
    """Replace missing values by the result of the learned rounds; a pure projection."""
    filled = df.withColumn("_s", _chained_state(fitted))
    return filled.withColumns({c: F.get("_s", F.lit(i)) + F.lit(fitted["means"][c]) for i, c in enumerate(fitted["cols"])}).drop("_s")


# ---- the whole recipe --------------------------------------------------------------------------

@dataclass
class FittedPrep:
    recipe: Recipe
    steps: list = field(default_factory=list)  # (operation, constants) in order
    names: list = field(default_factory=list)
    tables: dict = field(default_factory=dict)  # column -> written table of its encoding
    paths: dict = field(default_factory=dict)
    target: str | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        """The prepared table. Encodings are read from their written tables, so no training row is read again."""
        out = df
        for op, k in self.steps:
            out = _apply_step(out, op, k, self)
        return out

    def apply_to_training(self, train: DataFrame, id_col: str) -> DataFrame:
        """The prepared training rows: a target encoding comes from the other folds only, never from a row's own target."""
        out = train
        for op, k in self.steps:
            if op == "target":
                for c in k:
                    out = target_encode_out_of_fold(out, c, self.target, id_col)
            else:
                out = _apply_step(out, op, k, self)
        return out

    def to_json(self) -> str:
        """Constants, and the places of the written encodings."""
        return json.dumps({"recipe": asdict(self.recipe), "steps": self.steps, "names": self.names, "target": self.target, "encodings": self.paths})

    @staticmethod
    def from_json(spark, text: str) -> FittedPrep:
        k = json.loads(text)
        tables = {c: spark.read.parquet(p) for c, p in k["encodings"].items()}
        return FittedPrep(Recipe(**k["recipe"]), [tuple(s) for s in k["steps"]], k["names"], tables, k["encodings"], k["target"])

    def describe(self, spark) -> DataFrame:
        """(position, step, columns): what is done, in order."""
        rows = [(i, op, ", ".join(k if isinstance(k, (list, dict)) else [str(k)])) for i, (op, k) in enumerate(self.steps)]
        return spark.createDataFrame(rows, "position int, step string, columns string")

    def feature_names(self, spark) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.names)), "position int, feature string")


def _apply_step(df: DataFrame, op: str, k, fitted: FittedPrep) -> DataFrame:
    if op == "harmonise":
        return df.withColumns({c: F.col(c) * F.lit(f) for c, f in k.items()})
    if op == "gate":
        return gate(df, k)
    if op == "missing_flags":
        return missing_flags(df, k)
    if op == "impute":
        return impute(df, k)
    if op == "chained":
        return apply_chained(df, k)
    if op == "log1p":
        return df.withColumns({c: log1p_positive(c) for c in k})
    if op == "yeo-johnson":
        return df.withColumns({c: yeo_johnson(F.col(c), lam) for c, lam in k.items()})
    if op == "cap":
        return df.withColumns({c: clip(c, *lim) for c, lim in k.items()})
    if op == "scale":
        return rescale(df, k)
    if op == "fill_category":
        return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(v)) for c, v in k.items()})
    if op == "onehot":
        return onehot(df, k)
    if op == "ordinal":
        out = df
        for c in k:
            codes = fitted.tables[c].select(F.col("value").alias("_v"), (F.col("code") - 1).alias("_c"))
            out = out.join(codes, F.col(c) == F.col("_v"), "left").withColumn(c, F.coalesce(F.col("_c"), F.lit(-1))).drop("_v", "_c")
        return out
    if op == "target":
        out = df
        for c, overall in k.items():
            known = fitted.tables[c].select(F.col("value").alias("_v"), F.col("encoding").alias("_e"))
            out = out.join(known, F.col(c).eqNullSafe(F.col("_v")), "left").withColumn(c, F.coalesce("_e", F.lit(overall))).drop("_v", "_e")
        return out
    if op == "kmeans":
        dist = dict(zip(k["names"], FE.centroid_distances(k["cols"], k["centres"])))
        out = df.withColumns(dist)
        if k["onehot"]:
            nearest = F.array_position(F.array(*dist), F.array_min(F.array(*dist))) - 1
            out = out.withColumns({n: (nearest == i).cast("int") for i, n in enumerate(k["onehot"])})
        return out.drop(*k["cols"])
    if op == "pca":
        centred = df.withColumns({c: F.col(c) - F.lit(m) for c, m in zip(k["cols"], k["means"])})
        scores = FE.pca_scores(k["cols"], np.array(k["components"]), k["scale"])
        return centred.withColumns(dict(zip(k["names"], scores))).drop(*k["cols"])
    raise ValueError(op)


def fit(train: DataFrame, recipe: Recipe, target: str | None = None) -> FittedPrep:
    """Learn every constant of the recipe on the training rows, step by step."""
    fitted = FittedPrep(recipe)
    numeric, through, cats = list(recipe.numeric), list(recipe.passthrough), list(recipe.categorical)
    work = train

    def step(op, constants):
        nonlocal work
        fitted.steps.append((op, constants))
        work = _apply_step(work, op, constants, fitted)

    flags: list[str] = []
    if numeric:
        if recipe.harmonise_units:
            factors = conversion_factors(work, numeric)
            if factors:
                step("harmonise", factors)
        if recipe.gate_implausible:
            limits = plausible_bounds(numeric)
            if limits:
                step("gate", limits)
        if recipe.missing_flags:
            flags = missing_names(work, numeric)
            step("missing_flags", flags)
        if recipe.impute == "iterative":
            step("chained", fit_chained(work, numeric))
        else:
            step("impute", fill_values(work, numeric, recipe.impute))
        if recipe.power == "log1p":
            step("log1p", numeric)
        elif recipe.power == "yeo-johnson":
            step("yeo-johnson", power_lambdas(work, numeric))
        if recipe.outliers != "none":
            step("cap", capping_bounds(work, numeric, recipe.outliers))
    if through:
        step("impute", fill_values(work, through, recipe.impute if recipe.impute in ("mean", "constant") else "median"))
    if recipe.scale != "none" and numeric + through:
        step("scale", scaling(work, numeric + through, recipe.scale))
    names = [*numeric, *[f"missingindicator_{c}" for c in flags]]
    if cats:
        step("fill_category", modes(work, cats) if recipe.cat_impute == "most_frequent" else {c: MISSING_LABEL for c in cats})
        if recipe.encode == "onehot":
            values = categories(work, cats)
            names += [n for c in cats for n in onehot_columns(c, values[c])]
            step("onehot", values)
        elif recipe.encode == "ordinal":
            names += cats
            for c in cats:
                fitted.tables[c], fitted.paths[c] = written(FE.value_codes(work, c), "codes")
            step("ordinal", cats)
        else:
            if target is None:
                raise ValueError("target encoding needs the target")
            names += cats
            fitted.target = target
            for c in cats:
                fitted.tables[c], fitted.paths[c] = written(target_means(work, c, target), "encoding")
            step("target", {c: (fitted.tables[c].select("overall").first() or [0.0])[0] for c in cats})
    names += through
    if recipe.kmeans:
        centres = FE.fit_kmeans(work, names, recipe.kmeans, recipe.seed)
        new = [f"kmeans_dist_cluster_{i}" for i in range(recipe.kmeans)]
        hot = [f"kmeans_cluster_{i}" for i in range(recipe.kmeans)] if recipe.kmeans_onehot else []
        step("kmeans", {"cols": names, "centres": centres, "names": new, "onehot": hot})
        names = new + hot
    if recipe.pca:
        row = work.agg(*[F.avg(c).alias(str(i)) for i, c in enumerate(names)]).first()
        means = [float(x) for x in row]
        centred = work.select(*[(F.col(c) - F.lit(m)).alias(c) for c, m in zip(names, means)])
        k = min(int(recipe.pca), len(names)) if recipe.pca >= 1 else len(names)
        components, shares = FE.fit_pca(centred, names, k)
        if recipe.pca < 1:
            k = int(np.searchsorted(np.cumsum(shares), recipe.pca) + 1)
            components = components[:, :min(k, components.shape[1])]
        scale = None
        if recipe.whiten:
            spread = centred.agg(*[F.stddev_samp(s).alias(str(i)) for i, s in enumerate(FE.pca_scores(names, components))]).first()
            scale = [float(x) or 1.0 for x in spread]
        new = [f"pca_{i}" for i in range(components.shape[1])]
        step("pca", {"cols": names, "means": means, "components": components.tolist(), "scale": scale, "names": new})
        names = new
    fitted.names = names
    return fitted


# Models whose inputs must be scaled, and models meant to be read term by term.
NEEDS_SCALING = ("ridge", "lasso", "elasticnet", "logreg", "huber", "knn", "linear_svc", "mlp")


def recipe_for_model(recipe: Recipe, model: str, interpretability: str = "balanced") -> Recipe:
    """Scaling is switched on for models that need it; high interpretability drops power, components and clusters."""
    out = recipe
    if model in NEEDS_SCALING and out.scale == "none":
        out = replace(out, scale="standard")
    if interpretability == "high":
        out = replace(out, power="none", pca=0, kmeans=0)
    return out


def basic(df: DataFrame, target: str, features: Sequence[str], id_col: str, shares: Sequence[float] = (0.8, 0.0), seed: int = 42) -> DataFrame:
    """One-shot preparation: drop all-null rows, median fill and standard scale on train, and the split column."""
    from .splits import random_split

    clean = df.dropna(how="all", subset=list(features)).where(F.col(target).isNotNull())
    split = random_split(clean, id_col, shares, seed)
    fitted = fit(split.where("split = 'train'"), Recipe(numeric=features))
    return fitted.apply(split).select(id_col, *features, target, "split")


# ---- target ------------------------------------------------------------------------------------

@dataclass(frozen=True)
class TargetTransform:
    method: str
    lam: float | None = None

    def forward(self, y: Column) -> Column:
        if self.method == "log1p":
            return F.log1p(y)
        if self.method == "yeo-johnson":
            return yeo_johnson(y, self.lam)
        return box_cox(y, self.lam) if self.method == "box-cox" else y

    def inverse(self, z: Column) -> Column:
        if self.method == "log1p":
            return F.expm1(z)
        if self.method == "yeo-johnson":
            return yeo_johnson_inverse(z, self.lam)
        return box_cox_inverse(z, self.lam) if self.method == "box-cox" else z


def fit_target_transform(train: DataFrame, target: str, method: str) -> TargetTransform:
    """Check the training target's domain and learn the exponent where there is one."""
    if method == "none":
        return TargetTransform(method)
    low = train.agg(F.min(target)).first()[0]
    if method == "log1p":
        if low is not None and low <= -1:
            raise ValueError("log1p needs a target above -1")
        return TargetTransform(method)
    if method == "box-cox" and low is not None and low <= 0:
        raise ValueError("box-cox needs a positive target")
    return TargetTransform(method, power_lambdas(train.select(target), [target], method)[target])
