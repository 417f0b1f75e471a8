"""Which features a fitted model relies on, and how."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import mix, mixed, row_key
from ..functions.quantiles import quantile_values
from ..functions.storage import written
from .models import Fitted

ROWS_PER_BUCKET = 50_000
POINTS_PER_TASK = 10_000_000  # predictions of a task for pairs of features


def _loss(task: str) -> Column:
    gap = F.col("_y") - F.col("pred")
    return F.avg(gap * gap) if task == "regression" else F.avg((gap != 0).cast("double"))


def permutation(model: Fitted, df: DataFrame, target: str, id_col: str, repeats: int = 5, seed: int = 42) -> DataFrame:
    """(feature, importance, std): growth of the loss when a feature is shuffled.

    Rows are dealt once into random buckets of bounded size and stand there in a ring of random order. Each
    repeat turns the rings by its own shift, so that every row takes the feature from another row; all
    repeats come from one pass over a bucket, and all (feature, repeat) copies are scored in one pass.
    """
    n = df.count()
    buckets = max(1, -(-n // ROWS_PER_BUCKET))
    features = model.features
    types = {f.name: f.dataType.simpleString() for f in df.select(*features).schema}
    base = df.select(row_key(df, id_col).alias("_k"), F.col(target).cast("double").alias("_y"), *[F.col(f).alias(f"_own{i}") for i, f in enumerate(features)])
    dealt = base.withColumns({"_b": mix(F.col("_k"), seed) % buckets, "_o": mix(F.col("_k"), seed + 1000)})
    shifts = [mixed(i, seed) for i in range(repeats)]
    names = ["_repeat", "_y", *[f"_own{i}" for i in range(len(features))], *[f"_other{i}" for i in range(len(features))]]

    def turned(ring: pa.Table) -> pa.Table:
        ring = ring.sort_by([("_o", "ascending"), ("_k", "ascending")])
        own, m = [ring.column(f"_own{i}") for i in range(len(features))], ring.num_rows
        parts = []
        for i, shift in enumerate(shifts):
            shift = 1 + shift % (m - 1) if m > 1 else 0
            other = [pa.chunked_array([*c.slice(shift).chunks, *c.slice(0, shift).chunks], c.type) for c in own]
            parts.append(pa.Table.from_arrays([pa.chunked_array([pa.array(np.full(m, i, dtype=np.int32))]), ring.column("_y"), *own, *other], names))
        return pa.concat_tables(parts)

    kinds = [types[f] for f in features]
    schema = ", ".join(f"{c} {k}" for c, k in zip(names, ["int", "double", *kinds, *kinds]))
    partnered = dealt.groupBy("_b").applyInArrow(turned, schema)
    variants = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), *[F.col(f"_other{i}" if c == f else f"_own{i}").alias(c) for i, c in enumerate(features)]) for f in features]))
    rows = partnered.select("_repeat", "_y", variants.alias("_r")).select("_repeat", "_y", "_r.*")
    # Both prediction passes read the same expressions, so the unshuffled loss needs no extra copy.
    shuffled = model.predict(rows).groupBy("feature", "_repeat").agg(_loss(model.task).alias("loss"))
    plain = model.predict(df.select(F.col(target).cast("double").alias("_y"), *features)).agg(_loss(model.task).alias("base")).withColumn("_j", F.lit(0))
    joined = shuffled.withColumn("_j", F.lit(0)).join(F.broadcast(plain), "_j")
    gain = F.col("loss") - F.col("base")
    return joined.groupBy("feature").agg(F.avg(gain).alias("importance"), F.stddev_pop(gain).alias("std")).orderBy(F.desc("importance"), "feature")


def grid_values(df: DataFrame, features: Sequence[str], size: int) -> dict[str, list[float]]:
    """Evenly spaced values between the 5th and 95th percentile."""
    out = {}
    for f, (low, high) in quantile_values(df, list(features), [0.05, 0.95]).items():
        out[f] = sorted({low + (high - low) * i / (size - 1) for i in range(size)})
    return out


def _mean_at(model: Fitted, df: DataFrame, points: Sequence[Mapping[str, float]]) -> DataFrame:
    """(_p, m): mean prediction when all rows take the values of point ``_p``. A row is repeated for the number of a point alone; its values are looked up."""
    own = lambda f: F.get(F.array(*[F.lit(x.get(f)).cast("double") for x in points]), F.col("_p"))
    named = {f for x in points for f in x}
    rows = df.select(*model.features, F.explode(F.array(*[F.lit(i) for i in range(len(points))])).alias("_p")).select(
        "_p", *[F.coalesce(own(f), F.col(f).cast("double")).alias(f) if f in named else F.col(f) for f in model.features])
    target = F.coalesce("proba", "pred") if model.task == "classification" else F.col("pred")
    return model.predict(rows).groupBy("_p").agg(F.avg(target).alias("m"))


def _mean_at_pairs(model: Fitted, df: DataFrame, pairs: Sequence[tuple[str, str]], grids: Mapping[str, Sequence[float]]) -> DataFrame:
    """(_pair, _i, m): mean prediction when all rows take the values of grid point ``_i`` of pair ``_pair``.

    A point replaces both features of its pair, so rows alike in all others are scored once and count as many.
    """
    types = dict(df.dtypes)
    held = lambda f, pair: (F.lit(None).cast(types[f]) if f in pair else F.col(f)).alias(f)
    alike = df.select(F.inline(F.array(*[F.struct(F.lit(k).alias("_pair"), *[held(f, pair) for f in model.features]) for k, pair in enumerate(pairs)])))
    alike, _path = written(alike.groupBy("_pair", *model.features).agg(F.count(F.lit(1)).alias("_n")), "alike")
    of_pair = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("_pair"))
    counts = [len(grids[a]) * len(grids[b]) for a, b in pairs]
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-alike.count() * max(counts) // POINTS_PER_TASK))
    repeated = alike.repartition(tasks, "_pair", *model.features).withColumn("_i", F.explode(F.array(*[F.lit(i) for i in range(max(counts))])))
    repeated = repeated.where(F.col("_i") < of_pair(counts)).withColumn("_width", of_pair([len(grids[b]) for _, b in pairs]))

    def value(f: str) -> Column:
        if f not in grids:
            return F.col(f)
        at = lambda i: F.get(F.array(*[F.lit(float(v)) for v in grids[f]]), i.cast("int"))
        first, second = of_pair([a == f for a, _ in pairs]), of_pair([b == f for _, b in pairs])
        return F.when(first, at(F.floor(F.col("_i") / F.col("_width")))).when(second, at(F.col("_i") % F.col("_width"))).otherwise(F.col(f).cast("double")).alias(f)

    target = F.coalesce("proba", "pred") if model.task == "classification" else F.col("pred")
    scored = model.predict(repeated.select("_pair", "_i", "_n", *[value(f) for f in model.features])).select("_pair", "_i", "_n", target.alias("_m"))
    mean = F.try_divide(F.sum(F.col("_m") * F.col("_n")), F.sum(F.when(F.col("_m").isNotNull(), F.col("_n"))))
    return scored.groupBy("_pair", "_i").agg(mean.alias("m"))


def partial_dependence(model: Fitted, df: DataFrame, features: Sequence[str], size: int = 20) -> DataFrame:
    """(feature, value, mean_prediction): rows are repeated per grid value by explode and scored once."""
    grids = grid_values(df, features, size)
    points = [(f, float(v)) for f in features for v in grids[f]]
    names = df.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(points)], "_p int, feature string, value double")
    cells = _mean_at(model, df, [{f: v} for f, v in points])
    return cells.join(F.broadcast(names), "_p").select("feature", "value", F.col("m").alias("mean_prediction")).orderBy("feature", "value")


def partial_dependence_2d(model: Fitted, df: DataFrame, features: Sequence[str], size: int = 15) -> DataFrame:
    """(a, b, value_a, value_b, mean_prediction, interaction): interaction is what the two main effects leave over."""
    if len(features) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, value_a double, value_b double, mean_prediction double, interaction double")
    # Quantiles take many scans: of the columns at hand, not of what made the table.
    rows, _path = written(df.select(*dict.fromkeys([*features, *model.features])), "dependence")
    grids, pairs = grid_values(rows, features, size), list(combinations(features, 2))
    spark = df.sparkSession
    points = [(k, i, a, b, float(u), float(v)) for k, (a, b) in enumerate(pairs) for i, (u, v) in enumerate(product(grids[a], grids[b]))]
    names = spark.createDataFrame(points, "_pair int, _i int, a string, b string, value_a double, value_b double")
    cells = _mean_at_pairs(model, rows, pairs, grids).join(F.broadcast(names), ["_pair", "_i"])
    mean = lambda *k: F.avg("m").over(Window.partitionBy("a", "b", *k))
    return cells.select("a", "b", "value_a", "value_b", F.col("m").alias("mean_prediction"),
                        (F.col("m") - mean("value_a") - mean("value_b") + mean()).alias("interaction"))


def interaction_strength(surface: DataFrame) -> DataFrame:
    """(a, b, magnitude, range, strength) of 2-D partial dependence."""
    t = surface.groupBy("a", "b").agg(F.max(F.abs("interaction")).alias("magnitude"), (F.max("mean_prediction") - F.min("mean_prediction")).alias("range"))
    ratio = F.coalesce(F.try_divide(F.col("magnitude"), F.col("range")), F.lit(0.0))
    return t.withColumn("strength", F.when(F.col("magnitude") < 1e-6, "additive").when(ratio > 0.3, "strong").when(ratio > 0.1, "moderate").otherwise("mild"))


def shapley_linear(coefficients: Mapping[str, float], df: DataFrame, background: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Append ``shap_<f>`` = w (x - background mean) of a linear model."""
    names = [f for f in coefficients if f != "(intercept)"]
    row = background.agg(*[F.avg(f).alias(str(i)) for i, f in enumerate(names)]).first()
    return df.select(*(keep or df.columns), *[(F.lit(float(coefficients[f])) * (F.col(f) - F.lit(float(row[i])))).alias(f"shap_{f}") for i, f in enumerate(names)])


def shapley_sampled(model: Fitted, df: DataFrame, id_col: str, background: DataFrame, orderings: int = 16, background_rows: int = 8, seed: int = 42) -> DataFrame:
    """(id, feature, value): Shapley values from sampled feature orderings and background rows.

    Every (row, ordering) walks from a background row to the row itself, one feature at a time. A step has
    the row before and after it, so its gain needs no other row; both are scored and the gains of a row's id
    are added up before they travel. Steps of a walk add up to prediction minus background prediction.
    Rows that share an id share its walks, so their mean gain is divided among them.
    """
    import random

    rng = random.Random(seed)
    features = model.features
    k = row_key(background, None)
    refs = [tuple(float(r[f]) for f in features) for r in background.select(*features, mix(k, seed).alias("_h")).orderBy("_h", *features).limit(background_rows).collect()]
    steps = []
    for o in range(orderings):
        order = rng.sample(range(len(features)), len(features))
        ref = refs[o % len(refs)]
        point = lambda have: F.struct(*[(F.col(f).cast("double") if i in have else F.lit(ref[i])).alias(f"_{i}") for i, f in enumerate(features)])
        for s, i in enumerate(order):
            steps.append(F.struct(F.lit(i).alias("_step"), point(set(order[:s])).alias("_from"), point(set(order[:s + 1])).alias("_to")))
    walks = df.select(F.col(id_col).alias("_id"), *features).select("_id", F.inline(F.array(*steps)))
    at = lambda end: [F.col(f"{end}._{i}").alias(f) for i, f in enumerate(features)]
    target = F.coalesce("proba", "pred") if model.task == "classification" else F.col("pred")
    before = model.predict(walks.select("_id", "_step", "_to", *at("_from"))).select("_id", "_step", "_to", target.alias("_base"))
    after = model.predict(before.select("_id", "_step", "_base", *at("_to"))).select("_id", "_step", (target - F.col("_base")).alias("_gain"))
    sums = after.groupBy("_id").agg(F.count(F.lit(1)).alias("_n"), *[F.avg(F.when(F.col("_step") == i, F.col("_gain"))).alias(f"_m{i}") for i in range(len(features))])
    rows = F.col("_n") / (orderings * len(features))
    return sums.select(F.col("_id").alias("id"), F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), (F.col(f"_m{i}") / rows).alias("value")) for i, f in enumerate(features)])))


def shapley_rank(values: DataFrame, source: Mapping[str, str] | None = None) -> DataFrame:
    """(feature, mean_abs) over rows of (id, feature, value); encoded columns can be mapped to their source."""
    name = F.col("feature")
    if source:
        name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in source.items() for v in kv]), name), name)
    per_row = values.groupBy("id", name.alias("feature")).agg(F.sum("value").alias("value"))
    return per_row.groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs")).orderBy(F.desc("mean_abs"), "feature")
