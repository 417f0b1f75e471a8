"""How results move with the seed and with single features."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import fit, in_parallel
from .splits import random_split

STABLE, MODERATE = 0.03, 0.05


def _metric(model, test: DataFrame, target: str, task: str) -> float:
    gap = F.col(target).cast("double") - F.col("pred")
    score = F.sqrt(F.avg(gap * gap)) if task == "regression" else F.avg((gap == 0).cast("double"))
    return float(model.predict(test).agg(score).first()[0])


def seeds(df: DataFrame, key: str, features: Sequence[str], target: str, task: str, id_col: str, count: int = 5, first: int = 42, **params) -> DataFrame:
    """(seed, score): split, fit and score again under other seeds."""
    rows = df.persist()

    def run(seed):
        split = random_split(rows, id_col, (0.8, 0.0), seed)
        model = fit(key, split.where("split = 'train'"), features, target, task, seed, **params)
        return seed, _metric(model, split.where("split = 'test'"), target, task)

    results = in_parallel([lambda s=first + i: run(s) for i in range(count)])
    rows.unpersist()
    return df.sparkSession.createDataFrame(results, "seed int, score double")


def over_seeds(spark, run: Callable[[int], float], count: int = 5, first: int = 42) -> DataFrame:
    """(seed, score) of a user function from a seed to a score."""
    return spark.createDataFrame(in_parallel([lambda s=first + i: (s, float(run(s))) for i in range(count)]), "seed int, score double")


def seed_stability(scores: DataFrame) -> DataFrame:
    """(n, mean, std, range, relative, verdict): stable under 3% relative SD, moderate under 5%."""
    t = scores.agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), (F.max("score") - F.min("score")).alias("range"))
    relative = F.abs(F.try_divide(F.col("std"), F.col("mean")))
    return t.withColumn("relative", relative).withColumn("verdict", F.when(F.col("relative") < STABLE, "stable").when(F.col("relative") < MODERATE, "moderate").otherwise("unstable"))


def feature_dropout(df: DataFrame, key: str, features: Sequence[str], target: str, task: str, id_col: str, seed: int = 42, **params) -> DataFrame:
    """(dropped, score, baseline, impact): refit without each feature, largest loss of quality first."""
    split = random_split(df, id_col, (0.8, 0.0), seed).persist()
    train, test = split.where("split = 'train'"), split.where("split = 'test'")

    def run(out):
        kept = [f for f in features if f != out]
        return out, _metric(fit(key, train, kept, target, task, seed, **params), test, target, task)

    results = in_parallel([lambda o=o: run(o) for o in [None, *features]])
    split.unpersist()
    base = results[0][1]
    worse = 1.0 if task == "regression" else -1.0
    rows = [(f, s, base, worse * (s - base)) for f, s in results[1:]]
    return df.sparkSession.createDataFrame(rows, "dropped string, score double, baseline double, impact double").orderBy(F.desc("impact"), "dropped")


def summarise(scores: DataFrame, score: str = "score", baseline: str = "baseline") -> DataFrame:
    """(baseline, n, mean, std, low, high, within_10): spread of scores around a baseline."""
    near = F.abs(F.col(score) - F.col(baseline)) <= 0.1 * F.abs(F.col(baseline))
    return scores.agg(F.max(baseline).alias("baseline"), F.count(score).alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"),
                      F.min(score).alias("low"), F.max(score).alias("high"), F.avg(near.cast("double")).alias("within_10"))
