"""Bootstrap by weight vectors, and corrected intervals from leave-one-out values, against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabstudy.functions import resample
from tabstudy.functions.hashing import poisson_weight
from tabstudy.operators import evaluate as E


def rows(n, seed=1, classes=False):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n).astype(float) if classes else rng.normal(10, 3, n)
    score = np.round(rng.random(n) * 0.6 + 0.3 * (y if classes else 0), 2)
    return [(int(i * 7 + 3), float(a), float(a + rng.normal(0, 1)), float(s), "g" + str(i % 3)) for i, (a, s) in enumerate(zip(y, score))]


def table(spark, data):
    return spark.createDataFrame(data, "id long, y double, pred double, proba double, g string").repartition(5)


def test_weights_are_those_of_the_portable_hash(spark):
    keys = [0, 5, 2**31 + 9, 2**52 + 1]
    want = spark.createDataFrame([(k, r) for k in keys for r in range(7)], "k long, r int").select("k", "r", poisson_weight(F.col("k"), F.col("r")).alias("w")).collect()
    w = resample.poisson_weights(np.array(keys), 7)
    assert {(r.k, r.r): r.w for r in want} == {(k, r): int(w[i, r]) for i, k in enumerate(keys) for r in range(7)}


@pytest.mark.parametrize("size", [3, 10_000])
def test_replicates_against_loops(spark, monkeypatch, size):
    monkeypatch.setattr(resample, "RANGE_ROWS", 40 if size == 3 else size)
    monkeypatch.setattr(resample, "ROWS", size)
    data = rows(211, classes=True)
    df = table(spark, data)
    w = resample.poisson_weights(np.array([r[0] for r in data]), 20)
    y, score, e = np.array([r[1] for r in data]), np.array([r[3] for r in data]), np.abs([r[1] - r[2] for r in data])
    auc = resample.replicate_auc(df, F.col("id"), "y", "proba", 20)
    medians = resample.replicate_medians(df, F.col("id"), F.abs(F.col("y") - F.col("pred")), 20)
    sums = {(r.g, r.replicate): (r.s0, r.s1) for r in resample.replicate_sums(df, F.col("id"), [F.lit(1.0), F.col("proba")], 20, ["g"]).collect()}
    for b in range(20):
        k = w[:, b]
        pairs = sum(k[i] * k[j] * ((score[i] > score[j]) + (score[i] == score[j]) / 2) for i in np.flatnonzero(y == 1) for j in np.flatnonzero(y == 0))
        assert abs(auc[b] - pairs / (k[y == 1].sum() * k[y == 0].sum())) < 1e-12
        assert abs(medians[b] - np.median(np.repeat(e, k))) < 1e-12
        for g in ("g0", "g1", "g2"):
            own = np.array([r[4] == g for r in data])
            assert sums[g, b] == pytest.approx((k[own].sum(), (k * score)[own].sum()))


@pytest.mark.parametrize("n", [40, 41])
def test_accelerations_are_those_of_the_jackknife(spark, n):
    def bend(values):
        d = np.mean(values) - np.array(values)
        return (d**3).sum() / (6 * (d**2).sum() ** 1.5)

    def metrics(r):
        y, p = np.array([x[1] for x in r]), np.array([x[2] for x in r])
        e = y - p
        return {"rmse": np.sqrt(np.mean(e**2)), "mae": np.mean(np.abs(e)), "r2": 1 - (e**2).sum() / ((y - y.mean()) ** 2).sum(), "median_ae": np.median(np.abs(e))}

    data = rows(n, 3)
    out = {r.metric: r for r in E.bootstrap_intervals(table(spark, data), "id", replicates=30).collect()}
    left = [metrics(data[:i] + data[i + 1:]) for i in range(n)]
    for m, v in metrics(data).items():
        assert abs(out[m].estimate - v) < 1e-9 and abs(out[m].acceleration - bend([x[m] for x in left])) < 1e-6
        assert out[m].ci_lower <= out[m].ci_upper

    def scores(r):
        y, p, s = (np.array(v) for v in zip(*[(x[1], float(x[3] > 0.5), x[3]) for x in r]))
        f1 = sum(2 * ((y == c) & (p == c)).sum() / ((y == c).sum() + (p == c).sum()) * (y == c).sum() for c in (0, 1)) / len(y)
        a, b = s[y == 1], s[y == 0]
        return {"accuracy": np.mean(y == p), "f1": f1, "auc": np.mean((a[:, None] > b[None, :]) + (a[:, None] == b[None, :]) / 2)}

    data = rows(n, 4, classes=True)
    df = table(spark, data).withColumn("label", (F.col("proba") > 0.5).cast("double"))
    out = {r.metric: r for r in E.bootstrap_intervals(df, "id", "y", "label", 30, task="classification", score="proba").collect()}
    left = [scores(data[:i] + data[i + 1:]) for i in range(n)]
    for m, v in scores(data).items():
        assert abs(out[m].estimate - v) < 1e-9 and abs(out[m].acceleration - bend([x[m] for x in left])) < 1e-6


def test_interval_limits():
    b = np.arange(101.0)
    low, high = E.bca_interval(50.0, b, 0.0)
    assert abs(low - 2.5) < 0.3 and abs(high - 97.5) < 0.3
    assert E.bca_interval(-5.0, b, 0.0) == (0.0, 0.0) and E.bca_interval(200.0, b, 0.0) == (100.0, 100.0)
    assert E.bca_interval(3.0, [3.0] * 9, 0.1) == (3.0, 3.0) and all(math.isnan(v) for v in E.bca_interval(1.0, [], 0.0))
    assert E.bca_interval(50.0, b, 0.9)[1] == 100.0
