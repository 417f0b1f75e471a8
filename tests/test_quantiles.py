"""Whole columns narrowed over Arrow batches, and information counted there."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabstudy.functions import quantiles as Q
from tabstudy.operators import relations as R

INF = float("inf")


def _table():
    rng, n = np.random.default_rng(1), 3000
    table = pd.DataFrame({
        "normal": rng.normal(size=n), "few": rng.integers(0, 7, n).astype(float), "wide": np.exp(rng.normal(size=n) * 40) * rng.choice([-1, 1], n),
        "ends": rng.choice([INF, -INF, 0.5, 1.5], n), "zeros": rng.choice([0.0, -0.0], n), "constant": np.full(n, 3.0),
        "extreme": rng.choice([0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308], n), "tail": np.r_[np.ones(n - 2), 2.0, 9.0], "none": np.full(n, np.nan)})
    table.loc[::7, "normal"] = None
    return table


@pytest.mark.parametrize("listed", [Q.LISTED, 0])
def test_whole_columns_are_narrowed_without_a_row_for_each_value(spark, monkeypatch, listed):
    table, probs = _table(), [0, 0.01, 0.1, 0.25, 1 / 3, 0.5, 0.75, 0.9, 0.999, 1]
    monkeypatch.setattr(Q, "LISTED", listed)
    monkeypatch.setattr(Q, "_long", lambda *_: pytest.fail("every row was repeated for every column"))
    df = spark.createDataFrame(table).repartition(5)
    got = {r["column"]: (r["n"], r["q"]) for r in Q.exact_quantiles(df, list(table.columns), probs).collect()}
    for c in table.columns:
        v = np.sort(table[c].dropna().to_numpy())
        assert got[c][0] == len(v)
        for p, q in zip(probs, got[c][1] or []):
            at = (len(v) - 1) * p
            a, b, share = v[int(at)], v[min(int(at) + 1, len(v) - 1)], at - int(at)
            assert q == (a if share == 0 or a == b else (1 - share) * a + share * b), (c, p)
    assert got["none"] == (0, None)


def test_bits_keep_the_order_of_doubles():
    v = np.array([-INF, -1.7e308, -1.0, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1.7e308, INF])
    bits = Q._bits(v)
    assert (np.diff(bits) > 0).tolist() == [True] * 4 + [False] + [True] * 4
    assert (Q._values(bits) == v).all()


@pytest.mark.parametrize("classes", [R.CLASSES, 2])
def test_information_is_counted_without_a_row_for_each_feature(spark, monkeypatch, classes):
    monkeypatch.setattr(R, "CLASSES", classes)
    rows = [(i % 9 if i % 11 else None, float(i * 7 % 30) if i % 13 else None, "abcde"[i * i % 5] if i % 17 else None, float(i % 23)) for i in range(600)]
    df = spark.createDataFrame(rows, "a int, b double, k string, y double").repartition(3)

    def information(x, y, edges):
        cells = [(sum(v > e for e in edges), k) for v, k in zip(x, y) if v is not None and k is not None]
        count = lambda part: pd.Series([part(c) for c in cells]).value_counts()
        both, own, kind = count(lambda c: c), count(lambda c: c[0]), count(lambda c: c[1])
        return sum(n / len(cells) * math.log(n * len(cells) / (own[b] * kind[k])) for (b, k), n in both.items())

    edges = {c: sorted({float(np.quantile([r[i] for r in rows if r[i] is not None], p / 4)) for p in (1, 2, 3)}) for i, c in ((0, "a"), (1, "b"), (3, "y"))}
    binned = [sum(r[3] > e for e in edges["y"]) for r in rows]
    for target, task, y in (("k", "classification", [r[2] for r in rows]), ("y", "regression", binned)):
        table = R.mutual_information(df, target, ["a", "b"], task, bins=4)
        assert "Generate" not in table._jdf.queryExecution().toString()
        got = {r.feature: r.mi for r in table.collect()}
        assert all(abs(got[c] - information([r[i] for r in rows], y, edges[c])) < 1e-12 for i, c in ((0, "a"), (1, "b")))


def test_information_of_an_empty_part_and_of_no_rows(spark):
    df = spark.range(3).select(F.col("id").cast("double").alias("a"), F.lit(None).cast("string").alias("k"))
    assert R.mutual_information(df, "k", ["a"]).collect() == []
