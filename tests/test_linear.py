"""Cross products of many columns and penalised logistic fits, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabstudy.functions.gram import grams, pairwise_correlations
from tabstudy.functions.hashing import mix, mixed
from tabstudy.functions.logistic import logistic_fits
from tabstudy.operators import relations, selection


def frame(spark, x, **more):
    names = [f"c{i}" for i in range(x.shape[1])]
    rows = [(*map(lambda v: None if np.isnan(v) else float(v), r), *[more[m][k] for m in more]) for k, r in enumerate(x)]
    kinds = ", ".join([*[f"{c} double" for c in names], *[f"{m} {'string' if isinstance(more[m][0], str) else 'int'}" for m in more]])
    return spark.createDataFrame(rows, kinds).repartition(4), names


def test_five_hundred_columns_in_one_scan(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(50, 3, (300, 500)) @ np.diag(rng.uniform(0.1, 5, 500))
    df, names = frame(spark, x)
    shift = x.mean(axis=0)
    z = np.column_stack([np.ones(300), x - shift])
    assert np.allclose(grams(df, names, shift)[None], z.T @ z, rtol=1e-10, atol=1e-6)
    r = {(a.a, a.b): a.r for a in relations.correlations(df, names).collect()}
    want = np.corrcoef(x.T)
    assert len(r) == 500 * 499 // 2 and max(abs(r[names[i], names[j]] - want[i, j]) for i in range(0, 500, 7) for j in range(i + 1, 500, 5)) < 1e-10


def test_groups_weights_and_gaps(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (200, 3))
    x[::7, 1] = np.nan
    g = ["a" if i % 3 else "b" for i in range(200)]
    df, names = frame(spark, x, g=g, k=[i % 4 for i in range(200)])
    found = grams(df, names, [0.5, 0, 0], "g", F.col("k") + 1)
    for key in "ab":
        own = [i for i in range(200) if g[i] == key and not np.isnan(x[i]).any()]
        z = np.column_stack([np.ones(len(own)), x[own] - [0.5, 0, 0]])
        assert np.allclose(found[key], (z * (np.array(own)[:, None] % 4 + 1)).T @ z)
    r, n = pairwise_correlations(df.withColumn("flat", F.lit(0.1)), [*names, "flat"])
    both = ~np.isnan(x[:, 1])
    assert n[0, 1] == both.sum() and n[0, 2] == 200 and abs(r[0, 1] - np.corrcoef(x[both, 0], x[both, 1])[0, 1]) < 1e-12 and np.isnan(r[0, 3])
    assert grams(df.limit(0), names)[None].shape == (4, 4) and pairwise_correlations(df.limit(0), names)[1].sum() == 0


def test_inflation_of_dependent_columns(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (100, 4))
    x[:, 3] = x[:, 0] + x[:, 1]
    df, names = frame(spark, x)
    v = {r.feature: r.vif for r in relations.vif(df, names).collect()}
    assert [v[c] for c in ("c0", "c1", "c3")] == [999.0] * 3 and v["c2"] < 1.2


@pytest.mark.parametrize("l1, l2", [(0.0, 0.0), (0.02, 0.0), (0.1, 0.01), (10.0, 0.0)])
def test_logistic_fits_meet_their_conditions(spark, l1, l2):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (400, 5))
    y = (x @ [2, -1, 0, 0, 0.5] + rng.logistic(0, 1, 400) > 0.3).astype(int)
    g = rng.integers(0, 4, 400)
    df, names = frame(spark, x, y=y.tolist(), g=g.tolist())
    uses = np.vstack([np.ones((1, 4), dtype=bool), ~np.eye(4, dtype=bool)])
    fits = logistic_fits(df, names, "y", "g", uses, [l1] * 5, [l2] * 5)
    assert fits.departure.max() <= 1e-8 and fits.scans < 30
    for m, b in enumerate(fits.coefficients):
        own = uses[m][g]
        z = np.column_stack([np.ones(own.sum()), x[own]])
        mean = 1 / (1 + np.exp(-z @ b))
        slope = z.T @ (y[own] - mean) / own.sum()
        slope[1:] -= l2 * b[1:]
        assert abs(slope[0]) < 1e-6 and (np.abs(slope[1:][b[1:] == 0]) <= l1 + 1e-6).all() and np.allclose(slope[1:][b[1:] != 0], l1 * np.sign(b[1:][b[1:] != 0]), atol=1e-6)
        if m:
            eta = b[0] + x[~own] @ b[1:]
            assert abs(fits.held_out_loss[m] - np.mean(np.logaddexp(0, eta) - y[~own] * eta)) < 1e-9


def test_class_selection(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (600, 6))
    y = (2 * x[:, 0] - 2 * x[:, 3] + rng.logistic(0, 1, 600) > 0).astype(int)
    df, names = frame(spark, x, y=["yes" if v else "no" for v in y], id=list(range(600)))
    path = selection.lasso_class_path(df, "y", names, "id", penalties=12).collect()
    first, best = [r for r in path if r.penalty == max(p.penalty for p in path)], [r for r in path if r.best]
    assert all(r.coefficient == 0 for r in first) and len(best) == 6
    assert {r.feature for r in best if abs(r.coefficient) > 0.5} == {"c0", "c3"}
    ranks = {r.feature: (r.rank, r.selected) for r in selection.eliminate_classes(df, "y", names, "id").collect()}
    assert ranks["c0"] == ranks["c3"] == (1, True)
    kept = {r.feature: r.probability for r in selection.stability(df, "y", names, "id", rounds=20, task="classification", penalty=0.08).collect()}
    assert kept["c0"] == kept["c3"] == 1.0 and max(kept[c] for c in ("c1", "c2", "c4", "c5")) < 0.5
    with pytest.raises(ValueError):
        selection.lasso_class_path(df.withColumn("y", F.lit("one")), "y", names, "id")


def test_hash_on_the_driver(spark):
    rows = spark.range(50).select("id", mix(F.col("id") * 10**9 + 7, 3).alias("h")).collect()
    assert all(r.h == mixed(r.id * 10**9 + 7, 3) for r in rows)


def test_logistic_scans_are_the_same_for_any_number_of_fits_at_once(spark, monkeypatch):
    from tabstudy.functions import logistic

    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i % 3, int(x + e > 0), float(x)) for i, (x, e) in enumerate(rng.normal(size=(300, 2)))], "g int, y int, x double")
    uses = np.vstack([np.ones((1, 3), dtype=bool), ~np.eye(3, dtype=bool)])
    fits = []
    for n in (logistic.FITS, 3):
        monkeypatch.setattr(logistic, "FITS", n)
        fits.append(logistic.logistic_fits(rows, ["x"], "y", "g", uses, np.zeros(4), np.full(4, 0.01)))
    assert np.allclose(fits[0].coefficients, fits[1].coefficients, rtol=1e-10) and np.allclose(fits[0].held_out_loss, fits[1].held_out_loss, equal_nan=True)
    assert max(fits[0].departure) < logistic.TOLERANCE and np.isnan(fits[0].held_out_loss[0])


def test_interactions_take_quantiles_twice_and_from_a_written_table(spark, monkeypatch):
    from tabstudy.operators import relations as R

    calls, edges = [], R._edges
    monkeypatch.setattr(R, "_edges", lambda df, cols, bins: (calls.append(df.inputFiles()), edges(df, cols, bins))[1])
    df = spark.range(500).selectExpr("id % 11 as a", "id % 13 as b", "(id % 11) * (id % 13) as y")
    assert [(r.a, r.b) for r in R.interactions(df, "y", ["a", "b"]).collect()] in ([("a", "b")], [("b", "a")])
    assert len(calls) == 2 and all(calls)
