"""Permutation importance: rings, shifts, and rows without a partner."""

from pyspark.sql import functions as F

from tabstudy.operators import explain as X
from tabstudy.operators import models as M

MODEL = M.Fitted("fixed", "regression", ["a", "b"], lambda df: df.withColumn("pred", 2.0 * F.col("a") + 0 * F.col("b")))


def test_a_feature_without_use_costs_nothing_and_the_other_does(spark, monkeypatch):
    monkeypatch.setattr(X, "ROWS_PER_BUCKET", 40)
    df = spark.range(300).select("id", F.col("id").cast("double").alias("a"), (F.col("id") % 7).alias("b"), (2.0 * F.col("id")).alias("y"))
    out = {r.feature: (r.importance, r.std) for r in X.permutation(MODEL, df, "y", "id", repeats=4).collect()}
    assert out["b"] == (0.0, 0.0)
    # two independent draws of 0..299 differ by a mean square of twice the variance, times the slope squared
    assert abs(out["a"][0] / (4 * 2 * (300 ** 2 - 1) / 12) - 1) < 0.25


def test_one_row_has_no_partner_but_itself(spark):
    df = spark.range(1).select("id", F.lit(3.0).alias("a"), F.lit(1).alias("b"), F.lit(5.0).alias("y"))
    assert {r.feature: r.importance for r in X.permutation(MODEL, df, "y", "id", repeats=2).collect()} == {"a": 0.0, "b": 0.0}


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_sampled_shapley_adds_up_without_an_exchange_of_steps(spark):
    df = spark.range(60).select("id", F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    both = M.Fitted("fixed", "regression", ["a", "b"], lambda d: d.withColumn("pred", F.col("a") * F.col("b")))
    values = X.shapley_sampled(both, df, "id", df.where("id = 20"), orderings=4)
    assert "Window" not in _plan(values)  # steps of a walk met in one, after an exchange of all of them
    total = {r.id: r.v for r in values.groupBy("id").agg(F.sum("value").alias("v")).collect()}
    assert len(total) == 60 and all(abs(v - (i * (i % 7) - 20 * 6)) < 1e-9 for i, v in total.items())


def test_partial_dependence_repeats_rows_for_numbers_of_points(spark):
    df = spark.range(1, 101).select("id", F.col("id").cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    both = M.Fitted("fixed", "regression", ["a", "b"], lambda d: d.withColumn("pred", F.col("a") + 2 * F.col("b")))
    one = X.partial_dependence(both, df, ["a", "b"], size=3)
    two = X.partial_dependence_2d(both, df, ["a", "b"], size=3)
    assert all("Generate explode([0,1,2" in _plan(x) for x in (one, two))
    assert all(abs(r.mean_prediction - (r.value + 4 if r.feature == "a" else 50.5 + 2 * r.value)) < 1e-9 for r in one.collect())
    rows = two.collect()
    assert len(rows) == 9 and all(abs(r.mean_prediction - r.value_a - 2 * r.value_b) < 1e-9 and abs(r.interaction) < 1e-9 for r in rows)


def test_pairs_score_rows_alike_in_other_features_once_and_by_their_number(spark):
    rows = [(a, b, c) for a in (1.0, 2.0, 4.0) for b in (0.0, 3.0) for c in (1.0, 1.0, 5.0, 9.0)]
    df = spark.createDataFrame([*rows, (1.0, 3.0, 9.0), (None, 0.0, 1.0)], "a double, b double, c double")
    scored = []

    def predict(d):
        scored.append(d)
        return d.withColumn("pred", F.col("a") * F.col("b") + F.col("c") * F.col("c") * F.col("b"))

    out = X.partial_dependence_2d(M.Fitted("fixed", "regression", ["a", "b", "c"], predict), df.where("a is not null"), ["a", "b", "c"], size=4).collect()
    mean = lambda f: sum(f(*r) for r in [*rows, (1.0, 3.0, 9.0)]) / 25
    want = {("a", "b"): lambda u, v: mean(lambda a, b, c: u * v + c * c * v), ("a", "c"): lambda u, v: mean(lambda a, b, c: u * b + v * v * b),
            ("b", "c"): lambda u, v: mean(lambda a, b, c: a * u + v * v * u)}
    assert len(out) == 3 * 4 * 4
    assert all(abs(r.mean_prediction - want[r.a, r.b](r.value_a, r.value_b)) < 1e-9 for r in out)
    # 3 values of c, 2 of b, 3 of a are left beside the pairs: 8 rows at 16 points, of 25 rows at 48
    assert scored[0].count() == 8 * 16


def test_one_feature_has_no_pairs(spark):
    df = spark.range(9).select(F.col("id").cast("double").alias("a"), F.lit(1.0).alias("b"))
    assert X.partial_dependence_2d(MODEL, df, ["a"]).collect() == []


def test_the_pair_query_takes_all_pairs_on_whole_grids(spark, folder, monkeypatch):
    from __spark_entry__ import queries

    sizes, grid = [], X.grid_values
    monkeypatch.setattr(X, "grid_values", lambda df, features, size: sizes.append((len(features), size)) or grid(df, features, size))
    rows = queries()["ex_pdp2"](spark, folder).collect()
    assert sizes == [(4, 15)]
    assert len({(r.a, r.b) for r in rows}) == 6 == len(rows)
