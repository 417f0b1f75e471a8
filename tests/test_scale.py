"""Work that must not grow with the number of columns, models or rows of a task."""

import math

import pytest
from pyspark.sql import functions as F

from tabstudy.functions import quantiles as Q
from tabstudy.operators import hypothesis as H
from tabstudy.operators import models as M
from tabstudy.operators import relations as R
from tabstudy.operators.prep import Recipe


def test_linearity_makes_its_table_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(i):
        made.add(1)
        return math.exp(i % 40)

    df = spark.range(0, 120, 1, 2).withColumn("y", value.asNondeterministic()("id")).select("y", (F.col("id") % 7).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 40).alias("b"), (-F.col("id")).alias("c"))
    rows = {r.feature: r for r in R.linearity(df, "y", ["a", "b", "c"], None).collect()}
    assert made.value == 120
    assert {k: (r.test, r.n) for k, r in rows.items()} == {"a": ("spearman", 120), "b": ("spearman", 96), "c": ("spearman", 120)}
    assert rows["b"].statistic == pytest.approx(1.0)


def test_rank_tests_of_many_columns(spark, many_ranges):
    data = [(float(i * 37 % 101), float(i % 3), float("nan") if i % 50 == 7 else -float(i % 11), 1.0) for i in range(300)]
    df = spark.createDataFrame(data, "y double, a double, b double, c double")
    frame = df.toPandas()
    frame["b"] = frame["b"].fillna(math.inf)  # not a number ranks last
    found = {r.column: r for r in H.rank_tests(df, ["a", "b", "c"], "y").collect()}
    for c in ("a", "b"):
        assert found[c].n == 300 and found[c].statistic == pytest.approx(frame[c].rank().corr(frame["y"].rank()), abs=1e-12)
        alone = H.spearman(df, c, "y").first()
        assert (alone.statistic, alone.p, alone.effect) == pytest.approx((found[c].statistic, found[c].p, found[c].effect))
    assert found["c"].statistic is None
    assert H.spearman(df.limit(0), "a", "y").first()[:3] == ("spearman", None, 0)


def test_quantiles_of_few_groups_move_no_rows(spark, many_ranges, monkeypatch):
    data = [(("u", "v", None)[i % 3], i % 2, float("nan") if i % 17 == 0 else float("inf") if i % 29 == 0 else (i * 7919 % 1009) ** 3 - 5e8) for i in range(900)] + [("empty", 0, None)]
    df = spark.createDataFrame(data, "g string, h int, v double").repartition(3)
    key = lambda r: str((r.g, r.h))
    want = sorted((key(r), r.n, r.q) for r in Q._grouped_quantiles(df, ["v"], [0.1, 0.5, 0.99], ["g", "h"]).collect())

    def never(*_):
        raise AssertionError("all distinct values are shuffled")

    monkeypatch.setattr(Q, "_grouped_quantiles", never)
    got = Q.exact_quantiles(df, ["v"], [0.1, 0.5, 0.99], ["g", "h"])
    assert got.columns == ["g", "h", "column", "n", "q"]
    assert sorted((key(r), r.n, r.q) for r in got.collect()) == want
    with pytest.raises(AssertionError):  # many groups are no state for the driver
        Q.exact_quantiles(spark.range(200).selectExpr("id % 100 AS g", "id AS v"), ["v"], [0.5], ["g"])


def test_models_of_equal_recipes_share_their_preparation(spark, monkeypatch):
    made, learn = [], M.fit_prep
    monkeypatch.setattr(M, "fit_prep", lambda train, recipe, target: made.append(recipe) or learn(train, recipe, target))
    df = spark.range(200).selectExpr("id", "id % 13 AS x", "2.0 * (id % 13) + 1 AS y", "CASE WHEN id % 5 > 0 THEN 'train' ELSE 'test' END AS split")
    predictions, fitted = M.fit_all(df, Recipe(numeric=["x"], scale="none"), "y", "regression", "id", ["ols", "base_mean", "ridge"])
    assert [m.key for m in fitted] == ["ols", "base_mean", "ridge"] and predictions.count() == 600
    assert len(made) == len({r.scale for r in made}) < 3
    assert predictions.where("model = 'ols' and abs(pred - y) > 1e-6").isEmpty()


def test_trees_read_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(M, "PART_CELLS", 18 * 25)
    df = spark.range(0, 400, 1, 1).selectExpr("id", "CAST(id % 2 AS int) AS big", "IF(id % 2 = 0, 10.0, 30.0) + id % 4 AS y", "'wide' AS other")
    parts = M.dealt(df, ["big", "y"], 400)
    sizes = parts.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert len(sizes) == 16 and sizes.max() <= 25 + 1 and parts.columns == ["big", "y"]
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, df.select("big", "y").collect()))
    assert M.dealt(df, ["big", "y"], 25) is df
    model = M.fit("gbt", df, ["big"], "y", "regression", trees=3, depth=1)
    assert {r.big: round(r.pred, 6) for r in model.predict(df.select("big").distinct()).collect()} == {0: 11.0, 1: 32.0}
