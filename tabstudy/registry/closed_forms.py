"""Fitted operators on cases whose result has a closed form, so that SQL can repeat it: one feature, a 0/1 feature, separated groups, a fixed scorer."""

from pyspark.sql import functions as F

from ..functions.hashing import mix_sql, uniform_sql
from ..operators import evaluate as E
from ..operators import explain as X
from ..operators import features as FE
from ..operators import models as M
from ..operators import prep as P
from ..operators import relations as R
from ..operators import sensitivity as SN
from ..operators import splits as SP
from .audit import priced
from .base import query, r, rounded, union_sql
from .evaluate import S, scores
from .modelling import HOT, PR, hot

# ---- one feature -------------------------------------------------------------------------------

XY = "x AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem)"
LINE = f"{PR}, d AS (SELECT id, l_quantity AS x, l_quantity * p_retailprice * (1 - l_discount) + l_tax * 10000 AS y FROM pr)"


def _slope(t, key, **params):
    model = M.fit(key, priced(t), ["l_quantity"], "amount", "regression", **params)
    return M.coefficient_table([model], t.spark).where("feature = 'l_quantity'").select("model", (F.round("coefficient", 1) + 0.0).alias("slope"))


@query("mdl_lasso_one", f"WITH {LINE} SELECT 'lasso' AS model, {r('(covar_pop(x, y) - 50000) / var_pop(x)', 1)} AS slope FROM d")
def _(t):
    return _slope(t, "lasso", alpha=50000.0)


@query("mdl_elasticnet_one", f"WITH {LINE} SELECT 'elasticnet' AS model, {r('(covar_pop(x, y) - 360) / (var_pop(x) + 40)', 0)} AS slope FROM d")
def _(t):
    out = _slope(t, "elasticnet", alpha=400.0, l1_ratio=0.9)
    return rounded(out, {"slope": 0})


@query("mdl_cv_one", f"""WITH {LINE}, f AS (SELECT *, floor({uniform_sql('id', 42)} * 5)::INTEGER AS fold FROM d), k AS (SELECT a.fold, regr_slope(f.y, f.x) AS b, regr_intercept(f.y, f.x) AS a FROM (SELECT DISTINCT fold FROM f) a JOIN f ON f.fold <> a.fold GROUP BY 1),
  s AS (SELECT fold, sqrt(avg((y - a - b * x) ** 2)) AS score FROM f JOIN k USING (fold) GROUP BY 1) SELECT 'ols' AS model, count(*) AS folds, {r('avg(score)', 3)} AS mean, {r('stddev_pop(score)', 3)} AS std FROM s""")
def _(t):
    df = SP.hash_folds(priced(t).select("id", "l_quantity", "amount"), 5, "id")
    return rounded(M.cv_summary(M.cross_validate("ols", df, ["l_quantity"], "amount", "regression")), {"mean": 3, "std": 3})


@query("mdl_train_all_one", f"""WITH {LINE}, f AS (SELECT *, {uniform_sql('id', 42)} AS u FROM d), p AS (SELECT x, y, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.7 + 0.15 THEN 'val' ELSE 'test' END AS split FROM f),
  k AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(y) AS m FROM p WHERE split = 'train'), e AS (SELECT 'ols' AS model, split, y, a + b * x AS pred FROM p, k UNION ALL SELECT 'base_mean', split, y, m FROM p, k)
  SELECT model, split, count(*) AS n, {r('avg(abs(y - pred))', 3)} AS mae, {r('sqrt(avg((y - pred) ** 2))', 3)} AS rmse, {r('1 - avg((y - pred) ** 2) / var_pop(y)', 5)} AS r2, {r('quantile_cont(abs(y - pred), 0.5)', 3)} AS median_ae FROM e GROUP BY 1, 2""")
def _(t):
    rows = SP.random_split(priced(t).select("id", "amount", "l_quantity"), "id", (0.7, 0.15))
    predictions, _ = M.fit_all(rows, P.Recipe(numeric=["l_quantity"]), "amount", "regression", "id", ["ols", "base_mean"])
    return rounded(E.regression_metrics(predictions, by=["model", "split"]), {"mae": 3, "rmse": 3, "r2": 5, "median_ae": 3})


@query("sn_seed_one", f"""WITH {LINE}, f AS (SELECT x, y, s, {uniform_sql('id', 's')} < 0.8 AS train FROM d, range(42, 45) g(s)), k AS (SELECT s, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM f WHERE train GROUP BY 1),
  e AS (SELECT s, sqrt(avg((y - a - b * x) ** 2)) AS score FROM f JOIN k USING (s) WHERE NOT train GROUP BY 1) SELECT s::INTEGER AS seed, {r('score', 3)} AS score FROM e""")
def _(t):
    return rounded(SN.seeds(priced(t).select("id", "l_quantity", "amount"), "ols", ["l_quantity"], "amount", "regression", "id", count=3), {"score": 3})


@query("rel_normal_resid_qq_one", f"WITH {XY}, k AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM x), e AS (SELECT y - a - b * x AS e FROM x, k) " + union_sql(range(1, 100), lambda i: f"SELECT {i}::INTEGER AS percent, {r(f'quantile_cont(e, {i / 100})', 3)} AS sample FROM e"))
def _(t):
    points = R.qq_points(t.lineitem.select("l_quantity", "l_extendedprice"), "l_extendedprice", ["l_quantity"])
    return rounded(points.select(F.round(F.col("p") * 100).cast("int").alias("percent"), "sample"), {"sample": 3})


# ---- a 0/1 feature -----------------------------------------------------------------------------

def _by_big(t, key, task="classification", **params):
    """Score of the rows of both values of ``big``."""
    rows = hot(t).select("hot", "amount", (F.col("p_size") > 25).cast("int").alias("big"))
    target = "hot" if task == "classification" else "amount"
    model = M.fit(key, rows, ["big"], target, task, **params)
    return model.predict(rows.select("big").distinct())


BOTH = f"WITH {HOT}, g AS (SELECT big, count(*)::DOUBLE AS n, sum(hot)::DOUBLE AS y, avg(hot) AS p FROM hot GROUP BY 1)"


@query("mdl_logit_one", f"{BOTH} SELECT big, {r('p', 3)} AS proba FROM g")
def _(t):
    return rounded(_by_big(t, "logit", C=1e9).select("big", "proba"), {"proba": 3})


# The penalty moves up to 1 / C positives from the value that has more of them than its share to the other one.
@query("mdl_logreg_one", f"{BOTH}, w AS (SELECT max(y) FILTER (big = 1) - max(n) FILTER (big = 1) * sum(y) / sum(n) AS excess FROM g) SELECT big, {r('(y - CASE WHEN big = 1 THEN 1 ELSE -1 END * sign(excess) * least(abs(excess), 5)) / n', 3)} AS proba FROM g, w")
def _(t):
    return rounded(_by_big(t, "logreg", C=0.2, penalty="l1").select("big", "proba"), {"proba": 3})


@query("mdl_gbt_one", f"WITH {PR} SELECT (p_size > 25)::INTEGER AS big, {r('avg(l_quantity * p_retailprice * (1 - l_discount) + l_tax * 10000)', 2)} AS pred FROM pr GROUP BY 1")
def _(t):
    return rounded(_by_big(t, "gbt", "regression", trees=3, depth=1).select("big", "pred"), {"pred": 2})


# The first tree gives the mean of the labels -1 and 1, the second one step down the logistic loss.
@query("mdl_gbt_class_one", f"{BOTH}, a AS (SELECT big, p, 2 * p - 1 AS f FROM g), b AS (SELECT big, f + 0.1 * (p * 4 / (1 + exp(2 * f)) - (1 - p) * 4 / (1 + exp(-2 * f))) AS f FROM a) SELECT big, {r('1 / (1 + exp(-2 * f))', 5)} AS proba FROM b")
def _(t):
    return rounded(_by_big(t, "gbt", trees=2, depth=1, rate=0.1).select("big", "proba"), {"proba": 5})


@query("mdl_rf_steps", "SELECT o_orderkey, ([12.0, 55.0, 31.0])[(o_custkey % 3 + 1)::INTEGER]::DOUBLE AS pred FROM orders")
def _(t):
    rows = t.orders.select("o_orderkey", (F.col("o_custkey") % 3).alias("step"))
    rows = rows.withColumn("y", F.element_at(F.array(F.lit(12.0), F.lit(55.0), F.lit(31.0)), (F.col("step") + 1).cast("int")))
    return rounded(M.fit("rf", rows, ["step"], "y", "regression", trees=5, depth=3).predict(rows).select("o_orderkey", "pred"), {"pred": 6})


@query("mdl_gnb_one", """WITH d AS (SELECT o_orderkey AS id, o_totalprice / 100000 AS x, (o_totalprice + o_custkey % 100 * 2000 > 350000)::INTEGER AS y FROM orders), c AS (SELECT y, count(*)::DOUBLE AS n, avg(x) AS m, var_pop(x) AS v FROM d GROUP BY 1),
  s AS (SELECT id, sum(CASE WHEN c.y = 1 THEN 1 ELSE -1 END * (ln(c.n) - ln(c.v) / 2 - (x - c.m) ** 2 / (2 * c.v))) AS s FROM d, c GROUP BY id) SELECT id, """ + r("1 / (1 + exp(-s))", 4) + " AS proba FROM s")
def _(t):
    df = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 100000).alias("x"), (F.col("o_totalprice") + F.col("o_custkey") % 100 * 2000 > 350000).cast("int").alias("y"))
    return rounded(M.fit("gnb", df, ["x"], "y", "classification").predict(df).select("id", "proba"), {"proba": 4})


TWO = f"WITH {S}, z AS (SELECT id, b, CASE WHEN proba > 0.5 THEN 0.7 ELSE 0.3 END::DOUBLE AS proba FROM s), g AS (SELECT proba, avg(b) AS rate FROM z WHERE id % 10 < 7 GROUP BY 1)"


def _two_scores(t):
    df = scores(t).select("id", "b", F.when(F.col("proba") > 0.5, 0.7).otherwise(0.3).alias("proba"))
    return df.where("id % 10 < 7"), df.where("id % 10 >= 7")


@query("ev_platt_two", f"{TWO} SELECT id, {r('rate', 3)} AS calibrated FROM z JOIN g USING (proba) WHERE id % 10 >= 7")
def _(t):
    return rounded(E.recalibrate_platt(*_two_scores(t), "b").select("id", "calibrated"), {"calibrated": 3})


@query("ev_isotonic_two", f"{TWO} SELECT id, {r('CASE WHEN (SELECT max(rate) FILTER (proba > 0.5) >= max(rate) FILTER (proba < 0.5) FROM g) THEN rate ELSE (SELECT avg(b) FROM z WHERE id % 10 < 7) END', 6)} AS calibrated FROM z JOIN g USING (proba) WHERE id % 10 >= 7")
def _(t):
    return rounded(E.recalibrate_isotonic(*_two_scores(t), "b").select("id", "calibrated"), {"calibrated": 6})


# ---- two columns and separated groups ----------------------------------------------------------

PAIR = f"{LINE}, m AS (SELECT avg(y) AS a, stddev_pop(y) AS b, avg(x) AS c, stddev_pop(x) AS d, corr(x, y) AS rho FROM d)"


@query("fe_pca_two", f"WITH {PAIR} SELECT {r('((y - a) / b + (x - c) / m.d) / sqrt(2)', 5)} AS one, {r('abs((y - a) / b - (x - c) / m.d) / sqrt(2)', 5)} AS two FROM d, m")
def _(t):
    out = FE.add_pca(priced(t), ["amount", "l_quantity"], 2)
    return rounded(out.select(F.col("PCA_1").alias("one"), F.abs("PCA_2").alias("two")), {"one": 5, "two": 5})


@query("rel_pca_two", f"WITH {PAIR} SELECT k::INTEGER AS component, {r('CASE WHEN k = 1 THEN 1 + rho ELSE 1 - rho END / 2')} AS share, {r('CASE WHEN k = 1 THEN (1 + rho) / 2 ELSE 1 END')} AS cumulative, CASE WHEN rho >= 0.8 THEN 1 ELSE 2 END::INTEGER AS components_90, f AS feature, {r('sqrt(0.5)')} AS size FROM m, range(1, 3) g(k), (VALUES ('amount'), ('l_quantity')) v(f)")
def _(t):
    out = R.pca_summary(priced(t), ["amount", "l_quantity"])
    return rounded(out.withColumn("size", F.abs("loading")).drop("loading"), {"share": 6, "cumulative": 6, "size": 6})


@query("fe_bin_kmeans_groups", "SELECT o_orderkey, (o_orderkey % 4)::INTEGER AS a_binned FROM orders")
def _(t):
    df = t.orders.select("o_orderkey", (F.col("o_orderkey") % 4 * 1000 + F.col("o_custkey") % 7).alias("a"))
    return FE.binned(df, "a", 4, "kmeans").select("o_orderkey", F.col("a_binned").cast("int").alias("a_binned"))


@query("fe_kmeans_groups", f"""WITH d AS (SELECT o_orderkey AS id, o_orderkey % 3 AS k, o_orderkey % 3 * 1000 + o_custkey % 7 AS a, (o_orderkey % 3 = 1)::INTEGER * 500 + o_custkey % 11 AS b FROM orders),
  z AS (SELECT id, k, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS a, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS b FROM d) SELECT id, {r('sqrt((a - avg(a) OVER (PARTITION BY k)) ** 2 + (b - avg(b) OVER (PARTITION BY k)) ** 2)')} AS nearest FROM z""")
def _(t):
    k = F.col("o_orderkey") % 3
    df = t.orders.select(F.col("o_orderkey").alias("id"), (k * 1000 + F.col("o_custkey") % 7).alias("a"), ((k == 1).cast("int") * 500 + F.col("o_custkey") % 11).alias("b"))
    out = FE.add_kmeans(df, ["a", "b"], 3)
    return rounded(out.select("id", F.least(*[f"kmeans_dist_cluster_{i}" for i in range(3)]).alias("nearest")), {"nearest": 6})


# ---- a fixed scorer ----------------------------------------------------------------------------

FIXED_F = ["l_quantity", "l_discount"]
FIXED = "(1500 * {0} - 20000 * {1} + 300 * {0} * {1})"


def fixed(mixed=True):
    q, d = F.col("l_quantity"), F.col("l_discount")
    score = 1500 * q - 20000 * d + (300 * q * d if mixed else 0)
    return M.Fitted("fixed", "regression", FIXED_F, lambda df: df.withColumn("pred", score))


def _grid(c, n):
    return f"SELECT '{c}' AS f, lo + (hi - lo) * i / {n - 1} AS v FROM (SELECT quantile_cont({c}, 0.05) AS lo, quantile_cont({c}, 0.95) AS hi FROM pr), range({n}) g(i)"


@query("ex_pdp1_fixed", f"WITH {PR}, a AS (SELECT avg(l_quantity) AS q, avg(l_discount) AS d FROM pr), k AS ({_grid('l_quantity', 10)} UNION ALL {_grid('l_discount', 10)}) SELECT f AS feature, {r('v', 5)} AS value, {r('CASE WHEN f = $l_quantity$ THEN ' + FIXED.format('v', 'd') + ' ELSE ' + FIXED.format('q', 'v') + ' END', 3)} AS mean_prediction FROM k, a".replace("$", "'"))
def _(t):
    return rounded(X.partial_dependence(fixed(), priced(t), FIXED_F, size=10), {"value": 5, "mean_prediction": 3})


@query("ex_pdp2_fixed", f"""WITH {PR}, u AS ({_grid('l_quantity', 8)}), w AS ({_grid('l_discount', 8)}), k AS (SELECT u.v AS q, w.v AS d, {FIXED.format('u.v', 'w.v')} AS m FROM u, w)
  SELECT 'l_quantity' AS a, 'l_discount' AS b, {r('q', 5)} AS value_a, {r('d', 5)} AS value_b, {r('m', 3)} AS mean_prediction, {r('m - avg(m) OVER (PARTITION BY q) - avg(m) OVER (PARTITION BY d) + avg(m) OVER ()', 3)} AS interaction FROM k""")
def _(t):
    return rounded(X.partial_dependence_2d(fixed(), priced(t), FIXED_F, size=8), {"value_a": 5, "value_b": 5, "mean_prediction": 3, "interaction": 3})


RING = "d AS (SELECT o_orderkey AS id, o_totalprice AS y, o_custkey % 97 AS l_quantity, o_orderkey % 13 / 10.0::DOUBLE AS l_discount FROM orders)"


def ring(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("y"), (F.col("o_custkey") % 97).alias("l_quantity"), (F.col("o_orderkey") % 13 / 10.0).alias("l_discount"))


# Against the row of means every ordering gives a linear scorer the same steps.
@query("ex_shap_sampled_fixed", f"WITH {RING}, a AS (SELECT avg(l_quantity) AS q, avg(l_discount) AS e FROM d) SELECT 'l_quantity' AS feature, {r('avg(abs(1500 * (l_quantity - q)))', 3)} AS mean_abs FROM d, a UNION ALL SELECT 'l_discount', {r('avg(abs(20000 * (l_discount - e)))', 3)} FROM d, a")
def _(t):
    df = ring(t)
    means = df.agg(*[F.avg(c).alias(c) for c in FIXED_F])
    return rounded(X.shapley_rank(X.shapley_sampled(fixed(mixed=False), df, "id", means, orderings=4, background_rows=1)), {"mean_abs": 3})


# A bucket's rows stand in a ring; each repeat turns it by its own shift.
@query("ex_perm_fixed", f"""WITH {RING}, e AS (SELECT y, l_quantity AS q, l_discount AS d, id, {mix_sql('id', 42)} % greatest(1, (SELECT ceil(count(*) / {X.ROWS_PER_BUCKET}) FROM d))::BIGINT AS b, {mix_sql('id', 1042)} AS o FROM d),
  k AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY o, id) - 1 AS i, count(*) OVER (PARTITION BY b) AS m FROM e), h AS (SELECT k.*, rep, (i + CASE WHEN m > 1 THEN 1 + {mix_sql('rep', 42)} % (m - 1) ELSE 0 END) % m AS j FROM k, range(3) g(rep)),
  t AS (SELECT h.*, z.q AS q2, z.d AS d2 FROM h JOIN k z ON z.b = h.b AND z.i = h.j),
  l AS (SELECT rep, avg((y - {FIXED.format('q', 'd')}) ** 2) AS base, avg((y - {FIXED.format('q2', 'd')}) ** 2) AS lq, avg((y - {FIXED.format('q', 'd2')}) ** 2) AS ld FROM t GROUP BY 1)
  SELECT 'l_quantity' AS feature, {r('avg(lq - base)', 1)} AS importance, {r('stddev_pop(lq - base)', 1)} AS std FROM l UNION ALL SELECT 'l_discount', {r('avg(ld - base)', 1)}, {r('stddev_pop(ld - base)', 1)} FROM l""")
def _(t):
    return rounded(X.permutation(fixed(), ring(t), "y", "id", repeats=3), {"importance": 1, "std": 1})
