"""Relations, feature selection, models, explanation, sensitivity."""

from itertools import combinations

from pyspark.sql import functions as F

from ..functions.hashing import mix_sql, uniform_sql
from ..operators import evaluate as E
from ..operators import explain as X
from ..operators import features as FE
from ..operators import models as M
from ..operators import prep as P
from ..operators import relations as R
from ..operators import selection as SE
from ..operators import sensitivity as SN
from ..operators import splits as SP
from .audit import priced
from .base import LI, LI_NUM, li, query, r, rounded, union_sql
from .evaluate import FOLDS, fold_scores
from .testing import rk

# ---- relations ---------------------------------------------------------------------------------

PAIRS = list(combinations(LI_NUM, 2))


@query("rel_corr", f"WITH {LI} " + union_sql(PAIRS, lambda p: f"SELECT '{p[0]}' AS a, '{p[1]}' AS b, {r(f'corr({p[0]}, {p[1]})')} AS r, count(*) FILTER ({p[0]} IS NOT NULL AND {p[1]} IS NOT NULL) AS n FROM li"))
def _(t):
    return rounded(R.correlations(li(t), LI_NUM), {"r": 6})


def _spear(p):
    return f"SELECT '{p[0]}' AS a, '{p[1]}' AS b, {r('corr(x, y)')} AS r, count(*) AS n FROM (SELECT {rk(p[0])} AS x, {rk(p[1])} AS y FROM li WHERE {p[0]} IS NOT NULL AND {p[1]} IS NOT NULL)"


SPAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_linenumber"), ("l_extendedprice", "l_linenumber")]


@query("rel_corr_spearman", f"WITH {LI} " + union_sql(SPAIRS, _spear))
def _(t):
    return rounded(R.correlations(li(t), ["l_quantity", "l_extendedprice", "l_linenumber"], "spearman"), {"r": 6})


OPT = ["l_extendedprice", "l_quantity", "l_discount", "p_size", "p_retailprice", "q2"]
PR = ("pr AS (SELECT l_extendedprice, l_quantity, l_discount, l_tax, p_size, p_retailprice, exp(l_quantity / 5) AS q2, l_returnflag, l_linestatus, p_brand, "
      "(l_orderkey * 8 + l_linenumber) * 1009 + l_partkey % 1009 AS id FROM lineitem JOIN part ON l_partkey = p_partkey)")


@query("rel_top_pairs", f"WITH {PR}, c AS (" + union_sql(list(combinations(OPT, 2)), lambda p: f"SELECT '{p[0]}' AS a, '{p[1]}' AS b, corr({p[0]}, {p[1]}) AS x, count(*) AS n FROM pr") + f") SELECT a, b, {r('x')} AS r, n FROM c ORDER BY abs(x) DESC LIMIT 5")
def _(t):
    return rounded(R.top_pairs(R.correlations(priced(t), OPT), 5), {"r": 6})


TR = f"WITH {PR}, c AS (" + union_sql(OPT[1:], lambda c: f"SELECT '{c}' AS feature, corr({c}, l_extendedprice) AS x FROM pr") + f") SELECT feature, {r('x')} AS r, {r('abs(x)')} AS strength FROM c"


@query("rel_target_rank", TR)
def _(t):
    return rounded(R.target_correlations(priced(t), "l_extendedprice", OPT[1:]), {"r": 6, "strength": 6})


@query("rel_leakage", TR.replace(", l_extendedprice)", ", l_quantity)").replace("'l_quantity' AS feature, corr(l_quantity, l_quantity)", "'none' AS feature, 0") + " WHERE abs(x) > 0.5")
def _(t):
    return rounded(R.leakage(priced(t), "l_quantity", OPT[1:], 0.5), {"r": 6, "strength": 6})


def mi_sql(features, table, label, bins=10, name="mi"):
    def edges(c):
        return "[" + ", ".join(f"quantile_cont({c}, {i / bins})" for i in range(1, bins)) + "]"
    cells = union_sql(features, lambda c: f"SELECT '{c[0]}' AS feature, len(list_filter(list_distinct(e), lambda q: {c[1]} > q)) AS bin, {label} AS k FROM {table}, (SELECT {edges(c[1])} AS e FROM {table})")
    return (f"{name}_c AS (SELECT feature, bin, k, count(*)::DOUBLE AS n FROM ({cells}) GROUP BY ALL), {name} AS (SELECT feature, sum(n / w * ln(n * w / (b * c))) AS mi FROM "
            f"(SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS w, sum(n) OVER (PARTITION BY feature, bin) AS b, sum(n) OVER (PARTITION BY feature, k) AS c FROM {name}_c) GROUP BY 1)")


MI_F = ["l_extendedprice", "l_quantity", "l_discount", "p_retailprice"]


@query("rel_mi", f"WITH {PR}, {mi_sql([(c, c) for c in MI_F], 'pr', '(l_extendedprice + l_discount * 100000 > 52000)')} SELECT feature, {r('mi')} AS mi FROM mi")
def _(t):
    df = priced(t).withColumn("hot", F.when(F.col("l_extendedprice") + F.col("l_discount") * 100000 > 52000, "yes").otherwise("no"))
    return rounded(R.mutual_information(df, "hot", MI_F), {"mi": 6})


LABEL = "len(list_filter(list_distinct(te), lambda q: l_extendedprice > q))"
PT = "pt AS (SELECT pr.*, te FROM pr, (SELECT [" + ", ".join(f"quantile_cont(l_extendedprice, {i / 10})" for i in range(1, 10)) + "] AS te FROM pr))"
IF = ["l_quantity", "l_discount", "p_size", "p_retailprice"]
IP = list(combinations(IF, 2))


@query("rel_interactions", f"WITH {PR}, {PT}, {mi_sql([(c, c) for c in IF], 'pt', LABEL, name='one')}, {mi_sql([(f'{a}|{b}', f'({a} * {b})') for a, b in IP], 'pt', LABEL, name='two')}, "
       f"p AS (SELECT split_part(feature, '|', 1) AS a, split_part(feature, '|', 2) AS b, mi FROM two), g AS (SELECT p.*, p.mi - greatest(x.mi, y.mi) AS g FROM p JOIN one x ON x.feature = a JOIN one y ON y.feature = b) "
       f"SELECT least(a, b) AS a, greatest(a, b) AS b, {r('g')} AS gain FROM g WHERE g > 0 ORDER BY g DESC LIMIT 5")
def _(t):
    out = R.interactions(priced(t), "l_extendedprice", IF)
    return rounded(out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "gain"), {"gain": 6})


def _dose_sql(c):
    e = "list_sort(list_distinct([" + ", ".join(f"quantile_cont({c}, {i / 10})" for i in range(11)) + "]))"
    return (f"SELECT '{c}' AS feature, bin::INTEGER AS bin, {r('e[bin + 1]')} AS low, {r('e[bin + 2]')} AS high, {r('(e[bin + 1] + e[bin + 2]) / 2')} AS middle, n, {r('m', 3)} AS mean_target FROM (SELECT any_value(e) AS e, bin, count(*) AS n, avg(l_extendedprice) AS m FROM "
            f"(SELECT l_extendedprice, e, len(list_filter(e[2:len(e) - 1], lambda q: {c} > q)) AS bin FROM pr, (SELECT {e} AS e FROM pr)) GROUP BY bin)")


@query("rel_dose", f"WITH {PR} " + union_sql(["l_quantity", "p_retailprice"], _dose_sql))
def _(t):
    return rounded(R.dose_response(priced(t), "l_extendedprice", ["l_quantity", "p_retailprice"]), {"low": 6, "high": 6, "middle": 6, "mean_target": 3})


FIVE_SQL = ", ".join(f"{r(f'quantile_cont(l_extendedprice, {p})', 4)} AS \"{k}\"" for k, p in (("min", 0.0), ("q25", .25), ("median", .5), ("q75", .75), ("max", 1.0)))


@query("rel_interact_demo", f"""WITH {PR}, e AS (SELECT quantile_cont(p_size, {1 / 3}) AS a, quantile_cont(p_size, {2 / 3}) AS b FROM pr)
  SELECT 'l_returnflag' AS "column", l_returnflag AS "group", count(*) AS n, {FIVE_SQL} FROM pr GROUP BY 2 UNION ALL
  SELECT 'package', CASE WHEN p_size <= a THEN 'Low' WHEN p_size <= b THEN 'Mid' ELSE 'High' END AS g, count(*), {FIVE_SQL} FROM pr, e GROUP BY 2""")
def _(t):
    df = priced(t).withColumn("package", F.col("p_size"))
    return rounded(R.by_demographics(df, "l_extendedprice", ["l_returnflag", "package"]), {k: 4 for k in ("min", "q25", "median", "q75", "max")})


@query("rel_linearity", f"WITH {PR}, c AS (" + union_sql(IF, lambda c: f"SELECT '{c}' AS feature, corr({c}, l_extendedprice) AS x FROM pr") + "), k AS (SELECT "
       + ", ".join(f"{rk(c)} AS {c}" for c in [*IF, "l_extendedprice"]) + " FROM pr), s AS (" + union_sql(IF, lambda c: f"SELECT '{c}' AS feature, corr({c}, l_extendedprice) AS s, count(*) AS n FROM k")
       + f") SELECT feature, 'spearman' AS test, {r('s')} AS statistic, n FROM s JOIN c USING (feature) ORDER BY abs(x) DESC LIMIT 3")
def _(t):
    return rounded(R.linearity(priced(t), "l_extendedprice", IF, 3).drop("p"), {"statistic": 6})


ONE = "o1 AS (SELECT coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM li)) AS x, l_extendedprice AS y FROM li), f1 AS (SELECT x, y, y - (SELECT regr_intercept(y, x) FROM o1) - (SELECT regr_slope(y, x) FROM o1) * x AS e FROM o1)"


@query("rel_ols_resid", f"""WITH {LI}, {ONE} SELECT count(*) AS n, {r('stddev_pop(e)', 3)} AS std_residual, {r('min(e)', 3)} AS min_residual, {r('max(e)', 3)} AS max_residual, {r('quantile_cont(e, 0.5)', 3)} AS median_residual,
  {r('skewness(e) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0))', 5)} AS skew, {r('quantile_cont(e, 0.75) - quantile_cont(e, 0.25)', 3)} AS iqr FROM f1""")
def _(t):
    out = R.ols_residuals(li(t), "l_extendedprice", ["l_quantity"]).select("n", "std_residual", "min_residual", "max_residual", "median_residual", "skew", "iqr")
    return rounded(out, {**{c: 3 for c in out.columns if c not in ("n", "skew")}, "skew": 5})


@query("rel_influence", f"""WITH {LI}, {ONE}, a AS (SELECT avg(x) AS mx, var_pop(x) * count(*) AS sxx, count(*) AS n, avg(e * e) + 1e-12 AS mse FROM f1), h AS (SELECT e, 1.0 / n + (x - mx) ** 2 / sxx AS h, n, mse FROM f1, a)
  SELECT count(*) AS n, {r('max(h)', 9)} AS max_leverage, {r('max(e * e / (2 * mse) * h / (1 - h) ** 2)', 9)} AS max_cooks, count(*) FILTER (h > 4.0 / n) AS high_leverage, count(*) FILTER (e * e / (2 * mse) * h / (1 - h) ** 2 > 1) AS high_cooks FROM h""")
def _(t):
    return rounded(R.influence(li(t), "l_extendedprice", ["l_quantity"]), {"max_leverage": 9, "max_cooks": 9})


@query("rel_normal_resid")
def _(t):
    return R.residual_normality(li(t), "l_extendedprice", LI_NUM[:1] + ["l_discount", "l_tax"])


@query("rel_normal_resid_qq")
def _(t):
    return R.qq_points(li(t), "l_extendedprice", ["l_quantity", "l_discount"])


@query("rel_vif", f"WITH {PR}, c AS (SELECT 1 / (1 - corr(l_quantity, q2) ** 2) AS v FROM pr) SELECT 'l_quantity' AS feature, {r('v', 5)} AS vif FROM c UNION ALL SELECT 'q2', {r('v', 5)} FROM c")
def _(t):
    return rounded(R.vif(priced(t), ["l_quantity", "q2"]), {"vif": 5})


@query("rel_scaling", f"WITH {PR}, s AS (" + union_sql(OPT, lambda c: f"SELECT '{c}' AS feature, min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, stddev_samp({c}) AS sd, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM pr")
       + f"), k AS (SELECT *, hi > q3 + 1.5 * (q3 - q1) OR lo < q1 - 1.5 * (q3 - q1) AS o FROM s) SELECT feature, {r('lo')} AS min, {r('hi')} AS max, {r('sd', 4)} AS std, {r('hi - lo')} AS range, o AS has_outliers, {r('max(hi - lo) OVER () / min(hi - lo) OVER ()', 3)} AS range_ratio, CASE WHEN bool_or(o) OVER () THEN 'robust' ELSE 'standard' END AS scaler FROM k")
def _(t):
    return rounded(R.scaling_check(priced(t), OPT), {"min": 6, "max": 6, "std": 4, "range": 6, "range_ratio": 3})


@query("rel_macro_prep", f"WITH {LI}, m AS (SELECT id, " + ", ".join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM li)) AS {c}" for c in LI_NUM[:3]) + " FROM li) SELECT id, "
       + ", ".join(f"{r(f'({c} - (SELECT avg({c}) FROM m)) / (SELECT stddev_pop({c}) FROM m)')} AS {c}" for c in LI_NUM[:3]) + " FROM m")
def _(t):
    return rounded(FE.standardised(li(t).withColumn("flat", F.lit(3.0)), [*LI_NUM[:3], "flat"], ["id"]), {c: 6 for c in LI_NUM[:3]})


@query("rel_pca_summary")
def _(t):
    return R.pca_summary(priced(t), OPT)




@query("rel_mapper")
def _(t):
    nodes, edges = R.mapper(priced(t), ["l_extendedprice", "l_quantity", "p_size", "p_retailprice"])
    return nodes.select(F.lit("node").alias("kind"), F.col("node").alias("a"), F.lit(None).cast("string").alias("b"), "size", "x", "y").unionByName(
        edges.select(F.lit("edge").alias("kind"), "a", "b", F.col("shared").alias("size"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y")))


# ---- selection ---------------------------------------------------------------------------------

SF = ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice"]


@query("sel_prep", f"WITH {LI} SELECT c AS \"column\", {r('m')} AS missing_rate, m > 0.2 AS flagged, {r('v', 6)} AS filled_mean FROM (" + union_sql(["l_quantity", "l_discount"], lambda c: f"SELECT '{c}' AS c, 1 - count({c}) / count(*)::DOUBLE AS m, avg(coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM li))) AS v FROM li") + ")")
def _(t):
    rows, names, flags = SE.prepare(li(t), "l_extendedprice", ["l_quantity", "l_discount", "l_returnflag"])
    means = rows.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.avg(c).alias("filled_mean")) for c in names]).alias("_s")).select(F.inline("_s"))
    return rounded(flags.join(means, "column"), {"missing_rate": 6, "filled_mean": 6})


@query("sel_lasso")
def _(t):
    return SE.lasso_path(priced(t), "amount", SF, "id")


# One 0/1 feature: the optimality conditions fix how far the fitted rates stand from the observed ones.
HOT = f"{PR}, hot AS (SELECT id, (p_size > 25)::INTEGER AS big, (l_quantity * p_retailprice * (1 - l_discount) + l_tax * 10000 + l_extendedprice / 10 > 40000)::INTEGER AS hot FROM pr)"
BIG = f"""{HOT}, z AS (SELECT 1 / sqrt(avg(big) * (1 - avg(big))) AS d, count(*) AS n FROM hot), f AS (SELECT floor({uniform_sql('id', 42)} * 5)::INTEGER AS fold, big, hot FROM hot),
  c AS (SELECT fold, big, count(*) AS n, sum(hot) AS y FROM f GROUP BY ALL), m AS (SELECT k AS model, big, sum(n) FILTER (fold <> k) AS n, sum(y) FILTER (fold <> k) AS y, coalesce(sum(n) FILTER (fold = k), 0) AS hn, coalesce(sum(y) FILTER (fold = k), 0) AS hy FROM c, (VALUES (-1), (0), (1), (2), (3), (4)) v(k) GROUP BY ALL),
  w AS (SELECT model, sum(n) AS n, max(n) FILTER (big = 1) AS nb, max(n) FILTER (big = 0) AS na, max(y) FILTER (big = 1) AS yb, max(y) FILTER (big = 0) AS ya, sum(y) AS y, max(hn) FILTER (big = 1) AS hnb, max(hn) FILTER (big = 0) AS hna, max(hy) FILTER (big = 1) AS hyb, max(hy) FILTER (big = 0) AS hya FROM m GROUP BY 1),
  t AS (SELECT (SELECT d FROM z) AS d, abs(yb - nb * y / n::DOUBLE) * (SELECT d FROM z) / n AS top FROM w WHERE model = -1), g AS (SELECT i, top * 10 ** (-3.0 * i / 29) AS lam, d FROM t, range(30) r(i)),
  q AS (SELECT w.*, g.*, yb - nb * y / n::DOUBLE AS most, n * lam / d AS least FROM w, g), e AS (SELECT *, CASE WHEN abs(most) <= least THEN most ELSE sign(most) * least END AS rb FROM q),
  p AS (SELECT *, (yb - rb) / nb AS pb, (ya + rb) / na AS pa FROM e),
  o AS (SELECT i, sum(-hyb * ln(pb) - (hnb - hyb) * ln(1 - pb) - hya * ln(pa) - (hna - hya) * ln(1 - pa)) / sum(hnb + hna) AS err FROM p WHERE model >= 0 GROUP BY 1)"""


@query("sel_lasso_class", f"WITH {BIG} SELECT {r('lam', 8)} AS penalty, 'big' AS feature, {r('CASE WHEN abs(most) <= least THEN 0 ELSE (ln(pb / (1 - pb)) - ln(pa / (1 - pa))) / d END', 5)} AS coefficient, {r('err', 6)} AS cv_error FROM p JOIN o USING (i) WHERE model = -1")
def _(t):
    big = hot(t).withColumn("big", (F.col("p_size") > 25).cast("int"))
    return rounded(SE.lasso_class_path(big, "hot", ["big"], "id").select("penalty", "feature", "coefficient", "cv_error"), {"penalty": 8, "coefficient": 5, "cv_error": 6})


@query("sel_lasso_class_path")
def _(t):
    return SE.lasso_class_path(hot(t), "hot", SF, "id")


@query("sel_rfe_class")
def _(t):
    return SE.eliminate_classes(hot(t), "hot", SF, "id")


@query("sel_stability_class")
def _(t):
    return SE.stability(hot(t), "hot", SF, "id", rounds=30, task="classification")


# One feature is kept where its covariance with the target passes the penalty.
STAB = f"""{PR}, s AS (SELECT (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () AS x, l_extendedprice AS y, {mix_sql('id', 42)} % 64 AS b FROM pr), c AS (SELECT b, count(*) AS n, sum(x) AS sx, sum(y - 30000) AS sy, sum(x * (y - 30000)) AS sxy FROM s GROUP BY 1),
  h AS (SELECT rd, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxy) AS sxy FROM c, range(40) r(rd) WHERE {mix_sql('b', '(rd + 42)')} % 2 = 1 GROUP BY 1)"""


@query("sel_stability_one", f"WITH {STAB} SELECT 'p_size' AS feature, {r('avg((abs(sxy / n - sx / n * sy / n) > 60)::INTEGER)')} AS probability FROM h")
def _(t):
    return rounded(SE.stability(priced(t), "l_extendedprice", ["p_size"], "id", rounds=40, penalty=60.0, buckets=64).select("feature", "probability"), {"probability": 6})


@query("sel_rfe")
def _(t):
    return SE.recursive_elimination(priced(t), "amount", SF, "id")


@query("sel_univariate", f"WITH {PR} " + union_sql(SF, lambda c: f"SELECT '{c}' AS feature, {r(f'abs(corr({c}, l_extendedprice))')} AS statistic FROM pr"))
def _(t):
    return rounded(SE.univariate(priced(t), "l_extendedprice", SF).select("feature", "statistic"), {"statistic": 6})


@query("sel_stability")
def _(t):
    return SE.stability(priced(t), "amount", SF, "id", rounds=30)


@query("sel_consensus", f"WITH {PR}, c AS (" + union_sql(SF, lambda c: f"SELECT '{c}' AS feature, abs(corr({c}, l_extendedprice)) AS x, abs(corr({c}, l_quantity)) AS y FROM pr")
       + "), m AS (SELECT feature, 'linear' AS m FROM c WHERE x > 0.01 UNION ALL SELECT feature, 'quantity' FROM c WHERE y > 0.003 UNION ALL SELECT feature, 'top' FROM (SELECT feature FROM c ORDER BY x DESC LIMIT 2)) "
       "SELECT feature, string_agg(m, ', ' ORDER BY m) AS methods, count(*) AS n, count(*) >= 2 AS chosen FROM m GROUP BY 1")
def _(t):
    x = R.target_correlations(priced(t), "l_extendedprice", SF)
    y = R.target_correlations(priced(t).withColumn("copy", F.col("l_quantity")), "copy", SF)
    return SE.consensus({"linear": x.where("strength > 0.01"), "quantity": y.where("strength > 0.003"), "top": x.limit(2)})


# ---- models ------------------------------------------------------------------------------------

MF = ["l_quantity", "l_discount", "p_size", "p_retailprice"]


def regression_rows(t):
    """Price and features with a split column."""
    return SP.random_split(priced(t).select("id", "amount", *MF), "id", (0.7, 0.15))


def hot(t):
    return priced(t).withColumn("hot", (F.col("amount") + F.col("l_extendedprice") / 10 > 40000).cast("int"))


def class_rows(t):
    return SP.random_split(hot(t).select("id", "hot", *MF), "id", (0.7, 0.15))


def _scored(t, key, task, **params):
    """Test metrics of one model trained on standardised features."""
    rows, target = (regression_rows(t), "amount") if task == "regression" else (class_rows(t), "hot")
    predictions, _ = M.fit_all(rows, P.Recipe(numeric=MF), target, task, "id", [key], {key: params})
    return M.score_rows(predictions.where("split = 'test'"), task, ["model"])


def _model_query(name, key, task, **params):
    @query(name)
    def _(t):
        return _scored(t, key, task, **params)


for _name, _key, _task, _params in (
    ("mdl_logit", "logit", "classification", {}), ("mdl_lasso", "lasso", "regression", {"alpha": 50.0}),
    ("mdl_elasticnet", "elasticnet", "regression", {"alpha": 50.0}), ("mdl_logreg", "logreg", "classification", {"C": 0.5, "penalty": "l1"}),
    ("mdl_huber", "huber", "regression", {}), ("mdl_rf", "rf", "regression", {"trees": 10, "depth": 5}), ("mdl_rf_class", "rf", "classification", {"trees": 10, "depth": 5}),
    ("mdl_gbt", "gbt", "regression", {"trees": 8, "depth": 3}), ("mdl_gbt_class", "gbt", "classification", {"trees": 8, "depth": 3}),
    ("mdl_linear_svc", "linear_svc", "classification", {}), ("mdl_gnb", "gnb", "classification", {}), ("mdl_mlp", "mlp", "classification", {"layers": {"width": 8, "depth": 2, "shape": "funnel"}, "rounds": 30}),
):
    _model_query(_name, _key, _task, **_params)


@query("mdl_ols", f"SELECT 'ols' AS model, '(intercept)' AS feature, {r('regr_intercept(l_extendedprice, l_quantity)', 2)} AS coefficient FROM lineitem UNION ALL SELECT 'ols', 'l_quantity', {r('regr_slope(l_extendedprice, l_quantity)', 4)} FROM lineitem")
def _(t):
    table = M.coefficient_table([M.fit("ols", t.lineitem, ["l_quantity"], "l_extendedprice", "regression")], t.spark)
    return table.withColumn("coefficient", F.when(F.col("feature") == "(intercept)", F.round("coefficient", 2)).otherwise(F.round("coefficient", 4)) + 0.0)


@query("mdl_ridge", f"SELECT 'ridge' AS model, {r('regr_sxy(l_extendedprice, l_quantity) / (regr_sxx(l_extendedprice, l_quantity) + 500000)', 3)} AS slope FROM lineitem")
def _(t):
    table = M.coefficient_table([M.fit("ridge", t.lineitem, ["l_quantity"], "l_extendedprice", "regression", alpha=500000.0)], t.spark)
    return table.where("feature = 'l_quantity'").select("model", (F.round("coefficient", 3) + 0.0).alias("slope"))


@query("mdl_coef", f"SELECT 'ols' AS model, 'l_quantity' AS feature, {r('regr_slope(l_extendedprice, l_quantity)', 4)} AS coefficient FROM lineitem UNION ALL SELECT 'ridge', 'l_quantity', {r('regr_sxy(l_extendedprice, l_quantity) / (regr_sxx(l_extendedprice, l_quantity) + 1)', 4)} FROM lineitem")
def _(t):
    fitted = M.in_parallel([lambda k=k: M.fit(k, t.lineitem, ["l_quantity"], "l_extendedprice", "regression") for k in ("ols", "ridge")])
    return rounded(M.coefficient_table(fitted, t.spark).where("feature = 'l_quantity'"), {"coefficient": 4})


@query("mdl_lda", """WITH d AS (SELECT o_orderkey AS id, o_totalprice / 100000 AS x, (o_totalprice + o_custkey % 100 * 2000 > 350000)::INTEGER AS y FROM orders), c AS (SELECT y, count(*)::DOUBLE AS n, avg(x) AS m, var_pop(x) AS v FROM d GROUP BY 1),
  p AS (SELECT sum(n * v) / sum(n) AS v, sum(n) AS n FROM c), s AS (SELECT id, sum(CASE WHEN c.y = 1 THEN x * c.m / p.v - c.m ** 2 / (2 * p.v) + ln(c.n / p.n) END) - sum(CASE WHEN c.y = 0 THEN x * c.m / p.v - c.m ** 2 / (2 * p.v) + ln(c.n / p.n) END) AS s FROM d, c, p GROUP BY id)
  SELECT id, (s > 0)::INTEGER::DOUBLE AS pred, """ + r("1 / (1 + exp(-s))") + " AS proba FROM s")
def _(t):
    df = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 100000).alias("x"), (F.col("o_totalprice") + F.col("o_custkey") % 100 * 2000 > 350000).cast("int").alias("y"))
    return rounded(M.fit("lda", df, ["x"], "y", "classification").predict(df).select("id", "pred", "proba"), {"proba": 6})


KNN = ("d AS (SELECT o_orderkey AS id, o_totalprice / 99991 AS x, (o_custkey % 1500) / 317.0::DOUBLE AS z, o_totalprice + (o_custkey % 10) * 5000 AS y FROM orders), q AS (SELECT * FROM d WHERE id % 10 = 3), tr AS (SELECT * FROM d WHERE id % 10 <> 3)")


@query("mdl_knn", f"""WITH {KNN}, k AS (SELECT q.id, tr.y, row_number() OVER (PARTITION BY q.id ORDER BY sqrt((q.x - tr.x) ** 2 + (q.z - tr.z) ** 2), tr.id) AS i FROM q, tr) SELECT id, {r('avg(y)', 3)} AS pred FROM k WHERE i <= 5 GROUP BY 1""")
def _(t):
    df = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 99991).alias("x"), ((F.col("o_custkey") % 1500) / 317.0).alias("z"), (F.col("o_totalprice") + F.col("o_custkey") % 10 * 5000).alias("y"))
    model = M.fit("knn", df.where("id % 10 <> 3"), ["x", "z"], "y", "regression", k=5)
    return rounded(model.predict(df.where("id % 10 = 3")).select("id", "pred"), {"pred": 3})


@query("mdl_base_mean", f"SELECT o_orderkey, {r('(SELECT avg(o_totalprice) FROM orders WHERE o_orderkey % 10 < 7)', 4)} AS pred FROM orders WHERE o_orderkey % 10 >= 7")
def _(t):
    model = M.fit("base_mean", t.orders.where("o_orderkey % 10 < 7"), ["o_custkey"], "o_totalprice", "regression")
    return rounded(model.predict(t.orders.where("o_orderkey % 10 >= 7")).select("o_orderkey", "pred"), {"pred": 4})


@query("mdl_base_majority", f"WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1) SELECT doc_id, (SELECT quality FROM c ORDER BY n DESC, quality LIMIT 1)::DOUBLE AS pred, {r('(SELECT sum(n) FILTER (quality = 1) / sum(n)::DOUBLE FROM c)')} AS proba FROM labels")
def _(t):
    return rounded(M.fit("base_majority", t.labels, [], "quality", "classification").predict(t.labels).select("doc_id", "pred", "proba"), {"proba": 6})


@query("mdl_probe")
def _(t):
    return M.probe(priced(t).select("id", "amount", *MF), MF, "amount", "regression", "id")


@query("mdl_cv")
def _(t):
    df = SP.hash_folds(priced(t).select("id", "amount", *MF), 5, "id")
    return M.cv_summary(M.cross_validate("ridge", df, MF, "amount", "regression", method="log1p"))


@query("mdl_search")
def _(t):
    rows = regression_rows(t)
    return M.search("ridge", rows.where("split = 'train'"), rows.where("split = 'val'"), MF, "amount", "regression", trials=4)


@query("mdl_train_all")
def _(t):
    predictions, _ = M.fit_all(regression_rows(t), P.Recipe(numeric=MF), "amount", "regression", "id", ["ols", "ridge", "base_mean"], method="log1p")
    return E.regression_metrics(predictions, by=["model", "split"])


@query("mdl_external")
def _(t):
    rows = regression_rows(t)
    prep = P.fit(rows.where("split = 'train'"), P.Recipe(numeric=MF))
    model = M.fit("ols", prep.apply(rows.where("split = 'train'")), prep.names, "amount", "regression")
    return M.external(model, prep, rows.where("split = 'test'"), "amount", "id", replicates=100)


@query("mdl_external_class")
def _(t):
    rows = class_rows(t)
    prep = P.fit(rows.where("split = 'train'"), P.Recipe(numeric=MF))
    model = M.fit("logit", prep.apply(rows.where("split = 'train'")), prep.names, "hot", "classification")
    return M.external(model, prep, rows.where("split = 'test'"), "hot", "id", replicates=100, task="classification")


# ---- explanation -------------------------------------------------------------------------------

def linear(t, keep=False):
    df = priced(t).select("id", "amount", *MF)
    df = df.persist() if keep else df
    return df, M.fit("ols", df, MF, "amount", "regression")


def forest(t):
    df = priced(t).select("id", "amount", *MF)
    return df, M.fit("rf", df, MF, "amount", "regression", trees=5, depth=5)


@query("ex_perm")
def _(t):
    df, model = forest(t)
    return X.permutation(model, df, "amount", "id", repeats=3)


@query("ex_pdp1")
def _(t):
    df, model = linear(t)
    return X.partial_dependence(model, df, MF, size=10)


@query("ex_pdp2")
def _(t):
    df, model = linear(t)
    return X.interaction_strength(X.partial_dependence_2d(model, df, MF))


@query("ex_shap_linear", f"WITH {PR} SELECT id, {r('1500 * (l_quantity - (SELECT avg(l_quantity) FROM pr))', 3)} AS shap_l_quantity, {r('-20000 * (l_discount - (SELECT avg(l_discount) FROM pr))', 3)} AS shap_l_discount FROM pr")
def _(t):
    df = priced(t)
    return rounded(X.shapley_linear({"l_quantity": 1500.0, "l_discount": -20000.0}, df, df, ["id"]), {"shap_l_quantity": 3, "shap_l_discount": 3})


@query("ex_shap_sampled")
def _(t):
    df, model = linear(t)
    return X.shapley_rank(X.shapley_sampled(model, df, "id", df, orderings=4, background_rows=4))


@query("ex_shap_rank", f"WITH {PR} SELECT 'l_quantity' AS feature, {r('avg(abs(1500 * (l_quantity - (SELECT avg(l_quantity) FROM pr))))', 3)} AS mean_abs FROM pr UNION ALL SELECT 'offer', {r('avg(abs(-20000 * (l_discount - (SELECT avg(l_discount) FROM pr))))', 3)} FROM pr")
def _(t):
    df = priced(t).withColumn("n", F.monotonically_increasing_id())
    wide = X.shapley_linear({"l_quantity": 1500.0, "l_discount": -20000.0}, df, df, ["n"])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"shap_{c}").alias("value")) for c in ("l_quantity", "l_discount")]))
    long = wide.select(F.col("n").alias("id"), cells.alias("c")).select("id", "c.*")
    return rounded(X.shapley_rank(long, {"l_discount": "offer"}), {"mean_abs": 3})


# ---- sensitivity -------------------------------------------------------------------------------

@query("sn_seed")
def _(t):
    df = priced(t).select("id", "amount", *MF)
    return SN.seed_stability(SN.seeds(df, "ols", MF, "amount", "regression", "id", count=3))


@query("sn_dropout")
def _(t):
    return SN.feature_dropout(priced(t).select("id", "amount", *MF), "ols", MF, "amount", "regression", "id")


@query("sn_summary", f"WITH {FOLDS}, b AS (SELECT min(score) FILTER (fold = 0) AS b FROM f WHERE model = 'first') SELECT {r('any_value(b)', 3)} AS baseline, count(*) AS n, {r('avg(score)', 3)} AS mean, {r('stddev_pop(score)', 3)} AS std, {r('min(score)', 3)} AS low, {r('max(score)', 3)} AS high, {r('avg((abs(score - b) <= 0.1 * abs(b))::INTEGER)')} AS within_10 FROM f, b")
def _(t):
    scores = fold_scores(t)
    base = scores.where("model = 'first' and fold = 0").select(F.col("score").alias("baseline"), F.lit(0).alias("_k"))
    out = SN.summarise(scores.withColumn("_k", F.lit(0)).join(base, "_k"))
    return rounded(out, {**{c: 3 for c in ("baseline", "mean", "std", "low", "high")}, "within_10": 6})


