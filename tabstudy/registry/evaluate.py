"""Evaluation of scores computed by fixed formulas, so that any engine can repeat them."""

from pyspark.sql import functions as F

from ..functions.hashing import POISSON_CDF, uniform_sql
from ..operators import evaluate as E
from .base import query, r, rounded, union_sql

# y = order total, two formula predictions; b = finished order, formula probability with ties.
S = """s AS (SELECT o_orderkey AS id, o_orderstatus AS g, o_totalprice AS y, o_totalprice * 0.9 + (o_custkey % 101) * 300.0 AS pred, o_totalprice * 0.8 + (o_orderkey % 97) * 700.0 AS other, (o_orderstatus = 'F')::INTEGER AS b,
  ((o_custkey * 37 + o_orderkey * 11) % 1000 + CASE WHEN o_orderstatus = 'F' THEN 150 ELSE 0 END) / 1200.0::DOUBLE AS proba FROM orders)"""


def scores(t):
    o = F.col("o_orderstatus") == "F"
    return t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("g"), F.col("o_totalprice").alias("y"),
        (F.col("o_totalprice") * 0.9 + (F.col("o_custkey") % 101) * 300.0).alias("pred"), (F.col("o_totalprice") * 0.8 + (F.col("o_orderkey") % 97) * 700.0).alias("other"),
        o.cast("int").alias("b"), (((F.col("o_custkey") * 37 + F.col("o_orderkey") * 11) % 1000 + F.when(o, 150).otherwise(0)) / 1200.0).alias("proba"))


L = f"{S}, m AS (SELECT id, g, y, pred, b, proba, 'first' AS model FROM s UNION ALL SELECT id, g, y, other, b, 1 - proba, 'second' FROM s)"


def models(t):
    s = scores(t)
    cells = F.explode(F.array(F.struct(F.lit("first").alias("model"), F.col("pred").alias("p"), F.col("proba").alias("q")),
                              F.struct(F.lit("second").alias("model"), F.col("other").alias("p"), (1 - F.col("proba")).alias("q"))))
    return s.select("id", "g", "y", "b", cells.alias("c")).select("id", "g", "y", "b", "c.model", F.col("c.p").alias("pred"), F.col("c.q").alias("proba"))


@query("ev_regression", f"WITH {L} SELECT model, count(*) AS n, {r('avg(abs(y - pred))', 4)} AS mae, {r('sqrt(avg((y - pred) ** 2))', 4)} AS rmse, {r('1 - sum((y - pred) ** 2) / (var_pop(y) * count(*))')} AS r2, {r('quantile_cont(abs(y - pred), 0.5)', 4)} AS median_ae FROM m GROUP BY 1")
def _(t):
    return rounded(E.regression_metrics(models(t), by=["model"]), {"mae": 4, "rmse": 4, "r2": 6, "median_ae": 4})


C3 = f"{S}, c AS (SELECT g AS y, CASE WHEN id % 3 = 0 THEN g WHEN id % 3 = 1 THEN 'F' ELSE 'O' END AS p FROM s)"


def three(t):
    return scores(t).select(F.col("g").alias("y"), F.when(F.col("id") % 3 == 0, F.col("g")).when(F.col("id") % 3 == 1, "F").otherwise("O").alias("pred"))


@query("ev_class", f"""WITH {S}, c AS (SELECT b AS y, (proba >= 0.5)::INTEGER AS p, proba FROM s), k AS (SELECT l, count(*) FILTER (y = l) AS sup, count(*) FILTER (p = l) AS cal, count(*) FILTER (y = l AND p = l) AS hit FROM c, (VALUES (0), (1)) v(l) GROUP BY l)
  SELECT (SELECT count(*) FROM c) AS n, {r('sum(hit) / sum(sup)::DOUBLE')} AS accuracy, {r('sum(2 * hit / (sup + cal)::DOUBLE * sup) / sum(sup)')} AS f1,
  (SELECT {r('-avg(y * ln(greatest(least(proba, 1 - 2.220446049250313e-16), 2.220446049250313e-16)) + (1 - y) * ln(1 - greatest(least(proba, 1 - 2.220446049250313e-16), 2.220446049250313e-16)))')} FROM c) AS log_loss FROM k""")
def _(t):
    df = scores(t).withColumn("label", (F.col("proba") >= 0.5).cast("int"))
    return rounded(E.class_metrics(df, "b", "label", "proba"), {"accuracy": 6, "f1": 6, "log_loss": 6})


@query("ev_auc", f"""WITH {L}, k AS (SELECT model, b, rank() OVER (PARTITION BY model ORDER BY proba) + (count(*) OVER (PARTITION BY model, proba) - 1) / 2.0 AS rk FROM m)
  SELECT model, {r('(sum(rk) FILTER (b = 1) - sum(b) * (sum(b) + 1) / 2.0) / (sum(b) * (count(*) - sum(b)))')} AS auc FROM k GROUP BY 1""")
def _(t):
    return rounded(E.ranking_metrics(models(t), "b", "proba", ["model"]).drop("pr_auc"), {"auc": 6})


MULTI = {"F": "proba", "O": "(id * 7 % 500 + CASE WHEN g = 'O' THEN 60 ELSE 0 END) / 600.0::DOUBLE", "P": "1 - proba"}


@query("ev_auc_multiclass", f"WITH {S}, k AS (" + union_sql("FOP", lambda c: f"SELECT '{c}' AS c, (g = '{c}')::INTEGER AS h, {MULTI[c]} AS v FROM s")
       + f"""), q AS (SELECT c, h, rank() OVER (PARTITION BY c ORDER BY v) + (count(*) OVER (PARTITION BY c, v) - 1) / 2.0 AS rk FROM k), a AS (SELECT c, (sum(rk) FILTER (h = 1) - sum(h) * (sum(h) + 1) / 2.0) / (sum(h) * (count(*) - sum(h))) AS x FROM q GROUP BY 1) SELECT {r('avg(x)')} AS auc FROM a""")
def _(t):
    df = scores(t).withColumns({"po": (F.col("id") * 7 % 500 + F.when(F.col("g") == "O", 60).otherwise(0)) / 600.0, "pp": 1 - F.col("proba")})
    return rounded(E.auc_multiclass(df, "g", {"F": "proba", "O": "po", "P": "pp"}), {"auc": 6})


CUM = f"{L}, q AS (SELECT model, proba, sum(b) AS pos, count(*) AS n FROM m GROUP BY 1, 2), c AS (SELECT *, sum(pos) OVER w AS cp, sum(n) OVER w AS cn FROM q WINDOW w AS (PARTITION BY model ORDER BY proba DESC ROWS UNBOUNDED PRECEDING))"


@query("ev_prauc", f"WITH {CUM} SELECT model, {r('sum(pos * cp / cn::DOUBLE) / sum(pos)')} AS pr_auc FROM c GROUP BY 1")
def _(t):
    return rounded(E.ranking_metrics(models(t), "b", "proba", ["model"]).drop("auc"), {"pr_auc": 6})


@query("ev_roc_points", f"""WITH {CUM} SELECT model, {r('proba')} AS threshold, {r('(cn - cp) / (SELECT sum(n - pos) FROM q z WHERE z.model = c.model)::DOUBLE')} AS fpr, {r('cp / (SELECT sum(pos) FROM q z WHERE z.model = c.model)::DOUBLE')} AS tpr, {r('cp / cn::DOUBLE')} AS precision FROM c""")
def _(t):
    return rounded(E.curve_points(models(t), "b", "proba", ["model"]), {k: 6 for k in ("threshold", "fpr", "tpr", "precision")})


RES = "avg(e)", "stddev_pop(e)", "min(e)", "max(e)", "quantile_cont(e, 0.5)"
RES_N = "mean_residual", "std_residual", "min_residual", "max_residual", "median_residual"


@query("ev_residuals", f"WITH {L}, e AS (SELECT model, y - pred AS e FROM m) SELECT model, count(*) AS n, " + ", ".join(f"{r(x, 4)} AS {n}" for x, n in zip(RES, RES_N)) + " FROM e GROUP BY 1")
def _(t):
    return rounded(E.residuals(models(t), by=["model"]), {n: 4 for n in RES_N})


@query("ev_residuals_ext", f"WITH {L}, e AS (SELECT model, y - pred AS e, pred FROM m) SELECT model, count(*) AS n, " + ", ".join(f"{r(x, 4)} AS {n}" for x, n in zip(RES, RES_N))
       + f""", {r('skewness(e) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0))')} AS skew, {r('corr(e, pred)')} AS corr_with_predicted, {r('quantile_cont(e, 0.75) - quantile_cont(e, 0.25)', 4)} AS iqr, {r('quantile_cont(e, 0.05)', 4)} AS q5, {r('quantile_cont(e, 0.25)', 4)} AS q25,
  {r('quantile_cont(e, 0.75)', 4)} AS q75, {r('quantile_cont(e, 0.95)', 4)} AS q95 FROM e GROUP BY 1""")
def _(t):
    return rounded(E.residuals(models(t), by=["model"], extended=True), {**{n: 4 for n in (*RES_N, "iqr", "q5", "q25", "q75", "q95")}, "skew": 6, "corr_with_predicted": 6})


@query("ev_pred_actual", f"""WITH {S}, q AS (SELECT quantile_cont(y, 0.2) AS a, quantile_cont(y, 0.4) AS b2, quantile_cont(y, 0.6) AS c, quantile_cont(y, 0.8) AS d FROM s), e AS (SELECT y, pred, pred - y AS e, 1 + (y >= a)::INTEGER + (y >= b2)::INTEGER + (y >= c)::INTEGER + (y >= d)::INTEGER AS k FROM s, q)
  SELECT {r('corr(y, pred)')} AS correlation, {', '.join(f"{r(f'avg(e) FILTER (k = {i})', 4)} AS bias_q{i}" for i in range(1, 6))}, {r('max(e)', 4)} AS max_overprediction, {r('min(e)', 4)} AS max_underprediction, {r('avg(e)', 4)} AS mean_error FROM e""")
def _(t):
    out = E.predicted_vs_actual(scores(t))
    return rounded(out, {c: 6 if c == "correlation" else 4 for c in out.columns})


@query("ev_stratified", f"""WITH {S}, q AS (SELECT [quantile_cont(y, 0.0), quantile_cont(y, 0.2), quantile_cont(y, 0.4), quantile_cont(y, 0.6), quantile_cont(y, 0.8), quantile_cont(y, 1.0) + 1e-9] AS e FROM s),
  k AS (SELECT ((y >= e[2])::INTEGER + (y >= e[3])::INTEGER + (y >= e[4])::INTEGER + (y >= e[5])::INTEGER) AS bin, e, pred - y AS d FROM s, q), a AS (SELECT bin, any_value(e) AS e, count(*) AS n, avg(abs(d)) AS mae, sqrt(avg(d * d)) AS rmse, avg(d) AS mb FROM k GROUP BY 1)
  SELECT bin, {r('e[bin + 1]', 4)} AS low, {r('e[bin + 2]', 4)} AS high, n, {r('mae', 4)} AS mae, {r('rmse', 4)} AS rmse, {r('mb', 4)} AS mean_bias, CASE WHEN mb > 0.1 * mae THEN 'over' WHEN mb < -0.1 * mae THEN 'under' ELSE 'balanced' END AS direction FROM a""")
def _(t):
    return rounded(E.stratified_residuals(scores(t)), {c: 4 for c in ("low", "high", "mae", "rmse", "mean_bias")})


@query("ev_confusion", f"WITH {C3} SELECT y AS actual, p AS predicted, count(*) AS n FROM c GROUP BY ALL")
def _(t):
    return E.confusion(three(t))


@query("ev_confusion_classes", f"WITH {C3}, k AS (SELECT l AS label, count(*) FILTER (y = l) AS sup, count(*) FILTER (p = l) AS cal, count(*) FILTER (y = l AND p = l) AS hit FROM c, (VALUES ('F'), ('O'), ('P')) v(l) GROUP BY l) "
       f"SELECT label, sup AS support, {r('coalesce(hit / nullif(cal, 0)::DOUBLE, 0)')} AS precision, {r('coalesce(hit / nullif(sup, 0)::DOUBLE, 0)')} AS recall, {r('2 * hit / (sup + cal)::DOUBLE')} AS f1 FROM k")
def _(t):
    return rounded(E.per_class(three(t)), {"precision": 6, "recall": 6, "f1": 6})


@query("ev_confusion_top", f"WITH {C3} SELECT y AS actual, p AS predicted, count(*) AS n FROM c WHERE y <> p GROUP BY ALL ORDER BY n DESC, actual DESC, predicted DESC LIMIT 5")
def _(t):
    return E.top_confusions(three(t))


@query("ev_bland_altman", f"""WITH {S}, d AS (SELECT pred - other AS d FROM s), k AS (SELECT avg(d) AS m, stddev_pop(d) AS sd FROM d)
  SELECT {r('any_value(m)', 4)} AS mean_diff, {r('any_value(sd)', 4)} AS std_diff, {r('any_value(m - 1.96 * sd)', 4)} AS loa_low, {r('any_value(m + 1.96 * sd)', 4)} AS loa_high, count(*) AS n, count(*) FILTER (d < m - 1.96 * sd OR d > m + 1.96 * sd) AS n_outside,
  {r('count(*) FILTER (d < m - 1.96 * sd OR d > m + 1.96 * sd) / count(*)::DOUBLE')} AS share_outside FROM d, k""")
def _(t):
    return rounded(E.bland_altman(scores(t), "pred", "other"), {"mean_diff": 4, "std_diff": 4, "loa_low": 4, "loa_high": 4, "share_outside": 6})


FOLDS = f"{L}, f AS (SELECT model, id % 5 AS fold, sqrt(avg((y - pred) ** 2)) AS score FROM m GROUP BY 1, 2)"


def fold_scores(t):
    return models(t).groupBy("model", (F.col("id") % 5).alias("fold")).agg(F.sqrt(F.avg((F.col("y") - F.col("pred")) ** 2)).alias("score"))


@query("ev_paired_cv", f"WITH {FOLDS}, d AS (SELECT a.model AS model_a, b.model AS model_b, a.score - b.score AS d FROM f a JOIN f b ON a.fold = b.fold AND a.model < b.model) SELECT model_a, model_b, count(*) AS n, {r('avg(d)', 4)} AS mean_delta, {r('avg(d) * sqrt(count(*)) / stddev_samp(d)', 4)} AS statistic FROM d GROUP BY 1, 2")
def _(t):
    return rounded(E.paired_cv(fold_scores(t)).drop("p"), {"mean_delta": 4, "statistic": 4})


IMP = ["l_quantity", "l_discount", "l_tax", "l_suppkey", "l_partkey", "l_linenumber", "l_orderkey"]
IMP_CTE = "i AS (" + union_sql(IMP, lambda c: f"SELECT 'price' AS model, '{c}' AS feature, round(abs(corr({c}, l_extendedprice)), 9) AS v FROM lineitem UNION ALL SELECT 'returned', '{c}', round(abs(corr({c}, (l_returnflag = 'R')::INTEGER)), 9) FROM lineitem") + ")"


@query("ev_rank_agree", f"""WITH {IMP_CTE}, k AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY v) + (count(*) OVER (PARTITION BY model, v) - 1) / 2.0 AS rk, row_number() OVER (PARTITION BY model ORDER BY v DESC, feature) <= 5 AS top FROM i)
  SELECT a.model AS model_a, b.model AS model_b, count(*) AS n_features, {r('corr(a.rk, b.rk)')} AS spearman, count(*) FILTER (a.top AND b.top) AS top_overlap FROM k a JOIN k b ON a.feature = b.feature AND a.model < b.model GROUP BY 1, 2""")
def _(t):
    returned = (F.col("l_returnflag") == "R").cast("int")
    cells = [F.struct(F.lit(m).alias("model"), F.lit(c).alias("feature"), F.round(F.abs(F.corr(F.col(c).cast("double"), y.cast("double"))), 9).alias("importance"))
             for m, y in (("price", F.col("l_extendedprice")), ("returned", returned)) for c in IMP]
    return rounded(E.rank_agreement(t.lineitem.agg(F.array(*cells).alias("_s")).select(F.inline("_s"))), {"spearman": 6})


B = 40
WEIGHT = "(" + " + ".join(f"(u >= {p})::INTEGER" for p in POISSON_CDF) + ")"


def boot_cte(group=""):
    return f"b AS (SELECT s.*, k AS replicate, {uniform_sql('s.id', 'k')} AS u FROM s, range({B}) g(k)), w AS (SELECT *, {WEIGHT} AS w FROM b)"


@query("ev_boot", f"""WITH {S}, {boot_cte()} SELECT replicate::INTEGER AS replicate, {r('sqrt(sum(w * (y - pred) ** 2) / sum(w))', 3)} AS rmse, {r('sum(w * abs(y - pred)) / sum(w)', 3)} AS mae,
  {r('1 - sum(w * (y - pred) ** 2) / (sum(w * (y - 250000) ** 2) - sum(w * (y - 250000)) ** 2 / sum(w))')} AS r2 FROM w GROUP BY 1""")
def _(t):
    return rounded(E.bootstrap_regression(scores(t), "id", replicates=B, centre=250000.0), {"rmse": 3, "mae": 3, "r2": 6})


@query("ev_boot_class", f"""WITH {S}, {boot_cte()}, c AS (SELECT replicate, b AS y, (proba >= 0.5)::INTEGER AS p, sum(w) AS n FROM w GROUP BY ALL), k AS (SELECT replicate, l, sum(n) FILTER (y = l) AS sup, sum(n) FILTER (p = l) AS cal, sum(n) FILTER (y = l AND p = l) AS hit FROM c, (VALUES (0), (1)) v(l) GROUP BY 1, 2)
  SELECT replicate::INTEGER AS replicate, {r('sum(hit) / sum(sup)::DOUBLE')} AS accuracy, {r('sum(2 * hit / (sup + cal)::DOUBLE * sup) / sum(sup)')} AS f1 FROM k GROUP BY 1""")
def _(t):
    df = scores(t).withColumn("label", (F.col("proba") >= 0.5).cast("int"))
    return rounded(E.bootstrap_classification(df, "id", "b", "label", B), {"accuracy": 6, "f1": 6})


@query("ev_boot_auc", f"""WITH {S}, {boot_cte()}, q AS (SELECT replicate, proba, sum(w * b) AS pos, sum(w) AS n FROM w WHERE w > 0 GROUP BY 1, 2), c AS (SELECT *, sum(pos) OVER (PARTITION BY replicate ORDER BY proba DESC ROWS UNBOUNDED PRECEDING) AS cp FROM q)
  SELECT replicate::INTEGER AS replicate, {r('sum((n - pos) * (cp - pos / 2.0)) / (sum(pos) * sum(n - pos))')} AS auc FROM c GROUP BY 1""")
def _(t):
    return rounded(E.bootstrap_auc(scores(t), "id", "b", "proba", B), {"auc": 6})


@query("ev_boot_median", f"""WITH {S}, {boot_cte()}, q AS (SELECT replicate, abs(y - pred) AS a, sum(w) AS n FROM w WHERE w > 0 GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY replicate ORDER BY a ROWS UNBOUNDED PRECEDING) AS e, sum(n) OVER (PARTITION BY replicate) AS t FROM q)
  SELECT replicate::INTEGER AS replicate, {r('(max(a) FILTER (e - n <= floor((t - 1) / 2.0) AND floor((t - 1) / 2.0) < e) + max(a) FILTER (e - n <= ceil((t - 1) / 2.0) AND ceil((t - 1) / 2.0) < e)) / 2', 4)} AS median_ae FROM c GROUP BY 1""")
def _(t):
    return rounded(E.bootstrap_median_ae(scores(t), "id", replicates=B), {"median_ae": 4})


@query("ev_boot_ci")
def _(t):
    return E.bootstrap_intervals(scores(t), "id", replicates=200)


# What the intervals are made of: estimate, share of replicates below it, acceleration from leave-one-out values.
def _bend(metric, value, source):
    return f"SELECT '{metric}' AS metric, sum((m - {value}) ** 3) / (6 * sum((m - {value}) ** 2) ** 1.5) AS bend FROM (SELECT *, avg({value}) OVER () AS m FROM {source})"


def _below(metric, estimate, boots):
    return f"SELECT '{metric}' AS metric, (SELECT {metric} FROM {estimate}) AS estimate, avg(CASE WHEN {metric} < (SELECT {metric} FROM {estimate}) THEN 1.0 WHEN {metric} = (SELECT {metric} FROM {estimate}) THEN 0.5 ELSE 0 END) AS below FROM {boots}"


REG = f"""{S}, {boot_cte()}, e AS (SELECT abs(y - pred) AS a, y - pred AS e, y FROM s), t AS (SELECT count(*) AS n, sum(e * e) AS see, sum(a) AS sae, sum(y - 250000) AS sy, sum((y - 250000) ** 2) AS syy FROM e),
  est AS (SELECT sqrt(see / n) AS rmse, sae / n AS mae, 1 - see / (syy - sy * sy / n) AS r2, (SELECT quantile_cont(a, 0.5) FROM e) AS median_ae FROM t),
  o AS (SELECT a, e, y, row_number() OVER (ORDER BY a) AS k FROM e), x AS (SELECT n, max(a) FILTER (k = n // 2) AS lo, max(a) FILTER (k = n // 2 + 1) AS mid, max(a) FILTER (k = n // 2 + 2) AS hi FROM o, t GROUP BY n),
  l AS (SELECT sqrt((see - e * e) / (n - 1)) AS rmse, (sae - a) / (n - 1) AS mae, 1 - (see - e * e) / (syy - (y - 250000) ** 2 - (sy - (y - 250000)) ** 2 / (n - 1)) AS r2,
    CASE WHEN n % 2 = 0 THEN CASE WHEN k <= n // 2 THEN mid ELSE lo END WHEN k <= n // 2 THEN (mid + hi) / 2 WHEN k = n // 2 + 1 THEN (lo + hi) / 2 ELSE (lo + mid) / 2 END AS median_ae FROM o, t JOIN x USING (n)),
  rb AS (SELECT replicate, sqrt(sum(w * (y - pred) ** 2) / sum(w)) AS rmse, sum(w * abs(y - pred)) / sum(w) AS mae, 1 - sum(w * (y - pred) ** 2) / (sum(w * (y - 250000) ** 2) - sum(w * (y - 250000)) ** 2 / sum(w)) AS r2 FROM w GROUP BY 1),
  q AS (SELECT replicate, abs(y - pred) AS a, sum(w) AS n FROM w WHERE w > 0 GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY replicate ORDER BY a ROWS UNBOUNDED PRECEDING) AS e, sum(n) OVER (PARTITION BY replicate) AS t FROM q),
  mb AS (SELECT replicate, (max(a) FILTER (e - n <= floor((t - 1) / 2.0) AND floor((t - 1) / 2.0) < e) + max(a) FILTER (e - n <= ceil((t - 1) / 2.0) AND ceil((t - 1) / 2.0) < e)) / 2 AS median_ae FROM c GROUP BY 1)"""


@query("ev_boot_bca", f"WITH {REG}, share AS (" + union_sql(["rmse", "mae", "r2", "median_ae"], lambda m: _below(m, "est", "mb" if m == "median_ae" else "rb")) + "), curve AS (" + union_sql(["rmse", "mae", "r2", "median_ae"], lambda m: _bend(m, m, "l"))
       + f") SELECT metric, {r('estimate', 4)} AS estimate, {r('below', 4)} AS below, {r('bend', 6)} AS acceleration FROM share JOIN curve USING (metric)")
def _(t):
    return rounded(E.bootstrap_intervals(scores(t), "id", replicates=B).select("metric", "estimate", "below", "acceleration"), {"estimate": 4, "below": 4, "acceleration": 6})


def _weighted_f1(hit, sup, cal):
    return f"(coalesce(2 * {hit}1 / nullif({sup}1 + {cal}1, 0)::DOUBLE, 0) * {sup}1 + coalesce(2 * {hit}0 / nullif({sup}0 + {cal}0, 0)::DOUBLE, 0) * {sup}0) / ({sup}1 + {sup}0)"


CLS = f"""{S}, {boot_cte()}, e AS (SELECT id, b, (proba >= 0.5)::INTEGER AS p, proba FROM s), k AS (SELECT count(*) AS n, count(*) FILTER (b = 1 AND p = 1) AS h1, count(*) FILTER (b = 0 AND p = 0) AS h0, count(*) FILTER (b = 1) AS s1, count(*) FILTER (b = 0) AS s0, count(*) FILTER (p = 1) AS c1, count(*) FILTER (p = 0) AS c0 FROM e),
  d AS (SELECT proba, sum(b) AS pos, count(*) - sum(b) AS neg FROM e GROUP BY 1), u AS (SELECT *, sum(pos) OVER (ORDER BY proba) AS cp, sum(neg) OVER (ORDER BY proba) AS cn FROM d), g AS (SELECT sum(pos * (cn - neg / 2.0)) AS pairs, sum(pos) AS p, sum(neg) AS n FROM u),
  est AS (SELECT (h1 + h0) / k.n::DOUBLE AS accuracy, {_weighted_f1('h', 's', 'c')} AS f1, (SELECT pairs / (p * n) FROM g) AS auc FROM k),
  m AS (SELECT e.b, e.p, proba, h1 - (b = 1 AND e.p = 1)::INTEGER AS h1, h0 - (b = 0 AND e.p = 0)::INTEGER AS h0, s1 - (b = 1)::INTEGER AS s1, s0 - (b = 0)::INTEGER AS s0, c1 - (e.p = 1)::INTEGER AS c1, c0 - (e.p = 0)::INTEGER AS c0 FROM e, k),
  l AS (SELECT (h1 + h0) / (s1 + s0)::DOUBLE AS accuracy, {_weighted_f1('h', 's', 'c')} AS f1, CASE WHEN m.b = 1 THEN (pairs - (cn - neg / 2.0)) / ((g.p - 1) * g.n) ELSE (pairs - (g.p - cp + pos / 2.0)) / (g.p * (g.n - 1)) END AS auc FROM m JOIN u USING (proba), g),
  z AS (SELECT replicate, sum(w) FILTER (b = 1 AND proba >= 0.5) AS h1, sum(w) FILTER (b = 0 AND proba < 0.5) AS h0, sum(w) FILTER (b = 1) AS s1, sum(w) FILTER (b = 0) AS s0, sum(w) FILTER (proba >= 0.5) AS c1, sum(w) FILTER (proba < 0.5) AS c0 FROM w GROUP BY 1),
  rb AS (SELECT replicate, (h1 + h0) / (s1 + s0)::DOUBLE AS accuracy, {_weighted_f1('h', 's', 'c')} AS f1 FROM z),
  q AS (SELECT replicate, proba, sum(w * b) AS pos, sum(w) AS n FROM w WHERE w > 0 GROUP BY 1, 2), c AS (SELECT *, sum(pos) OVER (PARTITION BY replicate ORDER BY proba DESC ROWS UNBOUNDED PRECEDING) AS cp FROM q), ab AS (SELECT replicate, sum((n - pos) * (cp - pos / 2.0)) / (sum(pos) * sum(n - pos)) AS auc FROM c GROUP BY 1)"""


@query("ev_boot_bca_class", f"WITH {CLS}, share AS (" + union_sql(["accuracy", "f1", "auc"], lambda m: _below(m, "est", "ab" if m == "auc" else "rb")) + "), curve AS (" + union_sql(["accuracy", "f1", "auc"], lambda m: _bend(m, m, "l"))
       + f") SELECT metric, {r('estimate', 6)} AS estimate, {r('below', 4)} AS below, {r('bend', 6)} AS acceleration FROM share JOIN curve USING (metric)")
def _(t):
    df = scores(t).withColumn("label", (F.col("proba") >= 0.5).cast("int"))
    return rounded(E.bootstrap_intervals(df, "id", "b", "label", B, task="classification", score="proba").select("metric", "estimate", "below", "acceleration"), {"estimate": 6, "below": 4, "acceleration": 6})


@query("ev_boot_metric", f"WITH {S}, {boot_cte()} SELECT replicate::INTEGER AS replicate, {r('sum(w * abs(y - pred) / y) / sum(w)')} AS metric FROM w GROUP BY 1")
def _(t):
    share = lambda y, p, w: F.sum(w * F.abs(y - p) / y) / F.sum(w)
    return rounded(E.bootstrap_metric(scores(t), "id", share, replicates=B), {"metric": 6})


@query("ev_subgroup", f"""WITH {S}, {boot_cte()}, v AS (SELECT 'Overall' AS subgroup, * FROM w UNION ALL SELECT g, * FROM w), k AS (SELECT subgroup, replicate, sqrt(sum(w * (y - pred) ** 2) / sum(w)) AS x FROM v GROUP BY 1, 2),
  e AS (SELECT 'Overall' AS subgroup, y - pred AS e FROM s UNION ALL SELECT g, y - pred FROM s), a AS (SELECT subgroup, count(*) AS n, sqrt(avg(e * e)) AS rmse FROM e GROUP BY 1)
  SELECT subgroup, any_value(n) AS n, {r('any_value(rmse)', 3)} AS rmse, {r('quantile_cont(x, 0.025)', 3)} AS ci_lower, {r('quantile_cont(x, 0.975)', 3)} AS ci_upper FROM a JOIN k USING (subgroup) WHERE n >= 5 GROUP BY 1""")
def _(t):
    return rounded(E.subgroups(scores(t), "id", "g", replicates=B), {"rmse": 3, "ci_lower": 3, "ci_upper": 3})


@query("ev_calib_bins", f"WITH {S} SELECT least(floor(proba * 10), 9)::INTEGER AS bin, count(*) AS n, {r('avg(proba)')} AS mean_score, {r('avg(b)')} AS observed_rate FROM s GROUP BY 1")
def _(t):
    return rounded(E.calibration_bins(scores(t), "b"), {"mean_score": 6, "observed_rate": 6})


@query("ev_calib_scores", f"WITH {L}, k AS (SELECT model, least(floor(proba * 10), 9) AS i, count(*) AS n, abs(avg(b) - avg(proba)) AS g, sum((proba - b) ** 2) AS q FROM m GROUP BY 1, 2) SELECT model, {r('sum(q) / sum(n)')} AS brier, {r('sum(n * g) / sum(n)')} AS ece, {r('max(g)')} AS mce FROM k GROUP BY 1")
def _(t):
    return rounded(E.calibration_scores(models(t), "b", by=["model"]), {"brier": 6, "ece": 6, "mce": 6})


@query("ev_calib_reg", f"WITH {L} SELECT model, {r('regr_slope(y, pred)')} AS slope, {r('regr_intercept(y, pred)', 3)} AS intercept, {r('regr_r2(y, pred)')} AS r2 FROM m GROUP BY 1")
def _(t):
    return rounded(E.calibration_line(models(t), by=["model"]), {"slope": 6, "intercept": 3, "r2": 6})


@query("ev_platt")
def _(t):
    df = scores(t)
    return E.recalibrate_platt(df.where("id % 10 < 7"), df.where("id % 10 >= 7"), "b").select("id", "b", "proba", "calibrated")


@query("ev_isotonic")
def _(t):
    df = scores(t)
    return E.recalibrate_isotonic(df.where("id % 10 < 7"), df.where("id % 10 >= 7"), "b").select("id", "b", "proba", "calibrated")


@query("ev_decision", f"""WITH {L}, t AS (SELECT model, i * 0.01::DOUBLE AS pt, i, count(*) AS n, sum(b) AS p, sum(b) FILTER (proba >= i * 0.01::DOUBLE) AS tp, count(*) FILTER (proba >= i * 0.01::DOUBLE) AS c FROM m, range(1, 100) g(i) GROUP BY 1, 2, 3)
  SELECT model, {r('pt')} AS threshold, {r('coalesce(tp, 0) / n::DOUBLE - (c - coalesce(tp, 0)) / n::DOUBLE * pt / (1 - pt)')} AS net_benefit, {r('p / n::DOUBLE - (1 - p / n::DOUBLE) * pt / (1 - pt)')} AS treat_all, 0.0::DOUBLE AS treat_none FROM t""")
def _(t):
    return rounded(E.decision_curve(models(t), "b", "proba", ["model"]), {"threshold": 6, "net_benefit": 6, "treat_all": 6, "treat_none": 6})


BOARD = f"{S}, p AS (SELECT 'rf' AS model, y, pred FROM s UNION ALL SELECT 'gbt', y, other FROM s UNION ALL SELECT 'ridge', y, pred * 1.01 FROM s), q AS (SELECT model, sqrt(avg((y - pred) ** 2)) AS rmse, 1 - avg((y - pred) ** 2) / var_pop(y) AS r2 FROM p GROUP BY 1)"


def board(t):
    s = scores(t)
    parts = [s.select(F.lit(m).alias("model"), "y", e.alias("pred")) for m, e in (("rf", F.col("pred")), ("gbt", F.col("other")), ("ridge", F.col("pred") * 1.01))]
    return E.regression_metrics(parts[0].unionByName(parts[1]).unionByName(parts[2]), by=["model"]).select("model", "rmse", "r2")


@query("ev_compare", f"""WITH {BOARD}, k AS (SELECT *, min(rmse) OVER () AS best, max(rmse) OVER () - min(rmse) OVER () AS spread, row_number() OVER (ORDER BY rmse, model)::INTEGER AS rank FROM q), c AS (SELECT *, rmse <= best * 1.05 AS competitive FROM k)
  SELECT model, {r('rmse', 4)} AS rmse, {r('r2')} AS r2, {r('best', 4)} AS best, {r('spread', 4)} AS spread, rank, competitive, row_number() OVER (ORDER BY competitive DESC, CASE model WHEN 'ridge' THEN 0 WHEN 'rf' THEN 1 ELSE 2 END, rank) = 1 AS simplest FROM c""")
def _(t):
    return rounded(E.leaderboard(board(t)), {"rmse": 4, "r2": 6, "best": 4, "spread": 4})


@query("ev_diag", f"""WITH {BOARD}, d AS (SELECT *, r2 + CASE model WHEN 'gbt' THEN 0.2 ELSE 0.01 END AS train_score, r2 AS test_score, rmse * 0.2 AS cv_std FROM q),
  a AS (SELECT min(rmse) FILTER (model = 'ridge') AS s, min(rmse) FILTER (model = 'gbt') AS c, max(r2) AS q, max(cv_std) AS cv, max(rmse) - min(rmse) AS sp FROM d)
  SELECT 'prefer_simpler' AS id, 'warning' AS severity, 'ridge' AS model, {r('abs(s - c) / c')} AS value, {r('0.05')} AS threshold FROM a WHERE s <= c * 1.05 UNION ALL SELECT 'low_performance', 'opportunity', NULL, {r('q')}, {r('0.15')} FROM a WHERE q >= 0 AND q < 0.15
  UNION ALL SELECT 'cv_variance', 'info', NULL, {r('cv')}, {r('0.5 * sp')} FROM a WHERE sp > 0 AND cv >= 0.5 * sp UNION ALL SELECT 'overfit', 'warning', model, {r('train_score - test_score')}, {r('0.1')} FROM d WHERE train_score - test_score > 0.1""")
def _(t):
    b = board(t).withColumns({"train_score": F.col("r2") + F.when(F.col("model") == "gbt", 0.2).otherwise(0.01), "test_score": F.col("r2"), "cv_std": F.col("rmse") * 0.2})
    return rounded(E.diagnose(b), {"value": 6, "threshold": 6})


