"""Splits, feature engineering, preprocessing."""

from pyspark.sql import functions as F

from ..functions.hashing import mix_sql, uniform_sql
from ..operators import features as FE
from ..operators import prep as P
from ..operators import splits as SP
from .audit import priced, skewed
from .base import LI, ORD, li, orders, query, r, rounded

# ---- splits ------------------------------------------------------------------------------------

U = uniform_sql("o_orderkey", 42)
H = mix_sql("o_orderkey", 42)


@query("spl_random", f"SELECT o_orderkey, CASE WHEN {U} < 0.7 THEN 'train' WHEN {U} < 0.7 + 0.15::DOUBLE THEN 'val' ELSE 'test' END AS split FROM orders")
def _(t):
    return SP.random_split(t.orders, "o_orderkey").select("o_orderkey", "split")


@query("spl_random_exact", f"""WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY {H}, o_orderkey) AS i, count(*) OVER () AS n FROM orders)
  SELECT o_orderkey, CASE WHEN i <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN i <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM k""")
def _(t):
    return SP.random_split(t.orders, "o_orderkey", exact=True).select("o_orderkey", "split")


@query("spl_stratified", f"""WITH k AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {H}, o_orderkey) AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
  SELECT o_orderkey, CASE WHEN i <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN i <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM k""")
def _(t):
    return SP.stratified_split(t.orders, "o_orderstatus", "o_orderkey").select("o_orderkey", "split")


UC = uniform_sql("user_id", 42)


@query("spl_group", f"SELECT event_id, user_id, CASE WHEN {UC} < 0.7 THEN 'train' WHEN {UC} < 0.7 + 0.15::DOUBLE THEN 'val' ELSE 'test' END AS split FROM events")
def _(t):
    return SP.group_split(t.events, "user_id").select("event_id", "user_id", "split")


@query("spl_time", """WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS i, count(*) OVER () AS n FROM orders)
  SELECT o_orderkey, CASE WHEN i <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN i <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM k""")
def _(t):
    return SP.time_split(t.orders, "o_orderdate", "o_orderkey").select("o_orderkey", "split")


FOLD_CASE = "CASE " + " ".join(f"WHEN i <= n * {f + 1} // 5 THEN {f}" for f in range(4)) + " ELSE 4 END"


@query("spl_folds", f"""WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY {H}, o_orderkey) AS i, count(*) OVER () AS n FROM orders),
  b AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {H}, o_orderkey) AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
  SELECT o_orderkey, {FOLD_CASE.replace('i <=', 'a.i <=').replace(' n *', ' a.n *').replace('<= n', '<= a.n')} AS fold, {FOLD_CASE.replace('i <=', 'b.i <=').replace('<= n', '<= b.n')} AS stratified_fold FROM a JOIN b USING (o_orderkey)""")
def _(t):
    plain = SP.folds(t.orders, 5, "o_orderkey")
    return SP.folds(plain.withColumnRenamed("fold", "plain"), 5, "o_orderkey", stratify="o_orderstatus").select(
        "o_orderkey", F.col("plain").alias("fold"), F.col("fold").alias("stratified_fold"))


@query("spl_sample", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {H}, o_orderkey LIMIT 500")
def _(t):
    return SP.sample(t.orders, 500, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("spl_checks", f"""WITH s AS (SELECT o_orderstatus, CASE WHEN {U} < 0.7 THEN 'train' WHEN {U} < 0.7 + 0.15::DOUBLE THEN 'val' ELSE 'test' END AS split FROM orders)
  SELECT split, count(*) AS n, count(DISTINCT o_orderstatus) AS n_classes, count(*) >= 2 AS enough_rows, count(DISTINCT o_orderstatus) >= 2 AS enough_classes, count(*) < 10 AS small FROM s GROUP BY 1""")
def _(t):
    return SP.split_checks(SP.random_split(t.orders, "o_orderkey"), "o_orderstatus", "classification")


@query("spl_class_weight", f"WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1) SELECT quality AS class, n, {r('sum(n) OVER () / ((count(*) OVER ()) * n)::DOUBLE', 8)} AS weight FROM c")
def _(t):
    return rounded(SP.class_weights(t.labels, "quality"), {"weight": 8})


# ---- features ----------------------------------------------------------------------------------

FE_BASE = "f AS (SELECT o_orderkey, o_totalprice / 99991 AS a, o_custkey % 7 AS b, o_orderkey % 5 - 2 AS c FROM orders)"


def base(t):
    return t.orders.select("o_orderkey", (F.col("o_totalprice") / 99991).alias("a"), (F.col("o_custkey") % 7).alias("b"), (F.col("o_orderkey") % 5 - 2).alias("c"))


TERMS = {"a^2": "a * a", "a b": "a * b", "a c": "a * c", "b^2": "b * b", "b c": "b * c", "c^2": "c * c", "a^3": "a * a * a", "a^2 b": "a * a * b", "a^2 c": "a * a * c",
         "a b^2": "a * b * b", "a b c": "a * b * c", "a c^2": "a * c * c", "b^3": "b * b * b", "b^2 c": "b * b * c", "b c^2": "b * c * c", "c^3": "c * c * c"}


@query("fe_poly", f"WITH {FE_BASE} SELECT o_orderkey, " + ", ".join(f'{r(e)} AS "{n}"' for n, e in TERMS.items()) + " FROM f")
def _(t):
    return rounded(FE.polynomial(base(t), ["a", "b", "c"], 3).drop("a", "b", "c"), {n: 6 for n in TERMS})


@query("fe_interact", f"WITH {FE_BASE} SELECT o_orderkey, {r('a * b')} AS a_x_b, {r('CASE WHEN c <> 0 THEN a / c END')} AS a_div_c, {r('a * a')} AS a_squared FROM f")
def _(t):
    df = FE.interaction(FE.interaction(FE.interaction(base(t), "a", "b"), "a", "c", "divide"), "a", op="square")
    return rounded(df.drop("a", "b", "c"), {"a_x_b": 6, "a_div_c": 6, "a_squared": 6})


@query("fe_math", f"""WITH {FE_BASE} SELECT o_orderkey, {r('ln(a)')} AS log_a, {r('ln(1 + a)')} AS log1p_a, {r('sqrt(a)')} AS sqrt_a, {r('a * a')} AS a_squared, {r('a * a * a')} AS a_cubed, {r('1 / a')} AS inv_a,
  {r('ln(1 + b)')} AS log1p_b, {r('sqrt(b)')} AS sqrt_b, {r('b * b')} AS b_squared, {r('b * b * b')} AS b_cubed, {r('c * c')} AS c_squared, {r('c * c * c')} AS c_cubed FROM f""")
def _(t):
    out = FE.math_transforms(base(t), ["a", "b", "c"]).drop("a", "b", "c")
    return rounded(out, {c: 6 for c in out.columns if c != "o_orderkey"})


@query("fe_ratio", f"WITH {FE_BASE} SELECT o_orderkey, {r('b / a')} AS b_div_a FROM f")
def _(t):
    return rounded(FE.ratios(base(t), [("b", "a"), ("a", "c")]).drop("a", "b", "c"), {"b_div_a": 6})


@query("fe_bin_quantile", f"""WITH {FE_BASE}, e AS (SELECT {', '.join(f'quantile_cont(a, {p}) AS e{i}' for i, p in enumerate((.2, .4, .6, .8)))} FROM f)
  SELECT o_orderkey, (a >= e0)::INTEGER + (a >= e1)::INTEGER + (a >= e2)::INTEGER + (a >= e3)::INTEGER AS a_binned FROM f, e""")
def _(t):
    return FE.binned(base(t), "a", 5, "quantile").select("o_orderkey", "a_binned")


@query("fe_bin_uniform", f"""WITH {FE_BASE}, e AS (SELECT min(a) AS lo, max(a) - min(a) AS w FROM f), k AS (SELECT o_orderkey, (a >= lo + w * 1 / 4)::INTEGER + (a >= lo + w * 2 / 4)::INTEGER + (a >= lo + w * 3 / 4)::INTEGER AS i FROM f, e)
  SELECT o_orderkey, {', '.join(f'(i = {i})::INTEGER AS a_bin_{i}' for i in range(4))} FROM k""")
def _(t):
    return FE.binned(base(t), "a", 4, "uniform", "onehot").drop("a", "b", "c")


@query("fe_bin_kmeans")
def _(t):
    return FE.binned(base(t), "a", 4, "kmeans").groupBy("a_binned").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("low"), F.max("a").alias("high"))


@query("fe_has_data", f"WITH {LI} SELECT l_linestatus, sum((l_quantity IS NOT NULL)::INTEGER)::BIGINT AS q, sum((l_discount IS NOT NULL)::INTEGER)::BIGINT AS d, count(*) AS n FROM li GROUP BY 1")
def _(t):
    df = FE.has_data(li(t), ["l_quantity", "l_discount", "l_linestatus"], 0.01)
    return df.groupBy("l_linestatus").agg(F.sum("l_quantity_has_data").alias("q"), F.sum("l_discount_has_data").alias("d"), F.count(F.lit(1)).alias("n"))


@query("fe_cond_ordinal", f"WITH {ORD}, k AS (SELECT o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority)::INTEGER AS i FROM (SELECT DISTINCT o_orderpriority FROM ord WHERE o_orderpriority IS NOT NULL)) SELECT o_orderkey, coalesce(i, 0) AS o_orderpriority_ordinal FROM ord LEFT JOIN k USING (o_orderpriority)")
def _(t):
    return FE.conditional_ordinal(orders(t), ["o_orderpriority"]).select("o_orderkey", F.col("o_orderpriority_ordinal").cast("int").alias("o_orderpriority_ordinal"))


PRICED = ["l_extendedprice", "l_quantity", "l_discount", "p_size", "p_retailprice"]


@query("fe_pca")
def _(t):
    return FE.add_pca(priced(t), PRICED, 2).select("id", *PRICED, "PCA_1", "PCA_2")


@query("fe_kmeans")
def _(t):
    return FE.add_kmeans(priced(t), ["l_extendedprice", "l_quantity", "l_discount"], 3, onehot=True).drop("q2", "p_brand", "p_type")


@query("fe_append", f"WITH {FE_BASE} SELECT o_orderkey, {r('ln(a)')} AS log_a, {r('a + b')} AS total FROM f")
def _(t):
    df = FE.append(base(t), {"log_a": F.log("a"), "total": F.col("a") + F.col("b"), "a": F.lit(0.0)})
    return rounded(df.select("o_orderkey", "log_a", "total"), {"log_a": 6, "total": 6})


# ---- preprocessing -----------------------------------------------------------------------------

TRAIN = "tr AS (SELECT * FROM ord WHERE o_orderkey % 10 < 7)"


def train_of(t):
    return orders(t).where("o_orderkey % 10 < 7")


def _impute_query(how, fill):
    @query(f"pre_impute_{how}", f"WITH {ORD}, {TRAIN} SELECT o_orderkey, {r(f'coalesce(o_totalprice, (SELECT {fill} FROM tr))', 4)} AS o_totalprice FROM ord")
    def _(t):
        return rounded(P.impute(orders(t), P.fill_values(train_of(t), ["o_totalprice"], how)).select("o_orderkey", "o_totalprice"), {"o_totalprice": 4})


for _how, _fill in (("mean", "avg(o_totalprice)"), ("median", "quantile_cont(o_totalprice, 0.5)"), ("constant", "any_value(0.0)")):
    _impute_query(_how, _fill)


@query("pre_impute_iterative")
def _(t):
    df = li(t).select("id", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    fitted = P.fit_chained(df, ["l_extendedprice", "l_quantity", "l_discount", "l_tax"])
    return P.apply_chained(df, fitted)


@query("pre_missing_flag", f"WITH {ORD} SELECT o_orderkey, (o_totalprice IS NULL)::INTEGER AS missingindicator_o_totalprice FROM ord")
def _(t):
    flags = P.missing_names(train_of(t), ["o_totalprice", "o_custkey"])
    return P.missing_flags(orders(t), flags).select("o_orderkey", *[f"missingindicator_{c}" for c in flags])


@query("pre_log1p", f"WITH {ORD} SELECT o_orderkey, {r('ln(1 + greatest(o_totalprice - 200000, 0)) + CASE WHEN o_totalprice IS NULL THEN NULL ELSE 0 END')} AS y FROM ord")
def _(t):
    return rounded(orders(t).select("o_orderkey", P.log1p_positive(F.col("o_totalprice") - 200000).alias("y")), {"y": 6})


@query("pre_yeojohnson")
def _(t):
    df = skewed(t).where("wide is not null")
    lambdas = P.power_lambdas(df, ["wide"])
    return df.select("o_orderkey", P.yeo_johnson(F.col("wide"), lambdas["wide"]).alias("wide"), F.lit(lambdas["wide"]).alias("lambda"))


def _scale_query(how, shift, scale):
    @query(f"pre_scale_{how}", f"WITH {ORD}, {TRAIN} SELECT o_orderkey, {r(f'(o_totalprice - (SELECT {shift} FROM tr)) / (SELECT {scale} FROM tr)')} AS o_totalprice FROM ord")
    def _(t):
        return rounded(P.rescale(orders(t), P.scaling(train_of(t), ["o_totalprice"], how)).select("o_orderkey", "o_totalprice"), {"o_totalprice": 6})


for _how, _shift, _scale in (("standard", "avg(o_totalprice)", "stddev_pop(o_totalprice)"),
                             ("robust", "quantile_cont(o_totalprice, 0.5)", "quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)"),
                             ("minmax", "min(o_totalprice)", "max(o_totalprice) - min(o_totalprice)")):
    _scale_query(_how, _shift, _scale)


@query("pre_cat_mode", f"WITH {ORD}, {TRAIN} SELECT o_orderkey, coalesce(o_orderpriority, (SELECT o_orderpriority FROM tr WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority FROM ord")
def _(t):
    fill = P.modes(train_of(t), ["o_orderpriority"])
    return orders(t).select("o_orderkey", F.coalesce("o_orderpriority", F.lit(fill["o_orderpriority"])).alias("o_orderpriority"))


@query("pre_cat_constant", f"WITH {ORD} SELECT o_orderkey, coalesce(o_orderpriority, 'missing') AS o_orderpriority FROM ord")
def _(t):
    fitted = P.fit(train_of(t), P.Recipe(categorical=["o_orderpriority"], cat_impute="constant"))
    return orders(t).select("o_orderkey", F.coalesce("o_orderpriority", F.lit(fitted.steps[0][1]["o_orderpriority"])).alias("o_orderpriority"))


@query("pre_onehot", f"WITH {ORD} SELECT o_orderkey, " + ", ".join(f"coalesce((o_orderstatus = '{s}')::INTEGER, 0) AS \"o_orderstatus_{s}\"" for s in "FOP")
       + ", (o_orderkey % 2 = 1)::INTEGER AS parity_odd FROM ord")
def _(t):
    df = orders(t).withColumn("parity", F.when(F.col("o_orderkey") % 2 == 1, "odd").otherwise("even"))
    cats = P.categories(df.where("o_orderkey % 10 < 7"), ["o_orderstatus", "parity"])
    return P.onehot(df, cats).select("o_orderkey", "o_orderstatus_F", "o_orderstatus_O", "o_orderstatus_P", "parity_odd")


@query("pre_ordinal", f"WITH {ORD}, k AS (SELECT o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority)::INTEGER - 1 AS i FROM (SELECT DISTINCT o_orderpriority FROM ord WHERE o_orderpriority <> '5-LOW')) SELECT o_orderkey, coalesce(i, -1) AS o_orderpriority FROM ord LEFT JOIN k USING (o_orderpriority)")
def _(t):
    return P.ordinal(orders(t), orders(t).where("o_orderpriority <> '5-LOW'"), ["o_orderpriority"]).select("o_orderkey", F.col("o_orderpriority").cast("int").alias("o_orderpriority"))


@query("pre_target_encode", f"""WITH {ORD}, {TRAIN}, c AS (SELECT o_orderpriority AS v, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS s FROM tr WHERE o_totalprice IS NOT NULL GROUP BY 1), g AS (SELECT avg(o_totalprice) AS g, var_pop(o_totalprice) AS gv FROM tr)
  SELECT o_orderkey, {r('coalesce((n / (n + s / gv)) * m + (1 - n / (n + s / gv)) * g, g)', 4)} AS o_orderpriority FROM ord CROSS JOIN g LEFT JOIN c ON o_orderpriority IS NOT DISTINCT FROM v""")
def _(t):
    return rounded(P.target_encode(orders(t), train_of(t), "o_orderpriority", "o_totalprice").select("o_orderkey", "o_orderpriority"), {"o_orderpriority": 4})


FOLD = f"floor({U} * 5)::INTEGER"


@query("pre_target_encode_oof", f"""WITH {ORD}, k AS (SELECT *, {FOLD} AS f FROM ord), y AS (SELECT * FROM k WHERE o_totalprice IS NOT NULL), g AS (SELECT a.f, avg(y.o_totalprice) AS g, var_pop(y.o_totalprice) AS gv FROM (SELECT DISTINCT f FROM y) a JOIN y ON y.f <> a.f GROUP BY 1),
  c AS (SELECT a.v, a.f, count(y.o_totalprice) AS n, avg(y.o_totalprice) AS m, var_pop(y.o_totalprice) AS s FROM (SELECT DISTINCT o_orderpriority AS v, f FROM y) a JOIN y ON y.o_orderpriority IS NOT DISTINCT FROM a.v AND y.f <> a.f GROUP BY 1, 2)
  SELECT o_orderkey, {r('CASE WHEN n > 0 THEN (n / (n + s / gv)) * m + (1 - n / (n + s / gv)) * g ELSE g END', 2)} AS encoded FROM k JOIN g USING (f) JOIN c ON k.f = c.f AND o_orderpriority IS NOT DISTINCT FROM v""")
def _(t):
    return rounded(P.target_encode_out_of_fold(orders(t), "o_orderpriority", "o_totalprice", "o_orderkey", name="encoded").select("o_orderkey", "encoded"), {"encoded": 2})


@query("pre_passthrough", f"""WITH {ORD}, {TRAIN}, m AS (SELECT quantile_cont(o_totalprice, 0.5) AS m FROM tr), z AS (SELECT avg(coalesce(o_totalprice, m)) AS a, stddev_pop(coalesce(o_totalprice, m)) AS s FROM tr, m)
  SELECT o_orderkey, {r('(coalesce(o_totalprice, m) - a) / s')} AS o_totalprice FROM ord, m, z""")
def _(t):
    fitted = P.fit(train_of(t), P.Recipe(passthrough=["o_totalprice"], power="log1p", outliers="mad"))
    return rounded(fitted.apply(orders(t)).select("o_orderkey", "o_totalprice"), {"o_totalprice": 6})


@query("pre_kmeans")
def _(t):
    df = priced(t).drop("q2", "p_brand", "p_type", "l_returnflag", "l_linestatus")
    return P.fit(df, P.Recipe(numeric=["l_quantity", "l_discount", "p_size"], kmeans=3)).apply(df)


@query("pre_pca")
def _(t):
    df = priced(t).drop("q2", "p_brand", "p_type", "l_returnflag", "l_linestatus")
    return P.fit(df, P.Recipe(numeric=PRICED, pca=0.9, whiten=True)).apply(df)


FULL = dict(numeric=["o_totalprice"], categorical=["o_orderpriority", "o_orderstatus"], missing_flags=True, power="log1p", outliers="percentile")


@query("pre_names", f"""WITH {ORD}, {TRAIN} SELECT row_number() OVER (ORDER BY g, v)::INTEGER - 1 AS position, n || v AS feature FROM (SELECT 0 AS g, 'o_totalprice' AS n, '' AS v UNION ALL SELECT 1, 'missingindicator_o_totalprice', '' FROM tr HAVING count(*) > count(o_totalprice)
  UNION ALL SELECT DISTINCT 2, 'o_orderpriority_', o_orderpriority FROM tr WHERE o_orderpriority IS NOT NULL UNION ALL SELECT DISTINCT 3, 'o_orderstatus_', o_orderstatus FROM tr)""")
def _(t):
    return P.fit(train_of(t), P.Recipe(**FULL)).feature_names(t.spark)


@query("pre_recipe")
def _(t):
    return P.fit(train_of(t), P.Recipe(**FULL)).describe(t.spark)


@query("pre_label_encode", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority)::INTEGER - 1 AS o_orderpriority_code FROM orders")
def _(t):
    return P.label_encode(t.orders, "o_orderpriority").select("o_orderkey", F.col("o_orderpriority_code").cast("int").alias("o_orderpriority_code"))


@query("pre_basic", f"""WITH {ORD}, b AS (SELECT o_orderkey, o_totalprice, o_custkey, CASE WHEN {U} < 0.8 THEN 'train' ELSE 'test' END AS split FROM ord WHERE o_totalprice IS NOT NULL OR o_orderkey % 2 = 0),
  c AS (SELECT o_orderkey, o_totalprice AS x, o_custkey AS y, split FROM b WHERE o_totalprice IS NOT NULL), m AS (SELECT quantile_cont(x, 0.5) AS m FROM c WHERE split = 'train'), z AS (SELECT avg(coalesce(x, m)) AS a, stddev_pop(coalesce(x, m)) AS s FROM c, m WHERE split = 'train')
  SELECT o_orderkey, {r('(coalesce(x, m) - a) / s')} AS x, y, split FROM c, m, z""")
def _(t):
    df = orders(t).select("o_orderkey", F.col("o_totalprice").alias("x"), F.col("o_custkey").alias("y"))
    return rounded(P.basic(df, "y", ["x"], "o_orderkey"), {"x": 6})


@query("pre_model_rules", f"""WITH {ORD}, {TRAIN}, m AS (SELECT quantile_cont(o_totalprice, 0.5) AS m FROM tr), z AS (SELECT avg(coalesce(o_totalprice, m)) AS a, stddev_pop(coalesce(o_totalprice, m)) AS s FROM tr, m)
  SELECT 'ridge' AS model, count(*) AS n, {r('sum((coalesce(o_totalprice, m) - a) / s)', 4)} AS total FROM ord, m, z UNION ALL SELECT 'rf', count(*), {r('sum(coalesce(o_totalprice, m))', 2)} FROM ord, m""")
def _(t):
    start = P.Recipe(numeric=["o_totalprice"], scale="none", power="yeo-johnson", kmeans=3)
    out = None
    for model, digits in (("ridge", 4), ("rf", 2)):
        fitted = P.fit(train_of(t), P.recipe_for_model(start, model, "high"))
        one = fitted.apply(orders(t)).agg(F.lit(model).alias("model"), F.count(F.lit(1)).alias("n"), (F.round(F.sum("o_totalprice"), digits) + 0.0).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


@query("pre_target_transform", f"WITH {ORD} SELECT o_orderkey, {r('ln(1 + o_totalprice)')} AS forward, {r('exp(ln(1 + o_totalprice)) - 1', 4)} AS back FROM ord WHERE o_totalprice IS NOT NULL")
def _(t):
    df = orders(t).where("o_totalprice is not null")
    tr = P.fit_target_transform(df, "o_totalprice", "log1p")
    z = df.select("o_orderkey", tr.forward(F.col("o_totalprice")).alias("forward"))
    return rounded(z.withColumn("back", tr.inverse(F.col("forward"))), {"forward": 6, "back": 4})


