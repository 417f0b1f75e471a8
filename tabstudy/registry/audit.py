"""Audit, profile, missing data, plausibility, outliers."""

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import columns as C
from ..operators import hypothesis as H
from ..operators import joins as J
from ..operators import missing as M
from ..operators import outliers as O
from ..operators import plausibility as PL
from ..operators import profile as PR
from .base import LI, LI_NUM, ORD, li, orders, query, r, rounded, union_sql
from .tables import CLINICAL, clinical

DUP = f"{LI}, d AS (SELECT l_quantity, l_discount, l_tax, l_returnflag FROM li)"
DUP_COLS = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]


@query("agg_overview", f"""WITH {DUP}, g AS (SELECT count(*) AS n FROM d GROUP BY ALL), s AS (SELECT count(*) AS n_rows, {' + '.join(f'count(*) - count({c})' for c in DUP_COLS)} AS missing_cells FROM d)
  SELECT n_rows, 4 AS n_columns, missing_cells::BIGINT AS missing_cells, {r('missing_cells * 100.0 / (n_rows * 4)')} AS missing_pct, 3::BIGINT AS numeric_columns, n_rows - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS duplicate_rows FROM s""")
def _(t):
    return rounded(A.overview(li(t).select(*DUP_COLS)), {"missing_pct": 6})


@query("agg_duplicates", f"WITH {DUP} SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS duplicate_rows, "
       + r("(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d))) / count(*)::DOUBLE") + " AS duplicate_rate FROM d")
def _(t):
    return rounded(A.duplicate_summary(li(t).select(*DUP_COLS)), {"duplicate_rate": 6})


@query("agg_duplicates_members", f"WITH {DUP} SELECT d.l_quantity, d.l_discount, d.l_tax, d.l_returnflag FROM d QUALIFY count(*) OVER (PARTITION BY l_quantity, l_discount, l_tax, l_returnflag) > 1")
def _(t):
    return A.duplicate_rows(li(t).select(*DUP_COLS))


@query("agg_duplicates_dropped", f"WITH {DUP} SELECT DISTINCT * FROM d")
def _(t):
    return A.drop_duplicates(li(t).select(*DUP_COLS))


CARD = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "one", "two"]
CARD_CTE = "c AS (SELECT *, 1 AS one, c_custkey % 2 AS two FROM customer)"


@query("agg_cardinality", f"WITH {CARD_CTE}, u AS (" + union_sql(CARD, lambda c: f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique, count(*) AS n FROM c")
       + f""") SELECT "column", n_unique, {r('n_unique * 100.0 / n')} AS pct_unique, CASE WHEN n_unique = 1 THEN 'Constant' WHEN n_unique = 2 THEN 'Binary' WHEN n_unique = n THEN 'Unique'
  WHEN n_unique <= 10 THEN 'Low' WHEN n_unique <= 50 THEN 'Moderate' WHEN n_unique * 100.0 / n > 90 THEN 'High near-unique' ELSE 'High' END AS cardinality_class FROM u""")
def _(t):
    df = t.customer.withColumns({"one": F.lit(1), "two": F.col("c_custkey") % 2})
    return rounded(A.cardinality(df), {"pct_unique": 6})


@query("agg_dtypes", f"WITH {ORD} " + union_sql(
    [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderpriority", "string")],
    lambda c: f"SELECT '{c[0]}' AS \"column\", '{c[1]}' AS dtype, count({c[0]}) AS non_null, count(*) - count({c[0]}) AS nulls, count(DISTINCT {c[0]}) AS n_unique, "
              f"CASE WHEN count(*) > count({c[0]}) THEN (count(*) - count({c[0]}))::VARCHAR || ' missing' ELSE 'OK' END AS issues FROM ord"))
def _(t):
    return A.dtypes(orders(t).drop("o_orderdate")).drop("sample")


MISS = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query("agg_missing", f"WITH {LI}, m AS (" + union_sql(MISS, lambda c: f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, (count(*) - count({c})) / count(*)::DOUBLE AS x FROM li")
       + f""") SELECT "column", missing, {r('x')} AS missing_rate, x > 0.05 AS over_5, x > 0.10 AS over_10, x > 0.50 AS over_50 FROM m""")
def _(t):
    return rounded(A.missing(li(t), MISS), {"missing_rate": 6})


def describe_sql(c, table):
    return (f"SELECT '{c}' AS \"column\", count({c}) AS n, {r(f'avg({c})', 4)} AS mean, {r(f'stddev_samp({c})', 4)} AS std, {r(f'min({c})', 4)} AS min, "
            + ", ".join(f"{r(f'quantile_cont({c}, {p})', 4)} AS {k}" for k, p in (("q25", .25), ("q50", .5), ("q75", .75)))
            + f", {r(f'max({c})', 4)} AS max, {r(f'skewness({c})', 5)} AS skewness, {r(f'kurtosis({c})', 5)} AS kurtosis FROM {table}")


@query("agg_describe", f"WITH {LI} " + union_sql(LI_NUM, lambda c: describe_sql(c, "li")))
def _(t):
    return rounded(A.describe(li(t), LI_NUM), {**{k: 4 for k in ("mean", "std", "min", "q25", "q50", "q75", "max")}, "skewness": 5, "kurtosis": 5})


@query("agg_inspect", f"""WITH {ORD}, s AS (SELECT count(DISTINCT o_totalprice)::DOUBLE AS "unique", (count(*) - count(o_totalprice))::DOUBLE AS missing, avg(o_totalprice) AS mean, min(o_totalprice) AS min,
  quantile_cont(o_totalprice, 0.5) AS median, max(o_totalprice) AS max, stddev_samp(o_totalprice) AS std FROM ord),
  p AS (SELECT o_orderpriority AS text, count(*) AS n FROM ord WHERE o_orderpriority IS NOT NULL GROUP BY 1)
  SELECT 'o_totalprice' AS "column", item, NULL::VARCHAR AS text, {r('number', 4)} AS number FROM s UNPIVOT (number FOR item IN ("unique", missing, mean, min, median, max, std))
  UNION ALL SELECT 'o_orderpriority', 'unique', NULL, {r('count(*)', 4)} FROM p UNION ALL SELECT 'o_orderpriority', 'missing', NULL, {r('count(*)', 4)} FROM ord WHERE o_orderpriority IS NULL
  UNION ALL SELECT * FROM (SELECT 'o_orderpriority', 'top', text, {r('n', 4)} FROM p ORDER BY n DESC, text LIMIT 3)""")
def _(t):
    df = orders(t)
    both = A.inspect(df, "o_totalprice").withColumn("column", F.lit("o_totalprice")).unionByName(
        A.inspect(df, "o_orderpriority", 3).withColumn("column", F.lit("o_orderpriority")))
    return rounded(both, {"number": 4})


@query("agg_histogram", f"""WITH {ORD}, b AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 30 AS w FROM ord),
  c AS (SELECT least(floor((o_totalprice - lo) / w), 29)::INTEGER AS bin, count(*) AS n FROM ord, b WHERE o_totalprice IS NOT NULL GROUP BY 1)
  SELECT i::INTEGER AS bin, {r('lo + i * w', 4)} AS low, {r('lo + (i + 1) * w', 4)} AS high, coalesce(n, 0) AS n FROM range(30) g(i) CROSS JOIN b LEFT JOIN c ON c.bin = i""")
def _(t):
    return rounded(A.histogram(orders(t), "o_totalprice", 30), {"low": 4, "high": 4})


def five_sql(c):
    return ", ".join(f"{r(f'quantile_cont({c}, {p})', 4)} AS \"{k}\"" for k, p in (("min", 0.0), ("q25", .25), ("median", .5), ("q75", .75), ("max", 1.0)))


FIVE = {k: 4 for k in ("min", "q25", "median", "q75", "max")}


@query("agg_box", f"WITH {ORD} SELECT o_orderstatus AS \"group\", count(o_totalprice) AS n, {five_sql('o_totalprice')} FROM ord GROUP BY 1")
def _(t):
    return rounded(A.box_summary(orders(t), "o_totalprice", "o_orderstatus"), FIVE)


@query("agg_value_counts", "SELECT l_suppkey AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, value LIMIT 15")
def _(t):
    return A.value_counts(t.lineitem, "l_suppkey", 15)


FP = ["o_orderkey", "o_totalprice", "o_orderpriority", "c_acctbal", "c_mktsegment", "n_name"]
FP_CTE = ("j AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS o_orderpriority, "
          "c_acctbal, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)")


def _fp_sql(c):
    numeric = c in ("o_orderkey", "o_totalprice", "c_acctbal")
    num = lambda e, d=4: r(e, d) if numeric else "NULL::DOUBLE"
    dtype = {"o_orderkey": "bigint", "o_totalprice": "double", "c_acctbal": "double"}.get(c, "string")
    lo, hi = f"(SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM j)", f"(SELECT quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM j)"
    out = f"count(*) FILTER ({c} < {lo} OR {c} > {hi})" if numeric else "NULL::BIGINT"
    rate = f"{out} / count({c})::DOUBLE" if numeric else "NULL::DOUBLE"
    return (f"SELECT '{c}' AS \"column\", '{dtype}' AS dtype, {numeric} AS is_numeric, count(*) - count({c}) AS missing, {r(f'(count(*) - count({c})) / count(*)::DOUBLE')} AS missing_rate, "
            f"count(DISTINCT {c}) AS n_unique, {r(f'count(DISTINCT {c}) / count(*)::DOUBLE')} AS cardinality_ratio, {num(f'avg({c})')} AS mean, {num(f'stddev_samp({c})')} AS std, {num(f'min({c})')} AS min, "
            f"{num(f'quantile_cont({c}, 0.5)')} AS median, {num(f'max({c})')} AS max, {num(f'skewness({c})', 5)} AS skewness, {out} AS outliers, {r(rate)} AS outlier_rate, coalesce({rate} > 0.01, false) AS has_outliers, "
            f"{not numeric} AND (count(DISTINCT {c}) / count(*)::DOUBLE > 0.5 OR count(DISTINCT {c}) > 50) AS high_cardinality, count(DISTINCT {c}) <= 1 AS is_constant, "
            f"{dtype == 'bigint'} AND count(DISTINCT {c}) = count(*) AS is_id_like FROM j")


def joined(t):
    return J.merge_chain({"orders": orders(t), "customer": t.customer, "nation": t.nation}, [
        {"left": "orders", "right": "customer", "left_on": "o_custkey", "right_on": "c_custkey"},
        {"left": "result", "right": "nation", "left_on": "c_nationkey", "right_on": "n_nationkey"}]).select(*FP)


@query("agg_feature_profile", f"WITH {FP_CTE} " + union_sql(FP, _fp_sql))
def _(t):
    return rounded(PR.feature_profile(joined(t)), {"missing_rate": 6, "cardinality_ratio": 6, "mean": 4, "std": 4, "min": 4, "median": 4, "max": 4, "skewness": 5, "outlier_rate": 6})


@query("agg_feature_profile_top", f"WITH {FP_CTE}, c AS (" + union_sql(["o_orderpriority", "c_mktsegment", "n_name"], lambda c: f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM j WHERE {c} IS NOT NULL GROUP BY 2")
       + """), k AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value)::INTEGER AS rank FROM c) SELECT "column", rank, value, n FROM k WHERE rank <= 5""")
def _(t):
    return PR.top_categories(joined(t))


@query("agg_target_profile", f"""WITH {ORD}, b AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM ord),
  s AS (SELECT count(o_totalprice) AS n, count(DISTINCT o_totalprice) AS n_unique, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS std, min(o_totalprice) AS min, quantile_cont(o_totalprice, 0.5) AS median,
    max(o_totalprice) AS max, skewness(o_totalprice) AS skewness, count(*) FILTER (o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1)) / count(o_totalprice)::DOUBLE AS x FROM ord, b)
  SELECT 'o_totalprice' AS "column", n, n_unique, {r('mean', 4)} AS mean, {r('std', 4)} AS std, {r('min', 4)} AS min, {r('median', 4)} AS median, {r('max', 4)} AS max, {r('skewness', 5)} AS skewness, {r('x')} AS outlier_rate, x > 0.05 AS has_outliers FROM s""")
def _(t):
    return rounded(PR.target_profile(orders(t), "o_totalprice", "regression"), {"mean": 4, "std": 4, "min": 4, "median": 4, "max": 4, "skewness": 5, "outlier_rate": 6})


@query("agg_target_profile_class", f"""WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1), s AS (SELECT sum(n)::BIGINT AS n, count(*) AS k, min(n) AS lo, max(n) AS hi FROM c)
  SELECT 'quality' AS "column", n, k AS n_classes, lo AS minority_size, hi AS majority_size, {r('hi / lo::DOUBLE')} AS balance_ratio, {r('hi / n::DOUBLE')} AS majority_share,
  CASE WHEN hi > 10 * lo THEN 'severe' WHEN hi > 5 * lo THEN 'moderate' WHEN hi > 2 * lo THEN 'mild' ELSE 'none' END AS imbalance FROM s""")
def _(t):
    return rounded(PR.target_profile(t.labels, "quality", "classification"), {"balance_ratio": 6, "majority_share": 6})


def _listed(condition):
    return f"coalesce(string_agg(CASE WHEN {condition} THEN \"column\" END, ', ' ORDER BY \"column\"), '')"


@query("agg_dataset_profile", f"""WITH {FP_CTE}, f AS ({union_sql([c for c in FP if c != 'o_totalprice'], _fp_sql)}), n AS (SELECT count(*) AS n FROM j)
  SELECT count(*) FILTER (is_numeric) AS n_numeric, count(*) FILTER (NOT is_numeric) AS n_categorical, sum(missing)::BIGINT AS missing_cells, count(*) FILTER (missing > 0) AS columns_missing,
  count(*) FILTER (missing_rate > 0.1) AS columns_high_missing, count(*) FILTER (missing_rate > 0.5) AS columns_critical_missing, {_listed('high_cardinality')} AS high_cardinality, {_listed('is_constant')} AS constant,
  {_listed('is_id_like')} AS id_like, {_listed('has_outliers')} AS with_outliers, {_listed('abs(skewness) > 1')} AS skewed, any_value(n) AS n_rows, 5 AS n_features, {r('5 / any_value(n)::DOUBLE', 8)} AS p_n_ratio,
  NULL::BIGINT AS minority_size, NULL::DOUBLE AS epv, CASE WHEN any_value(n) < 50 THEN 'critical' WHEN any_value(n) < 100 THEN 'scarce' WHEN any_value(n) < 500 THEN 'limited' WHEN any_value(n) < 5000 THEN 'adequate' ELSE 'abundant' END AS level,
  {r('sum(missing) / (any_value(n) * 5)::DOUBLE', 8)} AS missing_cell_rate, 'regression' AS task FROM f, n""")
def _(t):
    return rounded(PR.dataset_profile(joined(t), "o_totalprice"), {"p_n_ratio": 8, "missing_cell_rate": 8})


@query("agg_sufficiency", f"""WITH d AS (SELECT * FROM documents JOIN labels USING (doc_id)), c AS (SELECT count(*) AS c FROM d GROUP BY quality), s AS (SELECT sum(c)::BIGINT AS n, min(c) AS m FROM c)
  SELECT n AS n_rows, 12 AS n_features, {r('12 / n::DOUBLE', 8)} AS p_n_ratio, m AS minority_size, {r('m / 12.0')} AS epv,
  ['critical','scarce','limited','adequate','abundant'][least(CASE WHEN n < 50 THEN 0 WHEN n < 100 THEN 1 WHEN n < 500 THEN 2 WHEN n < 5000 THEN 3 ELSE 4 END,
   CASE WHEN 12 > n THEN 0 WHEN 24 > n THEN 1 ELSE 4 END, CASE WHEN m / 12.0 < 5 THEN 0 WHEN m / 12.0 < 10 THEN 1 ELSE 4 END) + 1] AS level FROM s""")
def _(t):
    df = t.documents.join(t.labels, "doc_id")
    return rounded(PR.sufficiency(df, [f"f{i}" for i in range(12)], "quality", "classification"), {"p_n_ratio": 8, "epv": 6})


@query("agg_warnings", f"""WITH {FP_CTE}, f AS ({union_sql([c for c in FP if c != 'c_mktsegment'], _fp_sql)}), n AS (SELECT count(*) AS n FROM j), b AS (SELECT max(c) / min(c)::DOUBLE AS b FROM (SELECT count(*) AS c FROM j GROUP BY c_mktsegment)),
  s AS (SELECT any_value(n) AS n, count(*) FILTER (missing_rate > 0.1) AS hm, count(*) FILTER (missing_rate > 0.5) AS cm, {_listed('high_cardinality')} AS hc, count(*) FILTER (high_cardinality) AS nhc, {_listed('has_outliers')} AS o, count(*) FILTER (has_outliers) AS no FROM f, n)
  SELECT 'sample_size' AS id, 'sample_size' AS category, CASE WHEN n < 100 THEN 'critical' ELSE 'warning' END AS severity, '' AS columns, n::DOUBLE AS value, 500.0::DOUBLE AS threshold FROM s WHERE n < 500
  UNION ALL SELECT 'dimensionality', 'dimensionality', CASE WHEN 5 > n THEN 'critical' ELSE 'warning' END, '', {r('5.0 / n')}, 0.5 FROM s WHERE 5 / n::DOUBLE > 0.5
  UNION ALL SELECT 'imbalance', 'imbalance', CASE WHEN b > 10 THEN 'critical' WHEN b > 5 THEN 'warning' ELSE 'caution' END, '', {r('b')}, 2 FROM b WHERE b > 2
  UNION ALL SELECT 'missingness', 'missingness', CASE WHEN cm > 0 THEN 'critical' ELSE 'warning' END, '', hm, 0 FROM s WHERE hm > 0
  UNION ALL SELECT 'cardinality', 'cardinality', 'caution', hc, nhc, 0 FROM s WHERE nhc > 0 UNION ALL SELECT 'outliers', 'outliers', 'caution', o, no, 0 FROM s WHERE no > 0
  UNION ALL SELECT 'plausibility', 'plausibility', 'caution', 'c_acctbal', 1, 0 FROM s""")
def _(t):
    return rounded(PR.warnings(joined(t), "c_mktsegment", implausible=["c_acctbal"]), {"value": 6})


OPP = ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice", "q2"]
OPP_CTE = "o AS (SELECT l_extendedprice, l_quantity, l_discount, l_tax, p_size, p_retailprice, exp(l_quantity / 5) AS q2 FROM lineitem JOIN part ON l_partkey = p_partkey)"


def priced(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_extendedprice", "l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice", F.exp(F.col("l_quantity") / 5).alias("q2"), "p_brand", "p_type",
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1009 + F.col("l_partkey") % 1009).alias("id"), "l_returnflag", "l_linestatus",
        (F.col("l_quantity") * F.col("p_retailprice") * (1 - F.col("l_discount")) + F.col("l_tax") * 10000).alias("amount"))


def _rank_sql(c, table):
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


@query("agg_opportunities", f"""WITH {OPP_CTE}, k AS (SELECT {_rank_sql('l_extendedprice', 'o')} AS ry, {', '.join(f'{_rank_sql(c, "o")} AS r_{c}' for c in OPP)} FROM o),
  s AS (SELECT avg(g) AS gap FROM ({union_sql(OPP, lambda c: f"SELECT abs((SELECT corr(r_{c}, ry) FROM k)) - abs((SELECT corr({c}, l_extendedprice) FROM o)) AS g")})),
  m AS (SELECT greatest({', '.join(f'abs(corr({c}, l_extendedprice))' for c in OPP)}) AS top, count(*) / 6.0 AS np FROM o),
  w AS ({union_sql(OPP, lambda c: f"SELECT '{c}' AS c, {OPP.index(c)} AS i, skewness({c}) AS s FROM o")})
  SELECT 'strong_signal' AS id, 'relationship' AS category, 'opportunity' AS severity, '' AS columns, {r('top')} AS value, 0.7::DOUBLE AS threshold FROM m WHERE top > 0.7
  UNION ALL SELECT 'nonlinear', 'relationship', 'opportunity', '', {r('gap')}, 0.08 FROM s WHERE gap > 0.08
  UNION ALL SELECT 'high_np', 'sufficiency', 'opportunity', '', {r('np')}, 100 FROM m WHERE np > 100
  UNION ALL SELECT 'skew_group', 'distribution', 'info', string_agg(c, ', ' ORDER BY i), count(*), 0 FROM w WHERE abs(s) > 2 HAVING count(*) > 0""")
def _(t):
    return rounded(PR.opportunities(priced(t), "l_extendedprice", OPP), {"value": 6})


@query("agg_regime", f"""WITH {LI}, m AS (SELECT count(*) AS n, {', '.join(f'1 - count({c}) / count(*)::DOUBLE AS {c}' for c in MISS)} FROM li)
  SELECT n AS n_rows, 5 AS n_features, 3 AS n_numeric, 2 AS n_categorical, 0 AS n_datetime, {' + '.join(f'({c} > 0)::INTEGER' for c in MISS)} AS columns_missing, {' + '.join(f'({c} > 0.05)::INTEGER' for c in MISS)} AS columns_high_missing,
  'narrow' AS feature_regime, CASE WHEN n < 100 THEN 'tiny' WHEN n < 10000 THEN 'standard' WHEN n < 100000 THEN 'large' ELSE 'massive' END AS row_regime, 'numeric' AS target_type FROM m""")
def _(t):
    return PR.regime(li(t), MISS, "l_extendedprice")


@query("agg_task_type", f"""WITH u AS (SELECT count(*) AS n, count(DISTINCT quality) AS u, min(quality) AS lo, max(quality) AS hi FROM labels)
  SELECT 'quality' AS target, u AS n_unique, {r('u / n::DOUBLE', 8)} AS unique_ratio, CASE WHEN (u = 2 AND lo = 0 AND hi = 1) OR u <= 10 OR u / n::DOUBLE < 0.02 THEN 'classification' ELSE 'regression' END AS detected,
    CASE WHEN u = 2 AND lo = 0 AND hi = 1 THEN 'high' WHEN u <= 5 THEN 'med' WHEN u <= 10 THEN 'low' ELSE 'med' END AS confidence FROM u
  UNION ALL SELECT 'o_totalprice', u, {r('u / n::DOUBLE', 8)}, CASE WHEN u <= 10 OR u / n::DOUBLE < 0.02 THEN 'classification' ELSE 'regression' END, CASE WHEN u <= 10 THEN 'med' WHEN u / n::DOUBLE < 0.02 THEN 'low' ELSE 'high' END FROM (SELECT count(*) AS n, count(DISTINCT o_totalprice) AS u FROM orders)
  UNION ALL SELECT 'o_orderstatus', u, {r('u / n::DOUBLE', 8)}, 'classification', 'high' FROM (SELECT count(*) AS n, count(DISTINCT o_orderstatus) AS u FROM orders)""")
def _(t):
    both = PR.task_type(t.labels, "quality").unionByName(PR.task_type(t.orders, "o_totalprice")).unionByName(PR.task_type(t.orders, "o_orderstatus"))
    return rounded(both, {"unique_ratio": 8})


@query("agg_cohort", f"""WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), s AS (SELECT quantile_cont(n, 0.5) AS m, avg((n > 1)::INTEGER) AS rr FROM c)
  SELECT (SELECT count(*) FROM events) AS n_rows, CASE WHEN m >= 2 OR rr > 0.1 THEN 'longitudinal' ELSE 'cross_sectional' END AS detected, CASE WHEN m >= 2 THEN 'high' ELSE 'med' END AS confidence,
  'user_id' AS entity_candidates, 'user_id' AS entity, {r('m')} AS median_rows, {r('rr')} AS repeat_rate, 'ts' AS time_columns FROM s""")
def _(t):
    df = t.events.select("user_id", "ts", "event_type", "value")
    return rounded(PR.cohort(df, patterns=["user"], min_ratio=0.0, time_patterns=["date", "timestamp"]), {"median_rows": 6, "repeat_rate": 6})


@query("agg_rows_per_entity", f"""WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT 'o_custkey' AS entity, count(*) AS entities, {r('quantile_cont(n, 0.5)')} AS median_rows, {r('avg(n)')} AS mean_rows,
  max(n) AS max_rows, {r('avg((n > 1)::INTEGER)')} AS repeat_rate FROM c""")
def _(t):
    return rounded(PR.rows_per_entity(t.orders, "o_custkey"), {"median_rows": 6, "mean_rows": 6, "repeat_rate": 6})


@query("agg_rows_per_entity_hist", 'SELECT n AS "rows", count(*) AS entities FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY 1')
def _(t):
    return PR.rows_per_entity_histogram(t.orders, "o_custkey")


@query("agg_crosstab", f"WITH {LI} SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM li WHERE l_returnflag IS NOT NULL GROUP BY ALL")
def _(t):
    return H.crosstab(li(t), "l_returnflag", "l_linestatus")


T1_NUM = ["l_quantity", "l_extendedprice", "l_discount"]


@query("agg_table1", f"""WITH {LI}, g AS (SELECT 'Overall' AS stratum, * FROM li UNION ALL SELECT l_linestatus, * FROM li),
  n AS ({union_sql(T1_NUM, lambda c: f"SELECT '{c}' AS variable, stratum, count({c}) AS n, count(*) - count({c}) AS missing, avg({c}) AS mean, stddev_samp({c}) AS sd, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75 FROM g GROUP BY stratum")})
  SELECT variable, NULL::VARCHAR AS level, stratum, n, missing, {r('mean', 4)} AS mean, {r('sd', 4)} AS sd, {r('q25', 4)} AS q25, {r('q50', 4)} AS q50, {r('q75', 4)} AS q75, NULL::DOUBLE AS share FROM n
  UNION ALL SELECT 'l_returnflag', l_returnflag, stratum, count(*), NULL, NULL, NULL, NULL, NULL, NULL, {r('count(*) / sum(count(*)) OVER (PARTITION BY stratum)::DOUBLE')} FROM g WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag, stratum""")
def _(t):
    out = PR.table_one(li(t), T1_NUM, ["l_returnflag"], "l_linestatus", with_p=False)
    return rounded(out.drop("text"), {**{k: 4 for k in ("mean", "sd", "q25", "q50", "q75")}, "share": 6})


@query("agg_table1_tests", f"""WITH {LI} SELECT 'l_quantity' AS variable, 'mannwhitney' AS test UNION ALL SELECT 'l_extendedprice', 'mannwhitney' UNION ALL SELECT 'l_returnflag', 'chi2' FROM li HAVING count(*) > 0""")
def _(t):
    out = PR.table_one(li(t), ["l_quantity", "l_extendedprice"], ["l_returnflag"], "l_linestatus")
    return out.select("variable", "test").distinct()


@query("agg_smd", f"WITH {LI} " + union_sql(T1_NUM, lambda c: f"""SELECT '{c}' AS variable, {r('abs(m0 - m1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2))', 8)} AS smd FROM (SELECT count({c}) FILTER (l_linestatus = 'F') AS n0,
  count({c}) FILTER (l_linestatus = 'O') AS n1, avg({c}) FILTER (l_linestatus = 'F') AS m0, avg({c}) FILTER (l_linestatus = 'O') AS m1, var_samp({c}) FILTER (l_linestatus = 'F') AS v0, var_samp({c}) FILTER (l_linestatus = 'O') AS v1 FROM li)"""))
def _(t):
    return rounded(PR.smd(li(t), T1_NUM, "l_linestatus", ["F", "O"]), {"smd": 8})


# ---- missing data ------------------------------------------------------------------------------

MC = ["l_quantity", "l_discount"]


@query("mis_target_num", f"WITH {LI} " + union_sql(MC, lambda c: f"""SELECT '{c}' AS "column", n1, n0, {r('m1', 4)} AS mean_missing, {r('m0', 4)} AS mean_observed, {r('abs(m1 - m0)', 4)} AS difference, 't' AS test,
  {r('(m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0 / n1 + 1.0 / n0))')} AS statistic FROM (SELECT count(*) FILTER ({c} IS NULL) AS n1, count(*) FILTER ({c} IS NOT NULL) AS n0,
  avg(l_extendedprice) FILTER ({c} IS NULL) AS m1, avg(l_extendedprice) FILTER ({c} IS NOT NULL) AS m0, var_samp(l_extendedprice) FILTER ({c} IS NULL) AS v1, var_samp(l_extendedprice) FILTER ({c} IS NOT NULL) AS v0 FROM li)"""))
def _(t):
    out = M.target_by_missing(li(t), "l_extendedprice", M.high_missing(li(t), [*LI_NUM]))
    return rounded(out.drop("p"), {"mean_missing": 4, "mean_observed": 4, "difference": 4, "statistic": 6})


@query("mis_target_num_rank", f"WITH {LI}, k AS (SELECT l_quantity, l_extendedprice, {_rank_sql('l_extendedprice', 'li')} AS rk FROM li) SELECT 'l_quantity' AS \"column\", count(*) FILTER (l_quantity IS NULL) AS n1, "
       + r("sum(rk) FILTER (l_quantity IS NULL) - count(*) FILTER (l_quantity IS NULL) * (count(*) FILTER (l_quantity IS NULL) + 1) / 2.0", 3) + " AS statistic FROM k")
def _(t):
    return rounded(M.target_by_missing(li(t), "l_extendedprice", ["l_quantity"], parametric=False).select("column", "n1", "statistic"), {"statistic": 3})


@query("mis_target_cat", f"""WITH {LI}, c AS (SELECT l_linestatus AS k, count(*) FILTER (l_quantity IS NULL) AS a, count(*) FILTER (l_quantity IS NOT NULL) AS b FROM li GROUP BY 1), m AS (SELECT sum(a) AS n1, sum(b) AS n0, count(*) AS k FROM c)
  SELECT 'l_quantity' AS "column", any_value(n1)::BIGINT AS n1, any_value(n0)::BIGINT AS n0, {r('max(abs(a / n1::DOUBLE - b / n0::DOUBLE))')} AS max_share_difference, 'chi2' AS test,
  {r('sum((abs(a - e1) - least(0.5, abs(a - e1))) ** 2 / e1 + (abs(b - e0) - least(0.5, abs(b - e0))) ** 2 / e0)')} AS statistic
  FROM (SELECT *, n1 * (a + b) / (n1 + n0)::DOUBLE AS e1, n0 * (a + b) / (n1 + n0)::DOUBLE AS e0 FROM c, m)""")
def _(t):
    return rounded(M.class_by_missing(li(t), "l_linestatus", ["l_quantity"]).drop("p"), {"max_share_difference": 6, "statistic": 6})


@query("mis_pattern", f"WITH {LI} SELECT concat_ws(', ', {', '.join(f'CASE WHEN {c} IS NULL THEN {chr(39)}{c}{chr(39)} END' for c in MISS)}) AS pattern, {' + '.join(f'({c} IS NULL)::INTEGER' for c in MISS)} AS n_missing, count(*) AS n FROM li GROUP BY ALL")
def _(t):
    return M.missing_patterns(li(t), MISS)


# ---- plausibility ------------------------------------------------------------------------------

def _unit_rows():
    out = []
    for c in ("fasting_glucose", "bmi_base", "waist_in"):
        variable = PL.first_match(c, [h[0] for h in PL.UNIT_HYPOTHESES])
        for i, (v, canonical, unit, f, lo, hi) in enumerate([h for h in PL.UNIT_HYPOTHESES if h[0] == variable]):
            reach = 2.0 * (hi - lo)
            out.append(f"SELECT '{c}' AS \"column\", '{v}' AS variable, '{unit}' AS unit, '{canonical}' AS canonical_unit, {f}::DOUBLE AS factor, {i} AS position, avg(CASE WHEN {c} IS NOT NULL THEN ({c} * {f} BETWEEN {lo} AND {hi})::INTEGER END) AS fit, "
                       f"avg(CASE WHEN {c} IS NOT NULL THEN ({c} * {f} < {lo - reach} OR {c} * {f} > {hi + reach})::INTEGER END) AS ex FROM cl")
    return " UNION ALL ".join(out)


UNITS = f"u AS ({_unit_rows()}), best AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY \"column\" ORDER BY fit - ex * 0.5 DESC, position) = 1)"


@query("pla_unit", f"WITH {CLINICAL}, {UNITS} SELECT \"column\", variable, unit, canonical_unit, factor, {r('fit')} AS fit, {r('fit - ex * 0.5')} AS score, CASE WHEN fit >= 0.9 THEN 'high' WHEN fit >= 0.7 THEN 'med' ELSE 'low' END AS confidence FROM best")
def _(t):
    return rounded(PL.infer_units(clinical(t)), {"fit": 6, "score": 6})


@query("pla_harmonise", f"WITH {CLINICAL} SELECT event_id, {r('fasting_glucose * 18.0')} AS fasting_glucose, {r('waist_in * 2.54')} AS waist_in FROM cl")
def _(t):
    factors = PL.conversion_factors(clinical(t), ["fasting_glucose", "waist_in"], {"fasting_glucose": "mmol/L", "waist_in": "inches"})
    return rounded(PL.harmonise(clinical(t), factors).select("event_id", "fasting_glucose", "waist_in"), {"fasting_glucose": 6, "waist_in": 6})


@query("pla_bounds", f"WITH {CLINICAL} SELECT 'fasting_glucose' AS \"column\", 70.0::DOUBLE AS low, 200.0::DOUBLE AS high, count(fasting_glucose) AS n FROM cl UNION ALL SELECT 'bmi_base', 15, 50, count(bmi_base) FROM cl UNION ALL SELECT 'waist_in', 55, 150, count(waist_in) FROM cl")
def _(t):
    df = clinical(t)
    found = [(c, *b) for c, b in PL.plausible_bounds(df.columns).items()]
    return t.spark.createDataFrame(found, "column string, low double, high double").join(C.numeric_columns(df).withColumnRenamed("non_null", "n"), "column")


@query("pla_gate", f"WITH {CLINICAL} SELECT event_id, CASE WHEN fasting_glucose BETWEEN 70 AND 200 THEN fasting_glucose END AS fasting_glucose, CASE WHEN bmi_base BETWEEN 15 AND 50 THEN bmi_base END AS bmi_base FROM cl")
def _(t):
    return PL.gate(clinical(t), PL.plausible_bounds(["fasting_glucose", "bmi_base"])).select("event_id", "fasting_glucose", "bmi_base")


PLA = {"fasting_glucose": ("glucose", 70, 200), "bmi_base": ("bmi", 15, 50), "waist_in": ("waist", 55, 150)}


@query("pla_report", f"WITH {CLINICAL}, {UNITS} " + union_sql(list(PLA), lambda c: f"""SELECT '{c}' AS "column", '{PLA[c][0]}' AS variable, {PLA[c][1]}::DOUBLE AS low, {PLA[c][2]}::DOUBLE AS high, count(x) AS n, {r('min(x)')} AS min, {r('max(x)')} AS max,
  count(*) FILTER (x < {PLA[c][1]} OR x > {PLA[c][2]}) AS out_of_range, {r(f'count(*) FILTER (x < {PLA[c][1]} OR x > {PLA[c][2]}) / count(x)::DOUBLE')} AS out_rate, count(*) FILTER (x < {PLA[c][1]} OR x > {PLA[c][2]}) / count(x)::DOUBLE > 0.05 AS flagged
  FROM (SELECT {c} * factor AS x FROM cl, best WHERE "column" = '{c}')"""))
def _(t):
    return rounded(PL.plausibility_report(clinical(t)), {"min": 6, "max": 6, "out_rate": 6})


BANDS = [b for b in PL.THRESHOLD_BANDS if b[0] == "glucose" and b[1] == "mg/dL"]


@query("pla_report_bands", f"WITH {CLINICAL} " + union_sql(BANDS, lambda b: f"SELECT 'fasting_glucose' AS \"column\", '{b[2]}' AS band, count(*) FILTER (fasting_glucose >= {b[3]}"
       + (f" AND fasting_glucose < {b[4]}" if b[4] else "") + ") AS n, " + r(f"count(*) FILTER (fasting_glucose >= {b[3]}" + (f" AND fasting_glucose < {b[4]}" if b[4] else "") + ") / count(*)::DOUBLE") + " AS share FROM cl"))
def _(t):
    return rounded(PL.threshold_bands(clinical(t), {"fasting_glucose": "mg/dL"}), {"share": 6})


# ---- outliers ----------------------------------------------------------------------------------

def bounds_sql(c, method, table):
    if method == "iqr":
        return f"(SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo, quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM {table})"
    if method == "mad":
        return f"(SELECT any_value(m) - 3.5 * 1.4826 * quantile_cont(abs({c} - m), 0.5) AS lo, any_value(m) + 3.5 * 1.4826 * quantile_cont(abs({c} - m), 0.5) AS hi FROM {table}, (SELECT quantile_cont({c}, 0.5) AS m FROM {table}))"
    if method == "zscore":
        return f"(SELECT avg({c}) - 3 * stddev_samp({c}) AS lo, avg({c}) + 3 * stddev_samp({c}) AS hi FROM {table})"
    return f"(SELECT quantile_cont({c}, 0.01) AS lo, quantile_cont({c}, 0.99) AS hi FROM {table})"


def _mask_sql(c, method, table):
    if method == "mad":
        return f"abs(0.6745 * ({c} - (SELECT quantile_cont({c}, 0.5) FROM {table})) / (SELECT quantile_cont(abs({c} - m), 0.5) FROM {table}, (SELECT quantile_cont({c}, 0.5) AS m FROM {table}))) > 3.5"
    return f"({c} < lo OR {c} > hi)"


OUT_CTE = f"{ORD}, w AS (SELECT o_orderkey, o_totalprice, exp(o_totalprice / 100000) AS wide FROM ord)"


def skewed(t):
    return orders(t).select("o_orderkey", "o_totalprice", F.exp(F.col("o_totalprice") / 100000).alias("wide"))


def _out_query(method):
    @query(f"out_{method}", f"WITH {OUT_CTE} SELECT o_orderkey, coalesce({_mask_sql('wide', method, 'w')}, false) AS wide_outlier FROM w, {bounds_sql('wide', method, 'w')} b")
    def _(t):
        return O.mark_outliers(skewed(t), ["wide"], method).select("o_orderkey", "wide_outlier")


for _m in O.METHODS:
    _out_query(_m)


@query("out_rate", f"WITH {OUT_CTE} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{m}' AS method, {r('any_value(lo)', 3)} AS lower, {r('any_value(hi)', 3)} AS upper, count({c}) AS n, count(*) FILTER ({_mask_sql(c, m, 'w')}) AS outliers, {r(f'count(*) FILTER ({_mask_sql(c, m, chr(119))}) / count({c})::DOUBLE')} AS rate FROM w, {bounds_sql(c, m, 'w')} b"
    for c in ("o_totalprice", "wide") for m in O.METHODS))
def _(t):
    return rounded(O.outlier_rates(skewed(t), ["o_totalprice", "wide"]), {"lower": 3, "upper": 3, "rate": 6})


@query("out_cap", f"WITH {OUT_CTE} SELECT o_orderkey, {r('CASE WHEN wide IS NOT NULL THEN greatest(least(wide, hi), lo) END')} AS wide FROM w, {bounds_sql('wide', 'percentile', 'w')} b")
def _(t):
    df = skewed(t)
    return rounded(O.cap(df, O.capping_bounds(df, ["wide"])).select("o_orderkey", "wide"), {"wide": 6})


@query("out_target", f"WITH {OUT_CTE} SELECT 'wide' AS \"column\", 'iqr' AS method, {r('any_value(lo)', 3)} AS lower, {r('any_value(hi)', 3)} AS upper, count(wide) AS n, count(*) FILTER (wide < lo OR wide > hi) AS outliers, {r('count(*) FILTER (wide < lo OR wide > hi) / count(wide)::DOUBLE')} AS rate FROM w, {bounds_sql('wide', 'iqr', 'w')} b")
def _(t):
    return rounded(O.outlier_summary(skewed(t), "wide", "iqr"), {"lower": 3, "upper": 3, "rate": 6})


