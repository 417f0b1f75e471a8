"""Sources, column filters, joins."""

import os

from pyspark.sql import functions as F

from ..functions.storage import new_folder
from ..operators import columns as C
from ..operators import joins as J
from ..operators import plausibility as PL
from ..sources import tables as S
from .base import LI, LI_NUM, ORD, Tables, li, orders, query, r, rnd, rounded, union_sql


def scratch(t: Tables, name: str) -> str:
    return new_folder(t.spark, name)


# ---- sources -----------------------------------------------------------------------------------

@query("src_detect", "SELECT 'orders.parquet' AS name, 'parquet' AS format, count(*) AS n FROM orders")
def _(t):
    path = t.path("orders")
    fmt = S.detect_format(path)
    return S.load_table(t.spark, path, fmt).agg(F.count(F.lit(1)).alias("n")).select(F.lit(os.path.basename(path)).alias("name"), F.lit(fmt).alias("format"), "n")


TEXT_SUMS = ("SELECT o_orderstatus, count(*) AS n, " + r("sum(o_totalprice)", 2) + " AS total, count(DISTINCT o_orderpriority) AS priorities "
             "FROM orders GROUP BY o_orderstatus")


def _text_sums(df):
    return df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("o_totalprice"), 2).alias("total"),
                                           F.count_distinct("o_orderpriority").alias("priorities"))


@query("src_csv", TEXT_SUMS)
def _(t):
    path = scratch(t, "orders_csv")
    S.write_csv(t.orders, path)
    return _text_sums(S.read_csv(t.spark, path))


@query("src_tsv", TEXT_SUMS)
def _(t):
    path = scratch(t, "orders_tsv")
    t.orders.write.mode("overwrite").options(header=True, sep="\t").csv(path)
    return _text_sums(S.load_table(t.spark, path, "tsv"))


@query("src_parquet", "SELECT * FROM orders")
def _(t):
    return S.read_parquet(t.spark, t.path("orders"))


@query("src_load", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(t):
    return S.load_table(t.spark, t.path("customer"))


@query("src_preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def _(t):
    return S.preview(t.orders, 5, "o_orderkey")


@query("src_transpose", "WITH s AS (SELECT o_orderstatus AS k, count(*) AS n, count(DISTINCT o_custkey) AS c FROM orders GROUP BY 1) "
       + " UNION ALL ".join(f"SELECT '{c}' AS field, " + ", ".join(f"max(CASE WHEN k = '{k}' THEN {c} END)::VARCHAR AS \"{k}\"" for k in "FOP") + " FROM s" for c in "nc"))
def _(t):
    per_status = t.orders.groupBy(F.col("o_orderstatus").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("c"))
    return S.transpose(per_status, "k")


@query("src_orient", "SELECT count(*) AS n_rows, 7 AS n_columns, 7 > 2 * count(*) AND 7 > 10 AS probably_transposed FROM (SELECT l_suppkey FROM lineitem)")
def _(t):
    return S.orientation(t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_tax", "l_discount"))


@query("snk_csv", "SELECT o_orderpriority, count(*) AS n, " + r("avg(o_totalprice)", 4) + " AS mean_price FROM orders GROUP BY 1")
def _(t):
    summary = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean_price"))
    path = scratch(t, "summary_csv")
    S.write_csv(summary, path)
    return rounded(S.read_csv(t.spark, path, schema="o_orderpriority string, n bigint, mean_price double"), {"mean_price": 4})


# ---- columns and filters -----------------------------------------------------------------------

KEPT = lambda cols, table: union_sql(cols, lambda c: f"SELECT '{c}' AS \"column\", count({c}) AS non_null FROM {table} HAVING count({c}) > 0")


@query("prj_numeric_cols", f"WITH {LI} " + KEPT(["id", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LI_NUM], "li"))
def _(t):
    return C.numeric_columns(li(t))


@query("prj_cat_cols", f"WITH {LI} " + KEPT(["l_returnflag", "l_linestatus"], "li"))
def _(t):
    return C.categorical_columns(li(t))


@query("prj_validate", "SELECT * FROM (VALUES ('target_exists','o_totalprice',true),('has_features',NULL,true),('target_not_a_feature','o_totalprice',true),"
       "('feature_exists','o_custkey',true),('feature_exists','o_nothing',false),('has_usable_values','o_totalprice',(SELECT count(o_totalprice)>0 FROM orders)),"
       "('has_usable_values','o_custkey',(SELECT count(o_custkey)>0 FROM orders)),('target_is_numeric','o_totalprice',true)) v(\"check\",\"column\",ok)")
def _(t):
    return C.validate_selection(t.orders, "o_totalprice", ["o_custkey", "o_nothing"], "regression")


@query("prj_reconcile", "SELECT " + r("avg(l_extendedprice)", 4) + " AS l_extendedprice, " + r("avg(l_quantity)") + " AS l_quantity, " + r("avg(l_tax)") + " AS l_tax FROM lineitem")
def _(t):
    df = t.lineitem.drop("l_discount")
    target, features, _ = C.reconcile(df.columns, "l_extendedprice", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return rounded(df.agg(*[F.avg(c).alias(c) for c in [target, *features]]), {"l_extendedprice": 4, "l_quantity": 6, "l_tax": 6})


@query("prj_kind", union_sql(["c_custkey", "c_nationkey", "c_acctbal"], lambda c: f"SELECT '{c}' AS \"column\", 'numeric' AS kind FROM customer HAVING count(*) >= 0")
       + " UNION ALL " + union_sql(["c_name", "c_mktsegment"], lambda c: f"SELECT '{c}', CASE WHEN count(DISTINCT {c}) / count(*)::DOUBLE > 0.8 THEN 'text_like' ELSE 'categorical' END FROM customer"))
def _(t):
    return C.column_kinds(t.customer)


PRIORITY_TEXT = "CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_orderkey::VARCHAR END"


@query("prj_coerce", f"SELECT 'code' AS \"column\", count(*) AS non_null, count(TRY_CAST({PRIORITY_TEXT} AS DOUBLE)) AS numeric_values, "
       f"count(TRY_CAST({PRIORITY_TEXT} AS DOUBLE)) BETWEEN 1 AND count(*) - 1 AS mixed, " + r(f"sum(TRY_CAST({PRIORITY_TEXT} AS DOUBLE))", 2) + " AS total FROM orders")
def _(t):
    df = t.orders.select(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(F.col("o_orderkey").cast("string")).alias("code"))
    total = C.coerce_numeric(df, ["code"]).agg(rnd(F.sum("code"), 2).alias("total"), F.lit("code").alias("column"))
    return C.mixed_types(df).join(total, "column")


@query("flt_target_notnull", f"WITH {ORD} SELECT o_orderkey, o_totalprice FROM ord WHERE o_totalprice IS NOT NULL")
def _(t):
    return C.drop_missing_target(orders(t), "o_totalprice").select("o_orderkey", "o_totalprice")


@query("flt_target_trim", f"WITH {ORD} SELECT o_orderkey, o_totalprice FROM ord WHERE o_totalprice BETWEEN (SELECT quantile_cont(o_totalprice, 0.05) FROM ord) AND (SELECT quantile_cont(o_totalprice, 0.95) FROM ord)")
def _(t):
    return C.trim_target(orders(t), "o_totalprice", 0.05, 0.95).select("o_orderkey", "o_totalprice")


@query("flt_plausible", f"WITH {LI} SELECT count(*) AS n, count(DISTINCT l_orderkey) AS n_orders FROM li WHERE l_quantity * 2.54 BETWEEN 20 AND 100 AND l_discount <= 0.08")
def _(t):
    kept = C.plausible_rows(li(t), {"l_quantity": (20, 100), "l_discount": (None, 0.08)}, {"l_quantity": 2.54})
    return kept.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("n_orders"))


@query("flt_drop_constant", "SELECT o_orderkey, o_totalprice FROM orders")
def _(t):
    df = t.orders.select("o_orderkey", "o_totalprice").withColumn("one", F.lit(1)).withColumn("same", F.when(F.col("o_orderkey") % 2 == 0, "x"))
    return C.drop_constant(df)


@query("flt_drop_columns", "SELECT o_orderkey, o_totalprice, o_totalprice * 2 AS twice FROM orders")
def _(t):
    df = t.orders.select("o_orderkey", "o_totalprice", (F.col("o_totalprice") * 2).alias("twice"), (F.col("o_totalprice") ** 2).alias("square"))
    return C.drop_columns(df, ["square"])


@query("flt_pairwise_complete", f"WITH {LI} SELECT l_linestatus, count(*) AS n, {r('sum(l_quantity)', 2)} AS q, {r('sum(l_discount)', 4)} AS d FROM li WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL GROUP BY 1")
def _(t):
    return rounded(C.pairwise_complete(li(t), "l_quantity", "l_discount").groupBy("l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"), F.sum("l_discount").alias("d")), {"q": 2, "d": 4})


@query("flt_flow", f"""WITH {ORD}, m AS (SELECT *, o_orderpriority IS NULL AS a, coalesce(o_orderstatus = 'P', false) AS b,
    CASE WHEN o_orderkey % 10 < 7 THEN 'train' WHEN o_orderkey % 10 = 7 THEN 'val' ELSE 'test' END AS s FROM ord),
  c AS (SELECT count(*) n0, count(*) FILTER (a) n1, count(*) FILTER (NOT a AND b) n2, count(*) FILTER (a OR b) n3, count(*) FILTER (NOT a AND NOT b) n4,
    count(*) FILTER (NOT a AND NOT b AND o_totalprice IS NULL) n5, count(*) FILTER (NOT a AND NOT b AND o_totalprice IS NOT NULL) n6,
    count(*) FILTER (NOT a AND NOT b AND o_totalprice IS NOT NULL AND s = 'train') n7, count(*) FILTER (NOT a AND NOT b AND o_totalprice IS NOT NULL AND s = 'val') n8,
    count(*) FILTER (NOT a AND NOT b AND o_totalprice IS NOT NULL AND s = 'test') n9 FROM m)
  SELECT p AS position, step, n FROM c, LATERAL (VALUES (0,'total',n0),(1,'excluded: no priority',n1),(2,'excluded: pending',n2),(3,'excluded',n3),(4,'after exclusions',n4),
    (5,'missing target',n5),(6,'analysed',n6),(7,'train',n7),(8,'val',n8),(9,'test',n9)) v(p, step, n)""")
def _(t):
    split = F.when(F.col("o_orderkey") % 10 < 7, "train").when(F.col("o_orderkey") % 10 == 7, "val").otherwise("test")
    return C.flow_counts(orders(t), {"no priority": F.col("o_orderpriority").isNull(), "pending": F.col("o_orderstatus") == "P"}, "o_totalprice", split)


# ---- joins -------------------------------------------------------------------------------------

# Keys with nulls on both sides: a null key meets a null key.
A = "a AS (SELECT o_orderkey, CASE WHEN o_custkey % 50 <> 0 THEN o_custkey % 400 END AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 20 < 19)"
B = "b AS (SELECT c_custkey, CASE WHEN c_custkey <> 100 AND c_custkey >= 200 THEN c_custkey - 200 END AS k, c_acctbal AS v FROM customer WHERE c_custkey >= 199 AND c_custkey % 7 <> 0)"


def _sides(t):
    a = t.orders.where("o_orderkey % 20 < 19").select("o_orderkey", F.when(F.col("o_custkey") % 50 != 0, F.col("o_custkey") % 400).alias("k"), F.col("o_totalprice").alias("v"))
    b = t.customer.where("c_custkey >= 199 and c_custkey % 7 <> 0").select("c_custkey", F.when(F.col("c_custkey") >= 200, F.col("c_custkey") - 200).alias("k"), F.col("c_acctbal").alias("v"))
    return a, b


def _join_query(how, sql_how):
    @query(f"join_{how}", f"WITH {A}, {B} SELECT o_orderkey, coalesce(a.k, b.k) AS k, a.v AS v_x, c_custkey, b.v AS v_y FROM a {sql_how} JOIN b ON a.k IS NOT DISTINCT FROM b.k")
    def _(t):
        a, b = _sides(t)
        return J.merge(a, b, on="k", how=how)


for _how, _sql in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL")):
    _join_query(_how, _sql)


@query("join_chain", "SELECT o_orderkey, o_custkey, c_custkey, c_nationkey, n_nationkey, n_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    tables = {"orders": t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "customer": t.customer.select("c_custkey", "c_nationkey"),
              "nation": t.nation.select("n_nationkey", "n_name")}
    return J.merge_chain(tables, [
        {"left": "orders", "right": "customer", "left_on": "o_custkey", "right_on": "c_custkey", "how": "inner"},
        {"left": "result", "right": "nation", "left_on": "c_nationkey", "right_on": "n_nationkey", "how": "left"}])


def _keyed(t):
    """Tables renamed so that key columns share their names, as joins by name need."""
    return {
        "orders": t.orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_key"), F.col("o_orderdate").alias("date")),
        "customers": t.customer.select(F.col("c_custkey").alias("customer_key"), F.col("c_nationkey").alias("code")),
        "items": t.lineitem.select(F.col("l_orderkey").alias("order_id"), F.col("l_shipdate").alias("date"), F.col("l_quantity").alias("quantity")),
        "nations": t.nation.select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name")),
    }


@query("join_common_cols", """WITH c AS (SELECT * FROM (VALUES ('order_id','orders, items'),('customer_key','orders, customers'),('date','orders, items'),('code','customers, nations')) v("column", datasets)),
  m AS (SELECT 'order_id' AS "column", count(*) AS matching_keys FROM (SELECT o_orderkey FROM orders INTERSECT SELECT l_orderkey FROM lineitem)
  UNION ALL SELECT 'customer_key', count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer)
  UNION ALL SELECT 'date', count(*) FROM (SELECT o_orderdate FROM orders INTERSECT SELECT l_shipdate FROM lineitem)
  UNION ALL SELECT 'code', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT n_nationkey FROM nation)) SELECT * FROM c JOIN m USING ("column")""")
def _(t):
    tables = _keyed(t)
    counts = J.suggest_keys_with_matches(tables).groupBy(F.col("join_column").alias("column")).agg(F.max("matching_keys").alias("matching_keys"))
    return J.common_columns(tables).join(counts, "column")


@query("join_suggest", """SELECT * FROM (SELECT 'orders' AS left_dataset, 'items' AS right_dataset, 'order_id' AS join_column, 0.8::DOUBLE AS confidence, count(*) AS matching_keys FROM (SELECT o_orderkey FROM orders INTERSECT SELECT l_orderkey FROM lineitem)
  UNION ALL SELECT 'orders', 'customers', 'customer_key', 0.6, count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer)
  UNION ALL SELECT 'orders', 'items', 'date', 0.2, count(*) FROM (SELECT o_orderdate FROM orders INTERSECT SELECT l_shipdate FROM lineitem)
  UNION ALL SELECT 'customers', 'nations', 'code', 0.4, count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT n_nationkey FROM nation))""")
def _(t):
    return J.suggest_keys_with_matches(_keyed(t))


@query("join_match_count", "SELECT count(*) AS matching_keys FROM (SELECT l_partkey FROM lineitem INTERSECT SELECT p_partkey FROM part WHERE p_size < 20)")
def _(t):
    return J.match_count(t.lineitem, "l_partkey", t.part.where("p_size < 20"), "p_partkey")


CLINICAL = "cl AS (SELECT event_id, user_id, value * 4 AS fasting_glucose, 18 + value / 3 AS bmi_base, CASE WHEN event_id % 9 <> 0 THEN 40 + value END AS waist_in, event_type FROM events)"


def clinical(t: Tables):
    """Events rescaled to three clinical-looking columns."""
    v = F.col("value")
    return t.events.select("event_id", "user_id", (v * 4).alias("fasting_glucose"), (18 + v / 3).alias("bmi_base"),
                           F.when(F.col("event_id") % 9 != 0, 40 + v).alias("waist_in"), "event_type")


@query("join_lookup_units", f"""WITH {CLINICAL} SELECT 'fasting_glucose' AS "column", 'glucose' AS variable, count(fasting_glucose) AS n FROM cl UNION ALL SELECT 'bmi_base', 'bmi', count(bmi_base) FROM cl
  UNION ALL SELECT 'waist_in', 'waist', count(waist_in) FROM cl""")
def _(t):
    df = clinical(t)
    found = PL.match_variables(PL.column_list(df), PL.intervals_table(t.spark))
    return found.join(C.numeric_columns(df).withColumnRenamed("non_null", "n"), "column")


# ---- sets --------------------------------------------------------------------------------------

@query("set_intersect", "SELECT l_partkey AS value FROM lineitem INTERSECT SELECT p_partkey FROM part WHERE p_size > 25")
def _(t):
    return J.shared_values(t.lineitem, "l_partkey", t.part.where("p_size > 25"), "p_partkey")


@query("set_distinct", f"WITH {ORD} SELECT DISTINCT o_orderpriority::VARCHAR AS value FROM ord WHERE o_orderpriority IS NOT NULL")
def _(t):
    return orders(t).where("o_orderpriority is not null").select(F.col("o_orderpriority").cast("string").alias("value")).distinct().orderBy("value")


@query("set_concat_cols", "SELECT o_orderkey, o_totalprice, o_totalprice / 1000 AS thousands, c AS per_customer FROM orders JOIN (SELECT o_custkey, count(*) AS c FROM orders GROUP BY 1) USING (o_custkey)")
def _(t):
    per = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("per_customer"))
    return t.orders.withColumns({"thousands": F.col("o_totalprice") / 1000}).join(per, "o_custkey").select("o_orderkey", "o_totalprice", "thousands", "per_customer")


