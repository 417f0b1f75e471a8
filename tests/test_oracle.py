"""Every registered query against its SQL on DuckDB; those that cut values into ranges also with many of them."""

import math

import duckdb
import pytest

from tabstudy.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
RANGED = ["agg_describe", "agg_box", "agg_feature_profile", "agg_table1", "mis_target_num_rank", "out_mad", "spl_random_exact", "spl_stratified", "spl_time",
              "spl_folds", "fe_cond_ordinal", "ev_auc", "ev_prauc", "ev_boot_auc", "tst_spearman", "tst_kendall", "tst_kruskal", "tst_wilcoxon"]


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def agree(spark, duck, folder, name):
    df = QUERIES[name](spark, folder)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(result.fetchall(), names)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, folder, name):
    agree(spark, duck, folder, name)


@pytest.mark.parametrize("name", RANGED)
def test_many_ranges_match_sql(spark, duck, folder, many_ranges, name):
    agree(spark, duck, folder, name)


@pytest.mark.parametrize("name", ["agg_duplicates_members", "ev_boot", "tst_mannwhitney", "spl_stratified"])
def test_same_result_for_any_partitioning(spark, duck, folder, name):
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            agree(spark, duck, folder, name)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
