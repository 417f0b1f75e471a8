"""Named queries over the given tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """``t.orders`` reads ``<folder>/orders.parquet``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its counterpart for another engine, if there is one."""
    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def holes(df: DataFrame, key: str, every: dict[str, int]) -> DataFrame:
    """Null out a column on rows whose key is a multiple of a number, as the tables have no nulls."""
    return df.withColumns({c: F.when(F.col(key) % m != 0, F.col(c)) for c, m in every.items()})


def holes_sql(key: str, every: dict[str, int]) -> str:
    return ", ".join(f"CASE WHEN {key} % {m} <> 0 THEN {c} END AS {c}" for c, m in every.items())


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round doubles for comparison; adding zero turns -0.0 into 0.0."""
    return df.withColumns({c: rnd(F.col(c), d) for c, d in digits.items()})


def rnd(c: Column, d: int) -> Column:
    return F.round(c.cast("double"), d) + F.lit(0.0)


def r(expr: str, d: int = 6) -> str:
    return f"(round(({expr})::DOUBLE, {d}) + 0.0)"


# Frames shared by many queries: lineitem, orders and events with nulls made by the same rule.
LI_HOLES = {"l_quantity": 17, "l_discount": 13, "l_tax": 31, "l_returnflag": 29}
LI = (f"li AS (SELECT (l_orderkey * 8 + l_linenumber) * 1009 + l_partkey % 1009 AS id, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_linestatus, l_shipdate, "
      f"{holes_sql('l_orderkey', LI_HOLES)} FROM lineitem)")
LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def li(t: Tables) -> DataFrame:
    df = t.lineitem.select(((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1009 + F.col("l_partkey") % 1009).alias("id"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                           "l_extendedprice", "l_linestatus", "l_shipdate", *LI_HOLES)
    return holes(df, "l_orderkey", LI_HOLES)


OR_HOLES = {"o_totalprice": 11, "o_orderpriority": 7}
ORD = f"ord AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, {holes_sql('o_orderkey', OR_HOLES)} FROM orders)"


def orders(t: Tables) -> DataFrame:
    return holes(t.orders, "o_orderkey", OR_HOLES).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", *OR_HOLES)


def union_sql(cols, one: Callable[[str], str]) -> str:
    return " UNION ALL ".join(one(c) for c in cols)
