"""Equi-joins of named tables, join chains, and finding the columns to join on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Name parts that make a shared column likely to be a key, and their scores.
ID_PARTS = (("id",), 3)
KEY_ENDINGS = (("key",), 2)
EXACT_NAMES = (("id", "key", "index", "code"), 2)
ENTITY_PARTS = (("patient", "user", "customer", "account", "order", "product"), 1)
DATE_PARTS = (("date", "time", "timestamp"), 1)
SCORE_LIMIT = 5

HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full_outer"}


def _names(value) -> list[str]:
    return [value] if isinstance(value, str) else [str(v) for v in value]


def merge(left: DataFrame, right: DataFrame, on=None, left_on=None, right_on=None, how: str = "inner",
          suffixes: Sequence[str] = ("_x", "_y")) -> DataFrame:
    """Join on equal keys, where a null key equals a null key.

    Columns present on both sides get a suffix unless they are shared key columns; a shared key appears
    once, taken from whichever side has it.  The join algorithm is left to Catalyst and AQE.
    """
    if on is None and (left_on is None or right_on is None):
        raise ValueError("give on, or both left_on and right_on")
    left_keys = _names(on if on is not None else left_on)
    right_keys = _names(on if on is not None else right_on)
    if len(left_keys) != len(right_keys):
        raise ValueError("left_on and right_on differ in length")
    shared = {a for a, b in zip(left_keys, right_keys) if a == b}
    overlap = (set(left.columns) & set(right.columns)) - shared
    l, r = left.alias("l"), right.alias("r")
    condition = None
    for a, b in zip(left_keys, right_keys):
        test = F.col(f"l.`{a}`").eqNullSafe(F.col(f"r.`{b}`"))
        condition = test if condition is None else condition & test
    joined = l.join(r, condition, HOW[how])
    out = []
    for c in left.columns:
        if c in shared:
            out.append(F.coalesce(F.col(f"l.`{c}`"), F.col(f"r.`{c}`")).alias(c))
        else:
            out.append(F.col(f"l.`{c}`").alias(c + suffixes[0] if c in overlap else c))
    for c in right.columns:
        if c not in shared:
            out.append(F.col(f"r.`{c}`").alias(c + suffixes[1] if c in overlap else c))
    return joined.select(*out)


def merge_chain(tables: Mapping[str, DataFrame], steps: Sequence[Mapping]) -> DataFrame:
    """Apply join steps in order; ``left='result'`` continues from the step before."""
    if not steps:
        return next(iter(tables.values()))
    result = None
    for step in steps:
        if step["left"] == "result":
            if result is None:
                raise ValueError("the first step cannot start from 'result'")
            left = result
        else:
            left = tables[step["left"]]
        result = merge(left, tables[step["right"]], on=step.get("on"), left_on=step.get("left_on"),
                       right_on=step.get("right_on"), how=step.get("how", "inner"),
                       suffixes=step.get("suffixes", ("_x", "_y")))
    return result


def _schema_rows(tables: Mapping[str, DataFrame]) -> DataFrame:
    spark = next(iter(tables.values())).sparkSession
    rows = [(i, name, c) for i, (name, df) in enumerate(tables.items()) for c in df.columns]
    return spark.createDataFrame(rows, "position int, dataset string, column string")


def common_columns(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(column, datasets) for columns found in at least two tables."""
    listed = F.array_sort(F.collect_list(F.struct("position", "dataset")))
    return (
        _schema_rows(tables).groupBy("column").agg(listed.alias("l"))
        .where(F.size("l") > 1)
        .select("column", F.array_join(F.transform("l", lambda x: x["dataset"]), ", ").alias("datasets"))
    )


def key_score(column) -> F.Column:
    """Confidence in [0, 1] that a column name denotes a key."""
    name = F.lower(column)

    def any_of(test, words):
        hit = F.lit(False)
        for w in words:
            hit = hit | test(w)
        return hit

    score = F.when(any_of(name.contains, ID_PARTS[0]), ID_PARTS[1]).otherwise(0)
    score = score + F.when(any_of(name.endswith, KEY_ENDINGS[0]), KEY_ENDINGS[1]).otherwise(0)
    score = score + F.when(name.isin(*EXACT_NAMES[0]), EXACT_NAMES[1]).otherwise(0)
    score = score + F.when(any_of(name.contains, ENTITY_PARTS[0]), ENTITY_PARTS[1]).otherwise(0)
    score = score + F.when(any_of(name.contains, DATE_PARTS[0]), DATE_PARTS[1]).otherwise(0)
    return F.least(score, F.lit(SCORE_LIMIT)) / F.lit(float(SCORE_LIMIT))


def suggest_keys(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(left_dataset, right_dataset, join_column, confidence), best first."""
    names = _schema_rows(tables)
    a, b = names.alias("a"), names.alias("b")
    pairs = a.join(b, (F.col("a.column") == F.col("b.column")) & (F.col("a.position") < F.col("b.position")))
    return pairs.select(
        F.col("a.dataset").alias("left_dataset"), F.col("b.dataset").alias("right_dataset"),
        F.col("a.column").alias("join_column"), key_score(F.col("a.column")).alias("confidence"),
    ).orderBy(F.desc("confidence"), "left_dataset", "right_dataset", "join_column")


def shared_values(left: DataFrame, left_on: str, right: DataFrame, right_on: str) -> DataFrame:
    """Distinct key values found on both sides."""
    return left.select(F.col(left_on).alias("value")).intersect(right.select(F.col(right_on).alias("value")))


def match_count(left: DataFrame, left_on: str, right: DataFrame, right_on: str) -> DataFrame:
    """(matching_keys): how many distinct key values the two sides share."""
    return shared_values(left, left_on, right, right_on).where(F.col("value").isNotNull()).agg(F.count(F.lit(1)).alias("matching_keys"))


def suggest_keys_with_matches(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Suggestions with the number of key values the tables really share."""
    suggestions = suggest_keys(tables)
    counted = None
    for r in suggestions.collect():
        one = match_count(tables[r.left_dataset], r.join_column, tables[r.right_dataset], r.join_column).select(
            F.lit(r.left_dataset).alias("left_dataset"), F.lit(r.right_dataset).alias("right_dataset"),
            F.lit(r.join_column).alias("join_column"), F.lit(r.confidence).alias("confidence"), "matching_keys")
        counted = one if counted is None else counted.unionByName(one)
    return counted if counted is not None else suggestions.withColumn("matching_keys", F.lit(0).cast("bigint"))
