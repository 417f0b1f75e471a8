"""Train / validation / test splits, folds, samples and class weights.

Every split is a column computed row by row.  Exact shares come from boundary keys found by rank
selection, so the table itself is never sorted or shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import MODULUS, mix, row_key, uniform
from ..functions.quantiles import cut_points

SHARES = (0.7, 0.15, 0.15)
SEED = 42


def _at_most(k1: Column, k2: Column, edge1: Column, edge2: Column) -> Column:
    return (k1 < edge1) | ((k1 == edge1) & (k2 <= edge2))


def _ranks(n: int, shares: Sequence[float]) -> tuple[int, int]:
    """Zero-based rank of the last training and last validation row; -1 when a part is empty."""
    train = int(n * shares[0])
    return train - 1, train + int(n * shares[1]) - 1


def _label(k1: Column, k2: Column, train_edge, val_edge) -> Column:
    never = F.lit(False)
    in_train = _at_most(k1, k2, *[F.lit(v) for v in train_edge]) if train_edge else never
    in_val = _at_most(k1, k2, *[F.lit(v) for v in val_edge]) if val_edge else never
    return F.when(in_train, "train").when(in_val, "val").otherwise("test")


def random_split(df: DataFrame, id_col: str | None = None, shares: Sequence[float] = SHARES, seed: int = SEED, exact: bool = False) -> DataFrame:
    """Append ``split`` by hash of the row id: thresholds on the hash, or exact counts."""
    key = row_key(df, id_col)
    if not exact:
        u = uniform(key, seed)
        return df.withColumn("split", F.when(u < shares[0], "train").when(u < shares[0] + shares[1], "val").otherwise("test"))
    work = df.withColumns({"_h": mix(key, seed), "_i": key})
    n = df.count()
    wanted = [r for r in _ranks(n, shares) if r >= 0]
    edges = _hash_edges(work.select("_h", "_i"), {(): wanted}, {(): n})[()]
    train, val = (edges.get(r) for r in _ranks(n, shares))
    return work.withColumn("split", _label(F.col("_h"), F.col("_i"), train, val)).drop("_h", "_i")


DEVIATIONS = 8.0  # of the number of hashes below a value; a rank outside them is found by narrowing


def _hash_edges(work: DataFrame, ranks: dict[tuple, Sequence[int]], sizes: dict[tuple, int], by: Sequence[str] = ()) -> dict[tuple, dict[int, tuple]]:
    """Keys (_h, _i) at zero-based ranks of each group. The hash is uniform, so a rank's value is known but for a few standard deviations:

    one scan counts the rows below that bracket and hands over the distinct keys in it, about the square root of the group.
    """
    by = list(by)
    rows = []
    for g, wanted in ranks.items():
        n = max(sizes[g], 1)
        for r in sorted(set(wanted)):
            share, width = (r + 0.5) / n, DEVIATIONS * math.sqrt(max((r + 0.5) * (n - r - 0.5) / n, 1.0)) / n + 2.0 / n
            rows.append((*g, r, int(max(0.0, share - width) * MODULUS), int(min(1.0, share + width) * MODULUS)))
    if not rows:
        return {g: {} for g in ranks}
    fields = [T.StructField(f"_g{i}", work.schema[c].dataType) for i, c in enumerate(by)] + [T.StructField(c, T.LongType()) for c in ("_rank", "_lo", "_hi")]
    brackets = F.broadcast(work.sparkSession.createDataFrame(rows, T.StructType(fields)))  # a few rows for each class
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)]
    near = work.join(brackets, [*same, F.col("_h") <= F.col("_hi")])
    groups = [f"_g{i}" for i in range(len(by))]
    inside = F.when(F.col("_h") >= F.col("_lo"), F.struct("_h", "_i"))  # null below the bracket
    counts: dict[tuple, dict] = {}
    for row in near.groupBy(*groups, "_rank", inside.alias("_key")).agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault((tuple(row[g] for g in groups), row["_rank"]), {})[row["_key"] and tuple(row["_key"])] = row["n"]
    out: dict[tuple, dict[int, tuple]] = {g: {} for g in ranks}
    for (g, rank), keys in counts.items():
        passed = keys.pop(None, 0)
        for key in sorted(keys) if passed <= rank else ():
            passed += keys[key]
            if rank < passed:
                out[g][rank] = key
                break
    if lost := {g: [r for r in wanted if r not in out[g]] for g, wanted in ranks.items() if any(r not in out[g] for r in wanted)}:
        for g, more in cut_points(work.select(*by, "_h", "_i"), ["_h", "_i"], lost, by).items():
            out[g].update(more)
    return out


def _class_edges(work: DataFrame, target: str, ranks_of) -> DataFrame:
    """One row per class with the boundary keys for its ranks; bounded by the number of classes."""
    sizes = {(r[0],): r[1] for r in work.groupBy(target).agg(F.count(F.lit(1))).collect()}
    ranks = {g: ranks_of(n) for g, n in sizes.items()}
    edges = _hash_edges(work.select(target, "_h", "_i"), {g: sorted({r for r in rs if r >= 0}) for g, rs in ranks.items()}, sizes, [target])
    width = max((len(r) for r in ranks.values()), default=0)
    rows = []
    for g, rs in ranks.items():
        flat = []
        for r in rs:
            edge = edges[g].get(r, (-1, -1))
            flat += [int(edge[0]), int(edge[1])]
        rows.append((*g, *flat))
    fields = [T.StructField("_class", work.schema[target].dataType)]
    fields += [T.StructField(f"_{k}{i}", T.LongType()) for i in range(width) for k in ("h", "i")]
    return work.sparkSession.createDataFrame(rows, T.StructType(fields))


def stratified_split(df: DataFrame, target: str, id_col: str | None = None, shares: Sequence[float] = SHARES, seed: int = SEED) -> DataFrame:
    """Append ``split`` with exact shares inside every class."""
    key = row_key(df, id_col)
    work = df.withColumns({"_h": mix(key, seed), "_i": key})
    edges = _class_edges(work, target, lambda n: _ranks(n, shares))
    joined = work.join(F.broadcast(edges), F.col(target).eqNullSafe(F.col("_class")))
    label = F.when(_at_most(F.col("_h"), F.col("_i"), F.col("_h0"), F.col("_i0")), "train").when(
        _at_most(F.col("_h"), F.col("_i"), F.col("_h1"), F.col("_i1")), "val").otherwise("test")
    return joined.select(*df.columns, label.alias("split"))


def group_split(df: DataFrame, entity: str, shares: Sequence[float] = SHARES, seed: int = SEED) -> DataFrame:
    """Append ``split`` by hash of the entity, so no entity falls in two parts."""
    u = uniform(row_key(df, entity), seed)
    return df.withColumn("split", F.when(u < shares[0], "train").when(u < shares[0] + shares[1], "val").otherwise("test"))


def time_split(df: DataFrame, time_col: str, id_col: str, shares: Sequence[float] = SHARES) -> DataFrame:
    """Append ``split`` in time order, ties by id: first the training share, then validation, then test."""
    n = df.count()
    micros = F.unix_micros(F.col(time_col).cast("timestamp")) if isinstance(df.schema[time_col].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.col(time_col)
    work = df.withColumns({"_t": micros, "_i": row_key(df, id_col)})
    ranks = _ranks(n, shares)
    edges = cut_points(work.select("_t", "_i"), ["_t", "_i"], {(): [r for r in ranks if r >= 0]})[()]
    train, val = (edges.get(r) for r in ranks)
    return work.withColumn("split", _label(F.col("_t"), F.col("_i"), train, val)).drop("_t", "_i")


def folds(df: DataFrame, k: int = 5, id_col: str | None = None, seed: int = SEED, stratify: str | None = None) -> DataFrame:
    """Append ``fold`` 0..k-1: equal consecutive runs in hash order, inside each class when stratified."""
    key = row_key(df, id_col)
    work = df.withColumns({"_h": mix(key, seed), "_i": key})
    ends = lambda n: [n * f // k - 1 for f in range(1, k)]
    if stratify is None:
        work = work.withColumn("_all", F.lit(0))
    target = stratify or "_all"
    edges = _class_edges(work, target, ends)
    joined = work.join(F.broadcast(edges), F.col(target).eqNullSafe(F.col("_class")))
    fold = F.lit(k - 1)
    for f in reversed(range(k - 1)):
        fold = F.when(_at_most(F.col("_h"), F.col("_i"), F.col(f"_h{f}"), F.col(f"_i{f}")), f).otherwise(fold)
    return joined.select(*df.columns, fold.alias("fold"))


def hash_folds(df: DataFrame, k: int = 5, id_col: str | None = None, seed: int = SEED) -> DataFrame:
    """Append ``fold`` by hash alone: near-equal folds with no job at all."""
    return df.withColumn("fold", F.floor(uniform(row_key(df, id_col), seed) * k).cast("int"))


def sample(df: DataFrame, n: int, id_col: str | None = None, seed: int = SEED) -> DataFrame:
    """Seeded sample of n rows: the n smallest hashes, found by a per-task top-n."""
    key = row_key(df, id_col)
    return df.withColumns({"_h": mix(key, seed), "_i": key}).orderBy("_h", "_i").limit(n).drop("_h", "_i")


def split_checks(df: DataFrame, target: str, task: str, small: int = 10) -> DataFrame:
    """(split, n, n_classes, enough_rows, enough_classes, small) per part of a split table."""
    classes = F.count_distinct(F.col(target)) if task == "classification" else F.lit(None).cast("bigint")
    stats = df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), classes.alias("n_classes"))
    enough = F.coalesce(F.col("n_classes") >= 2, F.lit(True))
    return stats.select("split", "n", "n_classes", (F.col("n") >= 2).alias("enough_rows"), enough.alias("enough_classes"), (F.col("n") < small).alias("small"))


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """(class, n, weight) with balanced weights n / (k * n_class)."""
    counts = df.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("class")).agg(F.count(F.lit(1)).alias("n")).withColumn("_k", F.lit(0))
    total = counts.agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_c")).withColumn("_k", F.lit(0))
    return counts.join(F.broadcast(total), "_k").select("class", "n", (F.col("_n") / (F.col("_c") * F.col("n"))).alias("weight"))


def with_class_weight(df: DataFrame, target: str, name: str = "weight") -> DataFrame:
    weights = class_weights(df, target).select(F.col("class").alias("_class"), F.col("weight").alias(name))
    return df.join(F.broadcast(weights), F.col(target) == F.col("_class"), "left").drop("_class")
