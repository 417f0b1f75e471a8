"""Poisson bootstrap without a row for each replicate.

A row's weights in all replicates are one vector, made in the task from the row's key by the portable hash; each metric needs weighted
sums of a few numbers, which tasks add up as (sum, replicate) matrices. Metrics of ranks walk through ranges of rows in order of the
score, one vector of replicates for each range.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import FOLD_MULTIPLIER, FOLD_SHIFT, MODULUS, POISSON_CDF, ROUND_DIVISOR, ROUND_MULTIPLIER, ROUND_OFFSETS, START
from .storage import written

ROWS = 512  # rows whose weights are held at once
RANGE_ROWS = 200_000  # rows of one range in order


def poisson_weights(key: np.ndarray, replicates: int) -> np.ndarray:
    """(rows x replicates) weights, those of ``hashing.poisson_weight``."""
    key = key.astype(np.int64)
    folded = (key % MODULUS + (key >> FOLD_SHIFT) % MODULUS * FOLD_MULTIPLIER) % MODULUS
    x = ((folded * START[0] + START[2])[:, None] + (np.arange(replicates, dtype=np.int64) * START[1])[None, :]) % MODULUS
    for offset in ROUND_OFFSETS:
        x = ((x * x) % MODULUS + x // ROUND_DIVISOR * ROUND_MULTIPLIER + offset) % MODULUS
    return np.searchsorted(np.array(POISSON_CDF), x / float(MODULUS), "right")


def replicate_sums(df: DataFrame, key: Column, values: Sequence[Column], replicates: int, by: Sequence[str] = ()) -> DataFrame:
    """(by..., replicate, s0, s1, ...): sums of weight times value. Rows with a null value count in no sum of it."""
    by, k = list(by), len(values)
    fields = [T.StructField(f"_b{i}", df.schema[c].dataType) for i, c in enumerate(by)]
    rows = df.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], key.cast("long").alias("_key"), *[v.cast("double").alias(f"_v{i}") for i, v in enumerate(values)])
    schema = T.StructType([*fields, T.StructField("i", T.IntegerType()), T.StructField("sums", T.ArrayType(T.DoubleType()))])
    names = schema.names

    def batch_of(groups: list, i: int, sums: np.ndarray, kinds: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([g], t) for g, t in zip(groups, kinds)], pa.array([i], pa.int32()), pa.array([sums], pa.list_(pa.float64()))], names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        kinds: list = []
        for batch in batches:
            kinds = kinds or [c.type for c in batch.columns[:len(by)]]
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                w = poisson_weights(part.column(len(by)).to_numpy(zero_copy_only=False), replicates).astype(float)
                v = np.nan_to_num(np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns[len(by) + 1:]]), nan=0.0)
                own = list(zip(*[c.to_pylist() for c in part.columns[:len(by)]])) if by else [()] * part.num_rows
                places: dict[tuple, list[int]] = {}
                for row, g in enumerate(own):
                    places.setdefault(g, []).append(row)
                for g, at_rows in places.items():
                    sums = v[at_rows].T @ w[at_rows]
                    total[g] = total[g] + sums if g in total else sums
                if len(total) * k * replicates > 1 << 22:  # many groups: hand on what there is
                    for g, m in total.items():
                        yield from (batch_of(list(g), i, m[i], kinds) for i in range(k))
                    total = {}
        for g, m in total.items():
            yield from (batch_of(list(g), i, m[i], kinds) for i in range(k))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, total, kinds = None, None, []
        for batch in batches:
            kinds = kinds or [c.type for c in batch.columns[:len(by)]]
            for *g, i, sums in zip(*[c.to_pylist() for c in batch.columns[:-1]], batch.column(len(by) + 1)):
                own = sums.values.to_numpy()
                if place is not None and place != (g, i):
                    yield batch_of(place[0], place[1], total, kinds)
                    total = None
                place, total = (g, i), own if total is None else total + own
        if place is not None:
            yield batch_of(place[0], place[1], total, kinds)

    keys = [f.name for f in fields]
    done = rows.mapInArrow(add, schema).repartition(*keys, "i").sortWithinPartitions(*keys, "i", "sums").mapInArrow(merge, schema)
    wide = done.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col("sums"))).alias(f"s{i}") for i in range(k)])
    flat = wide.select(*keys, F.posexplode(F.arrays_zip(*[f"s{i}" for i in range(k)])).alias("replicate", "s"))
    return flat.select(*[F.col(n).alias(c) for n, c in zip(keys, by)], "replicate", *[F.col(f"s.s{i}").alias(f"s{i}") for i in range(k)])


def in_ranges(df: DataFrame, order: str) -> DataFrame:
    """``df`` cut into ranges of its order; equal values share a range."""
    parts = max(1, -(-df.count() // RANGE_ROWS))
    return df.repartitionByRange(parts, order).sortWithinPartitions(order)


def replicate_auc(df: DataFrame, key: Column, y: str, score: str, replicates: int) -> np.ndarray:
    """AUC of each replicate; ties count one half. Each range sends three vectors; they meet in order on the driver."""
    rows = in_ranges(df.select(key.cast("long").alias("_key"), F.col(y).cast("double").alias("_y"), F.col(score).cast("double").alias("_s")).where("_y is not null and _s is not null"), "_s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, below, positives, inside = None, np.zeros(replicates), np.zeros(replicates), np.zeros(replicates)
        tied, tied_pos, tied_neg = None, np.zeros(replicates), np.zeros(replicates)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                w = poisson_weights(part.column(0).to_numpy(zero_copy_only=False), replicates).astype(float)
                y, s = part.column(1).to_numpy(zero_copy_only=False), part.column(2).to_numpy(zero_copy_only=False)
                first = float(s[0]) if first is None else first
                cuts = np.flatnonzero(np.diff(s, prepend=np.nan) != 0)
                pos, neg = np.add.reduceat(w * y[:, None], cuts), np.add.reduceat(w * (1 - y)[:, None], cuts)
                for v, p, n in zip(s[cuts].tolist(), pos, neg):
                    if v != tied:
                        inside += tied_pos * (below + tied_neg / 2)
                        below, positives = below + tied_neg, positives + tied_pos
                        tied, tied_pos, tied_neg = v, p.copy(), n.copy()
                    else:
                        tied_pos, tied_neg = tied_pos + p, tied_neg + n
        if first is not None:
            inside += tied_pos * (below + tied_neg / 2)
            yield pa.RecordBatch.from_arrays([pa.array([first]), *(pa.array([v], pa.list_(pa.float64())) for v in (positives + tied_pos, below + tied_neg, inside))], ["first", "pos", "neg", "inside"])

    pos, neg, pairs = np.zeros(replicates), np.zeros(replicates), np.zeros(replicates)
    for r in rows.mapInArrow(run, "first double, pos array<double>, neg array<double>, inside array<double>").orderBy("first").toLocalIterator():
        pairs += np.array(r.inside) + neg * np.array(r.pos)
        pos, neg = pos + np.array(r.pos), neg + np.array(r.neg)
    with np.errstate(divide="ignore", invalid="ignore"):
        return pairs / (pos * neg)


def replicate_medians(df: DataFrame, key: Column, value: Column, replicates: int) -> np.ndarray:
    """Weighted median of each replicate: totals of each range first, then the values at two ranks in the ranges that hold them."""
    rows = in_ranges(df.select(key.cast("long").alias("_key"), value.cast("double").alias("_v")).where("_v is not null"), "_v")
    table, _ = written(rows.withColumn("_part", F.spark_partition_id()), "in_order")

    def totals(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                w, part = poisson_weights(piece.column(0).to_numpy(zero_copy_only=False), replicates), piece.column(1).to_numpy(zero_copy_only=False)
                for p in np.unique(part).tolist():
                    own = w[part == p].sum(axis=0)
                    total[p] = total[p] + own if p in total else own
        for p, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([t], pa.list_(pa.int64()))], ["part", "n"])

    each: dict[int, np.ndarray] = {}
    for r in table.select("_key", "_part").mapInArrow(totals, "part int, n array<long>").toLocalIterator():
        each[r.part] = each.get(r.part, 0) + np.array(r.n)
    if not each:
        return np.full(replicates, np.nan)
    order = sorted(each)
    upto = np.cumsum([each[p] for p in order], axis=0)
    size = upto[-1]
    ranks = np.stack([(size - 1) // 2, size // 2])  # zero-based
    at = (upto[None, :, :] <= ranks[:, None, :]).sum(axis=1)
    inside = ranks - np.where(at > 0, np.take_along_axis(upto, np.maximum(at - 1, 0), axis=0), 0)
    wanted = {p: [(side, b, int(inside[side, b])) for side in (0, 1) for b in np.flatnonzero((at[side] == k) & (size > 0)).tolist()] for k, p in enumerate(order)}

    def found(batches):
        part, columns, need, below = None, [], {}, np.zeros(0, dtype=np.int64)
        for batch in batches:
            out = []
            parts = batch.column(2).to_numpy(zero_copy_only=False)
            for start, stop in zip(*_stretches(parts)):
                if parts[start] != part:
                    part, need = int(parts[start]), {}
                    for side, b, rank in wanted[part]:
                        need.setdefault(b, []).append((side, rank))
                    columns = sorted(need)
                    below = np.zeros(len(columns), dtype=np.int64)
                for at in range(start, stop, ROWS):
                    piece = batch.slice(at, min(ROWS, stop - at))
                    v = piece.column(1).to_numpy(zero_copy_only=False)
                    w = np.cumsum(poisson_weights(piece.column(0).to_numpy(zero_copy_only=False), replicates)[:, columns], axis=0) + below
                    for c, b in enumerate(columns):
                        out += [(side, b, float(v[int(np.searchsorted(w[:, c], rank, "right"))])) for side, rank in need[b] if below[c] <= rank < w[-1, c]]
                    below = w[-1]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.float64())], ["side", "replicate", "value"])

    out = np.full((2, replicates), np.nan)
    hold = [p for p in order if wanted[p]]
    for r in table.where(F.col("_part").isin(hold)).repartition("_part").sortWithinPartitions("_part", "_v", "_key").mapInArrow(found, "side int, replicate int, value double").toLocalIterator():
        out[r.side, r.replicate] = r.value
    return out.mean(axis=0)


def _stretches(keys: np.ndarray) -> tuple[list[int], list[int]]:
    """Start and end of each stretch of equal keys."""
    cuts = np.flatnonzero(np.diff(keys, prepend=np.nan) != 0).tolist() if len(keys) else []
    return cuts, [*cuts[1:], len(keys)]
