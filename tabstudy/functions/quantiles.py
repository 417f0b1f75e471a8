"""Exact quantiles and order statistics that never gather a column in one place.

Whole columns are narrowed: every pass counts the rows of the current value interval in a fixed number of slices (map-side
combined), keeps the slice that holds the wanted rank, and stops when that slice holds a single value. Slices are of equal
length in the order of the doubles' bits, and tasks count Arrow batches; once the open intervals hold few rows, these are listed.
So a handful of passes closes them whatever the distribution. State per pass is ``slices x open intervals`` numbers for the columns
at hand; nothing is sorted or shuffled. Long frames are narrowed in SQL: an interval that spans magnitudes or zero is sliced by
magnitude, any other by width.

Quantiles within groups stay on the executors: distinct values are counted, and running totals over them give the ranks. Many rows
in few groups are narrowed like whole columns, with an interval for each group and rank.
Nulls and NaN are left out; infinities are values.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import rows_per_range, running_totals

SLICES = 4096
CASE_LIMIT = 48
WIDE = 4096.0  # an interval whose ends differ by more than this factor is sliced by magnitude
TINY = 1e-290  # magnitudes below it count as one
FEW = 32  # quantiles of all groups and columns together that are found by narrowing: slices for each of them reach the driver
CELLS = 65_536  # slices of all open intervals of whole columns together, but LEAST_SLICES of each
LEAST_SLICES = 64
LISTED = 262_144  # rows of all open intervals together that are listed instead of sliced
PLAIN = ("string", "boolean", "byte", "short", "integer", "long", "date")  # types of group keys that can be told apart in the driver


def _long(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by..., column, value) with nulls dropped; one scan, no shuffle."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols]))
    return (
        df.select(*by, pairs.alias("_p"))
        .select(*by, F.col("_p.column").alias("column"), F.col("_p.value").alias("value"))
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
    )


INF = float("inf")


def _range_exprs(v: Column) -> list[Column]:
    """Rows, those that are -inf, those that are +inf, least and largest finite value."""
    finite = F.when(F.abs(v) < INF, v)
    return [F.count(v).alias("n"), F.count(F.when(v == -INF, 1)).alias("low"), F.count(F.when(v == INF, 1)).alias("high"), F.min(finite).alias("lo"), F.max(finite).alias("hi")]


def value_ranges(long: DataFrame, by: Sequence[str]) -> dict[tuple, tuple]:
    """{(by..., column): (rows, rows at -inf, rows at +inf, least, largest finite value)} of a long frame."""
    keys = [*by, "column"]
    rows = long.groupBy(*keys).agg(*_range_exprs(F.col("value"))).collect()
    return {tuple(r[k] for k in keys): (r.n, r.low, r.high, r.lo, r.hi) for r in rows}


def _magnitude(v: Column) -> Column:
    """Monotone in the value and even in its exponent."""
    return F.signum(v) * F.log1p(F.abs(v) / TINY)


def _cell(v: Column, lo: Column, hi: Column) -> Column:
    """Slice of a value between lo < hi: by magnitude where the ends differ in sign or by a large factor, else by width."""
    small, large = F.least(F.abs(lo), F.abs(hi)), F.greatest(F.abs(lo), F.abs(hi))
    far = (lo * F.signum(hi) <= 0) | (large / WIDE > small)
    # Halves keep the width finite for intervals that span most of the double range.
    width = (v / 2 - lo / 2) / (hi / 2 - lo / 2)
    share = F.when(far, (_magnitude(v) - _magnitude(lo)) / (_magnitude(hi) - _magnitude(lo))).otherwise(width)
    share = F.when(share.isNull() | F.isnan(share), width).otherwise(share)
    return F.greatest(F.least(F.floor(share * SLICES), F.lit(SLICES - 1)), F.lit(0)).cast("int")


def select_ranks(long: DataFrame, wanted: dict[tuple, set[int]], by: Sequence[str], with_below: bool = False, ranges: dict[tuple, tuple] | None = None) -> dict[tuple, dict]:
    """Values at zero-based ranks, per (by..., column) key, from a long (by..., column, value) frame.

    ``wanted`` maps a key to its ranks.  Each open interval is (low, high, rows below it, ranks in it).
    With ``with_below`` every answer is (value, number of rows with a smaller value).
    """
    spark = long.sparkSession
    keys = [*by, "column"]
    found: dict[tuple, dict[int, float]] = {k: {} for k in wanted}
    ranges = value_ranges(long, by) if ranges is None else ranges
    open_: dict[tuple, list] = {}
    for k, (n, low, high, lo, hi) in ranges.items():
        ranks = set(wanted.get(k, ()))
        for r in sorted(ranks):
            if r < low or r >= n - high:
                value, below = (-INF, 0) if r < low else (INF, n - high)
                found[k][r] = (value, below) if with_below else value
        if inside := {r for r in ranks if low <= r < n - high}:
            open_[k] = [(lo, hi, low, inside)]
    schema = T.StructType(
        [long.schema[k] for k in keys]
        + [T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType()), T.StructField("part", T.IntegerType())]
    )
    while open_:
        rows = []
        for key, parts in open_.items():
            for i, (lo, hi, below, ranks) in enumerate(parts):
                if lo == hi:
                    found[key].update({r: (lo, below) if with_below else lo for r in ranks})
                else:
                    rows.append((*key, lo, hi, i))
        if not rows:
            break
        if not by and len(rows) <= CASE_LIMIT:
            # Few intervals: compare with literals instead of joining.
            found_in = F.lit(None).cast("struct<lo:double,hi:double,part:int>")
            for column, lo, hi, part in reversed(rows):
                hit = (F.col("column") == F.lit(column)) & F.col("value").between(F.lit(lo), F.lit(hi))
                found_in = F.when(hit, F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(part).alias("part"))).otherwise(found_in)
            matched = long.withColumn("_i", found_in).where(F.col("_i").isNotNull()).select("column", "value", "_i.*")
        else:
            intervals = F.broadcast(spark.createDataFrame(rows, schema))  # a few for each column or class that the caller names
            matched = long.alias("l").join(
                intervals.alias("i"), on=[F.col(f"l.{k}").eqNullSafe(F.col(f"i.{k}")) for k in keys],
            ).where(F.col("l.value").between(F.col("i.lo"), F.col("i.hi"))).select(
                *[F.col(f"l.{k}").alias(k) for k in keys], F.col("l.value").alias("value"), F.col("i.lo").alias("lo"), F.col("i.hi").alias("hi"), F.col("i.part").alias("part"))
        counts = (
            matched.select(*keys, "part", _cell(F.col("value"), F.col("lo"), F.col("hi")).alias("cell"), "value")
            .groupBy(*keys, "part", "cell")
            .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
            .collect()
        )
        grouped: dict[tuple, list] = {}
        for row in counts:
            grouped.setdefault((tuple(row[k] for k in keys), row.part), []).append(row)
        following: dict[tuple, list] = {}
        for (key, part), cells in grouped.items():
            _, _, below, ranks = open_[key][part]
            position = below
            for row in sorted(cells, key=lambda r: r.cell):
                inside = {r for r in ranks if position <= r < position + row.n}
                if inside:
                    last = position + row.n - 1
                    for r in () if with_below else list(inside):  # both ends of a slice are already known
                        if r == position or r == last:
                            found[key][r] = row.lo if r == position else row.hi
                            inside.discard(r)
                    if inside:
                        following.setdefault(key, []).append((row.lo, row.hi, position, inside))
                position += row.n
        open_ = following
    return found


def _bits(v: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles; both zeros are one."""
    b = (v + 0.0).view(np.int64)
    return np.where(b < 0, b ^ np.int64(0x7FFFFFFFFFFFFFFF), b)


def _values(bits: np.ndarray) -> np.ndarray:
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits).view(np.float64)


def _counted(df: DataFrame, open_: Sequence[tuple], listed: bool) -> pa.Table:
    """(part, n, lo, hi) of the slices of open intervals (column number, lo, hi, ...), or of their single values; bits as ``_bits`` gives them."""
    slices = max(LEAST_SLICES, min(SLICES, CELLS // len(open_)))
    places: dict[int, list[int]] = {}
    for part, x in enumerate(open_):
        places.setdefault(x[0], []).append(part)
    # By column: its intervals, ascending, their ends and the length of their slices.
    spec = [(j, np.array(p), np.array([open_[i][1] for i in p], dtype=np.int64), np.array([open_[i][2] for i in p], dtype=np.int64),
             np.array([(open_[i][2] - open_[i][1]) // slices + 1 for i in p], dtype=np.uint64)) for j, p in places.items()]

    def count(batches):
        n, lo = np.zeros(len(open_) * slices, dtype=np.int64), np.full(len(open_) * slices, np.iinfo(np.int64).max)
        hi, some = np.full(len(open_) * slices, np.iinfo(np.int64).min), []
        for batch in batches:
            for j, parts, low, high, step in spec:
                v = batch.column(j).to_numpy(zero_copy_only=False)
                bits = _bits(v[v == v])
                at = np.searchsorted(low, bits, "right") - 1
                inside = (at >= 0) & (bits <= high[at])
                at, bits = at[inside], bits[inside]
                if listed:
                    some.append((parts[at], bits))
                    continue
                cell = parts[at] * slices + ((bits.view(np.uint64) - low.view(np.uint64)[at]) // step[at]).astype(np.int64)
                n += np.bincount(cell, minlength=len(n))
                np.minimum.at(lo, cell, bits)
                np.maximum.at(hi, cell, bits)
        if listed and some:
            pairs, n = np.unique(np.column_stack([np.concatenate([x[i] for x in some]) for i in (0, 1)]), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (pairs[:, 0], n, pairs[:, 1], pairs[:, 1])], ["part", "n", "lo", "hi"])
        elif not listed:
            full = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (full, n[full], lo[full], hi[full])], ["part", "n", "lo", "hi"])

    cells = df.mapInArrow(count, "part bigint, n bigint, lo bigint, hi bigint")
    if listed:
        return cells.groupBy("part", "lo", "hi").agg(F.sum("n").alias("n")).toArrow()
    cells = cells.groupBy("part").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return cells.withColumn("part", F.floor(F.col("part") / slices).cast("bigint")).toArrow()


def _select_whole(df: DataFrame, cols: Sequence[str], wanted: dict[tuple, set[int]], ranges: dict[tuple, tuple]) -> dict[tuple, dict[int, float]]:
    """Values at zero-based ranks of whole columns: ``select_ranks`` without a long frame."""
    doubles = df.select(*[F.col(c).cast("double").alias(f"_{j}") for j, c in enumerate(cols)])
    found: dict[tuple, dict[int, float]] = {k: {} for k in wanted}
    open_ = []  # (column number, least, largest bits, rows below, ranks), rows
    for j, c in enumerate(cols):
        if (c,) not in ranges:
            continue
        n, low, high, lo, hi = ranges[(c,)]
        found[(c,)] = {r: -INF if r < low else INF if r >= n - high else lo for r in wanted[(c,)]}
        inside = {r for r in wanted[(c,)] if low <= r < n - high}
        if inside and lo != hi:
            a, b = (int(x) for x in _bits(np.array([lo, hi])))
            open_.append((j, a, b, low, inside, n - low - high))
    while open_:
        table = _counted(doubles, open_, sum(x[5] for x in open_) <= LISTED)
        part, n, lo, hi = (table.column(c).to_numpy() for c in ("part", "n", "lo", "hi"))
        following = []
        for i, (j, _, _, below, ranks, _) in enumerate(open_):
            own = np.flatnonzero(part == i)
            own = own[np.argsort(lo[own])]
            stops = below + np.cumsum(n[own])
            inner: dict[int, set[int]] = {}
            for r in ranks:
                k = int(np.searchsorted(stops, r, "right"))
                first, last = int(stops[k] - n[own[k]]), int(stops[k]) - 1
                if r in (first, last) or lo[own[k]] == hi[own[k]]:  # both ends of a slice are already known
                    found[(cols[j],)][r] = float(_values(lo[own[k:k + 1]] if r != last else hi[own[k:k + 1]])[0])
                else:
                    inner.setdefault(k, set()).add(r)
            following += [(j, int(lo[own[k]]), int(hi[own[k]]), int(stops[k] - n[own[k]]), rs, int(n[own[k]])) for k, rs in sorted(inner.items())]
        open_ = following
    return found


def _interpolate(values: dict[int, float], n: int, p: float) -> float:
    exact = (n - 1) * p
    low = int(exact)
    high = min(low + 1, n - 1)
    share = exact - low
    if share == 0 or values[low] == values[high]:
        return values[low]
    return (1 - share) * values[low] + share * values[high]


def _grouped_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """(by..., column, n, q) without any state in the driver: one row for every group, also those without values."""
    keys = [*by, "column"]
    clean = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
    sizes = df.groupBy(*by).agg(*[F.count(v).alias(f"_n{i}") for i, v in enumerate(clean.values())])
    sizes = sizes.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("n")) for i, c in enumerate(cols)])))
    counts = _long(df, cols, by).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("m"))
    cum = running_totals(counts, "value", ["m"], keys)
    match = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    inside = cum.alias("c").join(sizes.alias("s"), match("c", "s")).select(*[F.col(f"c.{k}").alias(k) for k in keys], "c.value", (F.col("c.cum_m") - F.col("c.m")).alias("first"), F.col("c.cum_m").alias("stop"), "s.n")
    at = lambda k: F.max(F.when((F.col("first") <= k) & (k < F.col("stop")), F.col("value")))
    exact = lambda p: (F.col("n") - 1) * F.lit(p)
    ends = [x for i, p in enumerate(probs) for x in (at(F.floor(exact(p))).alias(f"_a{i}"), at(F.least(F.floor(exact(p)) + 1, F.col("n") - 1)).alias(f"_b{i}"))]
    picked = inside.groupBy(*keys).agg(*ends)
    joined = sizes.alias("s").join(picked.alias("p"), match("s", "p"), "left")

    def value(i: int, p: float) -> Column:
        a, b, share = F.col(f"p._a{i}"), F.col(f"p._b{i}"), exact(p) - F.floor(exact(p))
        return F.when((share == 0) | (a == b), a).otherwise((1 - share) * a + share * b)

    return joined.select(*[F.col(f"s.{k}").alias(k) for k in keys], F.col("s.n").alias("n"), F.when(F.col("s.n") > 0, F.array(*[value(i, p) for i, p in enumerate(probs)])).alias("q"))


def _few_groups(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str]) -> bool:
    """Whether there are more rows than one task should order, in so few groups that intervals for each of them are a small state."""
    if not by or any(df.schema[k].dataType.typeName() not in PLAIN for k in by):
        return False
    rows, groups = df.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*by))).first()
    return rows > rows_per_range(df) and groups * len(cols) * len(probs) <= FEW


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, n, q array<double>) with linear interpolation; nulls and NaN are ignored, and n = 0 has no q."""
    cols, by, probs = list(cols), list(by), [float(p) for p in probs]
    if by and not _few_groups(df, cols, probs, by):
        return _grouped_quantiles(df, cols, probs, by)
    clean = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
    every = {(*r[:len(by)], c): tuple(r[len(by) + i]) for r in df.groupBy(*by).agg(*[F.struct(*_range_exprs(v)).alias(f"_{i}") for i, v in enumerate(clean.values())]).collect() for i, c in enumerate(cols)}
    ranges = {k: v for k, v in every.items() if v[0]}
    sizes = {k: r[0] for k, r in ranges.items()}
    wanted = {}
    for key, n in sizes.items():
        ranks: set[int] = set()
        for p in probs:
            low = int((n - 1) * p)
            ranks |= {low, min(low + 1, n - 1)}
        wanted[key] = ranks
    found = select_ranks(_long(df, cols, by), wanted, by, ranges=ranges) if by else _select_whole(df, cols, wanted, ranges)
    rows = [(*key, n, [_interpolate(found[key], n, p) for p in probs]) for key, n in sizes.items()]
    rows += [(*key, 0, None) for key in every if key not in sizes]
    schema = T.StructType([*[T.StructField(k, df.schema[k].dataType) for k in by], T.StructField("column", T.StringType()), T.StructField("n", T.LongType()), T.StructField("q", T.ArrayType(T.DoubleType()))])
    return df.sparkSession.createDataFrame(rows, schema)


def quantile_values(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
    """Quantiles as driver constants (len(cols) x len(probs) numbers), for literals in later plans."""
    return {r["column"]: list(r["q"]) if r["n"] else [None] * len(probs) for r in exact_quantiles(df, cols, probs).collect()}


EXACT = 2.0 ** 53  # integers up to here are doubles


def _parts(df: DataFrame, keys: Sequence[str]) -> dict[str, list[Column]]:
    """Each key as doubles that sort alike and lose no bit: integers beyond 2**53 in two halves."""
    whole = [k for k in keys if df.schema[k].dataType.typeName() in ("byte", "short", "integer", "long")]
    ends = df.agg(*[F.max(F.greatest(F.col(k).cast("double"), -F.col(k).cast("double"))).alias(k) for k in whole]).first() if whole else {}
    out = {}
    for i, k in enumerate(keys):
        v = F.col(k)
        if k in whole and (ends[k] or 0.0) >= EXACT:
            v = v.cast("bigint")
            out[k] = [F.shiftright(v, 32).cast("double").alias(f"_k{i}h"), v.bitwiseAND(F.lit(0xFFFFFFFF)).cast("double").alias(f"_k{i}l")]
        else:
            out[k] = [v.cast("double").alias(f"_k{i}h")]
    return out


def cut_points(df: DataFrame, keys: Sequence[str], ranks: dict[tuple, Sequence[int]], by: Sequence[str] = ()) -> dict[tuple, dict[int, tuple]]:
    """Composite key (k1, k2) found at zero-based ranks in the order k1, k2, per ``by`` group.

    The rows themselves are not moved: rounds of rank selection over the parts of the key, each among the rows that tie with a
    boundary so far, give the boundary keys, and callers compare rows with them.
    """
    by = list(by)
    parts = _parts(df, keys)
    names = [f"_k{i}{x}" for i, k in enumerate(keys) for x in "hl"[:len(parts[k])]]
    base = df.select(*by, *[c for k in keys for c in parts[k]])
    # (group, values of the parts so far, rank) -> rank among the rows that tie with them
    state = {(g, (), r): r for g, rs in ranks.items() for r in rs}
    for depth, name in enumerate(names):
        done = names[:depth]
        wanted: dict[tuple, set[int]] = {}
        for (g, before, _), r in state.items():
            wanted.setdefault((*g, *before, name), set()).add(r)
        if not wanted:
            break
        tied = base
        if depth:
            schema = T.StructType([base.schema[c] for c in [*by, *done]])
            edges = F.broadcast(df.sparkSession.createDataFrame(sorted({k[:-1] for k in wanted}, key=str), schema))  # as many as wanted ranks
            tied = base.alias("b").join(edges.alias("e"), [F.col(f"b.{c}").eqNullSafe(F.col(f"e.{c}")) for c in [*by, *done]]).select("b.*")
        stage = tied.select(*by, *done, F.lit(name).alias("column"), F.col(name).alias("value")).where(F.col("value").isNotNull())
        lead = select_ranks(stage, wanted, [*by, *done], with_below=True)
        state = {(g, (*before, lead[(*g, *before, name)][r][0]), first): r - lead[(*g, *before, name)][r][1]
                 for (g, before, first), r in state.items() if r in lead.get((*g, *before, name), {})}
    out: dict[tuple, dict[int, tuple]] = {g: {} for g in ranks}
    for (g, values, first), _ in state.items():
        if len(values) == len(names):
            rest, key = list(values), []
            for k in keys:
                own, rest = rest[:len(parts[k])], rest[len(parts[k]):]
                key.append((int(own[0]) << 32 | int(own[1])) if len(own) == 2 else own[0])
            out[g][first] = tuple(key)
    return out
