"""Portable integer hash, so that random splits and weights can be repeated in any SQL engine.

Built-in ``rand`` depends on partitioning and ``xxhash64`` has no counterpart elsewhere; this
mix needs only 64-bit integer products that never overflow.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the mix: modulus, multipliers, offsets.
MODULUS = 2147483647
START = (48271, 69621, 12345)
ROUND_MULTIPLIER = 40692
ROUND_DIVISOR = 32768
ROUND_SHIFT = 15  # divides by ROUND_DIVISOR
FOLD_SHIFT, FOLD_MULTIPLIER = 31, 69069
ROUND_OFFSETS = (7919, 112648, 217377)
# Cumulative Poisson(1) probabilities for weights 0..5; beyond the last the weight is 6.
POISSON_CDF = (0.36788, 0.73576, 0.91970, 0.98101, 0.99634, 0.99941)


def _seed(seed) -> Column:
    return seed if isinstance(seed, Column) else F.lit(int(seed))


def mix(key: Column, seed) -> Column:
    """Integer in [0, MODULUS) from a non-negative integer key and a seed (number or column).

    The rounds are folded with ``aggregate``: written out they would repeat their argument three
    times each, and a filter on the result would carry all copies.
    """
    key = key.cast("bigint")
    # High bits are folded in, so that keys that differ by a multiple of the modulus part.
    folded = F.pmod(F.pmod(key, F.lit(MODULUS)) + F.pmod(F.shiftright(key, FOLD_SHIFT), F.lit(MODULUS)) * FOLD_MULTIPLIER, F.lit(MODULUS))
    start = (folded * START[0] + _seed(seed).cast("bigint") * START[1] + START[2]) % MODULUS
    offsets = F.array(*[F.lit(o).cast("bigint") for o in ROUND_OFFSETS])
    return F.aggregate(offsets, start.cast("bigint"), lambda x, o: (
        ((x * x) % MODULUS + F.shiftright(x, ROUND_SHIFT) * ROUND_MULTIPLIER + o) % MODULUS).cast("bigint"))


def mixed(key: int, seed: int) -> int:
    """``mix`` of a number on the driver."""
    x = ((key % MODULUS + (key >> FOLD_SHIFT) % MODULUS * FOLD_MULTIPLIER) % MODULUS * START[0] + seed * START[1] + START[2]) % MODULUS
    for offset in ROUND_OFFSETS:
        x = (x * x % MODULUS + (x >> ROUND_SHIFT) * ROUND_MULTIPLIER + offset) % MODULUS
    return x


def uniform(key: Column, seed) -> Column:
    return mix(key, seed) / F.lit(float(MODULUS))


def poisson_weight(key: Column, seed) -> Column:
    """Poisson(1) bootstrap weight of a row in one replicate."""
    x = mix(key, seed)
    steps = F.array(*[F.lit(p * MODULUS) for p in POISSON_CDF])
    return F.size(F.filter(F.transform(steps, lambda s: s <= x), lambda hit: hit))


def row_key(df, id_col: str | None) -> Column:
    """Integer identity of a row: the id column, or a hash of all columns where there is none or it is null."""
    if id_col is None:
        return F.abs(F.xxhash64(*[F.col(c) for c in df.columns]) % F.lit(1 << 53))
    if dict(df.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint"):
        return F.coalesce(F.col(id_col).cast("bigint"), F.abs(F.xxhash64(*[F.col(c) for c in df.columns]) % F.lit(1 << 53)))
    return F.abs(F.xxhash64(F.col(id_col)) % F.lit(1 << 53))


def mix_sql(key: str, seed: str | int) -> str:
    """The same mix as a DuckDB expression."""
    folded = f"((({key}) % {MODULUS} + (({key}) // {1 << FOLD_SHIFT}) % {MODULUS} * {FOLD_MULTIPLIER}) % {MODULUS})"
    x = f"(({folded} * {START[0]} + ({seed}) * {START[1]} + {START[2]}) % {MODULUS})"
    for offset in ROUND_OFFSETS:
        x = f"(list_transform([{x}], lambda x: ((x * x) % {MODULUS} + (x // {ROUND_DIVISOR}) * {ROUND_MULTIPLIER} + {offset}) % {MODULUS})[1])"
    return f"({x})"


def uniform_sql(key: str, seed: str | int) -> str:
    return f"({mix_sql(key, seed)} / {MODULUS}.0::DOUBLE)"
