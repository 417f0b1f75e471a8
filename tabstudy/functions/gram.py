"""Cross-product matrices of many columns in one scan, and the small linear algebra on top.

Every task adds up its matrices with matrix products over Arrow batches and sends them row by row; rows of the same place are
added as they stream in, so no task holds more than one. Only (p + 1) x (p + 1) numbers per group reach the driver; every linear
fit below starts from them, so cross-validation and penalty paths need no further pass over the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH = 4096  # rows that are doubles at once


def means_of(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(str(i)) for i, c in enumerate(cols)]).first()
    return np.array([0.0 if v is None else float(v) for v in row])


def doubles(batch: pa.RecordBatch, first: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Short slices of a batch with the double columns from ``first`` on as a matrix; nulls are NaN."""
    for at in range(0, batch.num_rows, BATCH):
        part = batch.slice(at, BATCH)
        yield part, np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns[first:]]) if batch.num_columns > first else np.zeros((part.num_rows, 0))


def summed_matrices(df: DataFrame, of: Callable[[pa.RecordBatch], Iterator[tuple[object, np.ndarray]]], group: str) -> dict:
    """{group: sum of the matrices} that ``of`` gives for the batches of ``df`` as (group, matrix). ``group`` is the type of the groups."""

    def add(batches):
        total: dict = {}
        for batch in batches:
            for key, matrix in of(batch):
                total[key] = total[key] + matrix if key in total else matrix
        for key, matrix in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(matrix), kind), pa.array(np.arange(len(matrix))), pa.array(list(matrix), pa.list_(pa.float64()))], ["g", "i", "sums"])

    def merge(batches):
        place, total = None, None
        for batch in batches:
            for key, i, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own = sums.values.to_numpy()
                if place != (key, i):
                    if place is not None:
                        yield row(place, total)
                    place, total = (key, i), own
                else:
                    total = total + own
        if place is not None:
            yield row(place, total)

    def row(place, total):
        return pa.RecordBatch.from_arrays([pa.array([place[0]], kind), pa.array([place[1]], pa.int64()), pa.array([total], pa.list_(pa.float64()))], ["g", "i", "sums"])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    kind = to_arrow_type(DataType.fromDDL(group))
    schema = f"g {group}, i long, sums array<double>"
    out: dict = {}
    for r in df.mapInArrow(add, schema).repartition("g", "i").sortWithinPartitions("g", "i", "sums").mapInArrow(merge, schema).toLocalIterator():
        out.setdefault(r.g, {})[r.i] = np.array(r.sums)
    return {g: np.array([rows[i] for i in range(len(rows))]) for g, rows in out.items()}


def grams(df: DataFrame, cols: Sequence[str], shift: Sequence[float] | None = None, by: str | None = None, weight: Column | None = None) -> dict:
    """{group: matrix} of sums of products of (1, cols...) minus ``shift``; rows with a null or NaN are left out.

    Shifting by rough means keeps the sums well conditioned.
    """
    shift = np.array(list(shift) if shift is not None else [0.0] * len(cols), dtype=float)
    size = len(cols) + 1
    group = df.schema[by].dataType.simpleString() if by else "int"
    key = F.col(by) if by else F.lit(None).cast("int")
    w = weight.cast("double") if weight is not None else F.lit(1.0)
    rows = df.select(key.alias("_g"), w.alias("_w"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)])

    def of(batch: pa.RecordBatch) -> Iterator[tuple[object, np.ndarray]]:
        for part, x in doubles(batch, 1):
            good = ~np.isnan(x).any(axis=1)
            z = np.column_stack([np.ones(good.sum()), x[good, 1:] - shift])
            w = x[good, :1]
            groups = part.column(0).filter(pa.array(good)).dictionary_encode()
            codes = groups.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for code in np.unique(codes):
                own = codes == code
                yield (groups.dictionary[int(code)].as_py() if code >= 0 else None), (z[own] * w[own]).T @ z[own]

    found = summed_matrices(rows, of, group)
    return found if by or found else {None: np.zeros((size, size))}


def pairwise_sums(df: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n, sx, sxx, sxy, shift) over the rows complete in each pair: counts, sums and sums of squares of the row's column, products; values are minus ``shift``."""
    shift = means_of(df, cols)
    rows = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)])

    def of(batch: pa.RecordBatch) -> Iterator[tuple[object, np.ndarray]]:
        for _, x in doubles(batch):
            there = ~np.isnan(x)
            z, m = np.where(there, x - shift, 0.0), there.astype(float)
            yield 0, np.hstack([m.T @ m, z.T @ m, (z * z).T @ m, z.T @ z])

    found = summed_matrices(rows, of, "int").get(0, np.zeros((len(cols), 4 * len(cols))))
    return (*np.hsplit(found, 4), shift)


def pairwise_correlations(df: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(r, n) on the rows complete in each pair; NaN where a column does not vary on them."""
    n, sx, sxx, sxy, shift = pairwise_sums(df, cols)
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = sxx - sx * sx / n
        spread = np.where(spread > n * (1e-13 * (np.abs(shift)[:, None] + np.sqrt(np.maximum(sxx, 0) / n))) ** 2, spread, np.nan)
        return (sxy - sx * sx.T / n) / np.sqrt(spread * spread.T), n


def solve_ols(g: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """Coefficients (intercept first) of the last column on the others; the intercept is not penalised."""
    a, b = g[:-1, :-1].copy(), g[:-1, -1]
    if ridge:
        a[1:, 1:] += ridge * np.eye(a.shape[0] - 1)
    return np.linalg.lstsq(a, b, rcond=None)[0]


def covariance(g: np.ndarray) -> np.ndarray:
    """Population covariance of the columns behind a cross-product matrix."""
    n = g[0, 0]
    m = g[0, 1:] / n
    return g[1:, 1:] / n - np.outer(m, m)


def squared_error(g: np.ndarray, beta: np.ndarray) -> float:
    """Sum of squared residuals of the last column under coefficients fitted elsewhere."""
    v = np.append(-beta, 1.0)
    return float(v @ g @ v)


def lasso(cov: np.ndarray, xy: np.ndarray, penalty: float, start: np.ndarray | None = None, rounds: int = 1000, tolerance: float = 1e-9) -> np.ndarray:
    """Coordinate descent on a covariance matrix: minimises b'Cb / 2 - b'xy + penalty |b|."""
    beta = np.zeros(len(xy)) if start is None else start.copy()
    for _ in range(rounds):
        biggest = 0.0
        for j in range(len(xy)):
            if cov[j, j] <= 0:
                continue
            partial = xy[j] - cov[j] @ beta + cov[j, j] * beta[j]
            new = np.sign(partial) * max(abs(partial) - penalty, 0.0) / cov[j, j]
            biggest = max(biggest, abs(new - beta[j]))
            beta[j] = new
        if biggest < tolerance:
            break
    return beta
