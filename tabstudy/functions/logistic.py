"""Many penalised logistic fits from few scans, by proximal Newton steps.

All fits share the rows: each scan gives every fit its gradient, its weighted cross products and its loss, on the rows of its own
groups (all folds but one, half of the buckets), so folds, penalties and resamples cost no scan of their own. The driver holds
(p + 1) x (p + 1) numbers for each fit and takes the steps by coordinate descent.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gram import doubles, summed_matrices

SCANS = 60
FITS = 64  # that share the matrix products of a slice of rows
TOLERANCE = 1e-8  # largest departure from the optimality conditions, of the mean loss


@dataclass
class Fits:
    coefficients: np.ndarray  # fits x (1 + p), intercept first
    held_out_loss: np.ndarray  # mean log loss on the rows outside a fit's groups; NaN where there are none
    departure: np.ndarray  # from the optimality conditions
    scans: int


def _step(hessian: np.ndarray, gradient: np.ndarray, beta: np.ndarray, l1: float, l2: float, free: np.ndarray) -> np.ndarray:
    """Minimum of the quadratic model around ``beta`` with penalties on all but the first coefficient, by coordinate descent."""
    new = beta.copy()
    slope = -gradient.copy()  # of the model at ``new``
    for _ in range(500):
        largest = 0.0
        for j in np.flatnonzero(free):
            curve = hessian[j, j]
            if curve <= 0:
                continue
            ridge = l2 if j else 0.0
            target = curve * new[j] - slope[j]
            value = (np.sign(target) * max(abs(target) - l1, 0.0) if j else target) / (curve + ridge)
            if value != new[j]:
                slope += hessian[:, j] * (value - new[j])
                largest = max(largest, abs(value - new[j]) * np.sqrt(curve))
                new[j] = value
        if largest < 1e-12:
            break
    return new


def _departure(gradient: np.ndarray, beta: np.ndarray, l1: float, l2: float, free: np.ndarray) -> float:
    """Largest amount by which a coefficient's condition fails: gradient = l2 b + l1 sign(b), or at most l1 where b is 0."""
    g = gradient.copy()
    g[1:] -= l2 * beta[1:]
    off = np.where(beta == 0, np.maximum(np.abs(g) - l1, 0), np.abs(g - l1 * np.sign(beta)))
    off[0] = abs(g[0])
    return float(off[free].max())


def logistic_fits(rows: DataFrame, names: Sequence[str], target: str, group: str, uses: np.ndarray, l1: Sequence[float], l2: Sequence[float], free: np.ndarray | None = None, start: np.ndarray | None = None) -> Fits:
    """Fits of mean log loss + l1 |b| + l2 b'b / 2 on 0/1 rows; fit m sees the rows whose ``group`` (0, 1, ...) is set in ``uses[m]``.

    ``free`` (fits x p) names the columns of each fit. Rows with a null are left out. ``rows`` is read once for each scan: pass a written table.
    """
    m, p = len(uses), len(names)
    l1, l2 = np.asarray(l1, dtype=float), np.asarray(l2, dtype=float)
    open_ = np.column_stack([np.ones(m, dtype=bool), np.ones((m, p), dtype=bool) if free is None else free])
    beta = np.zeros((m, p + 1)) if start is None else start.copy()
    best, best_value, step_from = beta.copy(), np.full(m, np.inf), [None] * m
    held, off = np.full(m, np.nan), np.full(m, np.inf)
    frame = rows.select(F.col(group).cast("double").alias("_g"), F.col(target).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(names)])
    width = max(p + 2, 4)

    pairs = np.triu_indices(p + 1)

    def scan(which: np.ndarray, at: np.ndarray) -> dict:
        """All fits' sums of a slice of rows come from a few matrix products, with a weight of zero on the rows outside a fit's groups."""
        taken = uses[which].T.astype(float)  # groups x fits

        def of(batch: pa.RecordBatch):
            for _, x in doubles(batch):
                x = x[~np.isnan(x).any(axis=1)]
                z, y, g = np.column_stack([np.ones(len(x)), x[:, 2:]]), x[:, 1:2], x[:, 0].astype(np.int64)
                products = z[:, pairs[0]] * z[:, pairs[1]]
                for start in range(0, len(which), FITS):
                    own = slice(start, start + FITS)
                    inside, eta = taken[g, own], z @ at[own].T
                    small = np.exp(-np.abs(eta))
                    mean = np.where(eta >= 0, 1.0, small) / (1 + small)
                    loss = np.maximum(eta, 0) + np.log1p(small) - y * eta
                    curves = (inside * (small / (1 + small) ** 2)).T @ products
                    slopes = (inside * (y - mean)).T @ z
                    outside = 1 - inside
                    totals = [(loss * inside).sum(0), inside.sum(0), (loss * outside).sum(0), outside.sum(0)]
                    out = np.zeros((len(slopes), p + 2, width))
                    out[:, pairs[0], pairs[1]] = out[:, pairs[1], pairs[0]] = curves
                    out[:, :p + 1, p + 1] = slopes
                    out[:, p + 1, :4] = np.stack(totals, axis=1)
                    yield from zip(which[own].tolist(), out)

        return summed_matrices(frame, of, "int")

    active, scans = np.arange(m), 0
    while len(active) and scans < SCANS:
        scans += 1
        sums = scan(active, beta[active])
        again = []
        for k in active.tolist():
            if k not in sums:
                off[k] = 0.0
                continue
            s = sums[k]
            loss, n, other, n_other = s[p + 1, :4]
            n = max(n, 1.0)
            hessian, gradient = s[:p + 1, :p + 1] / n, s[:p + 1, p + 1] / n
            value = loss / n + l1[k] * np.abs(beta[k, 1:]).sum() + l2[k] * (beta[k, 1:] ** 2).sum() / 2
            if value > best_value[k] + 1e-13 * abs(best_value[k]) and np.abs(beta[k] - best[k]).max() > 1e-14:
                beta[k] = (beta[k] + best[k]) / 2  # too far: half the step
                again.append(k)
                continue
            best[k], best_value[k] = beta[k].copy(), value
            held[k] = other / n_other if n_other else np.nan
            off[k] = _departure(gradient, beta[k], l1[k], l2[k], open_[k])
            if off[k] > TOLERANCE:
                beta[k] = _step(hessian, gradient, beta[k], l1[k], l2[k], open_[k])
                again.append(k)
        active = np.array(again, dtype=int)
    return Fits(best, held, off, scans)
