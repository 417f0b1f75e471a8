"""Embedding whitening by incremental eigendecomposition.

Each partition keeps the spectrum of its rows' scatter about their mean and takes in every row as a centred rank-one update: the new
eigenvalues are the roots of a secular equation, after deflation of what the update does not touch. Spectra are combined by successive
rank-one updates along a tree. The leading eigenvectors are then refined by distributed Rayleigh-Ritz steps until their residuals are rounding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, slices

SCALE, SHIFT = 1024, 100_000  # entries become floor(SCALE c) + SHIFT
COMPONENTS = 8
SPARE = 8  # further vectors that the Ritz steps carry
FAN = 16  # spectra that one task combines
STEPS = 12  # Ritz steps at most
ROUNDING = 1e-13  # of the largest eigenvalue: residuals below are rounding
FLAT = 1e-12  # of the trace: directions below have no variance
LARGEST = 2.0**52  # of an entry times SCALE; beyond it doubles are not whole numbers, and entries end there


def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(z2 / (d - x)) = 0 for rising d and positive z2, as (place of the nearest pole, distance from it).

    Each root lies between its pole and the next. Steps interpolate the parts left and right of the root by one pole each; a
    bracket that halves keeps them safe.
    """
    k = len(d)
    gap = np.append(np.diff(d), z2.sum())
    low = np.arange(k)
    middle = d + gap / 2
    with np.errstate(divide="ignore"):
        value = 1 + (z2 / (d[None, :] - middle[:, None])).sum(axis=1)
    near = np.where((value < 0) & (low < k - 1), low + 1, low)  # below zero: the root is in the right half
    origin = d[np.minimum(near, k - 1)]
    delta = d[None, :] - origin[:, None]
    left = np.arange(k)[None, :] <= low[:, None]
    a = np.where(near > low, -gap / 2, 0.0)
    b = np.where(near > low, 0.0, np.where((low == k - 1) | (value >= 0), gap if k == 1 else np.where(low == k - 1, gap, gap / 2), gap / 2))
    lower, upper = delta[low, low], np.append(delta[low[:-1], low[1:]], np.inf)
    x = (a + b) / 2
    for _ in range(60):
        away = delta - x[:, None]
        away = np.where(away == 0, np.finfo(float).tiny, away)
        t = z2 / away
        slope = t / away
        psi, dpsi = (t * left).sum(axis=1), (slope * left).sum(axis=1)
        total, dphi = 1 + t.sum(axis=1), slope.sum(axis=1) - dpsi
        phi = total - 1 - psi
        a, b = np.where(total < 0, x, a), np.where(total >= 0, x, b)
        size = 1 + np.abs(psi) + np.abs(phi)
        open_ = (np.abs(total) > 8 * np.finfo(float).eps * k * size) & (np.abs(b - a) > 4 * np.finfo(float).eps * np.maximum(np.abs(a), np.abs(b)))
        if not open_.any():
            break
        # r + s / (pole - y) with the value and slope of each part at x
        dl, du = lower - x, np.where(np.isinf(upper), 0.0, upper - x)
        s, q = dpsi * dl * dl, np.where(np.isinf(upper), 0.0, dphi * du * du)
        c = total - dpsi * dl - np.where(np.isinf(upper), 0.0, dphi * du)
        # c + s / (dl - y) + q / (du - y) = 0 for the step y
        bb = c * (dl + du) + s + q
        cc = c * dl * du + s * du + q * dl
        root = np.sqrt(np.maximum(bb * bb - 4 * c * cc, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            y = np.where(bb > 0, 2 * cc / (bb + root), np.where(c != 0, (bb - root) / (2 * c), 0))
            y = np.where(np.isinf(upper), dl + s / c, y)  # the last root: c + s / (dl - y) = 0
        new = x + y
        safe = np.isfinite(new) & (new > a) & (new < b)
        x = np.where(open_, np.where(safe, new, (a + b) / 2), x)
    return near, x


@dataclass
class Spectrum:
    """Number of rows, exact sums, and the eigenvalues (rising) and eigenvectors (columns) of the scatter about the mean."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, width: int) -> Spectrum:
        return cls(0, [0] * width, np.zeros(width), np.eye(width))

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums]) if self.n else np.zeros(len(self.sums))

    def update(self, rho: float, v: np.ndarray) -> None:
        """Add rho v v' to the scatter."""
        z = self.vectors.T @ v
        size = np.sqrt(z @ z)
        if rho <= 0 or size == 0:
            return
        d = self.values
        tiny = np.finfo(float).eps * max(d[-1], rho * size * size) * 2
        # equal eigenvalues: turn their vectors so that one of them takes the whole update
        close = np.flatnonzero(np.diff(d) <= tiny)
        if len(close):
            cuts = np.flatnonzero(np.diff(close, prepend=-2) > 1)
            for a, b in zip(close[cuts].tolist(), [*(close[cuts[1:] - 1] + 1).tolist(), int(close[-1]) + 1]):
                part = z[a:b + 1].copy()
                norm = np.sqrt(part @ part)
                if norm == 0:
                    continue
                h = part.copy()
                h[-1] += norm if part[-1] >= 0 else -norm
                block = self.vectors[:, a:b + 1]
                self.vectors[:, a:b + 1] = block - np.outer(block @ h, h * (2 / (h @ h)))
                z[a:b + 1] = 0
                z[b] = -norm if part[-1] >= 0 else norm
        live = np.flatnonzero(rho * z * z > tiny * np.finfo(float).eps)
        live = live[np.abs(z[live]) * np.sqrt(rho) > np.finfo(float).eps * np.sqrt(max(d[-1], rho * size * size))]
        if not len(live):
            return
        own, z2 = d[live], rho * z[live] ** 2
        keep = np.append(np.diff(own) > 0, True)
        live, own, z2 = live[keep], own[keep], z2[keep]
        near, x = secular_roots(own, z2)
        away = own[None, :] - own[near][:, None] - x[:, None]  # pole - root
        away = np.where(away == 0, -np.finfo(float).tiny, away)
        # the update of which these are the exact roots keeps the vectors orthogonal
        k = len(own)
        ratio = np.abs(away)
        between = np.abs(own[None, :] - own[:, None])
        np.fill_diagonal(between, 1.0)
        log = np.log(ratio).sum(axis=0) - np.log(between).sum(axis=0)
        hat = np.exp(log / 2) * np.sign(z[live])
        w = hat[None, :] / away
        w /= np.sqrt((w * w).sum(axis=1))[:, None]
        self.vectors[:, live] = self.vectors[:, live] @ w.T
        self.values = d.copy()
        self.values[live] = own[near] + x
        order = np.argsort(self.values, kind="stable")
        if (np.diff(order) < 0).any() or k != len(d):
            self.values, self.vectors = np.maximum(self.values[order], 0), self.vectors[:, order]

    def add(self, x: np.ndarray, copies: int) -> None:
        """Take in equal rows x: one centred rank-one update."""
        if self.n:
            self.update(self.n * copies / (self.n + copies), x - self.mean)
        self.n += copies
        self.sums = [s + copies * int(v) for s, v in zip(self.sums, x)]

    def combine(self, other: Spectrum) -> None:
        """Take in another spectrum: an update for each of its vectors, and one for the distance of the means."""
        if not other.n:
            return
        if not self.n:
            self.values, self.vectors = other.values.copy(), other.vectors.copy()
        else:
            apart = other.mean - self.mean
            for value, vector in zip(other.values, other.vectors.T):
                self.update(value, vector)
            self.update(self.n * other.n / (self.n + other.n), apart)
        self.n += other.n
        self.sums = [a + b for a, b in zip(self.sums, other.sums)]


def _kept(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Places of vectors that are not null and hold neither null nor non-finite entries, and those vectors."""
    flat = column.flatten()
    good = np.isfinite(flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False))
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    bad = np.append(0, np.cumsum(~good))
    end = np.cumsum(size)
    at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (bad[end] == bad[end - size]))
    return at, column.take(pa.array(at))


def whole_numbers(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the remaining vectors, and their entries as whole numbers; missing places at the end count as 0."""
    at, own = _kept(column)
    out = np.full((len(at), width), SHIFT, dtype=np.int64)
    size = own.value_lengths().to_numpy(zero_copy_only=False)
    flat = own.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(at)), size)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[row, place] = np.floor(np.clip(flat * SCALE, -LARGEST, LARGEST)).astype(np.int64) + SHIFT
    return at, out


def _rows_of(s: Spectrum, part: int) -> pa.RecordBatch:
    columns = [pa.array([part]), pa.array([s.n]), pa.array([[str(v) for v in s.sums]]), pa.array([s.values]), pa.array([s.vectors.ravel()])]
    return pa.RecordBatch.from_arrays(columns, ["part", "n", "sums", "vals", "vecs"])


_SPECTRA = "part long, n long, sums array<string>, vals array<double>, vecs array<double>"


def spectrum(vectors: DataFrame, width: int) -> Spectrum:
    """Spectrum of the rows (vec) as a tree of combined partitions; the driver gets the last one, width squared numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum.empty(width)
        for batch in slices(batches, 1000):
            x, copies = np.unique(whole_numbers(batch.column(0), width)[1], axis=0, return_counts=True)
            for row, k in zip(x, copies.tolist()):
                own.add(row.astype(np.float64), k)
        if own.n:
            yield _rows_of(own, TaskContext.get().partitionId())

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own = None, Spectrum.empty(width)
        for batch in slices(batches, FAN):
            for p, n, sums, values, matrix in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
                if part is not None and p != part:
                    yield _rows_of(own, part)
                    own = Spectrum.empty(width)
                part = p
                own.combine(Spectrum(n, [int(s) for s in sums], values.values.to_numpy(), matrix.values.to_numpy().reshape(width, width)))
        if own.n:
            yield _rows_of(own, part)

    table = materialise(vectors.mapInArrow(run, _SPECTRA), "spectra")
    count = table.count()
    while count > 1:
        count = -(-count // FAN)
        near = table.withColumn("part", F.expr(f"pmod(hash(part), {count})") if count > 1 else F.lit(0).cast("long")).select(F.col("part").cast("long").alias("part"), "n", "sums", "vals", "vecs")
        done = materialise(near.repartition(count, "part").sortWithinPartitions("part", "n", "sums").mapInArrow(combined, _SPECTRA), "spectra")
        discard(table)
        table, count = done, done.count()
    last = table.first()
    discard(table)
    return Spectrum(last.n, [int(s) for s in last.sums], np.array(last.vals), np.array(last.vecs).reshape(width, width)) if last else Spectrum.empty(width)


def _matrix_sums(vectors: DataFrame, width: int, of) -> np.ndarray:
    """Sum over batches of the matrices ``of(whole numbers)``: each task sends one, added up row by row."""

    def add(batches):
        total = None
        for batch in slices(batches, 1000):
            own = of(whole_numbers(batch.column(0), width)[1])
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total))], ["i", "sums"])

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, s in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[i] = sums.get(i, 0) + s.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["i", "sums"])

    kind = "i long, sums array<double>"
    rows = sorted(vectors.mapInArrow(add, kind).repartition("i").sortWithinPartitions("i", "sums").mapInArrow(merge, kind).collect())
    return np.array([r.sums for r in rows])


@dataclass
class Whitening:
    n: int
    sums: list[int]
    values: np.ndarray  # leading eigenvalues of the covariance, falling
    vectors: np.ndarray  # columns
    trace: float
    error: float = 0.0

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Components of whole numbers; NaN where a direction has no variance."""
        flat = ~(self.values > FLAT * self.trace)
        scale = np.where(flat, np.nan, 1 / np.sqrt(np.where(flat, 1.0, self.values)))
        return ((x - self.mean) @ self.vectors) * scale

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums over dimensions of (n x - S)^2."""
        centre = [round(s / self.n) for s in self.sums]
        near = x - np.array(centre, dtype=np.int64)
        rest = [self.n * c - s for c, s in zip(centre, self.sums)]
        most = self.n * int(np.abs(near).max(initial=0)) + max(map(abs, rest), default=0)
        if most * most * max(1, x.shape[1]) < 1 << 62:
            off = near * self.n + np.array(rest, dtype=np.int64)
            return (off * off).sum(axis=1).tolist()
        return [sum((self.n * v + r) ** 2 for v, r in zip(row, rest)) for row in near.tolist()]


def fit(vectors: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """Whitening of rows (vec)."""
    start = spectrum(vectors, width)
    k = min(components, width)
    out = Whitening(start.n, start.sums, np.zeros(k), np.eye(width)[:, :k], 0.0)
    if not start.n:
        return out
    mean = out.mean

    def products(basis: np.ndarray) -> tuple[np.ndarray, float]:
        def of(x):
            c = x - mean
            return np.hstack([c.T @ (c @ basis), (c * c).sum(axis=0)[:, None]])

        total = _matrix_sums(vectors, width, of) / start.n
        return total[:, :-1], float(total[:, -1].sum())

    basis = start.vectors[:, ::-1][:, :min(width, components + SPARE)]
    for _ in range(STEPS):
        image, out.trace = products(basis)
        small = basis.T @ image
        e, w = np.linalg.eigh((small + small.T) / 2)
        e, w = e[::-1], w[:, ::-1]
        ritz, image = basis @ w, image @ w
        out.values, out.vectors = np.maximum(e[:k], 0), ritz[:, :k]
        rest = image - ritz * e
        if np.abs(rest[:, :k]).max() <= ROUNDING * max(e[0], 0):
            break
        spare = min(width, components + SPARE)
        further = rest[:, :k]
        further = further - ritz[:, :spare] @ (ritz[:, :spare].T @ further)
        size = np.sqrt((further**2).sum(axis=0))
        further = further[:, size > 0] / size[size > 0]
        basis = np.linalg.qr(np.hstack([ritz[:, :spare], further]))[0][:, :width]
    if out.trace > 0:
        live = np.flatnonzero(out.values > FLAT * out.trace)

        def squares(x):
            w = np.hstack([out.whiten(x)[:, live], np.ones((len(x), 1))])
            return w.T @ w

        total = _matrix_sums(vectors, width, squares) / start.n
        centre = total[:-1, -1]
        out.error = float(np.abs(total[:-1, :-1] - np.outer(centre, centre) - np.eye(len(live))).max(initial=0))
    return out


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error), one for each remaining row and leading component.

    Rows whose vector is null or holds a null or non-finite entry are dropped. Entries become floor(1024 c) + 100000; an entry
    beyond 2**52 / 1024 ends there. A vector shorter than the longest is taken to end in zeros. deviation is exact, and null where
    it passes 64 bits. Along directions without variance, whitened is null and explained 0 (null where nothing varies). Repeated
    rows and ids, and null ids, stay as they are; other columns are ignored; an empty table gives an empty one.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
    usable = F.col("vec").isNotNull() & F.forall("vec", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    width = vectors.where(usable).agg(F.max(F.size("vec"))).first()[0] or 0
    if not width:
        return rows.sparkSession.createDataFrame([], schema)
    model = fit(vectors.select("vec"), width, components)
    k = len(model.values)
    explained = [v / model.trace if v > FLAT * model.trace else 0.0 for v in model.values.tolist()] if model.trace > 0 else [None] * k
    error = model.error

    def run(batches):
        for batch in slices(batches, 1000):
            at, x = whole_numbers(batch.column(1), width)
            flat = model.whiten(x).ravel() if model.trace > 0 else np.full(len(at) * k, np.nan)
            off = [d if d < 1 << 63 else None for d in model.deviations(x)]
            each = np.repeat(np.arange(len(at)), k)
            columns = [batch.column(0).take(pa.array(at[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(flat), model.n)), pa.array(off, pa.int64()).take(pa.array(each))]
            columns += [pa.array(flat, from_pandas=True), pa.array(explained, pa.float64()).take(pa.array(np.tile(np.arange(k), len(at)))), pa.array(np.full(len(flat), error))]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return vectors.mapInArrow(run, schema)
