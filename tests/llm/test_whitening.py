import random

import numpy as np
import pytest
from pyspark.sql import types as T

from tabstudy.llm import QUERIES, whitening

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("n", T.StringType()), T.StructField("sums", T.StringType())])


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)


def slow(rows, components=8):
    """(vec_id, component) -> (n, deviation, whitened, explained) by one eigendecomposition of the whole covariance."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max(len(v) for _, v in kept)
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] + [100_000] * (width - len(v)) for _, v in kept], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviation = [int(sum((n * a - s) ** 2 for a, s in zip(r, sums))) for r in x]
    c = np.array([[float(n * a - s) / n for a, s in zip(r, sums)] for r in x])
    cov = c.T @ c / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    out = {}
    for k in range(min(components, width)):
        for (i, _), d, w in zip(kept, deviation, c @ v[:, k]):
            out.setdefault((i, k + 1), []).append((n, d, w / np.sqrt(e[k]) if e[k] > 1e-12 * cov.trace() else None, e[k] / cov.trace()))
    return out


def compare(df, want, close=1e-7):
    got = {}
    for r in df.collect():
        got.setdefault((r.vec_id, r.component), []).append((r.n, r.deviation, r.whitened, r.explained))
        assert r.identity_error <= 1e-4
    assert got.keys() == want.keys()
    signs = {}
    for key in sorted(want, key=repr):
        assert sorted(x[:2] for x in got[key]) == sorted(x[:2] for x in want[key])
        for a, b in zip(*(sorted(v, key=lambda x: (x[1], abs(x[2] or 0))) for v in (got[key], want[key]))):
            if b[2] is None:
                assert a[2] is None and a[3] == 0
                continue
            assert abs(a[3] - b[3]) <= 1e-9 * b[3]
            sign = signs.setdefault(key[1], np.sign(a[2] * b[2]) if abs(b[2]) > 1e-3 else None)
            if sign is None:
                del signs[key[1]]
                sign = 1 if abs(a[2] - b[2]) < abs(a[2] + b[2]) else -1
            assert abs(a[2] - sign * b[2]) <= close


def test_whole_table_against_one_decomposition(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    compare(QUERIES["op13_whitening"](spark, folder), slow(rows))


@pytest.mark.parametrize("kind", ["plain", "repeated", "flat", "few", "one", "large"])
def test_shapes(spark, kind):
    rng = np.random.default_rng(5)
    n, d = (6 if kind == "few" else 1 if kind == "one" else 300), (3 if kind == "flat" else 12)
    x = rng.normal(0, 1e2 if kind == "large" else 1, (n, d)) * np.arange(1, d + 1)
    if kind == "repeated":  # a third of all rows is one vector
        x[::3] = x[0]
    if kind == "flat":
        x[:, 1] = 0.5
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    df = table(spark, rows).repartition(40)
    if kind == "one":
        out = whitening.whitened(df).collect()
        assert [(r.component, r.n, r.deviation, r.whitened, r.explained) for r in out] == [(k, 1, 0, None, None) for k in range(1, 9)]
    else:
        compare(whitening.whitened(df), slow(rows))


def test_edges(spark):
    rnd = random.Random(2)
    good = [(i, [rnd.gauss(0, 1) for _ in range(5)]) for i in range(50)]
    rows = [*good, (7, good[0][1]), (None, good[1][1]), (60, None), (61, [1.0, None, 1.0, 1.0, 1.0]), (62, [float("nan")] * 5), (63, [1.0, float("-inf"), 0.0, 0.0, 0.0]), (64, [0.5, 0.25])]
    compare(whitening.whitened(table(spark, rows)), slow(rows))
    for none in ([], [(1, None)], [(1, [])]):
        assert whitening.whitened(table(spark, none)).count() == 0
    far = [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 0.5])]
    assert all(r.deviation is None or r.deviation >= 0 for r in whitening.whitened(table(spark, far)).collect())


def test_rank_one_updates_and_combined_spectra():
    rng = np.random.default_rng(6)
    for n, d in ((40, 6), (30, 32), (200, 16)):
        x = np.round(rng.normal(0, 100, (n, d))) + 100_000
        x[n // 2:n // 2 + 9] = x[0]
        x[:, -1] = x[:, 0]  # equal and zero eigenvalues
        whole, parts = whitening.Spectrum.empty(d), [whitening.Spectrum.empty(d) for _ in range(3)]
        for i, r in enumerate(x):
            whole.add(r, 1)
            parts[i % 3].add(r, 1)
        for p in parts[1:]:
            parts[0].combine(p)
        c = x - x.mean(axis=0)
        for s in (whole, parts[0]):
            assert np.abs(s.vectors.T @ s.vectors - np.eye(d)).max() < 1e-11
            assert np.abs(s.vectors * s.values @ s.vectors.T - c.T @ c).max() < 1e-10 * np.trace(c.T @ c)
            assert s.n == n and s.sums == x.sum(axis=0).astype(int).tolist()


def test_secular_roots():
    rng = np.random.default_rng(7)
    for k in (1, 2, 5, 40):
        for spread in (1.0, 1e-9):
            d = np.cumsum(rng.uniform(0.01, 1, k) * np.where(rng.random(k) < 0.3, spread, 1))
            z2 = rng.uniform(1e-8, 2, k)
            near, x = whitening.secular_roots(d, z2)
            want = np.linalg.eigvalsh(np.diag(d) + np.outer(np.sqrt(z2), np.sqrt(z2)))
            assert np.allclose(np.sort(d[near] + x), want, rtol=1e-12, atol=1e-13 * want[-1])
