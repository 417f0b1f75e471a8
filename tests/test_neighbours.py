"""Nearest neighbours through cells and leaves: exact, with few distances."""

import numpy as np
import pandas as pd
import pytest

from tabstudy.operators import models as M


def _brute(x, tid, q, k):
    d = M._distances(q, x)
    return [[(d[i, j], tid[j]) for j in np.lexsort((tid, d[i]))[:k]] for i in range(len(q))]


@pytest.mark.parametrize("width", [1, 2, 5])
def test_leaves_give_the_same_neighbours(width):
    rng = np.random.default_rng(width)
    x = np.round(rng.normal(size=(3000, width)), 2)
    x[:700] = x[0]  # copies
    tid, q = rng.permutation(3000), np.vstack([np.round(rng.normal(size=(150, width)), 2), x[:3], [[9.0] * width]])
    at, of, far, last = M._nearest(x, tid, q, np.full(len(q), np.inf), 6)
    for i, best in enumerate(_brute(x, tid, q, 6)):
        assert sorted(zip(far[at == i], tid[of[at == i]])) == best
        assert last[i] == best[-1][0]
    tight = last * 0.5
    at, of, far, _ = M._nearest(x, tid, q, tight, 6)
    for i, best in enumerate(_brute(x, tid, q, 6)):
        assert sorted(zip(far[at == i], tid[of[at == i]])) == [b for b in best if b[0] <= tight[i]]


def test_a_query_meets_few_rows_of_a_chunk(monkeypatch):
    rng, made, distances = np.random.default_rng(1), [0], M._distances
    monkeypatch.setattr(M, "_distances", lambda x, y: made.__setitem__(0, made[0] + len(x) * len(y)) or distances(x, y))
    x, q = rng.random((20_000, 2)), rng.random((2000, 2))
    M._nearest(x, np.arange(len(x)), q, np.full(len(q), np.inf), 5)
    assert made[0] < len(x) * len(q) / 8


def _found(spark, x, ids, q, names, k, features, **options):
    train = spark.createDataFrame(pd.DataFrame(x, columns=features).assign(id=ids))
    queries = spark.createDataFrame(pd.DataFrame(q, columns=features).assign(id=names))
    out = {}
    for r in M.nearest_neighbours(train, queries, features, k, "id", "id", **options).collect():
        out.setdefault(r["query"], []).append((r["rank"], r["distance"], r["neighbour"]))
    return {i: [p[1:] for p in sorted(v)] for i, v in out.items()}


@pytest.mark.parametrize("related", [False, True])
def test_cells_lose_no_neighbour(spark, related):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 2)) * [5, 3]
    if related:
        x[:, 1] = 2 * x[:, 0]
    q = np.vstack([rng.normal(size=(60, 2)) * [5, 3], [[500.0, -500.0]]])
    got = _found(spark, x, np.arange(2000), q, np.arange(61), 7, ["a", "b"], pivots=40, chunk=30)
    assert [got[i] for i in range(61)] == _brute(x, np.arange(2000), q, 7)


def test_few_rows_and_one_feature(spark):
    x, q = np.array([[1.0], [2.0], [2.0]]), np.array([[1.9], [-4.0]])
    assert [_found(spark, x, np.arange(3), q, np.arange(2), 5, ["a"])[i] for i in range(2)] == _brute(x, np.arange(3), q, 5)
    x = np.arange(400.0)[:, None]
    assert [_found(spark, x, np.arange(400), q, np.arange(2), 3, ["a"])[i] for i in range(2)] == _brute(x, np.arange(400), q, 3)


def test_rows_of_one_id_share_their_neighbours_and_gaps_are_refused(spark):
    x = np.arange(10.0)[:, None]
    got = _found(spark, x, np.arange(10), np.array([[2.0], [2.0], [7.1]]), np.array([0, 0, 1]), 4, ["a"])
    assert [n for _, n in got[0]] == [2, 2, 1, 1] and [n for _, n in got[1]] == [7, 8, 6, 9]
    with pytest.raises(ValueError, match="lack a feature"):
        _found(spark, np.array([[1.0], [np.nan]]), np.arange(2), x, np.arange(10), 1, ["a"])
