"""Models as Spark estimators: fit on a feature table, score by adding columns."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from random import Random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, OneVsRest, RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.gram import grams, means_of
from ..functions.quantiles import quantile_values
from ..functions.storage import written
from ..functions.hashing import mix, row_key
from .evaluate import class_metrics, join_groups, ranking_metrics, regression_metrics
from .prep import Recipe, TargetTransform, fit as fit_prep, fit_target_transform, recipe_for_model

PARALLEL_FITS = 4
TREES = ("rf", "gbt")  # fits that keep every row as objects and read them once a level
PART_CELLS = 8_000_000  # numbers that a task of such a fit keeps: the features of a row and some sixteen more that go with it


@dataclass
class Fitted:
    """A fitted model: ``predict`` appends pred (and proba, the probability of class 1)."""

    key: str
    task: str
    features: list[str]
    predict: Callable[[DataFrame], DataFrame]
    coefficients: dict[str, float] = field(default_factory=dict)


def in_parallel(jobs: Sequence[Callable], width: int = PARALLEL_FITS) -> list:
    """Run independent driver-side fits at the same time; Spark interleaves their jobs."""
    with ThreadPoolExecutor(width) as pool:
        return list(pool.map(lambda job: inheritable_thread_target(job)(), jobs))


# Model keys by task.
REGRESSORS = ("ols", "ridge", "lasso", "elasticnet", "huber", "rf", "gbt", "knn", "base_mean")
CLASSIFIERS = ("logit", "logreg", "rf", "gbt", "knn", "linear_svc", "gnb", "lda", "mlp", "base_majority")

# Search ranges (kind, low, high) per model parameter.
SEARCH_SPACE = {
    "ridge": {"alpha": ("log", 1e-3, 1e3)}, "lasso": {"alpha": ("log", 1e-4, 1e1)}, "elasticnet": {"alpha": ("log", 1e-4, 1e1), "l1_ratio": ("float", 0.05, 0.95)},
    "logreg": {"C": ("log", 1e-3, 1e2)}, "huber": {"epsilon": ("float", 1.1, 2.0)}, "rf": {"trees": ("int", 10, 60), "depth": ("int", 2, 10), "min_leaf": ("int", 1, 20)},
    "gbt": {"trees": ("int", 10, 60), "depth": ("int", 2, 6), "rate": ("log", 0.02, 0.3)}, "knn": {"k": ("int", 3, 30)},
}


def _estimator(key: str, task: str, n: int, spread: float, n_features: int, n_classes: int, p: Mapping, seed: int):
    """The Spark estimator for a key, with penalties converted to Spark's scale.

    Spark averages the loss over rows, and scales the squared penalty of linear regression by the
    target's standard deviation (``spread``), which the conversion undoes.
    """
    cls = task == "classification"
    if key == "ols":
        return LinearRegression(regParam=0.0, solver="normal")
    if key == "ridge":
        return LinearRegression(regParam=p.get("alpha", 1.0) / n * spread, elasticNetParam=0.0, standardization=False)
    if key == "lasso":
        return LinearRegression(regParam=p.get("alpha", 1.0), elasticNetParam=1.0, standardization=False)
    if key == "elasticnet":
        l1 = p.get("alpha", 1.0) * p.get("l1_ratio", 0.5)
        l2 = (p.get("alpha", 1.0) - l1) * spread
        return LinearRegression(regParam=l1 + l2, elasticNetParam=l1 / (l1 + l2) if l1 + l2 else 0.0, standardization=False)
    if key == "huber":
        return LinearRegression(loss="huber", epsilon=p.get("epsilon", 1.35), regParam=2 * p.get("alpha", 0.0001) / n, standardization=False)
    if key in ("logit", "logreg"):
        return LogisticRegression(regParam=1.0 / (n * p.get("C", 1.0)), elasticNetParam=1.0 if p.get("penalty") == "l1" else 0.0, standardization=False)
    if key == "rf":
        kind = RandomForestClassifier if cls else RandomForestRegressor
        return kind(numTrees=p.get("trees", 100), maxDepth=min(30, p.get("depth", 10)), minInstancesPerNode=p.get("min_leaf", 1), seed=seed)
    if key == "gbt":
        kind = GBTClassifier if cls else GBTRegressor
        one = kind(maxIter=p.get("trees", 50), maxDepth=p.get("depth", 4), stepSize=p.get("rate", 0.1), seed=seed)
        return OneVsRest(classifier=one) if cls and n_classes > 2 else one
    if key == "linear_svc":
        one = LinearSVC(regParam=1.0 / (n * p.get("C", 1.0)))
        return OneVsRest(classifier=one) if n_classes > 2 else one
    if key == "gnb":
        return NaiveBayes(modelType="gaussian")
    if key == "mlp":
        return MultilayerPerceptronClassifier(layers=[n_features, *hidden_layers(**p.get("layers", {})), n_classes], maxIter=p.get("rounds", 100), seed=seed)
    raise ValueError(key)


def dealt(train: DataFrame, cols: Sequence[str], n: int) -> DataFrame:
    """The columns of a tree fit in parts of bounded size: the rows that a task keeps and reads do not grow with the table."""
    parts = -(-n // max(1, PART_CELLS // (16 + len(cols))))
    if parts < 2:
        return train
    return train.select(*dict.fromkeys(cols)).repartition(max(parts, train.sparkSession.sparkContext.defaultParallelism))


def hidden_layers(width: int = 32, depth: int = 2, shape: str = "constant") -> list[int]:
    """Layer widths: constant, pyramid (growing) or funnel (halving)."""
    if shape == "funnel":
        return [max(8, width >> i) for i in range(depth)]
    if shape == "pyramid":
        return [max(8, width >> i) for i in range(depth)][::-1]
    return [width] * depth


def fit(key: str, train: DataFrame, features: Sequence[str], target: str, task: str, seed: int = 42, weight: str | None = None, **params) -> Fitted:
    """Fit one model.  Class targets are numeric codes from 0."""
    features = list(features)
    if key in ("base_mean", "base_majority"):
        return baseline(key, train, features, target, task)
    if key == "knn":
        return Fitted("knn", task, features, lambda df: knn_predict(train, df, features, target, task, **params))
    if key == "lda":
        return discriminant(train, features, target)
    shape = train.agg(F.count(F.lit(1)).alias("n"), F.max(target).alias("top"), F.stddev_pop(target).alias("spread")).first()
    vec = VectorAssembler(inputCols=features, outputCol="_assembled")
    classes = int(shape.top) + 1 if task == "classification" else 0
    estimator = _estimator(key, task, shape.n, float(shape.spread or 1.0), len(features), classes, params, seed)
    if isinstance(estimator, OneVsRest):
        estimator.setFeaturesCol("_assembled").setLabelCol(target).setPredictionCol("pred")
    else:
        estimator.setParams(featuresCol="_assembled", labelCol=target, predictionCol="pred")
        if weight and estimator.hasParam("weightCol"):
            estimator.setParams(weightCol=weight)
    probabilistic = estimator.hasParam("probabilityCol")
    if probabilistic:
        estimator.set(estimator.getParam("probabilityCol"), "_prob")
    rows = dealt(train, [*features, target, *([weight] if weight else [])], shape.n) if key in TREES else train
    model = estimator.fit(vec.transform(rows))
    slopes = getattr(model, "coefficients", None) if classes <= 2 else None
    coefficients = {}
    if slopes is not None:
        coefficients = {"(intercept)": float(model.intercept), **{f: float(b) for f, b in zip(features, slopes)}}

    def predict(df: DataFrame) -> DataFrame:
        out = model.transform(vec.transform(df))
        probs = vector_to_array("_prob") if probabilistic else F.lit(None).cast("array<double>")
        return out.select(*df.columns, F.col("pred").cast("double").alias("pred"), F.get(probs, F.lit(1)).alias("proba"), probs.alias("probs"))

    return Fitted(key, task, features, predict, coefficients)


def baseline(key: str, train: DataFrame, features: Sequence[str], target: str, task: str) -> Fitted:
    """Mean of the target, or the most frequent class (smallest on ties) with its share."""
    if task == "regression":
        value = train.agg(F.avg(target)).first()[0]
        make = lambda df: df.withColumns({"pred": F.lit(value).cast("double"), "proba": F.lit(None).cast("double")})
    else:
        counts = {r[0]: r[1] for r in train.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n")).collect()}
        best = min(counts, key=lambda c: (-counts[c], c))
        share = counts.get(1, 0) / sum(counts.values())
        make = lambda df: df.withColumns({"pred": F.lit(float(best)), "proba": F.lit(float(share))})
    return Fitted(key, task, list(features), make)


def discriminant(train: DataFrame, features: Sequence[str], target: str) -> Fitted:
    """Linear discriminant analysis: class means and a pooled covariance from one scan, linear scores as expressions."""
    features = list(features)
    shift = means_of(train, features)
    per_class = grams(train, features, shift, target)
    total = sum(g[0, 0] for g in per_class.values())
    pooled = sum(g[1:, 1:] - np.outer(g[0, 1:], g[0, 1:]) / g[0, 0] for g in per_class.values()) / total
    inverse = np.linalg.pinv(pooled)
    scores = {}
    for c, g in sorted(per_class.items()):
        m = g[0, 1:] / g[0, 0]
        w = inverse @ m
        scores[c] = (w, float(-0.5 * m @ w + math.log(g[0, 0] / total)))

    def linear(w, b) -> Column:
        out = F.lit(b)
        for f, s, x in zip(features, shift, w):
            out = out + F.lit(float(x)) * (F.col(f) - F.lit(float(s)))
        return out

    classes = list(scores)

    def predict(df: DataFrame) -> DataFrame:
        names = [f"_s{i}" for i in range(len(classes))]
        out = df.withColumns({n: linear(*scores[c]) for n, c in zip(names, classes)})
        top = F.greatest(*names)
        pred = F.lit(float(classes[-1]))
        for n, c in reversed(list(zip(names, classes))):
            pred = F.when(F.col(n) == top, float(c)).otherwise(pred)
        bottom = reduce(lambda a, b: a + b, [F.exp(F.col(n) - top) for n in names])
        one = F.exp(F.col(names[classes.index(1)]) - top) / bottom if 1 in classes else F.lit(None).cast("double")
        return out.withColumn("pred", pred).withColumn("proba", one).drop(*names)

    return Fitted("lda", "classification", features, predict)


# ---- nearest neighbours ------------------------------------------------------------------------

CHUNK_ROWS = 20_000
QUERY_ROWS = 50_000
CELLS = (16, 4096)  # fewest and most cells
CELL_ROWS = 20_000  # training rows of a cell, between those
LEAF_ROWS = 64  # training rows of a leaf within a cell
BLOCK_ROWS = 16  # queries that look at leaves together


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Matrix of distances, added up column by column."""
    total = np.zeros((len(x), len(y)))
    for a, b in zip(x.T, y.T):
        gap = a[:, None] - b[None]
        gap *= gap
        total += gap
    return np.sqrt(total)


def _first(distances: np.ndarray, tid: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least (distance, id), without a sort of the whole row."""
    near = np.flatnonzero(distances <= np.partition(distances, k - 1)[k - 1]) if k < len(distances) else np.arange(len(distances))
    return near[np.lexsort((tid[near], distances[near]))[:k]]


def _reach(low: np.ndarray, high: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest distances between two boxes, added up column by column like those of points, so that rounding keeps their order."""
    near = far = 0.0
    for a, b, c, d in zip(low.T, high.T, lo.T, hi.T):
        near = near + np.maximum(np.maximum(c - b, a - d), 0.0) ** 2
        far = far + np.maximum(d - a, b - c) ** 2
    return np.sqrt(near), np.sqrt(far)


def _blocks(x: np.ndarray, rows: int) -> list[np.ndarray]:
    """Places of the rows in blocks of at most ``rows``, halved along their widest side."""
    out, open_ = [], [np.arange(len(x))]
    while open_:
        at = open_.pop()
        if len(at) <= rows:
            out.append(at)
            continue
        own = x[at]
        order = np.argpartition(own[:, np.argmax(own.max(0) - own.min(0))], len(at) // 2)
        open_ += [at[order[:len(at) // 2]], at[order[len(at) // 2:]]]
    return out


def _nearest(x: np.ndarray, tid: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and of their k nearest rows, the distances, and each query's k-th distance (infinite where there are fewer rows), within ``bound``.

    Of equal rows the k least ids can be neighbours. The others stand in leaves; queries that lie together
    take a bound from the closest leaves, and see the rows of those that reach into it.
    """
    order = np.lexsort((tid, *x.T))
    rows = x[order]
    start = np.maximum.accumulate(np.where(np.r_[True, (rows[1:] != rows[:-1]).any(1)], np.arange(len(rows)), 0))
    order = order[np.arange(len(rows)) - start < k]
    leaves = _blocks(x[order], LEAF_ROWS)
    order, sizes = order[np.concatenate(leaves)], np.array([len(b) for b in leaves])
    x, tid, ends = x[order], tid[order], np.cumsum(sizes)
    lo, hi = (np.stack([f(x[e - n:e], axis=0) for e, n in zip(ends, sizes)]) for f in (np.min, np.max))
    out, last = [], np.full(len(q), np.inf)
    for b in _blocks(q, BLOCK_ROWS) if len(q) else []:
        own = q[b]
        near, far = _reach(own.min(0)[None], own.max(0)[None], lo, hi)
        reach = bound[b].max()
        if len(x) > k:
            closest = np.zeros(len(sizes), dtype=bool)
            by = np.argsort(far)
            closest[by[:int(np.searchsorted(np.cumsum(sizes[by]), k)) + 1]] = True
            reach = min(reach, np.partition(_distances(own, x[np.repeat(closest, sizes)]), k - 1, axis=1)[:, k - 1].max())
        seen = np.flatnonzero(np.repeat(near <= reach * (1 + 1e-12) + 1e-12, sizes))
        d = _distances(own, x[seen])
        if len(seen) > k:
            at = np.argpartition(d, k - 1, axis=1)[:, :k]
            top = np.take_along_axis(d, at, 1).max(1)
            for i in np.flatnonzero((d <= top[:, None]).sum(1) > k):
                at[i] = _first(d[i], tid[seen], k)
        else:
            at = np.tile(np.arange(len(seen)), (len(b), 1))
        if at.shape[1] == k:
            last[b] = np.take_along_axis(d, at, 1).max(1)
        d = np.take_along_axis(d, at, 1)
        kept = d <= bound[b][:, None]
        out.append((np.repeat(b, kept.sum(1)), order[seen[at[kept]]], d[kept]))
    empty = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
    return *(np.concatenate([empty[i], *[o[i] for o in out]]) for i in range(3)), last


def _cells(train: DataFrame, features: Sequence[str], many: int) -> tuple[list[int], list[np.ndarray], np.ndarray]:
    """Cells of about equal numbers of rows, cut along the two widest features: these, their edges, and the cell of each pair of slices.

    Strips of the first feature are cut by running totals of the second one's slices, so related features make no empty cells.
    """
    spread = [s if s and math.isfinite(s) else 0.0 for s in train.agg(*[F.stddev_pop(f) for f in features]).first()]
    wide = sorted(range(len(features)), key=lambda i: -spread[i])[:2]
    strips = many
    if len(wide) == 2 and spread[wide[1]]:
        strips = max(1, min(many, round(math.sqrt(many * spread[wide[0]] / spread[wide[1]]))))
    each = -(-many // strips)
    parts = (strips, 16 * each if each > 1 else 1)
    wide = wide[:1] if each == 1 else wide
    edges = [np.array(sorted(set(quantile_values(train, [features[j]], [i / n for i in range(1, n)])[features[j]])) if n > 1 else [], dtype=float) for j, n in zip(wide, parts)]
    if len(wide) == 1:
        return wide, edges, np.arange(len(edges[0]) + 1)[:, None]

    def count(batches):
        n = np.zeros((len(edges[0]) + 1, len(edges[1]) + 1), dtype=np.int64)
        for batch in batches:
            at = [np.searchsorted(e, batch.column(i).to_numpy(zero_copy_only=False), "right") for i, e in enumerate(edges)]
            n += np.bincount(at[0] * n.shape[1] + at[1], minlength=n.size).reshape(n.shape)
        a, b = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n[a, b])], ["a", "b", "n"])

    total = np.zeros((len(edges[0]) + 1, len(edges[1]) + 1))
    counted = train.select(*[features[j] for j in wide]).mapInArrow(count, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    total[counted.column("a").to_numpy(), counted.column("b").to_numpy()] = counted.column("n").to_numpy()
    before = np.cumsum(total, axis=1) - total
    return wide, edges, np.arange(len(total))[:, None] * each + np.minimum(before * each // np.maximum(total.sum(1, keepdims=True), 1), each - 1).astype(np.int64)


def nearest_neighbours(train: DataFrame, queries: DataFrame, features: Sequence[str], k: int, train_id: str, query_id: str, carry: Sequence[str] = (),
                       pivots: int | None = None, chunk: int = CHUNK_ROWS) -> DataFrame:
    """(query, neighbour, distance, rank, carry...): exact k nearest training rows of every query.

    Training rows lie in ``pivots`` cells that grow in number with them.  A query first meets the rows of its own
    cell; its k-th distance there bounds the others, and only queries whose bound reaches out of their
    cell visit further cells, those whose box it meets.  A dense cell is cut into chunks and spreads over tasks; a chunk
    is searched through leaves and returns at most k rows per query, and pairs are never written out.
    """
    features, carry, types = list(features), list(carry), dict(train.dtypes)
    axes = [f"_x{i}" for i in range(len(features))]
    doubles = [F.col(f).cast("double").alias(x) for f, x in zip(features, axes)]
    # Cells, boxes and both meetings read the rows.
    rows, _path = written(train.select(F.col(train_id).cast("bigint").alias("_t"), *carry, *doubles), "neighbours")
    lost = lambda x: F.col(x).isNull() | F.isnan(x)
    n, holes = rows.agg(F.count(F.lit(1)), F.count_if(reduce(lambda a, b: a | b, [lost(x) for x in axes]))).first()
    if holes:
        raise ValueError(f"{holes} training rows lack a feature")
    wide, edges, table = _cells(rows, axes, pivots or max(CELLS[0], min(CELLS[1], n // CELL_ROWS)))

    @F.pandas_udf("int")
    def cell_of(*v: pd.Series) -> pd.Series:
        at = [np.searchsorted(e, x.to_numpy(), "right") for x, e in zip(v, edges)]
        return pd.Series(table[at[0], at[1] if len(at) > 1 else 0].astype("int32"))

    cell = cell_of(*[axes[j] for j in wide]).alias("cell")
    placed = rows.select("*", cell)
    boxes = sorted(tuple(r) for r in placed.groupBy("cell").agg(F.count(F.lit(1)), *[F.min(x) for x in axes], *[F.max(x) for x in axes]).collect())
    ids, sizes = np.array([b[0] for b in boxes], dtype=np.int64), np.array([b[1] for b in boxes], dtype=np.int64)
    low, high = (np.array([b[s:s + len(axes)] for b in boxes], dtype=float).reshape(len(boxes), len(axes)) for s in (2, 2 + len(axes)))
    need = min(k, n)
    # Where a cell ends: no row of another one lies inside.
    walls = {int(c): [(float(np.r_[-np.inf, e, np.inf][s.min()]), float(np.r_[-np.inf, e, np.inf][s.max() + 1])) for e, s in zip(edges, np.nonzero(table == c))] for c in np.unique(table)}
    walls = np.array([walls.get(c, [(0.0, 0.0)] * len(wide)) for c in range(int(table.max()) + 1)])

    # Each row of queries has its own number, as ids may repeat.
    probes = queries.select(F.col(query_id).cast("bigint").alias("_q"), *doubles).where(~reduce(lambda a, b: a | b, [lost(x) for x in axes]))
    probes, _path = written(probes.select("_q", *axes, cell, F.monotonically_increasing_id().alias("_u")), "queries")

    @F.pandas_udf("array<int>")
    def visit(home: pd.Series, bound: pd.Series, *v: pd.Series) -> pd.Series:
        x, home, bound = np.column_stack([c.to_numpy() for c in v]), home.to_numpy(), bound.to_numpy()
        inside = np.ones(len(x), dtype=bool)
        for j, wall in zip(wide, walls[home].transpose(1, 2, 0)):
            inside &= (x[:, j] - wall[0] > bound) & (wall[1] - x[:, j] > bound)
        out = np.full(len(x), None, dtype=object)
        for i in np.flatnonzero(~inside):
            near, far = _reach(x[i][None], x[i][None], low, high)
            r = bound[i]
            if r == np.inf and len(ids):
                by = np.argsort(far)
                r = far[by][np.searchsorted(np.cumsum(sizes[by]), need)]
            out[i] = ids[(near <= r * (1 + 1e-12) + 1e-12) & (ids != home[i])].astype("int32")
        return pd.Series(out)

    def meet(right: DataFrame) -> DataFrame:
        """(_u, _q, _t, distance, _last, carry...): neighbours of queries in one cell each, with the k-th distance there."""
        # Training rows are repeated only for cells visited by more queries than one task should hold.
        visits = {r.cell: r.n for r in right.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        plan = [(int(c), int(-(-m // chunk)), -(-visits[c] // QUERY_ROWS)) for c, m in zip(ids, sizes) if c in visits]
        plan = F.broadcast(train.sparkSession.createDataFrame(plan, "cell int, many int, parts int"))  # a row for each cell
        left = placed.join(plan, "cell").withColumn("chunk", F.pmod(F.xxhash64("_t"), "many").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        right = right.join(plan, "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("many") - 1))).withColumn("part", F.pmod(F.xxhash64("_u"), "parts").cast("int"))
        keys = ["cell", "chunk", "part"]
        left, right = left.select("_t", *carry, *axes, *keys), right.select("_u", "_q", "_bound", *axes, *keys)
        schema = ", ".join(["_u bigint, _q bigint, _t bigint, distance double, _last double", *[f"`{c}` {types[c]}" for c in carry]])

        def closest(ts: pa.Table, qs: pa.Table) -> pa.Table:
            at, of, far, last = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0)
            if len(ts) and len(qs):
                x, q = (np.column_stack([t.column(a).to_numpy() for a in axes]) for t in (ts, qs))
                at, of, far, last = _nearest(x, ts.column("_t").to_numpy(), q, qs.column("_bound").to_numpy(), k)
            columns = [qs.column("_u").take(pa.array(at)), qs.column("_q").take(pa.array(at)), ts.column("_t").take(pa.array(of)), pa.array(far), pa.array(last[at])]
            return pa.Table.from_arrays([*columns, *[ts.column(c).take(pa.array(of)) for c in carry]], ["_u", "_q", "_t", "distance", "_last", *carry])

        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(closest, schema)

    own, _path = written(meet(probes.withColumn("_bound", F.lit(float("inf")))), "own_cells")
    reached = probes.join(own.groupBy("_u").agg(F.min("_last").alias("_bound")), "_u", "left").withColumn("_bound", F.coalesce("_bound", F.lit(float("inf"))))
    others, _path = written(reached.select("_u", "_q", "_bound", *axes, F.explode(visit("cell", "_bound", *axes)).alias("cell")), "visits")
    found = own.unionByName(meet(others))
    # At most k rows per query and visited chunk reach this window.
    rank = F.row_number().over(Window.partitionBy("_q").orderBy("distance", "_t"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("_q").alias("query"), F.col("_t").alias("neighbour"), "distance", "rank", *carry)


def knn_predict(train: DataFrame, df: DataFrame, features: Sequence[str], target: str, task: str, k: int = 5, weights: str = "uniform", id_col: str = "id") -> DataFrame:
    """Append pred (and proba) from the k nearest training rows, equally or by inverse distance."""
    near = nearest_neighbours(train.withColumn("_y", F.col(target).cast("double")), df, features, k, id_col, id_col, ["_y"])
    exact = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy("query"))
    w = F.lit(1.0) if weights == "uniform" else F.when(exact == 1, (F.col("distance") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("distance")))
    voted = near.withColumn("w", w)
    if task == "regression":
        scores = voted.groupBy("query").agg((F.sum(F.col("w") * F.col("_y")) / F.sum("w")).alias("pred"), F.lit(None).cast("double").alias("proba"))
    else:
        per = voted.groupBy("query", "_y").agg(F.sum("w").alias("w"))
        scores = per.groupBy("query").agg(F.max_by("_y", F.struct(F.col("w"), -F.col("_y"))).alias("pred"),
                                          (F.sum(F.when(F.col("_y") == 1, F.col("w")).otherwise(0.0)) / F.sum("w")).alias("proba"))
    return df.join(scores, F.col(id_col) == F.col("query"), "left").drop("query")


# ---- running many ------------------------------------------------------------------------------

def coefficient_table(models: Sequence[Fitted], spark) -> DataFrame:
    rows = [(m.key, f, b) for m in models for f, b in m.coefficients.items()]
    return spark.createDataFrame(rows, "model string, feature string, coefficient double")


def score_rows(predictions: DataFrame, task: str, by: Sequence[str]) -> DataFrame:
    """Metrics per group: regression or classification, with AUC when probabilities are there."""
    if task == "regression":
        return regression_metrics(predictions, by=by)
    base = class_metrics(predictions.withColumn("y", F.col("y").cast("int")).withColumn("pred", F.col("pred").cast("int")), by=by)
    # One class against the rest: every class where there are more than two, else class 1 alone.
    each = F.transform("probs", lambda p, i: F.struct(i.cast("int").alias("class"), (F.col("y").cast("int") == i).cast("int").alias("hit"), p.alias("s")))
    alone = F.array(F.struct(F.lit(1).alias("class"), F.col("y").cast("int").alias("hit"), F.col("proba").alias("s")))
    long = predictions.select(*by, F.explode(F.when(F.size("probs") > 2, each).otherwise(alone)).alias("_c")).select(*by, "_c.*")
    ranked = ranking_metrics(long, "hit", "s", [*by, "class"]).groupBy(*by).agg(F.avg("auc").alias("auc"), F.avg("pr_auc").alias("pr_auc"))
    return join_groups(base, ranked, by, "left")


def probe(df: DataFrame, features: Sequence[str], target: str, task: str, id_col: str, seed: int = 42) -> DataFrame:
    """(model, metrics...): null model, linear model and a small forest on an 80/20 split."""
    split = df.withColumn("_t", mix(row_key(df, id_col), seed) % 5 > 0).persist()
    train, test = split.where("_t"), split.where("not _t")
    keys = [("base_mean", {}), ("ols", {})] if task == "regression" else [("base_majority", {}), ("logit", {})]
    keys.append(("rf", {"trees": 10, "depth": 3}))
    try:
        fitted = in_parallel([lambda k=k, p=p: fit(k, train, features, target, task, seed, **p) for k, p in keys])
        predictions = written(_stack(fitted, test, target, [id_col]), "predictions")[0]
    finally:
        split.unpersist()
    return score_rows(predictions, task, ["model"])


def with_probs(scored: DataFrame) -> DataFrame:
    """Class probabilities as ``probs``; null for models that give none."""
    return scored if "probs" in scored.columns else scored.withColumn("probs", F.lit(None).cast("array<double>"))


def _stack(models: Sequence[Fitted], df: DataFrame, target: str, keep: Sequence[str]) -> DataFrame:
    parts = [with_probs(m.predict(df)).select(F.lit(m.key).alias("model"), *keep, F.col(target).cast("double").alias("y"), "pred", "proba", "probs") for m in models]
    return reduce(DataFrame.unionByName, parts)


def cross_validate(key: str, df: DataFrame, features: Sequence[str], target: str, task: str, fold_col: str = "fold", method: str = "none", seed: int = 42, **params) -> DataFrame:
    """(model, fold, score): RMSE or accuracy per held-out fold; the target transform is learned inside each fold."""
    rows = df.persist()
    ids = sorted(r[0] for r in rows.select(fold_col).distinct().collect())

    def run(i):
        train, test = rows.where(F.col(fold_col) != i), rows.where(F.col(fold_col) == i)
        change = fit_target_transform(train, target, method) if task == "regression" else TargetTransform("none")
        model = fit(key, train.withColumn("_y", change.forward(F.col(target).cast("double"))) if task == "regression" else train.withColumn("_y", F.col(target)), features, "_y", task, seed, **params)
        return model.predict(test).select(F.col(fold_col).alias("fold"), F.col(target).cast("double").alias("y"), change.inverse(F.col("pred")).alias("pred"))

    try:
        parts = in_parallel([lambda i=i: run(i) for i in ids])
        stacked = written(reduce(DataFrame.unionByName, parts), "fold_predictions")[0] if parts else None
    finally:
        rows.unpersist()
    if stacked is None:
        return df.sparkSession.createDataFrame([], "model string, fold int, score double")
    gap = F.col("y") - F.col("pred")
    score = F.sqrt(F.avg(gap * gap)) if task == "regression" else F.avg((gap == 0).cast("double"))
    return stacked.groupBy("fold").agg(score.alias("score")).select(F.lit(key).alias("model"), "fold", "score")


def cv_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model").agg(F.count("score").alias("folds"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))


def draw(space: Mapping[str, tuple], rng: Random) -> dict:
    out = {}
    for name, (kind, low, high) in space.items():
        out[name] = rng.randint(low, high) if kind == "int" else math.exp(rng.uniform(math.log(low), math.log(high))) if kind == "log" else rng.uniform(low, high)
    return out


def search(key: str, train: DataFrame, validation: DataFrame, features: Sequence[str], target: str, task: str, trials: int = 30, seed: int = 42) -> DataFrame:
    """(trial, params, score, best): random draws from the model's ranges, scored on validation rows."""
    rng = Random(seed)
    draws = [draw(SEARCH_SPACE[key], rng) for _ in range(trials)]
    train, validation = train.persist(), validation.persist()

    def run(i):
        gap = F.col(target).cast("double") - F.col("pred")
        error = F.sqrt(F.avg(gap * gap)) if task == "regression" else F.avg((gap != 0).cast("double"))
        return i, str(sorted(draws[i].items())), float(fit(key, train, features, target, task, seed, **draws[i]).predict(validation).agg(error).first()[0])

    results = in_parallel([lambda i=i: run(i) for i in range(trials)])
    train.unpersist()
    validation.unpersist()
    best = min(results, key=lambda x: x[2])[0]
    return train.sparkSession.createDataFrame([(*x, x[0] == best) for x in results], "trial int, params string, score double, best boolean")


def fit_all(df: DataFrame, recipe: Recipe, target: str, task: str, id_col: str, keys: Sequence[str], params: Mapping[str, Mapping] | None = None,
            method: str = "none", seed: int = 42) -> tuple[DataFrame, list[Fitted]]:
    """Predictions (model, id, split, y, pred, proba, probs) of many models on a table with a ``split`` column.

    Preparation and target transform are learned on training rows only; models that need scaling get it.
    The table is cached while the fits and the scoring read it, and released when the predictions, a narrow table, are written.
    """
    held = not df.is_cached
    if held:
        df.persist()
    train = df.where("split = 'train'")
    change = fit_target_transform(train, target, method) if task == "regression" else TargetTransform("none")

    recipes = [recipe_for_model(recipe, key) for key in keys]
    distinct = [r for i, r in enumerate(recipes) if r not in recipes[:i]]

    def run(key, own):
        prep = preps[distinct.index(own)]
        if any(op == "target" for op, _ in prep.steps):
            ready = prep.apply_to_training(train, id_col).unionByName(prep.apply(df.where(F.col("split").isNull() | (F.col("split") != "train"))))
        else:
            ready = prep.apply(df)
        ready = ready.withColumn("_y", change.forward(F.col(target).cast("double")) if task == "regression" else F.col(target))
        model = fit(key, ready.where("split = 'train'"), prep.names, "_y", task, seed, **(params or {}).get(key, {}), **({"id_col": id_col} if key == "knn" else {}))
        rows = with_probs(model.predict(ready)).select(F.lit(key).alias("model"), F.col(id_col).alias("id"), "split", F.col(target).cast("double").alias("y"),
                                           change.inverse(F.col("pred")).alias("pred"), "proba", "probs")
        return rows, model

    try:
        # Models with equal recipes share what was learned for one of them.
        preps = in_parallel([lambda r=r: fit_prep(train, r, target) for r in distinct])
        results = in_parallel([lambda k=k, r=r: run(k, r) for k, r in zip(keys, recipes)])
        predictions = written(reduce(DataFrame.unionByName, [r[0] for r in results]), "predictions")[0]
    finally:
        if held:
            df.unpersist()
    return predictions, [r[1] for r in results]


def external(model: Fitted, prep, table: DataFrame, target: str, id_col: str, replicates: int = 500, task: str = "regression") -> DataFrame:
    """Bootstrap intervals of a model on another table, after checking that its columns are there; with AUC where a 0/1 class model has a probability."""
    from .evaluate import bootstrap_intervals

    wanted = [*prep.recipe.numeric, *prep.recipe.categorical, *prep.recipe.passthrough, target]
    lost = [c for c in wanted if c not in table.columns]
    if lost:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    scored = model.predict(prep.apply(table))
    two = task != "regression" and "proba" in scored.columns
    scored = written(scored.select(id_col, F.col(target).cast("double").alias("y"), F.col("pred").cast("double").alias("pred"), *(["proba"] if two else [])), "external")[0]
    has = two and scored.where("proba is not null and y not in (0, 1)").isEmpty() and not scored.where("proba is not null").isEmpty()
    return bootstrap_intervals(scored, id_col, replicates=replicates, task=task, score="proba" if has else None)


