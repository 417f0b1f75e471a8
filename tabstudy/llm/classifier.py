"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

The features approximate a Gaussian kernel over standardised statistics of the whole text. Each task adds up its part of the normal
equations; the sums are solved on the driver, whose state is one matrix of the number of features squared. Calibration pools
neighbouring scores of rows that the ridge has not seen.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, lean, map_batches, materialise, raw_texts

FEATURES = 256  # random Fourier features
WIDTH = 2.0  # of the kernel, in standard deviations of a statistic
RIDGE = 1e-3
CELLS = 4_000  # score cells that calibration sums over
CUT = 0.3
SYMBOLS = np.frombuffer(b"#*$%&|<>@^_=+~{}[]\\/", dtype=np.uint8)


def statistics(text: bytes) -> list[float]:
    """Statistics of a whole text: size, shares of kinds of characters, repetition of words and lines."""
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    words, n = text.split(), max(1, len(text))
    w = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), sum(map(len, words)) / w, float(counts[65:91].sum()) / n, float(counts[97:123].sum()) / n, float(counts[48:58].sum()) / n, float(counts[SYMBOLS].sum()) / w,
        float(counts[33]) / w, float(counts[46] + counts[44]) / w, float(counts[128:].sum()) / n, len(set(words)) / w, len(set(zip(words, words[1:]))) / max(1, len(words) - 1), len(set(lines)) / max(1, len(lines)), len(lines) / w,
    ]


N_STATISTICS = len(statistics(b""))


def statistics_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat = np.array([statistics(t) for t in raw_texts(batch.column(1))], dtype=np.float64).reshape(-1, N_STATISTICS)
        offsets = pa.array(np.arange(0, flat.size + 1, N_STATISTICS, dtype=np.int32))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))], ["doc_id", "stats"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, stats array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: np.ndarray = field(default_factory=lambda: np.zeros(1))  # raw scores, ascending
    values: np.ndarray = field(default_factory=lambda: np.zeros(1))  # their calibrated scores

    def features(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(7)
        directions, phases = rng.normal(0, 1 / WIDTH, (len(self.mean), FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
        x = np.clip((stats - self.mean) / self.scale, -4, 4)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(x @ directions + phases), np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.steps, self.values), 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATISTICS)


def _normal_equations(rows: DataFrame, model: Model) -> np.ndarray:
    """Sums of z z' with z = (features, 1, label): each task sends one matrix, added up by its rows."""
    size = FEATURES + 2

    def add(batches):
        total = np.zeros((size, size))
        for batch in batches:
            z = np.hstack([model.features(_matrix(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False)[:, None]])
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(list(total))], ["i", "sums"])

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, s in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[i] = sums.get(i, 0) + s.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["i", "sums"])

    out = np.zeros((size, size))
    for r in rows.select("stats", F.col("label").cast("double")).mapInArrow(lean(add), "i long, sums array<double>").repartition("i").mapInArrow(lean(merge), "i long, sums array<double>").collect():
        out[r.i] = r.sums
    return out


def isotonic(total: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing rates nearest to those of the cells."""
    blocks: list[list[float]] = []
    for n, p in zip(total.tolist(), positive.tolist()):
        blocks.append([n, p, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.concatenate([np.full(int(k), p / n) for n, p, k in blocks]) if blocks else np.zeros(0)


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """stats: (doc_id, stats); labels: (doc_id, label 0..1), one row for each id. Ridge on three folds of the ids in four, calibration on the fourth.

    Without labelled rows every score is 0.5.
    """
    known = materialise(stats.join(labels, "doc_id").where("label is not null").select("stats", "label", crc_remainder(F.col("doc_id"), 20).alias("part")), "labelled")
    places = range(N_STATISTICS)
    sums = known.agg(F.count("*").alias("n"), *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in places], *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in places]).first()
    model = Model(np.zeros(N_STATISTICS), np.ones(N_STATISTICS), np.zeros(FEATURES + 1), np.zeros(1), np.full(1, 0.5))
    if not sums.n:
        return model
    model.mean = np.array([sums[f"m{i}"] for i in places])
    model.scale = np.array([max(sums[f"s{i}"], 1e-6) for i in places])
    total = _normal_equations(known.where("part % 4 <> 3"), model)
    if not total.any():
        total = _normal_equations(known, model)
    gram = total[:-1, :-1] + RIDGE * max(1.0, total[-2, -2]) * np.diag([*[1.0] * FEATURES, 0.0]) + 1e-9 * np.eye(FEATURES + 1)
    model.weights = np.linalg.solve(gram, total[:-1, -1])

    def cells(batch: pa.RecordBatch) -> pa.RecordBatch:
        cell = np.clip(np.floor((model.raw(_matrix(batch.column(0))) + 0.5) * CELLS / 2), 0, CELLS - 1).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(cell), batch.column(1)], ["cell", "label"])

    aside = map_batches(known.where("part % 4 = 3").select("stats", F.col("label").cast("double")), cells, "cell long, label double")
    table = aside.groupBy("cell").agg(F.count("*").alias("n"), F.sum("label").alias("p")).orderBy("cell").collect()  # at most CELLS rows
    if table:
        # one positive and one negative, spread over the cells, keep the ends away from 0 and 1
        n, p = np.array([float(r.n) for r in table]), np.array([float(r.p) for r in table])
        model.steps = (np.array([r.cell for r in table]) + 0.5) * 2 / CELLS - 0.5
        model.values = isotonic(n + 2 * n / n.sum(), p + n / n.sum())
    else:
        model.steps, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    sent = stats.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(_matrix(batch.column(1))))], ["doc_id", "score"])

    return map_batches(stats, run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 5, held_out: int = 0) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of ``docs``; fitted on labelled rows outside the held-out fold.

    Fold: crc32 of the id as text; a null id counts as the empty text. Null and empty texts are scored by their statistics. An id
    with several labels gets their mean; null labels are ignored, and without any the score is 0.5. Only doc_id and text are read
    of ``docs``; repeated rows stay repeated; an empty table gives an empty one.
    """
    stats = materialise(statistics_table(docs), "statistics")
    fold = lambda: crc_remainder(F.col("doc_id"), folds)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label")).where((fold() != held_out) & F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    model = fit(stats, known.groupBy("doc_id").agg(F.avg("label").alias("label")))
    return score(stats, model).select("doc_id", (fold() == held_out).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` whose score reaches the cut, all columns kept. Rows that share an id go or stay together, by their best score."""
    good = quality_scores(docs, labels, **options).where("predicted = 1").select(F.col("doc_id").alias("_good_id")).distinct()
    return docs.join(good, F.col("doc_id").cast("long").eqNullSafe(F.col("_good_id")), "left_semi")
