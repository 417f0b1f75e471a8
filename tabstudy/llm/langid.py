"""Language identification: sparse multinomial logistic regression on TF-IDF weighted character n-grams.

Document frequencies are counted over all training rows. The weights are fitted on a bounded sample of them by
follow-the-regularised-leader with an elastic-net penalty, then a temperature is fitted on a part of the sample that the weights have not seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_remainder, map_batches, slices

BITS = 15
CELLS = 1 << 24  # weights of all languages; where these are very many, n-grams share fewer buckets
SAMPLE = 600  # distinct texts of each language that the weights and the temperature are fitted on
TOTAL = 1 << 14  # distinct texts of all languages together, but two of each at least
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.1
CALIBRATION = 5  # each so-manieth row of the sample is for the temperature
CHUNK = 1 << 20
# Odd multipliers of the n-gram hash.
MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917], dtype=np.uint32)


def grams(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's 1-, 2- and 3-character grams in lower case, and how often each occurs."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    counts = np.zeros(1 << bits, dtype=np.int64)
    for at in range(0, len(codes), CHUNK):
        part = codes[at:at + CHUNK + 2]
        own = min(CHUNK, len(codes) - at)
        h = np.zeros(len(part), dtype=np.uint32)
        for n in range(min(3, len(part))):
            # a gram that starts in this chunk may end in the next
            h = h[:len(part) - n] * np.uint32(31) + part[n:] * MULTIPLIERS[n] + np.uint32(n)
            counts += np.bincount((h[:own] * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits), minlength=1 << bits)
    buckets = np.flatnonzero(counts)
    return buckets, counts[buckets]


def has_letter(text: str) -> bool:
    return text.upper() != text.lower() or any(c.isalpha() for c in text)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        buckets, counts = grams(text, len(self.idf).bit_length() - 1)
        return buckets, weigh(buckets, counts, self.idf)

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not has_letter(text):
            return "und", 0.0
        buckets, x = self.vector(text)
        p = softmax((x @ self.weights[buckets] + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def weigh(buckets: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of unit length; terms count by the logarithm of their number."""
    x = (1 + np.log(counts)) * idf[buckets]
    return (x / max(np.linalg.norm(x), 1e-12)).astype(np.float64)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], n_classes: int, idf: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias. rows: (class, buckets, counts); each epoch takes them in its own fixed order."""
    z = np.zeros((1 + len(idf), n_classes))
    n = np.zeros_like(z)

    def solve(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    for epoch in range(epochs):
        for r in np.random.default_rng(epoch).permutation(len(rows)):
            label, buckets, counts = rows[r]
            at, x = np.append(buckets + 1, 0), np.append(weigh(buckets, counts, idf), 0.1)  # place 0 is the bias
            w = solve(z[at], n[at])
            error = softmax(x @ w)
            error[label] -= 1
            g = x[:, None] * error
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    w = solve(z, n)
    return w[1:], 0.1 * w[0]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by ternary search over its logarithm."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean()
    low, high = -4.0, 2.0
    for _ in range(60):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(docs: DataFrame, text_col: str = "text", bits: int = BITS) -> np.ndarray:
    """How many texts hold each bucket; every task sends its sums once."""

    def run(batches):
        seen = np.zeros(1 << bits, dtype=np.int64)
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                seen[grams(text or "", bits)[0]] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["bucket", "n"])

    out = np.zeros(1 << bits)
    for r in docs.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.bucket] = r.n
    return out


def drawn_texts(known: DataFrame, each: int) -> DataFrame:
    """Rows (text, lang): of each language the ``each`` distinct texts of least hash, one row for each, however often it occurs."""
    hashed = known.withColumn("h", F.xxhash64("text", F.lit("sample")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = hashed.select("lang", "h").distinct().withColumn("place", place).where(F.col("place") <= each).drop("place")  # at most TOTAL rows, or two a language
    return hashed.join(F.broadcast(chosen), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.min("text").alias("text")).select("text", "lang")


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, total: int = TOTAL) -> Model:
    """Fit on the rows of ``docs`` that have a language, all languages.

    Documented bound: the weights are fitted on ``sample`` distinct texts of each language, fewer where all together would pass
    ``total`` (two at least). Document frequencies are those of all rows.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    bits = min(BITS, max(8, (CELLS // max(1, len(languages))).bit_length() - 1))
    if not languages:
        return Model([], np.zeros(1 << bits), np.zeros((1 << bits, 0)), np.zeros(0))
    idf = np.log((1 + sum(counts.values())) / (1 + document_frequencies(known, bits=bits))) + 1
    number = {v: k for k, v in enumerate(languages)}

    def featurise(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [grams(t, bits) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array([b.astype(np.int32) for b, _ in found], pa.list_(pa.int32())), pa.array([c.astype(np.int32) for _, c in found], pa.list_(pa.int32()))], ["lang", "buckets", "counts"])

    def train(batches):
        rows = []
        for batch in batches:
            rows += [(number[lang], b.values.to_numpy(), c.values.to_numpy()) for lang, b, c in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2))]
        if not rows:
            return
        rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))  # not by arrival
        # the temperature is that of weights which have not seen the rows it is fitted on; then all rows are fitted
        aside = rows[::CALIBRATION]
        weights, bias = fit_ftrl([r for i, r in enumerate(rows) if i % CALIBRATION], len(languages), idf)
        logits = np.array([weigh(b, c, idf) @ weights[b] + bias for _, b, c in aside]).reshape(len(aside), len(languages))
        temperature = fit_temperature(logits, np.array([r[0] for r in aside], dtype=np.int64))
        weights, bias = fit_ftrl(rows, len(languages), idf)
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f8").tobytes()]), pa.array([bias.astype("<f8").tobytes()]), pa.array([temperature])], ["weights", "bias", "temperature"])

    each = max(2, min(sample, total // len(languages)))
    sparse = map_batches(drawn_texts(known, each), featurise, "lang string, buckets array<int>, counts array<int>")
    fitted = sparse.repartition(1).mapInArrow(train, "weights binary, bias binary, temperature double").first()
    weights = np.frombuffer(fitted.weights, dtype="<f8").reshape(1 << bits, len(languages))
    return Model(languages, idf, weights, np.frombuffer(fitted.bias, dtype="<f8"), fitted.temperature)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """Rows (doc_id, lang_pred, score), one for each row of ``docs``. A null text, and one without letters, is ``und`` with score 0."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [sent.value.predict(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score): fitted on the rows of the other folds, applied to all.

    Fold: crc32 of the id as text; a null id counts as the empty text. Texts are read whole. Repeated rows stay repeated; columns
    other than doc_id, text and lang are ignored; without training rows every text is ``und``; an empty table gives an empty one.
    """
    fold = crc_remainder(F.col("doc_id"), folds)
    model = fit(docs.where(fold != held_out))
    return predict(docs, model).select("doc_id", (crc_remainder(F.col("doc_id"), folds) == held_out).alias("held_out"), "lang_pred", "score")
