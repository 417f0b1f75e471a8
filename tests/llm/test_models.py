import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabstudy.llm import QUERIES, classifier, langid

SF = "/root/testdata/sf0.01"


def auc(y, s):
    order = np.argsort(s, kind="stable")
    _, inverse, counts = np.unique(s, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    n1, n0 = y.sum(), (1 - y).sum()
    return (ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_language_accuracy_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = QUERIES["op9_language_id"](spark, SF).collect()
    assert len(out) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_language_edges(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 30)]
    rows += [(100, None, "en"), (101, "12 !?", "de"), (102, "", None), (None, "the dog", None), (103, "the " * 400_000, None), (0, rows[0][1], "en")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    out = {}
    for r in langid.identify(df).collect():
        out.setdefault(r.doc_id, []).append(r.lang_pred)
    assert out[100] == out[101] == out[102] == ["und"] and out[None] == out[103] == ["en"] and len(out[0]) == 2
    assert langid.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_more_languages_than_rows_of_one(spark):
    """Every language is learned, however many there are and however often one text makes up all of it."""
    word = lambda k: "".join(chr(97 + (k * 7 + j * (k % 11 + 3)) % 26) for j in range(9))
    rows = [(i, f"{word(k)} {word(k + 1000)} {word(k)}", f"l{k:03}") for i, k in enumerate([k for k in range(300) for _ in range(2)])]
    rows += [(10_000 + i, "the very same text of one language", "same") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert len(model.languages) == 301 and model.predict("the very same text of one language")[0] == "same"
    assert np.mean([model.predict(t)[0] == x for _, t, x in rows[:600]]) > 0.9
    drawn = langid.drawn_texts(df.select("text", "lang"), 5)
    assert drawn.where("lang = 'same'").count() == 1 and drawn.count() == 301


def test_weights_against_a_plain_follow_the_leader():
    """The same updates one number at a time, on dense rows."""
    rng = np.random.default_rng(2)
    idf = rng.uniform(1, 3, 32)
    rows = [(int(rng.integers(0, 3)), np.sort(rng.choice(32, 6, replace=False)), rng.integers(1, 5, 6)) for _ in range(40)]
    weights, bias = langid.fit_ftrl(rows, 3, idf, epochs=2)
    z, n = np.zeros((33, 3)), np.zeros((33, 3))
    solve = lambda: np.array([[0.0 if abs(z[f, k]) <= langid.L1 else -(z[f, k] - np.sign(z[f, k]) * langid.L1) / ((langid.BETA + n[f, k] ** 0.5) / langid.ALPHA + langid.L2) for k in range(3)] for f in range(33)])
    for epoch in range(2):
        for r in np.random.default_rng(epoch).permutation(40):
            label, at, counts = rows[r]
            x = np.zeros(33)
            x[0] = 0.1
            tfidf = (1 + np.log(counts)) * idf[at]
            x[at + 1] = tfidf / np.linalg.norm(tfidf)
            w = solve()
            p = np.exp(x @ w) / np.exp(x @ w).sum()
            for f in np.flatnonzero(x):
                for k in range(3):
                    g = x[f] * (p[k] - (k == label))
                    z[f, k] += g - ((n[f, k] + g * g) ** 0.5 - n[f, k] ** 0.5) / langid.ALPHA * w[f, k]
                    n[f, k] += g * g
    assert np.allclose(weights, solve()[1:]) and np.allclose(bias, 0.1 * solve()[0])


def test_grams_across_chunks(monkeypatch):
    text = "abcdefghij" * 5
    want = langid.grams(text)
    monkeypatch.setattr(langid, "CHUNK", 7)
    assert all((a == b).all() for a, b in zip(langid.grams(text), want))
    assert langid.grams(text)[1].sum() == 50 + 49 + 48


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 500)
    logits = 8 * rng.normal(size=(500, 3)) + 8 * np.eye(3)[y]
    loss = lambda t: -np.log(langid.softmax(logits / t)[np.arange(500), y]).mean()
    best = langid.fit_temperature(logits, y)
    assert loss(best) < loss(1.0) and loss(best) <= min(loss(best * 0.9), loss(best * 1.1))


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = QUERIES["op6_quality_classifier"](spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    held = [r for r in out if r.held_out and r.doc_id in labels]
    assert auc(np.array([labels[r.doc_id] for r in held]), np.array([r.score for r in held])) > 0.8


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (None, "x", "a"), (3, "w " * 300_000, "a"), (3, "again", "a")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in classifier.quality_scores(docs, none).collect()] == [0.5] * 5
    few = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in classifier.quality_scores(docs, few).collect())
    assert classifier.quality_scores(docs.limit(0), few).count() == 0
    assert classifier.keep_good(docs, none).count() == 5


@pytest.mark.parametrize("n", [1, 5, 40])
def test_isotonic_against_brute_force(n):
    rng = np.random.default_rng(n)
    total, positive = rng.integers(1, 6, n).astype(float), np.zeros(n)
    positive[:] = [rng.integers(0, t + 1) for t in total]
    got = classifier.isotonic(total, positive)
    rate = lambda a, b: positive[a:b].sum() / total[a:b].sum()
    want = [max(min(rate(a, b) for b in range(i + 1, n + 1)) for a in range(i + 1)) for i in range(n)]
    assert np.allclose(got, want)


def test_normal_equations_are_those_of_one_matrix(spark):
    rng = np.random.default_rng(1)
    stats, y = rng.normal(size=(60, classifier.N_STATISTICS)), rng.integers(0, 2, 60)
    model = classifier.Model(np.zeros(classifier.N_STATISTICS), np.ones(classifier.N_STATISTICS), np.zeros(classifier.FEATURES + 1))
    df = spark.createDataFrame([(s.tolist(), int(b)) for s, b in zip(stats, y)], "stats array<double>, label int").repartition(5)
    z = np.hstack([model.features(stats), y[:, None]])
    assert np.allclose(classifier._normal_equations(df, model), z.T @ z)
