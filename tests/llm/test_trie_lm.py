import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from tabstudy.llm import QUERIES, elias_fano, trie_lm
from tabstudy.llm.elias_fano import EliasFano, Trie

END = b"\n"


def slow(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) with whole counts in memory and no quantisation."""
    texts = [(i, zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0, [*(t or "").encode().lower().split(), END]) for i, t in rows]
    c, c2, c3 = Counter(), Counter(), Counter()
    for _, held, w in texts:
        if not held:
            p = [END, *w]
            c.update(w)
            c2.update(zip(p, p[1:]))
            c3.update(zip(p, p[1:], p[2:]))
    n, v = sum(c.values()), len(c)
    for i, held, w in texts:
        p, base, score = [END, *w], 0.0, 0.0
        for k in range(1, len(p)):
            one = (c[p[k]] + 0.1) / (n + 0.1 * (v + 1))
            q = (c2[p[k - 1], p[k]] + trie_lm.PRIOR2 * one) / (c[p[k - 1]] + trie_lm.PRIOR2)
            if not c[p[k - 1]]:
                q = one
            if k > 1 and c2[p[k - 2], p[k - 1]] >= 2:
                q = (c3[p[k - 2], p[k - 1], p[k]] + trie_lm.PRIOR3 * q) / (c2[p[k - 2], p[k - 1]] + trie_lm.PRIOR3)
            base, score = base + np.log10(one), score + np.log10(q)
        yield i, held, len(w), sum(c[x] > 0 for x in w), n, base, score


def compare(out, rows):
    key = lambda r: (repr(r[0]), r[2], round(r[5], 5))
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out), key=key)
    want = sorted(slow(rows), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) <= 1e-9 * max(1, abs(b[5]))
        assert abs(a[6] - b[6]) <= 3e-4 * a[2]  # one and a half steps of quantisation a token


def test_whole_table(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    out = QUERIES["op11_trie_lm"](spark, folder).collect()
    compare(out, rows)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held) > sum(r.base_score for r in held)


def test_small_blocks_and_parts(docs, monkeypatch):
    monkeypatch.setattr(trie_lm, "BLOCK", 300)
    monkeypatch.setattr(trie_lm, "n_parts", lambda tokens: 7)
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice("a B c d e f g".split()) for _ in range(rnd.randint(0, 60)))) for i in range(150)]
    rows += [(200, None), (None, "a b"), (201, ""), (3, rows[3][1]), (202, "never seen words"), (203, "x " * 5000), (10, "a Ä b\x1cc")]
    compare(trie_lm.text_scores(docs(rows, ["ids", "train", "block"]).repartition(5)).collect(), rows)


def test_edges(docs):
    assert trie_lm.text_scores(docs([])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    out = trie_lm.text_scores(docs([(held, "only held out")])).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out] == [(True, 4, 0, 0, 0.0, 0.0)]


def test_probabilities_of_a_context_sum_to_one(docs):
    """All next words of one context, each as the last word of a text of its own fold."""
    rnd = random.Random(5)
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10]
    held = [i for i in range(400, 4000) if not zlib.crc32(str(i).encode()) % 10]
    rows = [(i, " ".join(rnd.choice("abcd") for _ in range(6))) for i in train]
    ends = ["a b " + w for w in "abcd"] + ["a b new", "a b"]
    rows += list(zip(held, [*ends, *[f"{e} a" for e in ends[:0]]]))
    score = {r.doc_id: r.score for r in trie_lm.text_scores(docs(rows)).collect()}
    # p(w | a b) = p(a b w ...) / p(a b ...): compare by the rule itself
    want = {i: s for i, *_, s in slow(rows)}
    assert all(abs(score[i] - want[i]) < 2e-3 for i in held[:len(ends)])


@pytest.mark.parametrize("n, top", [(0, 1), (1, 1), (5, 3), (1000, 50), (3000, 10**7), (4, 10**12)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, top, n))
    head, low, high = EliasFano.encode(v)
    levels = EliasFano(n, int(head[1]), low, high)
    assert (levels.access(np.arange(n)) == v).all()
    q = np.concatenate([rng.integers(0, 2 * top, 500), v])
    at = levels.find(q)
    known = set(v.tolist())
    assert all((a >= 0) == (x in known) and (a < 0 or v[a] == x) for a, x in zip(at.tolist(), q.tolist()))


def test_trie_finds_its_pairs_alone():
    rng = np.random.default_rng(1)
    k = np.unique(rng.integers(0, 300, 20_000) * 10_000 + rng.integers(0, 800, 20_000))
    c, w, value = k // 10_000 * 7, k % 10_000 * 3, rng.integers(1, 60_000, len(k))
    levels = Trie.build(c, w, value)
    trie = Trie.mapped(levels)
    assert (trie.find(c, w) == value).all() and len(levels) < 6 * len(k)
    table = dict(zip(zip(c.tolist(), w.tolist()), value.tolist()))
    q = rng.integers(0, 2200, 5000), rng.integers(0, 2500, 5000)
    assert trie.find(*q).tolist() == [table.get(p, 0) for p in zip(q[0].tolist(), q[1].tolist())]
    assert Trie.mapped(Trie.build(*[np.zeros(0, dtype=np.int64)] * 3)).find(np.array([1]), np.array([2])).tolist() == [0]


def test_many_places_at_once_take_little_memory():
    rng = np.random.default_rng(2)
    v = np.sort(rng.integers(0, 10**7, 200_000))
    head, low, high = elias_fano.EliasFano.encode(v)
    levels = EliasFano(len(v), int(head[1]), low, high)
    few = np.concatenate([levels.access(np.arange(k, min(k + 1000, len(v)))) for k in range(0, len(v), 1000)])
    tracemalloc.start()
    place = elias_fano._select(levels.high, levels.ones, np.arange(len(v)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(place) == len(v) and peak < 40 * len(v)
    assert (levels.access(np.arange(len(v))) == v).all() and (few == v).all()


def test_ranks_by_table_and_by_sort():
    rng = np.random.default_rng(3)
    for v in (rng.integers(0, 300, 1000), rng.integers(0, 10**12, 1000), np.array([-1, 5, 5]), np.zeros(0, dtype=np.int64)):
        words, rank = elias_fano._ranked(v)
        assert words.tolist() == sorted(set(v.tolist())) and (words[rank] == v).all()


@pytest.mark.parametrize("bits", [1, 20, 60])
def test_distinct(bits):
    v = np.random.default_rng(bits).integers(0, 1 << bits, 500) * np.int64(1 if bits > 1 else -1)
    keys, place, number = trie_lm.distinct(v)
    assert keys.tolist() == sorted(set(v.tolist())) and (v[place] == keys).all() and (keys[number] == v).all()
