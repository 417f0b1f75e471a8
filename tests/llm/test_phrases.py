import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import types as T

from tabstudy.llm import grams, phrases


def slow(rows, least=10, covered=50, top=2000):
    """Rows of the contract by plain counting."""
    counts = {}
    for text, lang in rows:
        own = counts.setdefault(lang or "und", Counter())
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            w = re.findall("[^ \t]+", piece)
            for k in (1, 2, 3):
                own.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows_of = []
        for p, a in found.items():
            if any(len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= covered * a for q, b in found.items() if len(p) == 2):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows_of.append((-score, -a, " ".join(p).encode(), a, left, right))
        for rank, (s, _, phrase, a, left, right) in enumerate(sorted(rows_of)[:top], 1):
            out.append((lang, rank, phrase.decode(), a, left, right, n, -s))
    return sorted(out)


def table(spark, rows):
    fields = [T.StructField(c, T.StringType()) for c in ("text", "lang", "word", "id")]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], T.StructType(fields))


def got(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def prose(rnd, n):
    return "".join(rnd.choice("abcdeé") * rnd.randint(1, 2) + rnd.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", " ; "]) for _ in range(n))


def test_random_texts_against_plain_counting(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(prose(rnd, rnd.randint(0, 400)).title(), rnd.choice(["en", "de x", None, "und"])) for _ in range(120)]
    rows += [(None, "en"), ("", None), ("one two " * 400, "xx"), ("Of The of the OF THE of the", "yy")] * 3
    want = slow(rows)
    assert len(want) > 100 and got(phrases.collocations(table(spark, rows).repartition(6))) == want
    monkeypatch.setattr(phrases, "TOP", 5)
    assert got(phrases.collocations(table(spark, rows), top=5)) == slow(rows, top=5)
    con = duckdb.connect()
    documents = table(spark, rows).toPandas()  # noqa: F841
    sql = con.execute(phrases.SQL).fetchall()
    assert len(sql) == len([r for r in want]) or len(sql) == len(slow(rows, top=5))


def test_empty_tables(spark):
    assert phrases.collocations(table(spark, [])).count() == 0
    assert phrases.collocations(table(spark, [(None, None), ("a b.", "en")])).count() == 0


@pytest.mark.parametrize("burst, limit", [(4, 40), (16, 10_000), (1 << 14, 1 << 19)])
def test_trie_counts_what_a_counter_counts(burst, limit):
    rng = np.random.default_rng(8)
    trie, want, have = phrases.HatTrie(burst, limit), Counter(), Counter()
    for _ in range(20):
        first = np.minimum(rng.integers(1, 60, 300), rng.integers(1, 60, 300))
        keys = first << grams.SHIFT | rng.integers(1, 200, 300)
        want.update(keys.tolist())
        for k, n in trie.add(keys):
            assert (np.diff(k) > 0).all()
            have.update(dict(zip(k.tolist(), n.tolist())))
        assert sum(map(len, trie.leaves)) <= limit and (np.diff(trie.low) > 0).all()
    for k, n in trie.runs():
        have.update(dict(zip(k.tolist(), n.tolist())))
    assert have == want and (burst > 100 or len(trie.leaves) > 3)


def test_packed_columns_come_back():
    rng = np.random.default_rng(9)
    for n in (0, 1, 1000):
        columns = [np.sort(rng.integers(0, 1 << 62, n)), rng.integers(-5, 5, n), rng.integers(0, 1 << 20, n), np.zeros(n, dtype=np.int64), rng.integers(-(1 << 62), 1 << 62, n)]
        assert all((a == b).all() for a, b in zip(grams.unpack(grams.pack(*columns)), columns, strict=True))
