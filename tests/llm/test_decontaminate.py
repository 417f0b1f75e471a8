import hashlib
import random
import re

import duckdb
import pytest

from tabstudy.llm import ORACLES, QUERIES, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def slow(rows, items):
    out = []
    for i, text in rows:
        w = words(text)
        hit, named = set(), set()
        for item, body in items:
            b = words(body)
            k = min(13, len(b))
            grams = {tuple(b[j:j + k]) for j in range(len(b) - k + 1)} if b else set()
            for j in range(len(w) - k + 1):
                if tuple(w[j:j + k]) in grams:
                    hit |= set(range(j, j + k))
                    named.add("" if item is None else str(item))
        out.append((i, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


def test_matches_sql(spark, folder):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    assert got(QUERIES["op4_decontaminate"](spark, folder)) == sorted(con.execute(ORACLES["op4_decontaminate"]).fetchall(), key=str)


@pytest.mark.parametrize("block", [200_000, 60])
def test_small_alphabet_and_edges(spark, docs, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    rnd = random.Random(4)
    make = lambda n, k: " ".join(rnd.choice("ab") for _ in range(n))
    items = [(1, make(20, 2)), (2, make(14, 2)), (3, "a b a a"), (4, ""), (5, None), (6, "b"), (None, make(30, 2)), (7, make(13, 2)), (1, make(20, 2)), (8, "C d E f")]
    items = [x for x in items if x[0] != 6]
    rows = [(i, make(rnd.choice([3, 15, 60, 200]), 2)) for i in range(12)] + [(50, None), (51, ""), (None, "c-D.e f"), (52, "x " * 200 + items[0][1]), (53, "q"), (53, "q"), (54, "É ü " + items[1][1].upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert got(decontaminate.contamination(docs(rows, ["spans", "key", "items"]), bench)) == slow(rows, items)


def test_empty_tables_and_long_items(spark, docs, monkeypatch):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(docs([(1, "a b")]), bench).collect()] == [(0, 0, False)]
    assert decontaminate.contamination(docs([]), bench).count() == 0
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 10)
    items = [(1, " ".join(f"w{i}" for i in range(100)))]
    rows = [(1, " ".join(f"w{i}" for i in range(3, 97))), (2, "w5 w6")]
    assert got(decontaminate.contamination(docs(rows), spark.createDataFrame(items, "item_id long, text string"))) == slow(rows, items)


def test_removal(spark, docs):
    item = " ".join(f"w{i}" for i in range(15))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = "Nothing, to see - here. "
    big = "é x " * 300
    out = {r.doc_id: r.text for r in decontaminate.decontaminate(docs([(1, clean), (2, item), (3, big + "(" + item.upper() + ") end"), (4, None)], ["spans"]), bench).collect()}
    assert out == {1: clean, 3: big + "() end", 4: None}
