import re
from collections import Counter

import duckdb

from tabstudy.llm import ORACLES, QUERIES, rules


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def columns(df):
    return sorted(tuple(r) for r in df.select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())


def test_matches_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.execute(ORACLES["op5_quality_rules"])
    names = [c[0] for c in want.description]
    assert sorted(want.fetchall()) == sorted(tuple(r) for r in QUERIES["op5_quality_rules"](spark, folder).select(*names).collect())


def test_edges(docs):
    texts = [None, "", " \n\t ", "a b c d e a b c d e", "a a a a a a a a a a a a", "x\n x\nx\n\n\n#*$%&|<> y", "é ü z q", "same", "same", "one two three four five six seven eight nine ten eleven",
             " ".join(f"w{i % 7000}" for i in range(40_000)), "\n".join(["the line of it"] * 400)]
    df = rules.quality(docs([(i % 5, t) for i, t in enumerate(texts)] + [(None, "z")], ["words", "n_words", "h"]))
    assert columns(df) == sorted(slow(t) for t in [*texts, "z"])
    assert rules.quality(docs([])).count() == 0


def test_threshold_table(docs):
    plain = " ".join(["the house of words and lines is here with it"] * 1) + " and not the same again for all of us"
    noisy = " ".join(f"word{i}***" for i in range(30))
    kept = {r.doc_id: r.kept for r in rules.quality(docs([(1, plain), (2, noisy), (3, "too short")])).collect()}
    assert kept == {1: True, 2: False, 3: False}


def test_no_python_in_the_plan(spark, folder):
    plan = QUERIES["op5_quality_rules"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and not re.search("Python|Pandas|Arrow", plan)
