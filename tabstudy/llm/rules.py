"""Quality rules: a threshold table compiled into one projection of length, symbol, stop-word and line ratios.

Only SQL functions are used: no shuffle, no Python. A ratio holds if ``low * denominator <= 100 * numerator <= high * denominator``,
in whole numbers; a missing bound is no bound, and a denominator of 0 passes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5

# Frequent function words of four languages.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he at this are or his from but have an which you they "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er "
    "le la les de des et un une du en que est pour qui dans par sur pas plus au avec ne se ce il "
    "el los las y por con para una su al lo como más pero del no"
).split()

Rule = tuple[str, str, int | None, int | None, int]

# (measure, denominator, low percent, high percent, least words): in texts of so many words the ratio must lie within its bounds.
RULES: list[Rule] = [
    ("word_chars", "n_words", 150, 2_500, 10),
    ("n_symbols", "n_words", None, 30, 10),
    ("n_stop_words", "n_words", 2, None, 50),
    ("n_dup_lines", "n_lines", None, 50, 10),
]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once and only where it is needed."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(hashes: Column) -> Column:
    """Words within windows that occur twice or more: equal hashes meet by sorting, then their places are added up in order."""
    def repeated(pairs: Column) -> Column:
        places = F.transform(F.filter(pairs, lambda p, k: (p["h"] == F.get(pairs, k - 1)["h"]) | F.coalesce(p["h"] == F.get(pairs, k + 1)["h"], F.lit(False))), lambda p: p["i"])
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
        return F.aggregate(F.sort_array(places), start, lambda acc, p: F.struct(p.alias("last"), (acc["total"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("total")), lambda acc: acc["total"])

    return _let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), lambda pairs: F.coalesce(repeated(pairs), F.lit(0)))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stop_words: Sequence[str] = tuple(STOP_WORDS)) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words), one for each row of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    core = F.btrim(text, F.lit(WHITE))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, SPLIT)).alias("words"), lines.alias("lines"))
    n = F.size("words")
    window = lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)])
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window)).otherwise(F.array().cast("array<bigint>"))
    hashed = base.select("doc_id", "text", "words", "lines", hashes.alias("hashes"))
    return hashed.select(
        "doc_id", n.cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), _covered(F.col("hashes"))).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), F.size(F.filter("words", lambda w: F.lower(w).isin(*sorted(set(stop_words))))).cast("long").alias("n_stop_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def verdict(rules: Sequence[Rule] = tuple(RULES)) -> Column:
    """The threshold table as one boolean expression."""
    held = F.lit(True)
    for measure, per, low, high, least in rules:
        value, unit, few = 100 * F.col(measure), F.col(per), F.col("n_words") < least
        if low is not None:
            held = held & (few | (value >= low * unit))
        if high is not None:
            held = held & (few | (value <= high * unit))
    return held


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = tuple(RULES)) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` for each row of ``docs``.

    A null or empty text has no words and fails the base rule. Texts are read whole. Repeated rows and null ids stay as they are;
    other columns are ignored; an empty table gives an empty one. Windows are compared by 64-bit hashes within their own text.
    """
    rated = measures(docs, id_col, text_col)
    failed = base_failed()
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"), "n_lines", "n_stop_words")


def sql(rules: Sequence[Rule] = tuple(RULES)) -> str:
    """The same rows in DuckDB's SQL."""
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    bounds = " AND ".join(f"(n_words < {least} OR 100 * {m} {op} {v} * {per})" for m, per, low, high, least in rules for op, v in ((">=", low), ("<=", high)) if v is not None)
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
g AS (SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS gram FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT p) AS covered FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM r) GROUP BY rid),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, len(list_filter(words, lambda x: lower(x) IN ({stops})))::BIGINT AS n_stop_words
  FROM w LEFT JOIN c USING (rid)),
f AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {bounds}) AS kept, n_lines, n_stop_words FROM f"""
