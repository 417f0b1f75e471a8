"""Benchmark decontamination with a generalised suffix automaton of the benchmark's word sequences.

Documents stream through the automaton, which tracks the longest match that ends at each word. A match as long as a window marks
the window's words; spans over the length limit are removed, and a document above the coverage limit is contaminated. The
benchmark is cut into blocks of bounded size, each block broadcast and matched against all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, map_batches, raw_texts, slices

WINDOW = 13
BLOCK_WORDS = 200_000  # words of items in one broadcast automaton
PIECE_WORDS = 20_000  # longer items are cut into overlapping pieces that keep all windows
COVERAGE = 20  # contaminated if hit words are at least one in so many
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class SuffixAutomaton:
    """All factors of several sequences; ``items`` has for each state with a whole window the items that contain it."""

    def __init__(self, pieces: Iterable[tuple[str, list[bytes], bool]], window: int):
        """pieces: (item id, words, whole): ``whole`` marks an item shorter than a window, which only matches as a whole."""
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.window = window
        pieces = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], whole) for item, words, whole in pieces if words]
        for _, ids, _ in pieces:
            at = 0
            for c in ids:
                at = self._extend(at, c)
        self.windows: dict[int, set[str]] = {}  # state of a whole window -> items
        self.shorts: dict[int, set[str]] = {}  # state of a whole short item -> items
        for item, ids, whole in pieces:
            at, matched = 0, 0
            for c in ids:
                at, matched = self.step(at, matched, c)
                if not whole and matched >= window:
                    self.windows.setdefault(self.window_state(at), set()).add(item)
            if whole:
                self.shorts.setdefault(at, set()).add(item)
        # nearest state on the suffix links, itself included, where a short item ends
        self.short_at = [-1] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.short_at[s] = s if s in self.shorts else self.short_at[self.link[s]]
        lengths = [len(ids) for _, ids, whole in pieces if whole]
        self.least = min([window, *lengths]) if pieces else 0
        self.any_short = bool(lengths)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, q, c)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def step(self, at: int, matched: int, c: int) -> tuple[int, int]:
        """State and longest matching length after one more word."""
        while at and c not in self.next[at]:
            at = self.link[at]
            matched = self.length[at]
        if c in self.next[at]:
            return self.next[at][c], matched + 1
        return 0, 0

    def window_state(self, at: int) -> int:
        """State of the suffix as long as a window."""
        while self.length[self.link[at]] >= self.window:
            at = self.link[at]
        return at

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged hit spans (start, end) of word places, and the items with occurring windows."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words], dtype=np.int64)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], ids >= 0, [0]]).astype(np.int8)))
        for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if stop - start < self.least:
                continue
            at = matched = 0
            for i, c in enumerate(ids[start:stop].tolist(), start):
                at, matched = self.step(at, matched, c)
                if matched >= self.window and (found := self.windows.get(self.window_state(at))):
                    items |= found
                    self._mark(spans, i + 1 - self.window, i + 1)
                if self.any_short:
                    # the states on the links below ``at`` are its suffixes; ``at`` itself only if it is matched whole
                    s = self.short_at[at if matched >= self.length[at] else self.link[at]] if at else -1
                    while s > 0:
                        items |= self.shorts[s]
                        self._mark(spans, i + 1 - self.length[s], i + 1)
                        s = self.short_at[self.link[s]]
        return spans, items

    @staticmethod
    def _mark(spans: list[tuple[int, int]], start: int, end: int) -> None:
        while spans and start <= spans[-1][1]:
            start, end = min(start, spans[-1][0]), max(end, spans.pop()[1])
        spans.append((start, end))


def _pieces(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """Rows (item, body, whole, n): normalised words of each item, long items in overlapping pieces."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for item, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
            words = words_of(text)
            for at in range(0, max(1, len(words) - window + 1), PIECE_WORDS):
                if part := words[at:at + PIECE_WORDS + window - 1]:
                    out.append((item, b" ".join(part), len(words) < window, len(part)))
        kinds = [pa.string(), pa.binary(), pa.bool_(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [[]] * 4, kinds)], ["item", "body", "whole", "n"])

    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    return map_batches(items, run, "item string, body binary, whole boolean, n long").distinct()


def _blocks(pieces: DataFrame) -> list[list[tuple[str, list[bytes], bool]]]:
    """Blocks of at most ``BLOCK_WORDS`` words; only one block is in the driver at a time but for its own items."""
    total = pieces.agg(F.sum("n")).first()[0] or 0
    n = max(1, -(-2 * total // BLOCK_WORDS))
    place = lambda n: F.pmod(F.xxhash64("item", "body"), F.lit(n))
    while n > 1 and pieces.groupBy(place(n)).agg(F.sum("n").alias("s")).agg(F.max("s")).first()[0] > BLOCK_WORDS:
        n *= 2
    for b in range(n):
        yield [(r.item, bytes(r.body).split(), r.whole) for r in pieces.where(place(n) == b).toLocalIterator()]


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, key, n_words, spans, items), one for each row of ``docs``: spans are start and end places of hit words, merged and in turn."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    parts = []
    for block in _blocks(_pieces(benchmark, item_col, item_text_col, window)):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            automaton = SuffixAutomaton(sent.value, window)
            for batch in slices(batches):
                counts, spans, items = [], [], []
                for text in raw_texts(batch.column(2)):
                    words = words_of(text)
                    found, named = automaton.scan(words)
                    counts.append(len(words))
                    spans.append([x for s in found for x in s])
                    items.append(sorted(named))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                                                 ["doc_id", "key", "n_words", "spans", "items"])

        parts.append(base.mapInArrow(lean(run), "doc_id long, key long, n_words long, spans array<long>, items array<string>"))
    if len(parts) == 1:
        return parts[0]
    # Equal rows have equal hits: of those of all blocks, the documents without any are told by one block alone.
    first, rest = parts[0].withColumn("row", F.lit(1)), None
    for p in parts[1:]:
        found = p.where("size(spans) > 0").withColumn("row", F.lit(0))
        rest = found if rest is None else rest.union(found)
    grouped = first.union(rest).groupBy("doc_id", "key").agg(F.sum("row").alias("copies"), F.max("n_words").alias("n_words"), F.collect_set(F.when(F.size("spans") > 0, F.col("spans"))).alias("all"),
                                                             F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    merged = grouped.withColumn("spans", _merge(F.col("all"))).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return merged.select("doc_id", "key", "n_words", "spans", "items")


def _merge(lists):
    """Union of several span lists as one list."""
    pairs = F.array_sort(F.flatten(F.transform(lists, lambda s: F.transform(F.sequence(F.lit(0), (F.size(s) / 2 - 1).cast("int")), lambda i: F.struct(F.get(s, i * 2).alias("a"), F.get(s, i * 2 + 1).alias("b"))))))
    kind = "array<struct<a:bigint,b:bigint>>"

    def add(acc, p):
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], p["b"]).alias("b"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["b"] >= p["a"]), grown).otherwise(F.concat(acc, F.array(p)))

    return F.flatten(F.transform(F.aggregate(pairs, F.array().cast(kind), add), lambda p: F.array(p["a"], p["b"])))


def _covered(spans):
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def contamination(docs: DataFrame, benchmark: DataFrame, **columns) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans), one for each row of ``docs``.

    A null or empty text has no words and no hits. An item without words has no window; repeated items count once by item_id, and a
    null item_id counts as the empty id. Repeated documents stay repeated; other columns are ignored; empty tables are no error.
    """
    found = hits(docs, benchmark, **columns)
    n_hit = _covered(F.col("spans"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
                        ((n_hit > 0) & (COVERAGE * n_hit >= F.col("n_words"))).alias("contaminated"), "spans")


def cut_spans(text: str | None, spans: list[int] | None) -> str | None:
    """The text without the hit words and what stands between them; without spans, as it is."""
    if not spans:
        return text
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw.translate(_TABLE))]
    kept, last = [], 0
    for start, end in zip(spans[::2], spans[1::2]):
        kept.append(raw[last:at[start][0]])
        last = at[end - 1][1]
    return b"".join([*kept, raw[last:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, all columns kept; hit spans below the coverage limit are cut from the text. Clean texts stay as they are."""
    found = hits(docs, benchmark, id_col=id_col, text_col=text_col, **columns).where("size(spans) > 0").select(F.col("doc_id").alias("_hit_id"), F.col("key").alias("_hit_key"), F.col("n_words").alias("_hit_words"), F.col("spans").alias("_hit_spans")).distinct()
    joined = docs.join(found, F.col(id_col).cast("long").eqNullSafe(F.col("_hit_id")) & (F.xxhash64(text_col) == F.col("_hit_key")), "left")
    columns_of, at = docs.columns, docs.columns.index(text_col)

    def cut(batches):
        for batch in slices(batches):
            texts = [cut_spans(t, s) for t, s in zip(batch.column(at).to_pylist(), batch.column(len(columns_of)).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(columns_of))], columns_of)

    clean = joined.where(F.col("_hit_key").isNull()).select(*columns_of)
    some = joined.where(F.col("_hit_key").isNotNull() & (COVERAGE * _covered(F.col("_hit_spans")) < F.col("_hit_words"))).select(*columns_of, "_hit_spans")
    return clean.union(some.mapInArrow(lean(cut), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)))


SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
w AS (SELECT DISTINCT item, k, array_to_string(words[i:i + k - 1], ' ') AS gram FROM (SELECT item, words, least(13, len(words)) AS k, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS i FROM b WHERE len(words) > 0)),
g AS (SELECT rid, i, k, array_to_string(words[i:i + k - 1], ' ') AS gram FROM (SELECT rid, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM w))),
h AS (SELECT DISTINCT rid, i, k, item FROM g JOIN w USING (k, gram)),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM h) GROUP BY rid),
s AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words)) AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN s USING (rid)"""
