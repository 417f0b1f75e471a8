"""Blocks of numbered words, and the exchange by which counts of word sequences meet.

A block is one row: the words of many documents as numbers of the block's own word list. Lists are joined with the totals of all
blocks, so nothing whose size grows with the corpus is ever broadcast. Sequences of two neighbours are counted within a block and
leave it as sorted runs, one for each part of the key space; a task merges the runs of one part and answers each of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean

BLOCK = 1 << 20  # tokens after which a block is closed
PART = 1 << 20  # keys that one part of the exchange is made for
SHIFT = 31  # bits of the second number of a pair
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
# Odd multipliers.
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


@contextmanager
def wide_rows(spark: SparkSession, rows: int = 8) -> Iterator[None]:
    """Few rows in an Arrow batch, for tables whose rows take megabytes."""
    before = spark.conf.get(ROWS)
    spark.conf.set(ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ROWS, before)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length in few bytes: as they are or as differences of neighbours, in as few bytes as the largest needs, byte by byte, compressed."""
    out = [np.int64(len(columns[0])).tobytes()]
    for c in columns:
        c = c.astype(np.int64)
        d = np.diff(c, prepend=0)
        rising = len(d) and d.min() >= 0
        d = (d << 1) ^ (d >> 63)  # small for small differences of either sign
        differences = bool(rising or _width(d) < _width(c))
        v = d if differences else c
        width = _width(v)
        out += [bytes([width, differences]), np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _width(v: np.ndarray) -> int:
    """Bytes that hold every number; all eight where one is negative."""
    return 8 if len(v) and v.min() < 0 else max(1, -(-int(v.max(initial=0)).bit_length() // 8))


def unpack(packed: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    while at < len(raw):
        width, differences = raw[at], raw[at + 1]
        flat = np.zeros((n, 8), dtype=np.uint8)
        flat[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 2).reshape(width, n).T
        v = flat.view("<i8").ravel()
        out.append(np.cumsum((v >> 1 & 0x7FFFFFFFFFFFFFFF) ^ -(v & 1)) if differences else v)
        at += 2 + n * width
    return out


def word_totals(blocks: DataFrame, least: int) -> DataFrame:
    """Rows (word, gid, c) of words with a total of at least ``least`` in blocks (words, counts)."""
    return occurrences(blocks).groupBy("word").agg(F.sum("n").alias("c")).where(F.col("c") >= least).select("word", F.monotonically_increasing_id().alias("gid"), "c")


def occurrences(blocks: DataFrame) -> DataFrame:
    """Rows (block, pos, word, n) of the word lists."""
    return blocks.select("block", F.posexplode(F.arrays_zip("words", "counts"))).select("block", "pos", F.col("col.words").alias("word"), F.col("col.counts").alias("n"))


def with_totals(blocks: DataFrame, totals: DataFrame, *columns: str) -> DataFrame:
    """Blocks with ``vocab``: (pos, gid, c) of the words of their list that have a total."""
    found = occurrences(blocks).join(totals, "word").groupBy("block").agg(F.collect_list(F.struct("pos", "gid", "c")).alias("vocab"))
    return blocks.select("block", *columns).join(found, "block", "left")


def vocabulary(vocab: pa.Scalar, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(gid, c) by place in the block's list; -1 and 0 for words without a total."""
    gid, c = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
    if vocab.is_valid and len(vocab.values):
        pos, g, total = (vocab.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        gid[pos], c[pos] = g, total
    return gid, c


def parts_of(x: np.ndarray, y: np.ndarray, parts: int) -> np.ndarray:
    """Part of each pair: a hash, so that a frequent first word is spread."""
    h = (x.astype(np.uint64) * _A + y.astype(np.uint64)) * _B
    h = (h ^ (h >> np.uint64(29))) * _A
    return ((h >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def by_part(part: np.ndarray) -> np.ndarray:
    """Order of rows by part, stable; short numbers are sorted by digits instead of comparisons."""
    return np.argsort(part.astype(np.uint16) if part.max(initial=0) < 1 << 16 else part, kind="stable")


def dealt(part: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(part, packed columns) of each part, in the given order of rows."""
    order = by_part(part)
    part = part[order]
    cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if len(part) else np.zeros(0, dtype=np.int64)
    columns = tuple(c[order] for c in columns)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield int(part[a]), pack(*(c[a:b] for c in columns))


def n_parts(tokens: int) -> int:
    return max(1, -(-tokens // PART))


def merged_parts(runs: DataFrame, parts: int, merge: Callable[[list[int], list[list[np.ndarray]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply ``merge`` to (blocks, unpacked runs) of each part of rows (part, block, run)."""

    def run(batches):
        part, blocks, own = None, [], []
        for batch in batches:
            for p, b, r in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if p != part and own:
                    yield from merge(blocks, own)
                    blocks, own = [], []
                part = p
                blocks.append(b)
                own.append(unpack(r))
        if own:
            yield from merge(blocks, own)

    return runs.select("part", "block", "run").repartition(parts, "part").sortWithinPartitions("part", "block").mapInArrow(lean(run), schema)


def summed(own: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of runs (x, y, n, ...) in order with their sums, and for each row of all runs the place of its pair."""
    x, y, n = (np.concatenate([r[k] for r in own]) for k in range(3))
    bits = int(y.max(initial=0)).bit_length()
    fits = len(x) and min(x.min(), y.min()) >= 0 and int(x.max()).bit_length() + bits < 64
    order = np.argsort(x << bits | y) if fits else np.lexsort((y, x))
    xs, ys = x[order], y[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (xs[1:] != xs[:-1]) | (ys[1:] != ys[:-1])
    place = np.empty(len(x), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return xs[first], ys[first], np.add.reduceat(n[order], first) if len(x) else n, place
