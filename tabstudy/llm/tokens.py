"""Token ids in ORC: integer run-length encoded stripes with row indexes and Bloom filters on document ids.

Texts are dealt by ranges of document ids and encoded where they land, so each file holds its ids in ascending order. A row also
holds its place in the file's token stream; adding up the files' totals gives each document's place in the corpus without a sort
of all rows. Stripes are read in parallel, and a look-up of ids skips stripes and row groups by their statistics and filters.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Ragged, ranges, raw_texts, slices

SCHEMA = "doc_id long, block int, place long, n_tokens long, ids array<int>"
STRIPE_BYTES = 32 << 20


MARK = "|"  # stands between words that are encoded in one call


def _words_encoder(tokenizer):
    """Encode new words, given as bytes, as (ids, lengths): many in one call, told apart by the mark's own id; words that hold the mark alone."""
    mark = tokenizer.encode(MARK, add_special_tokens=False).ids

    def one_by_one(words: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def make(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [w.decode() for w in words]
        lengths = np.zeros(len(texts), dtype=np.int64)
        plain = np.array([i for i, t in enumerate(texts) if MARK not in t and len(mark) == 1], dtype=np.int64)
        others = np.array([i for i, t in enumerate(texts) if MARK in t or len(mark) != 1], dtype=np.int64)
        parts = []
        for at in range(0, len(plain), 5000):
            some = plain[at:at + 5000]
            ids = np.array(one_by_one([f" {MARK} ".join(texts[i] for i in some.tolist())])[0], dtype=np.int64)
            ends = np.append(np.flatnonzero(ids == mark[0]), len(ids))
            if len(ends) != len(some):
                raise ValueError("the vocabulary joins words over white space")
            lengths[some] = np.diff(ends, prepend=-1) - 1
            parts.append(ids[ids != mark[0]])
        lists = one_by_one([texts[i] for i in others.tolist()])
        lengths[others] = [len(x) for x in lists]
        values = np.concatenate([*parts, *(np.array(x, dtype=np.int64) for x in lists), np.zeros(0, dtype=np.int64)])
        order = np.concatenate([plain, others])
        starts = np.zeros(len(texts), dtype=np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        return values[ranges(starts, lengths)], lengths

    return make


@lru_cache(maxsize=2)
def _known_words(path: str) -> Ragged:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Ragged(_words_encoder(Tokenizer.from_file(path)))


def encode_texts(path: str, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, ``end_id`` after each, and the bounds of each text.

    The vocabulary drops white space and never joins what it parts, so words are encoded once and looked up afterwards.
    """
    known = _known_words(path)
    words = [t.split() for t in texts]
    slots = known.find(list(chain.from_iterable(words)))
    reach = np.concatenate([[0], np.cumsum(known.length[slots])])
    ends = reach[np.cumsum([len(ws) for ws in words])]
    ids = np.insert(known.gather(slots), ends, end_id)
    return ids, np.concatenate([[0], ends + np.arange(1, len(texts) + 1)])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = STRIPE_BYTES) -> None:
    """Encode ``docs`` and write them to ``path`` in ascending order of doc_id.

    A null text is empty and gives the end id alone. Null ids come first. Repeated rows stay repeated; rows that share an id are
    ordered by a hash of their text. Other columns are ignored; an empty table gives a file without rows.
    """

    def run(batches):
        block, place = TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            ids, bounds = encode_texts(tokenizer, raw_texts(batch.column(1)), end_id)
            n = np.diff(bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), block, dtype=np.int32)), pa.array(place + bounds[:-1]), pa.array(n), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))],
                                             ["doc_id", "block", "place", "n_tokens", "ids"])
            place += int(bounds[-1])

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    (ordered.mapInArrow(run, SCHEMA).write.option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .option("orc.create.index", "true").option("orc.row.index.stride", "1000").option("orc.stripe.size", str(stripe_bytes)).orc(path))


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows of the files; with ``doc_ids``, only theirs: the filter reaches the files' indexes."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(*doc_ids))


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of all documents in the files at ``path``."""

    def run(batches):
        for batch in slices(batches, 200):
            ids = batch.column(3)
            flat, bounds = ids.flatten().to_numpy().astype("<u4"), ids.offsets.to_numpy()
            bounds = bounds - bounds[0]
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(bounds).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "block", "place", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path)
    read = rows.select("doc_id", "block", "place", "ids").mapInArrow(run, "doc_id long, block int, place long, n_tokens long, ids_crc32 long")
    totals = rows.groupBy("block").agg(F.max(F.col("place") + F.col("n_tokens")).alias("total"))  # one row for each file
    before = totals.select("block", (F.sum("total").over(Window.orderBy("block")) - F.col("total")).alias("before"))
    return read.join(before, "block").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
