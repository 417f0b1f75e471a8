"""Language-model scores from Elias-Fano tries of word pairs and triples.

Words are numbered by falling count, so that counts are a step function of the numbers and need not travel with them. The pairs of a block of documents, with their counts in training texts, go to parts of the key space;
each part adds them up, lays smoothed, quantised probabilities out as a trie, and answers the block's pairs from it. Triples follow
under the pairs that were found at least twice. Probabilities take the shorter context as a Dirichlet prior: (count + weight * p(shorter)) /
(count of the context + weight), so each context's sum is one before quantisation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _Numbers, crc_remainder, discard, materialise, raw_texts, slices
from .elias_fano import Trie
from .grams import BLOCK, by_part, dealt, merged_parts, n_parts, occurrences, pack, parts_of, summed, unpack, wide_rows

FOLDS, HELD_OUT = 10, 0
ADDED = 0.1  # to the count of each word
PRIOR2, PRIOR3 = 30.0, 10.0  # weights of the shorter context
REPEATED = 2  # training count of a pair that is a context of triples
STEPS = 4096  # quantisation steps in one unit of log10
END = b"\n"  # closes each text, and stands before the next; no word holds it


def quantised(p: np.ndarray) -> np.ndarray:
    """Code of a probability, from 1; up to 16 bits."""
    return np.clip(np.rint(-np.log10(p) * STEPS), 0, 65534).astype(np.int64) + 1


def probability(code: np.ndarray) -> np.ndarray:
    return _PROBABILITY[code]


_PROBABILITY = 10.0 ** (-(np.arange(1 << 16) - 1) / STEPS)


def _blocks(docs: DataFrame, folds: int, held_out: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (block, ids, words, counts, doc_ids, lengths, training, tokens); counts are those in training texts, number 0 closes a text."""

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0

        def block():
            nonlocal number
            number += 1
            ids = np.concatenate(parts)
            counts = np.bincount(ids[np.repeat(training, lengths)], minlength=len(words))
            values = [(task << 32) + number, pack(ids), list(words), counts, doc_ids, lengths, training, len(ids)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names)

        def fresh():
            table = _Numbers()
            table[END] = 0
            return table, [], [], [], [], 0

        words, parts, doc_ids, lengths, training, size = fresh()
        for batch in slices(batches, 50):
            for doc, train, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch.column(2))):
                own = text.lower().split()
                own.append(END)
                parts.append(np.fromiter(map(words.__getitem__, own), dtype=np.int64, count=len(own)))
                words.new.clear()
                doc_ids.append(doc)
                lengths.append(len(own))
                training.append(train)
                size += len(own)
                if size >= BLOCK:
                    yield block()
                    words, parts, doc_ids, lengths, training, size = fresh()
        if size:
            yield block()

    names = ["block", "ids", "words", "counts", "doc_ids", "lengths", "training", "tokens"]
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.int64()]
    train = crc_remainder(F.col(id_col), folds) != held_out
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), train.alias("train"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "block long, ids binary, words array<binary>, counts array<bigint>, doc_ids array<bigint>, lengths array<bigint>, training array<boolean>, tokens long")


@dataclass
class Counts:
    """Training counts of words by their number: ``c[i]`` for numbers from ``first[i]`` on. There are fewer than sqrt(2 N) + 1 steps, as different counts add up to N at most."""

    first: np.ndarray
    c: np.ndarray
    tokens: int
    words: int

    def of(self, gid: np.ndarray) -> np.ndarray:
        """Counts, 0 for the number -1 of words without any."""
        if not len(self.first):
            return np.zeros(len(gid), dtype=np.int64)
        return np.where(gid < 0, 0, self.c[np.searchsorted(self.first, gid, "right") - 1])

    def floor(self, c: np.ndarray) -> np.ndarray:
        """Probability of a word with this count, whatever stands before it."""
        return (c + ADDED) / (self.tokens + ADDED * (self.words + 1))


def ranked_words(blocks: DataFrame, parts: int) -> tuple[DataFrame, Counts]:
    """Rows (word, gid) of training words, numbered by falling count, and their counts."""
    counted = materialise(occurrences(blocks).groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"), "word_counts")
    order = [F.desc("c"), F.col("word")]
    placed = materialise(counted.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("word", "c", F.monotonically_increasing_id().alias("at")), "word_places")
    discard(counted)
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r.part: r.n for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # one for each task
    before, offsets = 0, []
    for k in range(max(sizes, default=-1) + 1):
        offsets.append(before)
        before += sizes.get(k, 0)
    numbered = placed.select("word", "c", (F.get(F.array(*[F.lit(o).cast("long") for o in offsets or [0]]), part.cast("int")) + row).alias("gid"))
    steps = sorted((r.gid, r.c, r.n) for r in numbered.groupBy("c").agg(F.min("gid").alias("gid"), F.count("*").alias("n")).collect())
    return numbered.select("word", "gid"), Counts(np.array([g for g, _, _ in steps], dtype=np.int64), np.array([c for _, c, _ in steps], dtype=np.int64), sum(c * n for _, c, n in steps), before)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, a place of each, and for each row the number of its key."""
    bits = len(keys).bit_length()
    if len(keys) and keys.min() >= 0 and int(keys.max()).bit_length() + bits < 64:  # numbers are sorted faster than their places
        both = np.sort(keys << bits | np.arange(len(keys)))
        own, order = both >> bits, both & ((1 << bits) - 1)
    else:
        order = np.argsort(keys)
        own = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = own[1:] != own[:-1]
    number = np.empty(len(keys), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return own[new], order[new], number


def renumbered(ids: bytes, vocab: pa.Scalar) -> tuple[bytes, bytes]:
    """Tokens of a block numbered by the rising gid of their words, and those gids; all words without one share the next number."""
    t = unpack(ids)[0]
    pos, gid = (vocab.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)) if vocab.is_valid and len(vocab.values) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.argsort(gid)
    number = np.full(int(t.max()) + 1, len(gid), dtype=np.int64)
    number[pos[order]] = np.arange(len(gid))
    return pack(number[t]), pack(gid[order])


class Block:
    """Tokens of a block with what is known of their words; words are numbered in order of their gid, so that pairs are sorted by those too."""

    def __init__(self, ids: bytes, gids: bytes, lengths: pa.Scalar, training: pa.Scalar, counts: Counts):
        self.t = unpack(ids)[0]
        self.gid = np.append(unpack(gids)[0], -1)
        known = len(self.gid) - 1
        self.c = counts.of(self.gid)
        self.floor = counts.floor(self.c)
        self.before = np.concatenate([self.t[-1:], self.t[:-1]])  # the last token is an end, as the one before the first
        lengths = lengths.values.to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.cumsum(lengths) - lengths
        self.train = np.repeat(training.values.to_numpy(zero_copy_only=False).astype(bool), lengths)
        self.at = np.flatnonzero((self.t < known) & (self.before < known))
        bits = known.bit_length()
        self.keys, _, self.pair = distinct(self.before[self.at] << bits | self.t[self.at])
        self.x, self.y = self.keys >> bits, self.keys & ((1 << bits) - 1)

    def pair_runs(self, parts: int) -> Iterator[tuple[int, bytes]]:
        n = np.bincount(self.pair[self.train[self.at]], minlength=len(self.keys))
        x, y = self.gid[self.x], self.gid[self.y]
        return dealt(parts_of(x, y, parts), x, y, n)

    def take_pairs(self, replies: list[tuple[int, bytes]], parts: int) -> None:
        """Probability of each token after the word before it (p), and count and id of the pairs that training texts repeat."""
        part = parts_of(self.gid[self.x], self.gid[self.y], parts)
        order = by_part(part)
        columns = [_split(r) for _, r in sorted(replies)]
        code, n, ident = np.zeros(len(part), dtype=np.int64), np.zeros(len(part), dtype=np.int64), np.full(len(part), -1, dtype=np.int64)
        if columns:
            code[order] = np.concatenate([c[0][0] for c in columns])
            many = order[np.concatenate([c[0][1] for c in columns]) > 0]
            n[many], ident[many] = (np.concatenate([c[1][k] for c in columns]) for k in (0, 1))
        own = np.where(code > 0, probability(code), PRIOR2 / (self.c[self.x] + PRIOR2) * self.floor[self.y])
        of_before = self.c[self.before]
        self.p = np.where(of_before > 0, PRIOR2 / (of_before + PRIOR2), 1.0) * self.floor[self.t]
        self.p[self.at] = own[self.pair]
        # triples: known words after a pair that training texts repeat, within one text
        before = np.full(len(self.t) + 1, -1, dtype=np.int64)  # place among the pairs of the two words before a token
        before[self.at + 1] = self.pair
        before = before[:-1]
        before[self.start] = -1
        self.context = np.append(n, 0)[before]
        self.triple_at = np.flatnonzero((self.context >= REPEATED) & (self.c[self.t] > 0))
        number = np.cumsum(n >= REPEATED) - 1  # of the repeated pairs
        bits = len(self.gid).bit_length()
        keys, first, self.triple = distinct(number[before[self.triple_at]] << bits | self.t[self.triple_at])
        tx = ident[before[self.triple_at[first]]]
        order = np.argsort(tx, kind="stable")  # ids that rise take few bytes
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.triple, self.triple_first = place[self.triple], self.triple_at[first[order]]  # a place of each triple
        self.tx, self.ty = tx[order], self.gid[keys[order] & ((1 << bits) - 1)]

    def triple_runs(self, parts: int) -> Iterator[tuple[int, bytes]]:
        n = np.bincount(self.triple[self.train[self.triple_at]], minlength=len(self.tx))
        return dealt(parts_of(self.tx, self.ty, parts), self.tx, self.ty, n, self.context[self.triple_first], quantised(self.p[self.triple_first]))

    def take_triples(self, replies: list[tuple[int, bytes]], parts: int) -> None:
        code = np.zeros(len(self.tx), dtype=np.int64)
        if replies:
            code[by_part(parts_of(self.tx, self.ty, parts))] = np.concatenate([_split(r)[0][0] for _, r in sorted(replies)])
        unknown = np.flatnonzero((self.context >= REPEATED) & (self.c[self.t] == 0))
        self.p[unknown] *= PRIOR3 / (self.context[unknown] + PRIOR3)
        prior = PRIOR3 / (self.context[self.triple_at] + PRIOR3)
        self.p[self.triple_at] = np.where(code[self.triple] > 0, probability(code[self.triple]), prior * self.p[self.triple_at])


def _joined(*packed: bytes) -> bytes:
    return b"".join(len(b).to_bytes(8, "little") + b for b in packed)


def _split(joined: bytes) -> list[list[np.ndarray]]:
    out, at = [], 0
    while at < len(joined):
        n = int.from_bytes(joined[at:at + 8], "little")
        out.append(unpack(joined[at + 8:at + 8 + n]))
        at += 8 + n
    return out


def _answer(prior: float, counts: Counts | None, part_of: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    """Add up a part's runs (x, y, n), build its trie, and answer each run with codes and, of pairs, the counts and ids of those that repeat.

    The counts of contexts and the probabilities of the shorter context come from ``counts``, or without it as further columns of the runs.
    """

    def merge(blocks: list[int], own: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        x, y, n, place = summed(own)
        if counts is None:
            some = np.empty(len(x), dtype=np.int64)
            some[place] = np.arange(len(place))
            of_x, shorter = (np.concatenate([r[k] for r in own])[some] for k in (3, 4))
            shorter = probability(shorter)
        else:
            of_x, shorter = counts.of(x), counts.floor(counts.of(y))
        known = n > 0
        levels = Trie.build(x[known], y[known], quantised((n[known] + prior * shorter[known]) / (of_x[known] + prior)))
        code = Trie.mapped(levels).find(x, y)
        ident = (TaskContext.get().partitionId() << 30) + merge.done + np.arange(len(x))
        merge.done += len(x)
        part, at = int(part_of(x[:1], y[:1])[0]), 0
        for b, r in zip(blocks, own):
            mine = place[at:at + len(r[0])]
            at += len(r[0])
            many = n[mine] >= REPEATED
            reply = _joined(pack(code[mine])) if counts is None else _joined(pack(code[mine], many), pack(n[mine][many], ident[mine][many]))
            yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([part]), pa.array([reply], pa.binary())], ["block", "part", "reply"])

    merge.done = 0
    return merge


def _answered(run_rows: DataFrame, parts: int, prior: float, counts: Counts | None, name: str) -> DataFrame:
    merge = _answer(prior, counts, lambda x, y: parts_of(x, y, parts))
    return materialise(merged_parts(run_rows, parts, merge, "block long, part long, reply binary"), name)


def _by_block(replies: DataFrame, name: str) -> DataFrame:
    return replies.groupBy("block").agg(F.collect_list(F.struct("part", "reply")).alias(name))


def _replies(column: pa.Array, i: int) -> list[tuple[int, bytes]]:
    return [(r["part"], r["reply"]) for r in column[i].as_py() or []]


def text_scores(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row of ``docs``.

    Learned from texts outside the held-out fold (crc32 of the id as text; a null id counts as the empty text). Texts are lower-cased
    (A-Z); tokens are words and one end. base_score sums log10((c + 0.1) / (N + 0.1 (V + 1))) over tokens, score is the log10
    probability of the text by triples, pairs, and words. Null and empty texts are one end. Without training texts both are 0. Repeated
    rows count again and stay repeated; other columns are ignored; an empty table gives an empty one. Nothing but one block, or the
    pairs of one part, is ever held as a whole.
    """
    spark = docs.sparkSession
    blocks = materialise(_blocks(docs, folds, held_out, id_col, text_col), "text_blocks")
    parts = n_parts(blocks.agg(F.sum("tokens")).first()[0] or 0)
    with wide_rows(spark):
        ranked, counts = ranked_words(blocks, parts)
        found = occurrences(blocks).join(ranked, "word").groupBy("block").agg(F.collect_list(F.struct("pos", "gid")).alias("vocab"))

        def numbered(batches):
            for batch in batches:
                own = [renumbered(batch.column(1)[i].as_py(), batch.column(2)[i]) for i in range(batch.num_rows)]
                ids, gids = (pa.array([o[k] for o in own], pa.binary()) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids, gids, *(batch.column(k) for k in (3, 4, 5))], ["block", "ids", "gids", "lengths", "training", "doc_ids"])

        joined = blocks.select("block", "ids", "doc_ids", "lengths", "training").join(found, "block", "left").select("block", "ids", "vocab", "lengths", "training", "doc_ids")
        known = materialise(joined.mapInArrow(numbered, "block long, ids binary, gids binary, lengths array<bigint>, training array<boolean>, doc_ids array<bigint>"), "known_blocks")
        discard(blocks)

        def rows(block: int, dealt_out: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
            out = list(dealt_out)
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([block] * len(out), pa.int64()), pa.array([r for _, r in out], pa.binary())], ["part", "block", "run"])

        def opened(batch: pa.RecordBatch) -> Iterator[tuple[int, Block]]:
            for i in range(batch.num_rows):
                yield i, Block(batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), batch.column(3)[i], batch.column(4)[i], counts)

        def pair_level(batches):
            for batch in batches:
                for i, own in opened(batch):
                    yield rows(batch.column(0)[i].as_py(), own.pair_runs(parts))

        columns, kind = ["block", "ids", "gids", "lengths", "training"], "part long, block long, run binary"
        pair_table = _answered(known.select(*columns).mapInArrow(pair_level, kind), parts, PRIOR2, counts, "pair_replies")
        pairs = _by_block(pair_table, "pair_replies")

        def triple_level(batches):
            for batch in batches:
                for i, own in opened(batch):
                    own.take_pairs(_replies(batch.column(5), i), parts)
                    yield rows(batch.column(0)[i].as_py(), own.triple_runs(parts))

        triple_table = _answered(known.join(pairs, "block", "left").select(*columns, "pair_replies").mapInArrow(triple_level, kind), parts, PRIOR3, None, "triple_replies")
        triples = _by_block(triple_table, "triple_replies")

        def score(batches):
            for batch in batches:
                for i, own in opened(batch):
                    own.take_pairs(_replies(batch.column(5), i), parts)
                    own.take_triples(_replies(batch.column(6), i), parts)
                    c = own.c[own.t]
                    per_text = lambda v, at=own.start: np.add.reduceat(v, at)
                    yield pa.RecordBatch.from_arrays([batch.column(7)[i].values, batch.column(4)[i].values, pa.array(per_text(np.ones(len(c), dtype=np.int64))), pa.array(per_text((c > 0).astype(np.int64))), pa.array(per_text(np.log10(counts.floor(c)))), pa.array(per_text(np.log10(own.p)))], ["doc_id", "training", "n_tokens", "n_known", "base_score", "score"])

        found = known.join(pairs, "block", "left").join(triples, "block", "left").select(*columns, "pair_replies", "triple_replies", "doc_ids")
        done = materialise(found.mapInArrow(score, "doc_id long, training boolean, n_tokens long, n_known long, base_score double, score double"), "text_scores")
    discard(known, pair_table, triple_table)
    return done.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", F.lit(counts.tokens).cast("long").alias("train_tokens"), "base_score", "score")
