"""Phrase collocation mining by HAT-trie counting.

Words are numbered within blocks. Each level counts pairs of neighbours, words first and then frequent phrases that overlap in all
but one word, in a HAT-trie: hash containers under a shallow trie over the numbers. A container that grows too large is burst along
the next number; when the trie holds too much, whole subtrees leave as sorted runs. Runs are merged by parts of the phrases' keys.
A phrase can only be frequent if its shorter parts are, so each level goes on with what the one before has found frequent.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _Numbers, discard, materialise, raw_texts, slices
from .grams import BLOCK, SHIFT, dealt, merged_parts, n_parts, pack, parts_of, summed, unpack, vocabulary, wide_rows, with_totals, word_totals

LEAST = 10  # occurrences of a candidate
COVERED = 50  # percent of a phrase's occurrences inside a longer one that make it redundant
TOP = 2000  # phrases of a language
SCALE = 1_000_000
SEPARATORS = bytes.maketrans(b".,;:!?\x0b\x0c\x0d", b"\n" * 9)


class HatTrie:
    """Counts of pairs (first << SHIFT | second).

    Leaves are hash containers; each covers an interval of keys that starts where a prefix starts, or inside a prefix that fills
    containers of its own.
    """

    def __init__(self, burst: int = 1 << 14, limit: int = 1 << 19):
        self.burst, self.limit = burst, limit
        self.low = np.zeros(1, dtype=np.int64)
        self.leaves: list[Counter] = [Counter()]

    def add(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Count the keys; yields sorted runs (keys, counts) of subtrees that had to leave."""
        leaf = np.searchsorted(self.low, keys, "right") - 1
        order = np.argsort(leaf.astype(np.uint16) if len(self.low) < 1 << 16 else leaf, kind="stable")
        keys, leaf = keys[order], leaf[order]
        cuts = np.flatnonzero(np.diff(leaf, prepend=-1, append=-1)).tolist() if len(leaf) else []
        grown = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = self.leaves[leaf[a]]
            own.update(keys[a:b].tolist())
            if len(own) > self.burst:
                grown.append(int(leaf[a]))
        for at in reversed(grown):
            self._burst(at)
        if sum(map(len, self.leaves)) > self.limit:
            yield from self._spill(self.limit // 2)

    def _burst(self, at: int) -> None:
        keys = np.sort(np.fromiter(self.leaves[at], dtype=np.int64, count=len(self.leaves[at])))
        cuts = keys[np.linspace(0, len(keys), 9, dtype=np.int64)[1:-1]]
        prefix = cuts >> SHIFT << SHIFT
        cuts = np.unique(np.where(prefix > keys[0], prefix, cuts))  # along first numbers where there are several
        cuts = cuts[cuts > self.low[at]]
        parts: list[Counter] = [Counter() for _ in range(len(cuts) + 1)]
        for part, (k, n) in zip(np.searchsorted(cuts, np.fromiter(self.leaves[at], dtype=np.int64, count=len(keys)), "right").tolist(), self.leaves[at].items()):
            parts[part][k] = n
        self.leaves[at:at + 1] = parts
        self.low = np.insert(self.low, at + 1, cuts)

    def _spill(self, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        left = sum(map(len, self.leaves))
        for at in sorted(range(len(self.leaves)), key=lambda k: -len(self.leaves[k])):
            if left <= keep:
                return
            own, self.leaves[at] = self.leaves[at], Counter()
            left -= len(own)
            if own:
                keys = np.fromiter(own.keys(), dtype=np.int64, count=len(own))
                order = np.argsort(keys)
                yield keys[order], np.fromiter(own.values(), dtype=np.int64, count=len(own))[order]

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All that is left, as sorted runs."""
        yield from self._spill(0)


def _blocks(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """Rows (block, ids, words, counts, tokens): numbers of the words from 1, 0 between pieces; a word is its language, a space, and itself."""

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0

        def fresh():
            return {}, {}, 0

        def block(own: dict, ids: dict):
            nonlocal number
            sequence, words, offset = [], [], 0
            for lang, table in own.items():
                names = list(table)[1:]
                part = np.concatenate(ids[lang])
                sequence.append(np.where(part > 0, part + offset, 0))
                words += [lang + b" " + w for w in names]
                offset += len(names)
            flat = np.concatenate(sequence)
            counts = np.bincount(flat, minlength=offset + 1)[1:]
            number += 1
            columns = [pa.array([(task << 32) + number]), pa.array([pack_ids(flat)], pa.binary()), pa.array([words], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int64())), pa.array([int(counts.sum())])]
            return pa.RecordBatch.from_arrays(columns, ["block", "ids", "words", "counts", "tokens"])

        own, ids, size = fresh()
        for batch in slices(batches, 50):
            for lang, text in zip(raw_texts(batch.column(0)), raw_texts(batch.column(1))):
                words: list[bytes] = []
                for piece in text.lower().translate(SEPARATORS).split(b"\n"):
                    if part := piece.split():
                        words += part
                        words.append(b"")
                if not words:
                    continue
                if lang not in own:
                    own[lang], ids[lang] = _Numbers(), []
                    own[lang][b""] = 0
                ids[lang].append(np.fromiter(map(own[lang].__getitem__, words), dtype=np.int64, count=len(words)))
                own[lang].new.clear()
                size += len(words)
                if size >= BLOCK:
                    yield block(own, ids)
                    own, ids, size = fresh()
        if size:
            yield block(own, ids)

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "block long, ids binary, words array<binary>, counts array<bigint>, tokens long")


def pack_ids(ids: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_ids(packed: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def pairs(sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and key of each two neighbours of which neither is 0."""
    at = np.flatnonzero((sequence[1:] > 0) & (sequence[:-1] > 0))
    return at, sequence[at] << SHIFT | sequence[at + 1]


def _runs(block: int, sequence: np.ndarray, names: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Counted pairs of a block: rows (part, block, run) with runs (x, y, n, key) where x and y are the names of the numbers."""
    keys = pairs(sequence)[1]
    trie = HatTrie()

    def rows(run: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        k, n = run
        x, y = names[k >> SHIFT], names[k & ((1 << SHIFT) - 1)]
        out = list(dealt(parts_of(x, y, parts), x, y, n, k))
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([block] * len(out), pa.int64()), pa.array([r for _, r in out], pa.binary())], ["part", "block", "run"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(keys), 1 << 17):
        held += trie.add(keys[at:at + (1 << 17)])
    held += trie.runs()
    if held:  # subtrees of one block travel together
        order = np.argsort(k := np.concatenate([h[0] for h in held]), kind="stable")
        yield rows((k[order], np.concatenate([h[1] for h in held])[order]))


def _merge(least: int):
    """Sum the runs of a part: rows (x, y, a, id) of frequent pairs, and for each run that has any the rows (block, kept) with their keys and ids."""
    names = ["x", "y", "a", "id", "block", "kept"]
    kinds = [pa.int64()] * 5 + [pa.binary()]

    def merge(blocks, own):
        x, y, n, place = summed(own)
        part = (TaskContext.get().partitionId() << 40) + merge.done
        merge.done += len(x)
        keep = n >= least
        ident = part + np.arange(len(x))
        k = int(keep.sum())
        yield pa.RecordBatch.from_arrays([pa.array(v[keep]) for v in (x, y, n, ident)] + [pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())], names)
        at = 0
        for b, r in zip(blocks, own):
            mine = place[at:at + len(r[0])]
            at += len(r[0])
            hit = keep[mine]
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, t) for t in kinds[:4]] + [pa.array([b], pa.int64()), pa.array([pack(r[3][hit], ident[mine][hit])], pa.binary())], names)

    merge.done = 0
    return merge


MERGED = "x long, y long, a long, id long, block long, kept binary"


def _level(runs: DataFrame, parts: int, least: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows (x, y, a, id) of frequent pairs, rows (block, kept))"""
    done = materialise(merged_parts(runs, parts, _merge(least), MERGED), name)
    return done.where("id is not null").select("x", "y", "a", "id"), done.where("block is not null").select("block", "kept")


def phrase_counts(docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Frequent words (lang, word, gid, c), all words of each language (lang, n), frequent pairs of words (x, y, a, id), and of pairs (x, y, a, id)."""
    spark = docs.sparkSession
    blocks = materialise(_blocks(docs, text_col, lang_col), "phrase_blocks")
    tokens = blocks.agg(F.sum("tokens")).first()[0] or 0
    parts = n_parts(tokens)
    text = F.col("word").cast("string")  # the language, a space, and a word, which holds none
    word = F.substring_index(text, " ", -1)
    lang = F.expr("left(cast(word as string), length(cast(word as string)) - length(substring_index(cast(word as string), ' ', -1)) - 1)")
    named = lambda df: df.withColumns({"word": word, "lang": lang})
    with wide_rows(spark):
        totals = materialise(word_totals(blocks, 1), "word_totals")
        frequent = totals.where(F.col("c") >= least)

        def words_level(batches):
            for batch in batches:
                for block, ids, vocab in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    sequence = unpack_ids(ids)
                    gid, _ = vocabulary(vocab, int(sequence.max(initial=0)))
                    gid = np.concatenate([[-1], gid])
                    yield from _runs(block, np.where(gid[sequence] >= 0, sequence, 0), gid, parts)

        runs = with_totals(blocks, frequent, "ids").select("block", "ids", "vocab").mapInArrow(words_level, "part long, block long, run binary")
        two, kept = _level(runs, parts, least, "word_pairs")

        def pairs_level(batches):
            for batch in batches:
                for block, ids, found in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    key, ident = (np.concatenate(c) for c in zip(*(unpack(f) for f in found)))
                    order = np.argsort(key)
                    key, ident = key[order], ident[order]
                    sequence = unpack_ids(ids)
                    at, own = pairs(sequence)
                    number = np.minimum(np.searchsorted(key, own), len(key) - 1)
                    following = np.zeros(len(sequence), dtype=np.int64)
                    following[at] = np.where(key[number] == own, number + 1, 0)
                    yield from _runs(block, following, np.concatenate([[-1], ident]), parts)

        answers = kept.groupBy("block").agg(F.collect_list("kept").alias("kept"))
        runs = blocks.select("block", "ids").join(answers, "block").select("block", "ids", "kept").mapInArrow(pairs_level, "part long, block long, run binary")
        three, _ = _level(runs, parts, least, "pair_pairs")
    discard(blocks)
    sizes = named(totals.select("word", "c")).groupBy("lang").agg(F.sum("c").alias("n"))
    return named(frequent.select("word", "gid", "c")), sizes, two, three


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): the best phrases of two and three words of each language.

    Texts are lower-cased (A-Z) and cut at ``.,;:!?`` and line ends into pieces; words are what spaces and tabs leave. a counts all
    occurrences of the phrase, overlaps included, l and r those of its parts at the cut with the least score
    floor(1000000 a a / (l r)), the first such cut; n counts all words of the language. Phrases that lie in a longer candidate for
    ``covered`` percent of their occurrences or more are left out. Order: score, a (both falling), phrase (bytes). All arithmetic
    is exact. A null language is ``und``; null and empty texts have no words; repeated rows count again; other columns are ignored;
    an empty table gives an empty one. Only lists of one block are ever held as a whole.
    """
    words, sizes, two, three = phrase_counts(docs, least, text_col, lang_col)

    def scored(a: str, left: str, right: str):
        return F.expr(f"(cast({SCALE} as decimal(7,0)) * cast({a} as decimal(15,0)) * cast({a} as decimal(15,0))) div (cast({left} as decimal(19,0)) * cast({right} as decimal(19,0)))")

    first = words.select(F.col("gid").alias("x"), "lang", F.col("word").alias("w1"), F.col("c").alias("c1"))
    second = words.select(F.col("gid").alias("y"), F.col("word").alias("w2"), F.col("c").alias("c2"))
    pair = two.join(first, "x").join(second, "y").select("id", "lang", "w1", "w2", "a", "c1", "c2")
    pair = materialise(pair.withColumn("score", scored("a", "c1", "c2")), "pairs")
    left = pair.select(F.col("id").alias("x"), "lang", "w1", "w2", F.col("a").alias("a12"), "c1")
    right = pair.select(F.col("id").alias("y"), F.col("w2").alias("w3"), F.col("a").alias("a23"), F.col("c2").alias("c3"))
    triple = three.join(left, "x").join(right, "y").withColumn("s1", scored("a", "c1", "a23")).withColumn("s2", scored("a", "a12", "c3"))
    one = F.col("s1") <= F.col("s2")
    triples = triple.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(one, F.col("c1")).otherwise(F.col("a12")).alias("l"), F.when(one, F.col("a23")).otherwise(F.col("c3")).alias("r"), F.least("s1", "s2").alias("score"))
    longer = three.select(F.explode(F.array("x", "y")).alias("id"), F.col("a").alias("long")).groupBy("id").agg(F.max("long").alias("long"))
    alone = pair.join(longer, "id", "left").where(F.col("long").isNull() | (F.col("long") * 100 < F.col("a") * covered))
    doubles = alone.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("c1").alias("l"), F.col("c2").alias("r"), "score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = doubles.union(triples).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


SQL = f"""
WITH pieces AS (
  SELECT lang, list_filter(string_split(replace(piece, chr(9), ' '), ' '), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
        FROM documents)
),
f1 AS (SELECT lang, w1, count(*) AS c FROM (SELECT lang, unnest(w) AS w1 FROM pieces) GROUP BY ALL),
sizes AS (SELECT lang, sum(c)::BIGINT AS n FROM f1 GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w))) AS i FROM pieces WHERE len(w) > 1),
f2 AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, count(*) AS a FROM places GROUP BY ALL HAVING count(*) >= {LEAST}),
f3 AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3, count(*) AS a FROM places WHERE i + 1 < len(w) GROUP BY ALL HAVING count(*) >= {LEAST}),
three AS (
  SELECT f3.*, x.c AS c1, z.c AS c3, p.a AS a12, q.a AS a23,
         ({SCALE}::HUGEINT * f3.a * f3.a) // (x.c::HUGEINT * q.a) AS s1, ({SCALE}::HUGEINT * f3.a * f3.a) // (p.a::HUGEINT * z.c) AS s2
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f1 z ON z.lang = f3.lang AND z.w1 = f3.w3
  JOIN f2 p ON p.lang = f3.lang AND p.w1 = f3.w1 AND p.w2 = f3.w2 JOIN f2 q ON q.lang = f3.lang AND q.w1 = f3.w2 AND q.w2 = f3.w3
),
longer AS (
  SELECT lang, w1, w2, max(a) AS most FROM (SELECT lang, w1, w2, a FROM f3 UNION ALL SELECT lang, w2, w3, a FROM f3) GROUP BY ALL
),
candidates AS (
  SELECT f2.lang, concat_ws(' ', f2.w1, f2.w2) AS phrase, f2.a, x.c AS l, y.c AS r, ({SCALE}::HUGEINT * f2.a * f2.a) // (x.c::HUGEINT * y.c) AS score
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
  LEFT JOIN longer o ON o.lang = f2.lang AND o.w1 = f2.w1 AND o.w2 = f2.w2
  WHERE o.most IS NULL OR 100 * o.most < {COVERED} * f2.a
  UNION ALL
  SELECT lang, concat_ws(' ', w1, w2, w3), a, CASE WHEN s1 <= s2 THEN c1 ELSE a12 END, CASE WHEN s1 <= s2 THEN a23 ELSE c3 END, least(s1, s2) FROM three
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM candidates) JOIN sizes USING (lang)
WHERE rank <= {TOP}
"""
