"""SimHash near-duplicates: fingerprints, BK-trees over shards of them, connected components.

Fingerprints within ``radius`` bits agree on at least one of ``radius + 1`` blocks of bits. Each distinct fingerprint goes to the
shard of each of its blocks; a shard's members form a BK-tree (children keyed by integer Hamming distance to the parent) and
each member follows only edges within the radius. Shard trees travel to their own queries by shuffle: together they grow with
the corpus, so none is broadcast. Shards above ``TREE`` members are cut by further blocks, and what is still larger is cut into
several trees that all of the shard's members query. A shard emits a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, map_batches, materialise, raw_texts
from .components import connected_components

SEED = 42
TREE = 4096  # members of one BK-tree
LEVELS = 3
SLICE = 65_536  # shingles counted at once


def fingerprint(text: bytes, words_per_shingle: int = 3) -> int:
    """64-bit SimHash of a text's word shingles, each as often as it occurs; 0 without words. A text with fewer words is one shingle."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - words_per_shingle + 1)
    bits, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    stops = ends[-n:].tolist()
    firsts = starts[:n].tolist()
    for at in range(0, n, SLICE):
        h = np.array([digest(joined[i:j], SEED) for i, j in zip(firsts[at:at + SLICE], stops[at:at + SLICE])], dtype=np.uint64)
        bits += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """Rows (doc_id, fp): one per row of ``docs``, fp the fingerprint as a signed long. A null text has fingerprint 0."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(t, words_per_shingle) for t in raw_texts(batch.column(1))], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, fp long")


class BKTree:
    """Children are keyed by integer Hamming distance to the parent."""

    def __init__(self, values: list[int]):
        self.values, self.children = list(values), [{} for _ in values]
        for i in range(1, len(values)):
            self._insert(i)
        self._flat = None

    def _insert(self, i: int) -> None:
        at, value = 0, self.values[i]
        while True:
            d = (self.values[at] ^ value).bit_count()
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = i
                return
            at = below

    def within(self, query: int, radius: int) -> list[int]:
        """Indexes of the members within ``radius``, visiting only children whose key can hold any."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ query).bit_count()
            if d <= radius:
                found.append(at)
            todo.extend(child for key, child in self.children[at].items() if d - radius <= key <= d + radius)
        return found

    def within_many(self, queries: np.ndarray, radius: int, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query index, member index) of all links, in blocks; one step for each level of the tree."""
        if self._flat is None:
            counts = np.array([len(c) for c in self.children])
            self._flat = (np.array(self.values, dtype=np.uint64), np.cumsum(counts) - counts, counts,
                          np.array([k for c in self.children for k in c], dtype=np.int64), np.array([i for c in self.children for i in c.values()], dtype=np.int64))
        values, first, counts, keys, nodes = self._flat
        for start in range(0, len(queries), block):
            q = np.arange(start, min(start + block, len(queries)))
            at = np.zeros(len(q), dtype=np.int64)
            while len(q):
                d = np.bitwise_count(values[at] ^ queries[q]).astype(np.int64)
                near = d <= radius
                if near.any():
                    yield q[near], at[near]
                n = counts[at]
                q, d, edge = np.repeat(q, n), np.repeat(d, n), np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                go = np.abs(keys[edge] - d) <= radius
                q, at = q[go], nodes[edge[go]]


def _links(members: list[int], queries: list[int], radius: int) -> list[tuple[int, int]]:
    """Spanning forest, as (node, root), of all links between queries and members."""
    parent = {v: v for v in queries}

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    def join(a: int, b: int) -> None:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)

    tree = BKTree(members)
    if len(members) < 64:
        for q in queries:
            for i in tree.within(q, radius):
                join(q, members[i])
    else:
        for q, i in tree.within_many(np.array(queries, dtype=np.uint64), radius):
            for a, b in zip(q.tolist(), i.tolist()):
                if queries[a] != members[b]:
                    join(queries[a], members[b])
    return [(v, r) for v in queries if (r := root(v)) != v]


def _search(radius: int):
    """Over rows sorted by shard and tree: build each tree, query it with all rows of its shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fps, own = None, [], []

        def flush() -> pa.RecordBatch | None:
            members = [f for f, m in zip(fps, own) if m]
            found = _links(members, fps, radius) if members and len(fps) > 1 else []
            if found:
                pairs = np.array(found, dtype=np.uint64).view(np.int64).reshape(-1, 2)
                return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
            return None

        for batch in batches:
            mask, value, tree, fp, member = (batch.column(i) for i in range(5))
            groups = zip(mask.to_pylist(), value.to_pylist(), tree.to_pylist())
            for k, f, m in zip(groups, fp.to_numpy().view(np.uint64).tolist(), member.to_pylist()):
                if k != key:
                    if (out := flush()) is not None:
                        yield out
                    key, fps, own = k, [], []
                fps.append(f)
                own.append(m)
        if (out := flush()) is not None:
            yield out

    return run


def _masks(radius: int) -> tuple[list[int], dict[int, list[int]]]:
    """Masks of the first blocks, and for each mask those that also fix a block of the bits it leaves open."""

    def cut(fixed: int) -> list[int]:
        open_bits = [b for b in range(64) if not fixed >> b & 1]
        return [fixed | sum(1 << int(b) for b in part) for part in np.array_split(open_bits, radius + 1)]

    first, below = cut(0), {}
    level = first
    for _ in range(LEVELS - 1):
        below |= {m: cut(m) for m in level}
        level = [m for x in level for m in below[x]]
    return first, below


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def links(fps: DataFrame, radius: int = 3, tree: int = TREE) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints within ``radius`` bits, directly or through others. ``fps`` has distinct longs ``fp``."""
    first, below = _masks(radius)
    lits = lambda masks: F.array(*[F.lit(_signed(m)).cast("long") for m in masks])
    shards = fps.select("fp", F.explode(lits(first)).alias("mask")).withColumn("value", F.expr("fp & mask"))
    found = None
    for level in range(LEVELS):
        last = level == LEVELS - 1
        large = materialise(shards.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > tree), "large_shards")
        some = not large.isEmpty()
        work = shards.join(large, ["mask", "value"], "left_anti").withColumn("n", F.lit(1)) if some and not last else shards.join(large, ["mask", "value"], "left") if some else shards.withColumn("n", F.lit(1))
        trees = F.ceil(F.coalesce("n", F.lit(1)) / tree).cast("int")
        work = work.withColumn("own", F.pmod(F.xxhash64("fp"), trees)).withColumn("tree", F.explode(F.sequence(F.lit(0), trees - 1)))
        work = work.select("mask", "value", "tree", "fp", (F.col("own") == F.col("tree")).alias("member"))
        part = work.repartition("mask", "value", "tree").sortWithinPartitions("mask", "value", "tree", "fp").mapInArrow(lean(_search(radius)), "a long, b long")
        found = part if found is None else found.union(part)
        if last or not some:
            return found
        deeper = F.create_map(*[x for m, ms in below.items() for x in (F.lit(_signed(m)).cast("long"), lits(ms))])
        shards = shards.join(large.drop("n"), ["mask", "value"], "left_semi").select("fp", F.explode(deeper[F.col("mask")]).alias("mask")).distinct().withColumn("value", F.expr("fp & mask"))
    return found


def _components(docs: DataFrame, id_col: str, text_col: str, words_per_shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, fp) of all documents, and (fp, component_id, root) of all fingerprints."""
    marked = materialise(fingerprints(docs, id_col, text_col, words_per_shingle), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = materialise(connected_components(links(distinct.select("fp"), radius)), "roots")
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return marked, named.join(least, "root").select("fp", "component_id", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, radius: int = 3) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one for each row of ``docs``.

    fingerprint: 16 hex digits. component_id: the least doc_id that can be reached over fingerprints within ``radius`` bits, itself
    included. Null and empty texts have fingerprint 0 and link like others. Repeated rows stay repeated. A null doc_id stays null and
    never is the least one; where a component has no other id, component_id is null. Other columns are ignored; an empty table gives an empty one.
    """
    marked, table = _components(docs, id_col, text_col, words_per_shingle, radius)
    return marked.join(table.drop("root"), "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """One row of each component of ``docs``, one with the least doc_id, all columns kept.

    Among rows of that id in the component the one whose text has the least hash stays; a component without any id keeps one row likewise.
    Rows that share an id but lie in different components each stand for their own. Null and empty texts form a component; an empty
    table gives an empty one.
    """
    marked, table = _components(docs, id_col, text_col, 3, radius)
    # of each component one fingerprint: the least of those with the least id
    own = marked.distinct().join(table, "fp").where(F.col("component_id").eqNullSafe(F.col("doc_id")))
    keepers = own.groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("k")).select(F.col("k.doc_id").alias("_keeper_id"), F.col("k.fp").alias("_keeper_fp"))
    times = marked.groupBy("doc_id").agg(F.count("*").alias("_times"))
    keepers = materialise(keepers.join(times, keepers["_keeper_id"].eqNullSafe(times["doc_id"])).drop("doc_id"), "keepers")
    same = lambda k: F.col(id_col).cast("long").eqNullSafe(k["_keeper_id"])
    once, often = keepers.where("_times = 1"), keepers.where("_times > 1")
    # rows that share an id are told apart by their own fingerprints
    rows = with_fingerprints(docs.join(often, same(often), "left_semi"), text_col, "_row_fp")
    kept = rows.join(often, same(often) & (F.col("_row_fp") == often["_keeper_fp"]), "left_semi")
    order = Window.partitionBy(F.col(id_col).cast("long"), "_row_fp").orderBy(F.xxhash64(text_col), text_col)
    first = kept.withColumn("_row_of_group", F.row_number().over(order)).where("_row_of_group = 1").select(*docs.columns)
    return docs.join(once, same(once), "left_semi").union(first)


def with_fingerprints(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """``docs`` with the fingerprint of each row's text as a further column."""
    columns, at = docs.columns, docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(t) for t in raw_texts(batch.column(at))], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(values.view(np.int64))], [*columns, name])

    return map_batches(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{name}` long")
