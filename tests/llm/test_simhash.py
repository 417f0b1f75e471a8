import random

import numpy as np
import xxhash

from tabstudy.llm import QUERIES, simhash
from tabstudy.llm.components import connected_components


def slow_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, fps):
    reach = {i: {i} for i in range(len(fps))}
    seen, out = set(), [None] * len(fps)
    f = np.array(fps, dtype=np.uint64)
    for i in reach:
        if i in seen:
            continue
        todo, part = [i], {i}
        while todo:
            near = set(np.flatnonzero(np.bitwise_count(f ^ f[todo.pop()]) <= 3).tolist()) - part
            part |= near
            todo.extend(near)
        seen |= part
        known = [ids[j] for j in part if ids[j] is not None]
        for j in part:
            out[j] = min(known) if known else None
    return out


def check(df, rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    comps = slow_components([i for i, _ in rows], fps)
    want = sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, comps)), key=str)
    assert sorted((tuple(r) for r in df.collect()), key=str) == want


def test_whole_table_against_brute_force(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    check(QUERIES["op2_simhash"](spark, folder), rows)


def test_nulls_ties_repeats_and_extra_columns(docs):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "one two three four"), (None, "one two three four"), (7, "a b"), (5, "A  b"), (7, "a b"), (9, "x y z É é")]
    check(simhash.near_duplicates(docs(rows, ["fp", "component_id", "root"])), rows)
    assert simhash.near_duplicates(docs([])).count() == 0


def test_very_long_text(docs):
    rnd = random.Random(3)
    rows = [(1, " ".join(rnd.choice("abcdefgh") for _ in range(150_000)))]
    check(simhash.near_duplicates(docs(rows)), rows)


def test_large_shards_are_cut_without_losing_links(spark):
    rnd = random.Random(5)
    centre = rnd.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 9))) for _ in range(300)} | {rnd.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    found = {r.node: r.root for r in connected_components(simhash.links(df, 3, tree=8)).collect()}
    want = slow_components(list(range(len(fps))), fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    got = [found.get(s, s) for s in signed]
    groups = lambda labels: {frozenset(i for i, x in enumerate(labels) if x == y) for y in set(labels)}
    assert groups(got) == groups(want)


def test_tree_visits_find_everything():
    rnd = random.Random(1)
    values = [rnd.getrandbits(10) for _ in range(200)]
    tree = simhash.BKTree(values)
    queries = [rnd.getrandbits(10) for _ in range(50)]
    want = [[i for i, v in enumerate(values) if (v ^ q).bit_count() <= 2] for q in queries]
    assert [sorted(tree.within(q, 2)) for q in queries] == want
    many = [[] for _ in queries]
    for q, i in tree.within_many(np.array(queries, dtype=np.uint64), 2):
        for a, b in zip(q.tolist(), i.tolist()):
            many[a].append(b)
    assert [sorted(m) for m in many] == want


def test_one_row_of_each_group(docs):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(4, long), (2, long), (2, long), (9, "other words entirely in here"), (None, None)]
    assert sorted((r.doc_id or 0) for r in simhash.one_per_group(docs(rows, ["_x"])).collect()) == [0, 2, 9]


def test_shared_ids_and_missing_ids(docs):
    """Texts that share an id but not a group each stand for their own; a copy without an id goes where its group has one."""
    one, two, three = (" ".join(f"{x}{i}" for i in range(60)) for x in ("one", "two", "three"))
    rows = [(1, one), (1, two), (1, two), (2, two), (3, three), (None, three), (None, one + " x"), (None, "alone and without any id at all"), (None, "alone and without any id at all")]
    out = sorted(((r.doc_id, r.text) for r in simhash.one_per_group(docs(rows, ["_x", "fp"])).collect()), key=repr)
    assert out == sorted([(1, one), (1, two), (3, three), (None, "alone and without any id at all")], key=repr)
    assert simhash.one_per_group(docs([])).count() == 0
