import glob
import struct
import zlib

import public_tokenizers
import pyarrow.orc
from tokenizers import Tokenizer

from tabstudy.llm import QUERIES, tokens
from tabstudy.llm.common import scratch

PATH = public_tokenizers.path("word_bpe_49k.json")


def slow(rows):
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_whole_table_against_whole_texts(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert got(QUERIES["op10_token_orc"](spark, folder)) == slow(rows)


def test_edges_and_lookup(spark, docs):
    rows = [(5, None), (3, ""), (8, " \n "), (None, "null id"), (2, "It's <|endoftext|> é ́x a b c \x1c d\x85e İI ΑΣ 123 日本語 😀"), (7, "same"), (7, "same"), (9, "w " * 50_000), (4, "x" * 20_000)]
    path = scratch(spark, "orc")
    tokens.write_tokens(docs(rows, ["ids", "block", "tie"]), path, PATH, 2)
    assert got(tokens.token_table(spark, path)) == slow(rows)
    assert sorted(r.doc_id for r in tokens.read_tokens(spark, path, [7, 9]).collect()) == [7, 7, 9]
    plan = tokens.read_tokens(spark, path, [7])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in plan
    assert all(pyarrow.orc.ORCFile(f).nstripes >= 1 for f in glob.glob(f"{path}/*.orc"))
    tokens.write_tokens(docs([]), empty := scratch(spark, "orc"), PATH, 2)
    assert tokens.token_table(spark, empty).count() == 0


def test_kept_lists_survive_shrinking():
    import numpy as np

    from tabstudy.llm.common import Ragged

    make = lambda keys: (np.array([int(k) for k in keys for _ in range(int(k) % 4)]), np.array([int(k) % 4 for k in keys]), np.array([float(k) for k in keys]))
    kept, rng = Ragged(make, limit=40, extras=1), np.random.default_rng(0)
    for _ in range(60):
        keys = [str(int(x)) for x in rng.geometric(0.02, 50)]
        slots = kept.find(keys)
        assert kept.gather(slots).tolist() == [int(k) for k in keys for _ in range(int(k) % 4)]
        assert kept.extra[0][slots].tolist() == [float(k) for k in keys]
        assert len(kept.slots) <= 40 + 50
