

import corpus_pipeline
import public_tokenizers
import sentencepiece
from test_decontaminate import slow as slow_contamination
from test_simhash import slow_components, slow_fingerprint
from test_substrings import exact_repeats

from tabstudy.llm import QUERIES
from tabstudy.llm.common import materialise


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_each_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, taken = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialise(stage(spark, docs, folder), name)
        taken[name] = (pairs(before), pairs(docs))
        assert name == "sentencepiece" or docs.columns == columns
    before, after = taken["quality_classifier"]
    good = {r.doc_id for r in QUERIES["op6_quality_classifier"](spark, folder).collect() if r.predicted}
    assert sorted(after) == sorted(x for x in before if x[0] in good) and 0 < len(after) < len(before)
    before, after = taken["simhash_near_dedup"]
    ids = [i for i, _ in before]
    groups = slow_components(ids, [slow_fingerprint(t) for _, t in before])
    assert sorted(after) == sorted(x for x, g in zip(before, groups) if x[0] == g)
    before, after = taken["substring_dedup"]
    want, left = exact_repeats(before), dict(after)
    assert not exact_repeats(after)
    assert all(left[i] == t for i, t in before if i in left and i not in want and len(left[i]) == len(t))
    assert {i for i, _ in before} - set(left) <= set(want)
    before, after = taken["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    bad = {r[0]: (r[2], r[5]) for r in slow_contamination(before, items)}
    assert sorted(i for i, _ in after) == sorted(i for i, _ in before if not bad[i][1])
    assert all(t == dict(before)[i] for i, t in after if not bad[i][0])
    assert all(r[2] == 0 or bad[r[0]][0] > r[2] for r in slow_contamination(after, items))
    before, after = taken["sentencepiece"]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert sorted(after) == sorted(before)
    assert all(library.decode(list(r.ids)) == r.text and list(r.scores) == sorted(r.scores, reverse=True) for r in docs.collect())


def test_run_takes_rows_of_clashing_names(spark, tmp_path, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "'x' AS score", "1 AS key", "'y' AS fp", "2 AS uid", "lang AS label")
    docs = docs.union(docs.limit(5)).union(docs.limit(3).selectExpr("CAST(NULL AS BIGINT)", "NULL", *[f"`{c}`" for c in docs.columns[2:]]))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "ids", "scores", "text"] and out.count() > 50
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

