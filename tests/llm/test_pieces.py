import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from tabstudy.llm import QUERIES, pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def own():
    return pieces.Encoder(PATH)


@pytest.fixture(scope="module")
def library():
    """The library's own best paths over the same pieces and scores, by its lattice model."""
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(PATH, "rb").read())
    model.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def slow(vocabulary, text):
    """All segmentations, as (score, ids)."""
    def below(at):
        if at == len(text):
            return [(0.0, [])]
        out = []
        for end in range(at + 1, len(text) + 1):
            i = vocabulary.plain.get(text[at:end])
            if i is not None or end == at + 1:
                s, ids = (vocabulary.score[i], [i]) if i is not None else (vocabulary.unknown_score, vocabulary.ids_of(-1, text[at]))
                out += [(s + a, [*ids, *b]) for a, b in below(end)]
        return out
    return sorted(below(0), key=lambda x: -x[0])


TEXTS = ["hello world", "a", " two  spaces", "line\nbreak\t!", "naïve café 日本", "aaaa bbb", "😀x", "in the", "▁", "x y"]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("n", [1, 2, 5, 20])
def test_best_paths_against_all_segmentations(own, text, n):
    want = slow(own.vocabulary, own.vocabulary.normalise(text))
    encoded = own.encode([text], n)[0]
    got = own.paths(encoded, n)
    assert [s for s, _ in got] == pytest.approx([s for s, _ in want[:n]])
    every = {(round(s, 6), tuple(ids)) for s, ids in want}
    assert len({tuple(p.tolist()) for _, p in got}) == len(got) == min(n, len(want))
    assert all((round(s, 6), tuple(p.tolist())) in every for s, p in got)
    assert got[0][1].tolist() == encoded[0].tolist()
    if pieces.SPACE not in text:
        assert all(own.decode(p) == text for _, p in got)


def test_best_scores_against_the_library(own, library, spark, folder):
    # lines without uncovered characters, whose penalty exceeds the precision of the library's scores
    texts = [x[:300] for r in spark.read.parquet(f"{folder}/documents.parquet").limit(40).collect() for x in r.text.split("\n") if x and all(c == " " or c in own.vocabulary.plain for c in x)]
    assert len(texts) > 100
    score = lambda ids: sum(own.vocabulary.score[i] for i in ids)
    pairs = [(t, e) for t, e in zip(texts, own.encode(texts, 4)) if e[1][-1][0] > -1e8]
    assert len(pairs) > 100
    for text, encoded in pairs:
        assert [s for s, _ in encoded[1]] == pytest.approx([score(p) for p in library.nbest_encode(text, nbest_size=4)], abs=1)
        assert library.decode(encoded[0].tolist()) == text


def test_short_and_long_chunks_agree(own, monkeypatch):
    rnd = random.Random(1)
    chunks = ["".join(rnd.choice("abeinrst▁.é日") for _ in range(rnd.randint(1, 20))) for _ in range(300)]
    ids, scores, losses = pieces.best_paths(own.vocabulary, chunks)
    for c, i, s, x in zip(chunks, ids, scores, losses):
        two = pieces.nbest(own.vocabulary, c, 2)
        assert two[0][0] == pytest.approx(s) and (x == np.inf if len(two) == 1 else two[0][0] - two[1][0] == pytest.approx(x))
        assert sum(own.vocabulary.score[j] for j in i if j > 258) == pytest.approx(sum(own.vocabulary.score[j] for j in two[0][1] if j > 258))


def test_whole_table(spark, folder):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    out = QUERIES["op1_sentencepiece"](spark, folder).collect()
    assert sorted(r.doc_id for r in out) == sorted(rows)
    assert all(r.decoded and list(r.scores) == sorted(r.scores, reverse=True) and r.n_paths == pieces.NBEST for r in out if len(rows[r.doc_id]) > 20)


def test_edges(docs, monkeypatch):
    monkeypatch.setattr(pieces, "KNOWN", 50)  # for new encoders
    rows = [(1, None), (2, ""), (None, "null id"), (3, "same"), (3, "same"), (4, "x" * 5_000), (5, "word \n" * 30_000), (6, "\x00\x01 ​"), (7, "日" * 100)]
    df = docs(rows, ["ids", "scores"])
    encoded = pieces.encode(df, PATH, n=3)
    out = sorted(((r.doc_id or 0), len(r.ids), len(r.scores), len(r.nbest)) for r in encoded.collect())
    assert [x[1] for x in out if x[0] in (1, 2)] == [0, 0] and len(out) == len(rows)
    back = sorted(((r.doc_id or 0), r.text) for r in pieces.decode(encoded, PATH).collect())
    assert back == sorted(((i or 0), t or "") for i, t in rows)
    assert all(r.decoded for r in pieces.round_trips(df, PATH).collect())
    assert pieces.encode(docs([]), PATH).count() == 0
