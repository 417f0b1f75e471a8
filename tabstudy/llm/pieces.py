"""SentencePiece encoding and decoding with N-best segmentation.

A text's lattice has an edge for each vocabulary piece at each place and one for each character that no piece covers. Forward
Viterbi gives the best score from the start to every place; these scores are exact heuristics for an A* search that walks back from
the end, so complete paths leave the agenda in the order of their scores. Places that no piece crosses cut the lattice into chunks: a
text's best path is that of its chunks, and only the chunks whose second paths lose least can differ in its N best paths. Chunks are kept once found.
"""

from __future__ import annotations

import heapq
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Ragged, kept, lean, map_batches, slices

SPACE = "▁"
UNKNOWN = 10.0  # a character without a piece scores so much less than the least piece
NBEST = 4
WIDE = 48  # longer chunks are searched one by one
KNOWN = 500_000  # chunks that a worker keeps


class Vocabulary:
    """Pieces, scores and bytes of a model file, and a trie of the pieces as sorted arrays."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.unknown_id = model.unk_id()
        names = [model.id_to_piece(i) for i in range(n)]
        bytes_of = {int(names[i][3:-1], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_ids = [bytes_of.get(b, self.unknown_id) for b in range(256)]
        self.plain = {names[i]: i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        self.score = np.array([model.get_score(i) for i in range(n)])
        self.unknown_score = min(self.score[i] for i in self.plain.values()) - UNKNOWN
        self.longest = max(map(len, self.plain))
        self.surface = [names[i].replace(SPACE, " ").encode() for i in range(n)]
        for b, i in bytes_of.items():
            self.surface[i] = bytes([b])
        for i in range(n):
            if model.is_control(i):
                self.surface[i] = b""
        self.surface[self.unknown_id] = " ⁇ ".encode()
        self.spaced = any(SPACE in p.lstrip(SPACE) for p in self.plain)
        joined = {c for p in self.plain if len(p) > 1 for c in p} - {SPACE}
        whole = "".join(map(re.escape, sorted(joined)))
        # a chunk: spaces and the characters that occur together with others, or one character that never does
        self.chunks = re.compile(f"{SPACE}*[{whole}]+|{SPACE}+|." if joined and not self.spaced else ".+", re.S)
        self._trie()

    def _trie(self) -> None:
        states, edges = {"": 0}, {}
        for p in self.plain:
            for k in range(1, len(p) + 1):
                if p[:k] not in states:
                    states[p[:k]] = len(states)
                edges[states[p[:k - 1]] << 21 | ord(p[k - 1])] = states[p[:k]]
        order = sorted(edges)
        self.keys, self.targets = np.array([*order, 1 << 62], dtype=np.int64), np.array([*(edges[k] for k in order), 0], dtype=np.int64)
        self.piece_at = np.full(len(states), -1, dtype=np.int64)
        for p, i in self.plain.items():
            self.piece_at[states[p]] = i

    def normalise(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def ids_of(self, piece: int, char: str) -> list[int]:
        """Ids of an edge; -1 is a character without a piece, which its bytes stand for."""
        return [piece] if piece >= 0 else [self.byte_ids[b] for b in char.encode("utf-8", "replace")]

    def edges(self, chunk: str) -> list[list[tuple[int, int, float]]]:
        """For each end the edges (start, piece or -1, score), shorter ones first."""
        into: list[list[tuple[int, int, float]]] = [[] for _ in range(len(chunk) + 1)]
        get = self.plain.get
        for end in range(1, len(chunk) + 1):
            for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
                if (i := get(chunk[start:end])) is not None:
                    into[end].append((start, i, float(self.score[i])))
                elif start == end - 1:
                    into[end].append((start, -1, float(self.unknown_score)))
        return into


def forward(into: list[list[tuple[int, int, float]]]) -> list[float]:
    """Best score from the start to each place."""
    best = [0.0] * len(into)
    for end in range(1, len(into)):
        best[end] = max(best[start] + s for start, _, s in into[end])
    return best


def nbest(vocabulary: Vocabulary, chunk: str, n: int) -> list[tuple[float, list[int]]]:
    """The ``n`` best segmentations as (score, ids), best first.

    The agenda holds partial paths from a place to the end; a path's priority is its own score plus the exact best score from the
    start to its place. Of equal ones the latest goes first, and longer pieces are pushed last, so the best path ends in the longest piece.
    """
    into = vocabulary.edges(chunk)
    best = forward(into)
    found: list[tuple[float, list[int]]] = []
    agenda: list = [(-best[-1], 0, len(chunk), 0.0, None)]
    pushed = 0
    while agenda and len(found) < n:
        _, _, at, own, path = heapq.heappop(agenda)
        if not at:
            ids = []
            while path is not None:
                piece, end, path = path
                ids += vocabulary.ids_of(piece, chunk[end - 1])
            found.append((own, ids))
            continue
        for start, piece, s in into[at]:
            pushed += 1
            heapq.heappush(agenda, (-(best[start] + s + own), -pushed, start, s + own, (piece, at, path)))
    return found


def best_paths(vocabulary: Vocabulary, chunks: list[str]) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
    """Best ids of each chunk, their scores, and what the second best path loses (infinite if there is none), all chunks at once.

    The second path uses an edge that the best one does not: the best score over such edges of (forward, edge, backward).
    """
    n, lengths = len(chunks), np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
    wide = int(lengths.max())
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    flat = np.frombuffer("".join(chunks[i] for i in order.tolist()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    first = np.cumsum(lengths) - lengths
    tops = [int(np.searchsorted(-lengths, -p, side="left")) for p in range(wide + 1)]  # rows longer than p
    found = []  # (row, start, end, piece, score)
    for start in range(wide):
        rows = np.arange(tops[start])
        state, covered = np.zeros(len(rows), dtype=np.int64), np.zeros(tops[start], dtype=bool)
        for end in range(start + 1, min(wide, start + vocabulary.longest) + 1):
            live = lengths[rows] >= end
            rows, state = rows[live], state[live]
            key = state << 21 | flat[first[rows] + end - 1]
            at = np.searchsorted(vocabulary.keys, key)
            hit = vocabulary.keys[at] == key
            rows, state = rows[hit], vocabulary.targets[at[hit]]
            piece = vocabulary.piece_at[state]
            full = piece >= 0
            if end == start + 1:
                covered[rows[full]] = True
                bare = np.flatnonzero(~covered)
                if len(bare):
                    found.append((bare, start, end, np.full(len(bare), -1), np.full(len(bare), vocabulary.unknown_score)))
            if full.any():
                found.append((rows[full], start, end, piece[full], vocabulary.score[piece[full]]))
            if not len(rows):
                break
    ahead, back, edge = np.full((n, wide + 1), -np.inf), np.full((n, wide + 1), -np.inf), np.full((n, wide + 1), -1, dtype=np.int64)
    ahead[:, 0] = 0
    for number, (rows, start, end, _, s) in sorted(enumerate(found), key=lambda x: (x[1][2], -x[1][1])):
        total = ahead[rows, start] + s
        better = total >= ahead[rows, end]  # of equal ones the longest, which comes last
        ahead[rows[better], end], edge[rows[better], end] = total[better], number
    back[np.arange(n), lengths] = 0
    for rows, start, end, _, s in sorted(found, key=lambda x: -x[1]):
        back[rows, start] = np.maximum(back[rows, start], s + back[rows, end])
    score = ahead[np.arange(n), lengths]
    used = np.zeros((n, wide + 1), dtype=np.int64) - 1  # by end, the edge of the best path
    place = lengths.copy()
    starts = np.array([f[1] for f in found])
    while (active := np.flatnonzero(place > 0)).size:
        e = edge[active, place[active]]
        used[active, place[active]] = e
        place[active] = starts[e]
    second = np.full(n, -np.inf)
    path: list[list[int]] = [[] for _ in range(n)]
    for number, (rows, start, end, piece, s) in sorted(enumerate(found), key=lambda x: x[1][2]):
        own = used[rows, end] == number
        other = rows[~own]
        second[other] = np.maximum(second[other], ahead[other, start] + s[~own] + back[other, end])
        for r, p in zip(rows[own].tolist(), piece[own].tolist()):
            path[r].append(p) if p >= 0 else path[r].extend(vocabulary.ids_of(p, chunks[order[r]][end - 1]))
    out: list[list[int]] = [[]] * n
    scores, losses = np.zeros(n), np.zeros(n)
    for r, i in enumerate(order.tolist()):
        out[i] = path[r]
    scores[order], losses[order] = score, score - second
    return out, scores, losses


class Encoder:
    """Encodes texts by chunks that it keeps."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.known = Ragged(self._make, KNOWN, 2)  # best ids, their score, what the second path loses
        self.lists: dict[tuple[str, int], list[tuple[float, list[int]]]] = {}

    def _make(self, chunks: list[str]) -> tuple[np.ndarray, ...]:
        out: list[list[int]] = [[]] * len(chunks)
        scores, losses = np.zeros(len(chunks)), np.zeros(len(chunks))
        narrow = [i for i, c in enumerate(chunks) if len(c) <= WIDE]
        if narrow:
            ids, scores[narrow], losses[narrow] = best_paths(self.vocabulary, [chunks[i] for i in narrow])
            for i, x in zip(narrow, ids):
                out[i] = x
        for i, c in enumerate(chunks):
            if len(c) > WIDE:
                two = nbest(self.vocabulary, c, 2)
                scores[i], out[i] = two[0]
                losses[i] = two[0][0] - two[1][0] if len(two) > 1 else np.inf
        return np.fromiter(chain.from_iterable(out), dtype=np.int32), np.array([len(x) for x in out], dtype=np.int64), scores, losses

    def _other(self, chunk: str, n: int) -> list[tuple[float, list[int]]]:
        if len(self.lists) > KNOWN // 20:
            self.lists.clear()
        if (chunk, n) not in self.lists:
            self.lists[chunk, n] = nbest(self.vocabulary, chunk, n)
        return self.lists[chunk, n]

    def encode(self, texts: list[str], n: int = 1) -> list[tuple[np.ndarray, list[tuple[float, list[tuple[int, int]]]], list[str], np.ndarray]]:
        """For each text: the ids of its best path; its ``n`` best paths as (score, [(chunk place, rank)]) with the chunks that are not in their best form; the chunks; the bounds of their ids."""
        parts = [self.vocabulary.chunks.findall(self.vocabulary.normalise(t)) for t in texts]
        slots = self.known.find(list(chain.from_iterable(parts)))
        scores, losses = self.known.extra
        out, at = [], 0
        for p in parts:
            own = slots[at:at + len(p)]
            at += len(p)
            bounds = np.concatenate([[0], np.cumsum(self.known.length[own])])
            score = float(scores[own].sum())
            out.append((self.known.gather(own), self._combine(p, score, losses[own], n), p, bounds))
        return out

    def _combine(self, chunks: list[str], score: float, losses: np.ndarray, n: int) -> list[tuple[float, list[tuple[int, int]]]]:
        """The ``n`` best sums over chunks: only the ``n - 1`` whose second path loses least can change, earlier ones first among equals."""
        if n <= 1 or not len(chunks):
            return [(score, [])]
        few = min(n - 1, len(losses))
        limit = np.partition(losses, few - 1)[few - 1]
        below = np.flatnonzero(losses < limit)
        near = [i for i in np.sort(np.concatenate([below, np.flatnonzero(losses == limit)[:few - len(below)]])).tolist() if np.isfinite(losses[i])]
        lists = [[s - own[0][0] for s, _ in own] for own in (self._other(chunks[i], n) for i in near)]
        found, agenda, seen = [], [(0.0, (0,) * len(near))], {(0,) * len(near)}
        while agenda and len(found) < n:
            loss, ranks = heapq.heappop(agenda)
            found.append((score - loss, [(i, r) for i, r in zip(near, ranks) if r]))
            for k, own in enumerate(lists):
                if ranks[k] + 1 < len(own) and (up := (*ranks[:k], ranks[k] + 1, *ranks[k + 1:])) not in seen:
                    seen.add(up)
                    heapq.heappush(agenda, (-sum(x[r] for x, r in zip(lists, up)), up))
        return found

    def paths(self, encoded, n: int) -> list[tuple[float, np.ndarray]]:
        """The ``n`` best paths of an encoded text, written out."""
        ids, best, chunks, bounds = encoded
        out = []
        for score, changed in best:
            own = ids
            for i, rank in reversed(changed):
                own = np.concatenate([own[:bounds[i]], np.array(self._other(chunks[i], n)[rank][1], dtype=np.int32), own[bounds[i + 1]:]])
            out.append((score, own))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids stand for: pieces and bytes in turn, without the space put in front."""
        raw = b"".join(map(self.vocabulary.surface.__getitem__, ids.tolist()))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", n: int = NBEST, paths: bool = True, decoded: bool = False) -> DataFrame:
    """Rows (doc_id, ids, scores[, nbest][, text]), one for each row of ``docs``: ids of the best path, scores of the ``n`` best, with ``paths`` their ids, best first, and with ``decoded`` the text decoded from the best.

    A null or empty text has no ids and the one score 0. Texts are encoded whole. Repeated rows stay repeated; null ids stay;
    other columns are ignored; an empty table gives an empty one.
    """
    schema = "doc_id long, ids array<int>, scores array<double>" + ", nbest array<array<int>>" * paths + ", text string" * decoded
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        own = kept(Encoder, model)
        for batch in slices(batches, 200):
            found = own.encode([t or "" for t in batch.column(1).to_pylist()], n)
            columns = [batch.column(0), _lists([f[0] for f in found], pa.int32()), pa.array([[s for s, _ in f[1]] for f in found], pa.list_(pa.float64()))]
            if paths:
                columns.append(pa.array([[p for _, p in own.paths(f, n)] for f in found], pa.list_(pa.list_(pa.int32()))))
            if decoded:
                columns.append(pa.array([own.decode(f[0]) for f in found], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), schema)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int32), kind))


def decode(encoded: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """Rows (doc_id, text): the texts that lists of ids stand for; null ids give a null text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = kept(Encoder, model)
        texts = [None if x is None else own.decode(np.array(x, dtype=np.int64)) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_batches(encoded.select("doc_id", ids_col), run, "doc_id long, text string")


def round_trips(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", n: int = NBEST) -> DataFrame:
    """Rows (doc_id, n_pieces, ids_crc32, score, scores, n_paths, decoded), one for each row of ``docs``: decoded tells whether decoding the best path and the last of the ``n`` best give the text back."""
    def run(batches):
        own = kept(Encoder, model)
        for batch in slices(batches, 200):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            for text, f in zip(texts, own.encode(texts, n)):
                scores = [s for s, _ in f[1]]
                last = own.paths((f[0], f[1][-1:], f[2], f[3]), n)[0][1] if len(scores) > 1 else f[0]
                rows.append((len(f[0]), zlib.crc32(f[0].astype("<u4")), scores[0], scores, len(scores), own.decode(f[0]) == text and (last is f[0] or own.decode(last) == text)))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(zip(*rows), kinds))], ["doc_id", "n_pieces", "ids_crc32", "score", "scores", "n_paths", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), "doc_id long, n_pieces long, ids_crc32 long, score double, scores array<double>, n_paths int, decoded boolean")
