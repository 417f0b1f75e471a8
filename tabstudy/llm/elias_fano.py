"""Rising sequences in Elias-Fano form, and tries of such levels, laid out in one flat buffer that can be mapped into memory."""

from __future__ import annotations

import mmap

import numpy as np

_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)
_PLACE = np.full((256, 8), 8, dtype=np.uint8)  # place of the k-th one of a byte
for _i in range(256):
    _PLACE[_i, :_ONES[_i]] = [b for b in range(8) if _i >> b & 1]


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one (from 0); ``before`` counts the ones in front of each word. Many are read off a list of all ones."""
    if 4 * len(k) > len(words):
        return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little").view(bool))[k]
    word = np.searchsorted(before, k, "right") - 1
    left = k - before[word]
    byte = words[word].reshape(-1, 1).view(np.uint8).reshape(-1, 8)
    upto = np.cumsum(_ONES[byte], axis=1, dtype=np.int64)
    at = (upto <= left[:, None]).sum(axis=1)
    row = np.arange(len(k))
    left = left - (upto[row, at] - _ONES[byte[row, at]])
    return word * 64 + at * 8 + _PLACE[byte[row, at], left]


class EliasFano:
    """Non-decreasing numbers: low bits side by side, high bits in unary."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        count = np.bitwise_count(high).astype(np.int64)
        self.ones = np.cumsum(count) - count
        self.zeros = np.arange(len(high)) * 64 - self.ones

    @staticmethod
    def encode(values: np.ndarray) -> list[np.ndarray]:
        """Head (n, low bits, words of low, words of high), low, and high bits."""
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        v = values.astype(np.uint64)
        low = np.zeros(n * bits // 64 + 2, dtype=np.uint64)
        if bits:
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            part, word, shift = v & np.uint64((1 << bits) - 1), (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(bits) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        place = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(((top >> bits) + n + 2) // 64 + 1, dtype=np.uint64)
        np.bitwise_or.at(high, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
        return [np.array([n, bits, len(low), len(high)], dtype=np.uint64), low, high]

    def _low(self, j: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(j), dtype=np.int64)
        at = j * self.low_bits
        if self.low_bits <= 57:  # eight bytes from any place hold a number
            at_byte = np.ndarray(8 * len(self.low) - 7, dtype="<u8", buffer=self.low, strides=(1,))
            return (at_byte[at >> 3] >> (at & 7).astype(np.uint64) & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        upper = np.where(shift > 0, self.low[word + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return ((self.low[word] >> shift | upper) & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def access(self, j: np.ndarray) -> np.ndarray:
        return (_select(self.high, self.ones, j) - j) << self.low_bits | self._low(j)

    def find(self, v: np.ndarray) -> np.ndarray:
        """Place of each number, -1 where it is not there: the successor in its run of equal high bits."""
        out = np.full(len(v), -1, dtype=np.int64)
        if not self.n:
            return out
        h = v >> self.low_bits
        some = np.flatnonzero((h < len(self.high) * 64 - self.n) & (v >= 0))
        h, want = h[some], v[some] & ((1 << self.low_bits) - 1)
        inverted = ~self.high
        low = np.zeros(len(h), dtype=np.int64)
        later = np.flatnonzero(h > 0)
        both = _select(inverted, self.zeros, np.concatenate([h, h[later] - 1]))
        low[later] = both[len(h):] + 1 - h[later]
        end = np.minimum(both[:len(h)] - h, self.n)
        high = end.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) >> 1
            less = self._low(middle) < want[open_]
            low[open_] = np.where(less, middle + 1, low[open_])
            high[open_] = np.where(less, high[open_], middle)
        hit = np.flatnonzero(low < end)
        hit = hit[self._low(low[hit]) == want[hit]]
        out[some[hit]] = low[hit]
        return out


def _ranked(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and the rank of each; by a table instead of a sort where it is short."""
    top = int(v.max()) + 1 if len(v) and v.min() >= 0 else 0
    if not 0 < top <= 4 * len(v):
        return np.unique(v, return_inverse=True)
    held = np.zeros(top, dtype=bool)
    held[v] = True
    return np.flatnonzero(held), (np.cumsum(held, dtype=np.int32) - 1)[v].astype(np.int64)


class Trie:
    """Quantised values of pairs (context, word): levels of contexts, pointers to their successors, the successors, and the values.

    A successor is kept as the rank of its word plus what the last one of the context before ends with, so that the level rises.
    """

    def __init__(self, buffer):
        at, levels = 0, []
        for _ in range(4):
            n, bits, low, high = (int(v) for v in np.frombuffer(buffer, np.uint64, 4, at))
            levels.append(EliasFano(n, bits, np.frombuffer(buffer, np.uint64, low, at + 32), np.frombuffer(buffer, np.uint64, high, at + 32 + 8 * low)))
            at += 32 + 8 * (low + high)
        self.words, self.contexts, self.pointers, self.successors = levels
        self.values = np.frombuffer(buffer, np.uint16, self.successors.n, at)

    @classmethod
    def mapped(cls, levels: bytes) -> Trie:
        """A trie over an anonymous memory map."""
        area = mmap.mmap(-1, max(1, len(levels)))
        area[:len(levels)] = levels
        return cls(area)

    @staticmethod
    def build(context: np.ndarray, word: np.ndarray, value: np.ndarray) -> bytes:
        """Levels of distinct pairs in order of (context, word), as bytes."""
        words, rank = _ranked(word)
        new = np.flatnonzero(np.diff(context, prepend=-1)) if len(context) else np.zeros(0, dtype=np.int64)
        lengths = np.diff(np.append(new, len(context)))
        last = rank[new + lengths - 1] + 1 if len(new) else rank
        base = np.cumsum(last) - last
        parts = [*EliasFano.encode(words), *EliasFano.encode(context[new]), *EliasFano.encode(np.append(new, len(context))), *EliasFano.encode(rank + np.repeat(base, lengths)), value.astype(np.uint16)]
        return b"".join(p.tobytes() for p in parts)

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Value of each pair, 0 where it is not there."""
        out = np.zeros(len(context), dtype=np.int64)
        # each context and word is looked up once, however many pairs hold it
        if len(context) and (context[1:] >= context[:-1]).all():
            new = np.append(True, context[1:] != context[:-1])
            contexts, which = context[new], np.cumsum(new) - 1
        else:
            contexts, which = np.unique(context, return_inverse=True)
        c = self.contexts.find(contexts)
        known = np.flatnonzero(c >= 0)
        start, end, base = (np.zeros(len(contexts), dtype=np.int64) for _ in range(3))
        start[known], end[known] = self.pointers.access(c[known]), self.pointers.access(c[known] + 1)
        later = start > 0
        base[later] = self.successors.access(start[later] - 1) + 1
        words, of = _ranked(word)
        w = self.words.find(words)[of]
        some = np.flatnonzero((end[which] > 0) & (w >= 0))
        start, end, base = (v[which[some]] for v in (start, end, base))
        at = self.successors.find(base + w[some])
        inside = (at >= start) & (at < end)
        out[some[inside]] = self.values[at[inside]]
        return out
