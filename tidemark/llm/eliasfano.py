"""Elias-Fano sequences and the two-level n-gram trie over them, as flat buffers that are read in place."""

from __future__ import annotations

import numpy as np

from .common import U64


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    """Values of `width` bits one after another, and eight bytes of padding."""
    if not width:
        return np.zeros(8, np.uint8)
    spread = (values[:, None] >> np.arange(width, dtype=U64)) & U64(1)
    return np.concatenate((np.packbits(spread.astype(np.uint8).ravel(), bitorder="little"), np.zeros(8, np.uint8)))


def _read_bits(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(at), U64)
    bit = at * width
    byte, shift = bit >> 3, (bit & 7).astype(U64)
    value = np.zeros(len(at), U64)
    for k in range((width + 14) // 8):
        value |= data[byte + k].astype(U64) << U64(8 * k)
    return (value >> shift) & U64((1 << width) - 1)


class EliasFano:
    """A non-decreasing sequence of n numbers below `bound` in about 2 + log2(bound / n) bits each.

    The low bits stand packed; the high bits are a unary bit vector with the number of ones before each 64-bit word.
    """

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.width, self.low, self.high = n, width, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(ones)))
        self.zeros_before = np.arange(len(self.before)) * 64 - self.before

    @staticmethod
    def pack(values: np.ndarray, bound: int) -> list[np.ndarray]:
        n = len(values)
        values = values.astype(U64)
        width = max(0, int(max(bound, 1) // max(n, 1)).bit_length() - 1)
        top = (values >> U64(width)).astype(np.int64)
        size = (int(top[-1]) if n else 0) + n + 2
        bits = np.zeros((size + 63) // 64 * 64, np.uint8)
        bits[top + np.arange(n)] = 1
        return [np.array([n, width], np.int64), _bits(values & U64((1 << width) - 1), width), np.packbits(bits, bitorder="little").view(U64)]

    @classmethod
    def open(cls, parts: list[np.ndarray]) -> EliasFano:
        head = parts[0].view(np.int64)
        return cls(int(head[0]), int(head[1]), parts[1], parts[2].view(U64))

    def _select(self, before: np.ndarray, k: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Place of the k-th (from 0) one of `words`, of which `before[w]` come before word w."""
        word = np.searchsorted(before, k, "right") - 1
        left, value, place = k - before[word], words[word], word * 64
        for step in (32, 16, 8, 4, 2, 1):
            half = np.bitwise_count(value & U64((1 << step) - 1)).astype(np.int64)
            over = left >= half
            left = np.where(over, left - half, left)
            value = np.where(over, value >> U64(step), value)
            place = place + np.where(over, step, 0)
        return place

    def at(self, index: np.ndarray) -> np.ndarray:
        """The values at the indices."""
        high = self._select(self.before, index, self.high) - index
        return (high.astype(U64) << U64(self.width)) | _read_bits(self.low, index, self.width)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value that is x or larger (n if there is none)."""
        x = x.astype(U64)
        top = (x >> U64(self.width)).astype(np.int64)
        zeros = int(self.zeros_before[-1])
        inside = top < zeros
        index = np.full(len(x), self.n)
        rows = np.flatnonzero(inside)
        # Values with the same high part stand between two zeros: as many values come before as ones do.
        t = top[rows]
        low = np.where(t > 0, self._select(self.zeros_before, np.maximum(t - 1, 0), ~self.high) - (t - 1), 0)
        high = np.minimum(self._select(self.zeros_before, t, ~self.high) - t, self.n)
        low, want = np.minimum(low, self.n), x[rows] & U64((1 << self.width) - 1)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            less = _read_bits(self.low, middle, self.width) < want[open_]
            low[open_[less]], high[open_[~less]] = middle[less] + 1, middle[~less]
            open_ = open_[low[open_] < high[open_]]
        index[rows] = low
        return index


def _pack_parts(parts: list[np.ndarray]) -> bytes:
    """Parts on 8-byte borders behind their number and sizes."""
    raw = [p.tobytes() for p in parts]
    head = np.array([len(raw), *map(len, raw)], np.int64).tobytes()
    return head + b"".join(r + bytes(-len(r) % 8) for r in raw)


def _open_parts(buffer: np.ndarray) -> list[np.ndarray]:
    many = int(buffer[:8].view(np.int64)[0])
    sizes = buffer[8 : 8 + 8 * many].view(np.int64)
    parts, at = [], 8 + 8 * many
    for size in sizes.tolist():
        parts.append(buffer[at : at + size])
        at += size + (-size % 8)
    return parts


class Trie:
    """Contexts, monotone pointers to their successors, the successors, and a quantised probability for each of them.

    Successors stand relative to their context: the numbers of a context are shifted by the largest number of all contexts
    before it, which makes the whole level monotone. A query finds the context by a successor search in the first level
    and then the shifted number by one in the second.
    """

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, codes: np.ndarray) -> None:
        self.contexts, self.pointers, self.successors, self.codes = contexts, pointers, successors, codes

    @staticmethod
    def build(context: np.ndarray, successor: np.ndarray, codes: np.ndarray) -> bytes:
        """Of pairs sorted by (context, successor), each pair once."""
        first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(context) else np.zeros(0, np.int64)
        last = np.concatenate((first[1:], [len(context)]))[: len(first)] - 1
        shift = np.concatenate(([0], np.cumsum(successor[last].astype(np.int64) + 1)))
        level = successor.astype(np.int64) + np.repeat(shift[:-1], last - first + 1)
        pointers = np.concatenate((first, [len(context)]))
        parts = [EliasFano.pack(context[first], int(context[-1]) + 1 if len(context) else 1), EliasFano.pack(pointers, len(context) + 1), EliasFano.pack(level, int(shift[-1]) + 1)]
        return _pack_parts([p for part in parts for p in part] + [codes.astype(np.uint16)])

    @classmethod
    def open(cls, buffer: bytes | np.ndarray) -> Trie:
        """Over bytes or a memory-mapped array; nothing is copied."""
        parts = _open_parts(np.frombuffer(buffer, np.uint8) if not isinstance(buffer, np.ndarray) else buffer)
        return cls(EliasFano.open(parts[0:3]), EliasFano.open(parts[3:6]), EliasFano.open(parts[6:9]), parts[9].view(np.uint16))

    def lookup(self, context: np.ndarray, many: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Codes (0: not there) of the successors, `many` of them for each of the contexts."""
        out = np.zeros(len(successor), np.uint16)
        if not self.contexts.n or not len(successor):
            return out
        rank = self.contexts.successor(context)
        there = np.flatnonzero(rank < self.contexts.n)
        there = there[self.contexts.at(rank[there]) == context[there].astype(U64)]
        low, high = np.zeros(len(context), np.int64), np.zeros(len(context), np.int64)
        low[there], high[there] = self.pointers.at(rank[there]), self.pointers.at(rank[there] + 1)
        shift = np.zeros(len(context), U64)
        later = there[low[there] > 0]
        shift[later] = self.successors.at(low[later] - 1) + U64(1)
        asked = np.flatnonzero(np.repeat(high > low, many))
        of = np.repeat(np.arange(len(context)), many)[asked]
        target = successor[asked].astype(U64) + shift[of]
        place = self.successors.successor(target)
        fits = (place >= low[of]) & (place < high[of])
        asked, place, target = asked[fits], place[fits], target[fits]
        same = self.successors.at(place) == target
        out[asked[same]] = self.codes[place[same]]
        return out
