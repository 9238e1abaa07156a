"""Fuzzy line dedup: segments of short and MinHash bands of long normalised lines, edit similarity, one occurrence per connected group."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, counted_ranges, free_name, mix, pieces_of, slices, span_hashes, stored, utf8
from .components import components, joined
from .lexicon import normal_words
from .minhash import min_max

_BANDS, _ROWS = 16, 3  # MinHash bands of long lines
_FEW = 5  # pairs with at most so many edits to spare meet by their segments, with certainty
_SEEN = 1 << 18  # forms a task remembers
_HELD = 1 << 19  # marks a task holds before it deals them out
_MANY = 500  # edits up to which pairs are taken together
_LITTLE = 32  # fewer pairs are not worth it
_HELD_LETTERS = 1 << 23  # letters of pairs that a task holds before it counts their edits
_ALL = 4  # lines of a bucket that are all compared at once
_SIEVE = 23  # bits of the index into the fixed-size sieve of lines to be fetched
_BASE = U64(0x9E3779B97F4A7C15)
_MARK = np.dtype([("key", "<u4"), ("node", "<i8"), ("letters", "<u2")])  # 32 bits of the key beside its part; letters up to 65,535
_LINE = pa.schema([(name, pa.int64()) for name in ("doc_id", "row", "line", "form", "check")])


def _line_cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line of every text, and the number of lines of each text (an empty text has one)."""
    breaks = np.flatnonzero(data == 10)
    first = np.searchsorted(breaks, offsets)
    counts = np.diff(first) + 1
    ends = np.insert(breaks, first[1:], offsets[1:])
    starts = np.insert(breaks + 1, first[:-1], offsets[:-1])
    return starts, ends, counts


def budget(length: int, similarity: float) -> int:
    """The most edits that a line of so many letters and a shorter one may differ by."""
    return int((1 - similarity) * length + 1e-9)


def _segments(length: int, edits: int) -> list[tuple[int, int]]:
    """Start and length of edits + 1 segments of even length."""
    cuts = [length * k // (edits + 1) for k in range(edits + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


@lru_cache(4096)
def _spans(length: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tags, starts and ends of the parts by which a line of so many letters meets those within `_FEW` edits.

    As the shorter of a pair it shows its edits + 1 segments, of which one is whole in the longer; as the longer it shows, for
    every shorter length, the places at which a segment can then stand (Pass-Join, with multi-match-aware places).
    """
    spans = {}
    tag = lambda shorter, k, i: shorter << 16 | k << 8 | i
    longer = length
    while longer - budget(longer, similarity) <= length and budget(longer, similarity) <= _FEW:
        k = budget(longer, similarity)
        for i, (at, size) in enumerate(_segments(length, k) if 0 < k < length else []):
            spans[tag(length, k, i), at, at + size] = None
        longer += 1
    k = budget(length, similarity)
    for shorter in range(max(k + 1, length - k), length + 1) if 0 < k <= _FEW else []:
        more = length - shorter
        for i, (at, size) in enumerate(_segments(shorter, k)):
            for start in range(max(0, at - i, at + more - (k - i)), min(length - size, at + i, at + more + (k - i)) + 1):
                spans[tag(shorter, k, i), start, start + size] = None
    tags, starts, ends = np.array(list(spans), np.int64).reshape(-1, 3).T
    return mix(tags.astype(U64)), starts, ends


def _codes(data: np.ndarray) -> np.ndarray:
    """A number for every letter of UTF-8 bytes: its bytes, the first lowest."""
    head = (data & 0xC0) != 0x80
    first = np.flatnonzero(head)
    if not len(first):
        return np.zeros(0, U64)
    inner = np.arange(len(data)) - first[np.maximum(np.cumsum(head) - 1, 0)]
    return np.add.reduceat(data.astype(U64) << (8 * np.maximum(inner, 0)).astype(U64), first)


def _normal_bytes(data: np.ndarray, word_a: np.ndarray, word_b: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words joined by a space, so many (one at least) a line: the bytes of all lines, and their n + 1 offsets."""
    last = np.cumsum(size) - 1
    length = word_b - word_a + 1
    length[last] -= 1
    ends = np.cumsum(length)
    out = np.append(data, np.uint8(32))[counted_ranges(word_a, length)]
    inner = np.ones(len(length), bool)
    inner[last] = False
    out[ends[inner] - 1] = 32
    return out, np.concatenate(([0], ends[last]))


class _Lines:
    """The lines with a word of a column of texts: two hashes of their normal words, and their letters."""

    def __init__(self, texts: pa.Array) -> None:
        self.data, offsets = utf8(texts)
        starts, ends, counts = _line_cuts(self.data, offsets)
        self.word_a, self.word_b, _ = normal_words(self.data, np.unique(np.concatenate((starts, ends)))) if len(self.data) else (starts[:0], starts[:0], None)
        self.hashes = span_hashes(self.data, self.word_a, self.word_b)
        first, last = np.searchsorted(self.word_a, starts), np.searchsorted(self.word_a, ends)
        full = np.flatnonzero(last > first)
        self.at, self.size = first[full], (last - first)[full]
        self.doc = np.repeat(np.arange(len(counts)), counts)[full]
        self.number = counted_ranges(np.zeros(len(counts), np.int64), counts)[full]
        self.form, self.check, self.letters = np.zeros(len(full), U64), np.zeros(len(full), U64), np.zeros(len(full), np.int64)
        if len(full):
            place = counted_ranges(np.zeros(len(full), np.int64), self.size).astype(U64)
            self.form = np.add.reduceat(mix(self.hashes + place * U64(0x2545F4914F6CDD1D)), self.at)
            self.check = np.add.reduceat(mix((self.hashes ^ U64(0xA0761D6478BD642F)) + place * U64(0x9FB21C651E98DF25)), self.at)
            heads = np.concatenate(([0], np.cumsum((self.data & 0xC0) != 0x80)))  # letters before every byte
            self.letters = np.add.reduceat(heads[self.word_b] - heads[self.word_a], self.at) + self.size - 1

    def band_keys(self, of: np.ndarray) -> np.ndarray:
        """`_BANDS` keys of each line by the minimum and maximum, under each permutation, of its set of words; words of less than five bytes count together with the next."""
        if not len(of):
            return np.zeros((0, _BANDS), U64)
        size = self.size[of]
        words = counted_ranges(self.at[of], size)
        at = np.cumsum(size) - size
        hashes = self.hashes[words]
        after = np.append(hashes[1:], U64(0))
        after[at[1:] - 1] = 0
        values = np.where(self.word_b[words] - self.word_a[words] < 5, mix(hashes * U64(0x2545F4914F6CDD1D) + after), hashes)
        signature = min_max(values, at, _BANDS * _ROWS // 2, 11)
        keys = np.zeros((len(of), _BANDS), U64)
        for band in range(_BANDS):
            key = np.full(len(of), U64(band + 1))
            for value in signature[band * _ROWS : (band + 1) * _ROWS]:
                key = mix(key ^ value) + U64(band)
            keys[:, band] = mix(key)
        return keys

    def segment_keys(self, of: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
        """The keys of the parts (`_spans`) of each line, and whose they are: lines of one length together, by hashes of their beginnings."""
        if not len(of):
            return np.zeros(0, U64), of
        words = counted_ranges(self.at[of], self.size[of])
        raw, cuts = _normal_bytes(self.data, self.word_a[words], self.word_b[words], self.size[of])
        codes, letters = _codes(raw), self.letters[of]
        start = np.cumsum(letters) - letters
        keys, whose = [np.zeros(0, U64)], [of[:0]]
        for length in np.unique(letters).tolist():
            tags, a, b = _spans(length, similarity)
            if len(tags):
                mine = np.flatnonzero(letters == length)
                head = np.zeros((length + 1, len(mine)), U64)
                for k in range(length):
                    head[k + 1] = head[k] * _BASE + codes[start[mine] + k] + U64(1)
                power = np.multiply.accumulate(np.concatenate(([U64(1)], np.full(length, _BASE))))
                keys.append(mix(head[b] - head[a] * power[b - a][:, None] ^ tags[:, None]).ravel())
                whose.append(np.tile(of[mine], len(tags)))
        return np.concatenate(keys), np.concatenate(whose)


def _marked(similarity: float, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(part, marks, lines): the keys of the buckets in which every line meets others, dealt by key into `parts`, as packed `_MARK`s.

    Copies within a task are left out as far as a bounded memory tells. Beside them, in any part, a row for some thousand lines with
    a word: a stream of their places and the two hashes of their normal words (`_LINE`).
    """

    def dealt(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, node, letters = (np.concatenate(x) for x in zip(*held))
        part = ((key >> U64(32)) * U64(parts) >> U64(32)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        marks = np.empty(len(key), _MARK)
        marks["key"], marks["node"], marks["letters"] = key[order] & U64(0xFFFFFFFF), node[order], letters[order]
        part = part[order]
        cuts = np.flatnonzero(np.concatenate((part[1:] != part[:-1], [True]))) + 1
        offsets = np.concatenate(([0], cuts)) * _MARK.itemsize
        blobs = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(marks)])
        return pa.RecordBatch.from_arrays([pa.array(part[cuts - 1]), blobs, pa.nulls(len(cuts), pa.binary())], ["part", "marks", "lines"])

    def described(batch: pa.RecordBatch, lines: _Lines) -> pa.RecordBatch:
        doc, sink = pa.array(lines.doc), pa.BufferOutputStream()
        columns = [batch.column("doc_id").take(doc), batch.column("row").take(doc), *map(pa.array, (lines.number, lines.form.view(np.int64), lines.check.view(np.int64)))]
        with pa.ipc.new_stream(sink, _LINE) as stream:
            stream.write_batch(pa.RecordBatch.from_arrays(columns, schema=_LINE))
        part = pa.array([int(lines.form[0] % U64(parts))], pa.int32())
        return pa.RecordBatch.from_arrays([part, pa.nulls(1, pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["part", "marks", "lines"])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, count = [], 0
        for batch in slices(batches, "text", 1 << 20):
            lines = _Lines(batch.column("text"))
            if len(lines.form):
                yield described(batch, lines)
            fresh = np.array([k for k, form in enumerate(lines.form.tolist()) if form not in seen and not seen.add(form)], np.int64)
            if len(seen) > _SEEN:
                seen.clear()
            most = np.array([(budget(n, similarity), budget(int(n / similarity) + 1, similarity)) for n in lines.letters[fresh].tolist()], np.int64).reshape(-1, 2)
            long = fresh[most[:, 1] > _FEW]
            segments, whose = lines.segment_keys(fresh[most[:, 0] <= _FEW], similarity)
            key, whose = np.concatenate((lines.band_keys(long).ravel(), segments)), np.concatenate((np.repeat(long, _BANDS), whose))
            held.append((key, lines.form[whose].view(np.int64), np.minimum(lines.letters[whose], 65535).astype(np.uint16)))
            count += len(key)
            if count > _HELD:
                yield dealt(held)
                held, count = [], 0
        if count:
            yield dealt(held)

    return marked


def _meet(similarity: float) -> Callable[[pa.Table], pa.Table]:
    """Lines that share a bucket and whose lengths allow a link: (a, b) of all pairs of up to `_ALL` lines, or of each line and the smallest.

    What remains of larger buckets, (block, a, letters) of the lines but the smallest, is compared later.
    """

    def meet(table: pa.Table) -> pa.Table:
        marks = np.frombuffer(b"".join(x.as_py() for x in table["marks"]), _MARK)
        order = np.argsort(marks["key"])
        key = marks["key"][order]
        same, several = key[1:] == key[:-1], np.zeros(len(key), bool)
        several[1:] |= same
        several[:-1] |= same
        marks = marks[order[several]]
        marks = marks[np.lexsort((marks["node"], marks["key"]))]
        key, node = marks["key"], marks["node"]
        marks = marks[np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))[: len(key)]]
        key, node, letters = marks["key"].astype(np.int64), marks["node"], marks["letters"].astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
        size = np.diff(np.concatenate((starts, [len(key)])))
        near = lambda x, y: np.abs(letters[x] - letters[y]) <= (1 - similarity) * np.maximum(letters[x], letters[y]) + 1e-6
        bucket = np.repeat(np.arange(len(starts)), size)
        pairs = [np.stack((np.arange(len(key)), starts[bucket]))[:, np.arange(len(key)) != starts[bucket]]]
        for i in range(1, _ALL):
            for j in range(i + 1, _ALL):
                few = starts[(size > j) & (size <= _ALL)]
                pairs.append(np.stack((few + j, few + i)))
        a, b = np.concatenate(pairs, axis=1)
        close = near(a, b)
        a, b = a[close], b[close]
        rest = np.flatnonzero((size[bucket] > _ALL) & (np.arange(len(key)) != starts[bucket]))
        rest = rest[np.lexsort((letters[rest], bucket[rest]))]  # next to each other, those of like length
        close = (bucket[rest[1:]] == bucket[rest[:-1]]) & near(rest[1:], rest[:-1])
        rest = rest[(np.concatenate((close, [False])) | np.concatenate(([False], close)))[: len(rest)]]
        block = (int(table["part"][0].as_py()) << 32 if len(rest) else 0) + key[rest]
        none = pa.nulls(len(a), pa.int64())
        return pa.table({"a": np.concatenate((node[a], node[rest])), "b": pa.chunked_array([pa.array(node[b]), pa.nulls(len(rest), pa.int64())]),
                         "block": pa.chunked_array([none, pa.array(block)]), "letters": pa.chunked_array([none, pa.array(letters[rest])])})

    return meet


def _met(similarity: float) -> Callable[[pa.Table], pa.Table]:
    """`_meet` of a part's marks, and the part's lines."""
    meet = _meet(similarity)

    def met(table: pa.Table) -> pa.Table:
        found = meet(table.select(["part", "marks"]).filter(table["marks"].is_valid()))
        lines = pa.concat_tables([_LINE.empty_table(), *(pa.ipc.open_stream(x.as_buffer()).read_all() for x in table["lines"].drop_null())])
        return pa.concat_tables([found, lines], promote_options="default").select([*found.column_names, *_LINE.names])

    return met


def similar(a: str, b: str, similarity: float) -> bool:
    """Is 1 - edits / longer length at least `similarity`?"""
    longer = max(len(a), len(b))
    most = budget(longer, similarity)
    if abs(len(a) - len(b)) > most:
        return False
    x, y = a.split(" "), b.split(" ")
    if len(x) == len(y) and sum(max(len(u), len(v)) for u, v in zip(x, y) if u != v) <= most:
        return True  # words replaced in their places are edits enough
    if longer > 40:  # an edit takes three trigrams at most and brings as many
        mine, other = Counter(map(hash, zip(a, a[1:], a[2:]))), Counter(map(hash, zip(b, b[1:], b[2:])))
        if len(a) + len(b) - 4 - 2 * sum(min(n, other[t]) for t, n in mine.items() if t in other) > 6 * most:
            return False
    return within(a, b, most)


def within(a: str, b: str, most: int) -> bool:
    """Are at most so many edits between them? Common ends are left out; then whole numbers are the band of bits that `_banded` has in words."""
    if abs(len(a) - len(b)) > most:
        return False
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    short = min(len(x), len(y))
    apart = np.flatnonzero(x[:short] != y[:short])
    head = int(apart[0]) if len(apart) else short
    apart = np.flatnonzero(x[head:][::-1][: short - head] != y[head:][::-1][: short - head])
    tail = int(apart[0]) if len(apart) else short - head
    x, y = x[head : len(x) - tail], y[head : len(y) - tail]
    bits = 2 * most + 2
    full = (1 << bits) - 1
    masks = {c: int.from_bytes(np.packbits(x == c, bitorder="little").tobytes(), "little") << bits for c in np.unique(x).tolist()}
    up, down, score, low = full ^ ((1 << bits - most - 1) - 1), 0, most, bits - 1
    for k, c in enumerate(y.tolist(), most + 1):
        same = masks.get(c, 0) >> k & full
        keep = ((same & up) + up & full ^ up) | same | down
        right = down | full ^ (keep | up)
        left = keep & up
        score += not keep >> low
        keep >>= 1
        up = left | full ^ (keep | right)
        down = keep & right
        if score > 2 * most + len(y) - len(x):
            return False
    first = low - most + len(x) - len(y)
    inside = (1 << low) - 1 >> first << first
    return score - (up & inside).bit_count() + (down & inside).bit_count() <= most


def _laid(codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The letters of texts that start at these places, one text after another."""
    return codes[counted_ranges(start, size)].astype(np.int64)


def _banded(codes: np.ndarray, start: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, top: int) -> np.ndarray:
    """The edits between texts a and b of every pair, if `top` at most; else more than `top`. Texts b stand longest first.

    Hyyro's band of bit vectors: the `top` places on either side of the diagonal are the bits of a few words, moved on letter by
    letter of b for all pairs at a time; so the work follows the letters times the words of a band. Letters are numbered from 1; what
    is looked up of a text is made once for all its pairs.
    """
    (of_a, a), (of_b, b) = np.unique(a, return_inverse=True), np.unique(b, return_inverse=True)
    letters_a, letters_b = _laid(codes, start[of_a], size[of_a]), _laid(codes, start[of_b], size[of_b])
    size_a, size_b = size[of_a][a], size[of_b][b]
    pairs, wide, letters = len(a), top // 32 + 1, int(max(letters_a.max(initial=0), letters_b.max(initial=0))) + 1
    bits, last, one = 64 * wide, U64(63), U64(1)
    longest = int(size_b[0])
    words = (max(int(size_a.max()), longest + top + 1) >> 6) + 2 * wide + 1
    table = np.zeros((words, len(of_a) * letters), U64)  # where in a text, after a band's room, each letter stands
    place = counted_ranges(np.full(len(of_a), bits), size[of_a])
    at = (place >> 6) * (len(of_a) * letters) + np.repeat(np.arange(len(of_a)) * letters, size[of_a]) + letters_a
    np.add.at(table.reshape(-1), at, one << (place & 63).astype(U64))
    column = np.zeros((longest, len(of_b)), np.int64)  # letter 0 stands nowhere
    column[counted_ranges(np.zeros(len(of_b), np.int64), size[of_b]), np.repeat(np.arange(len(of_b)), size[of_b])] = letters_b
    a *= letters
    ones = [min(max(64 * (k + 1) - (bits - top - 1), 0), 64) for k in range(wide)]
    up = np.repeat(np.array([(1 << 64) - (1 << (64 - n)) for n in ones], U64)[:, None], pairs, axis=1)
    down, score, whole = np.zeros((wide, pairs), U64), np.full(pairs, top), [up, *(np.empty((wide, pairs), U64) for _ in range(4))]
    whole, scores, width = [*whole, down], score, 0
    longer = np.searchsorted(-size_b, -np.arange(longest), "left").tolist()  # texts longer than so many letters
    for k in range(longest):
        if longer[k] != width:  # a text that has ended keeps its bits
            width = longer[k]
            up, same, more, keep, right, down = (x[:, :width] for x in whole)
            scores = score[:width]
        word, shift = divmod(k + top + 1, 64)
        at = column[k].take(b[:width])
        at += a[:width]
        for w in range(wide):
            table[word + w].take(at, out=same[w], mode="clip")
        if shift:
            more[:-1] = same[1:]
            table[word + wide].take(at, out=more[-1], mode="clip")
            same >>= U64(shift)
            more <<= U64(64 - shift)
            same |= more
        np.bitwise_and(same, up, out=keep)
        keep += up
        if wide > 1:
            carry = keep < up
            for w in range(1, wide):
                keep[w] += carry[w - 1]
                carry[w] |= carry[w - 1] & (keep[w] == 0)
        keep ^= up
        keep |= same
        keep |= down
        np.bitwise_or(keep, up, out=right)
        np.invert(right, out=right)
        right |= down
        np.bitwise_and(keep, up, out=more)
        scores += keep[-1].view(np.int64) >> 63
        np.right_shift(keep, one, out=same)
        if wide > 1:
            keep <<= last
            same[:-1] |= keep[1:]
        np.bitwise_and(same, right, out=down)
        same |= right
        np.invert(same, out=up)
        up |= more
    # What lies between a band's lowest place and the end of the first text is taken off.
    bit = np.arange(bits)
    inside = (bit < bits - 1) & (bit >= (bits - 1 - top + size_a - size_b)[:, None])
    steps = [np.unpackbits(np.ascontiguousarray(x.T).view(np.uint8), axis=1, bitorder="little") & inside for x in (whole[0], whole[-1])]
    return score + size_b - steps[0].sum(axis=1, dtype=np.int64) + steps[1].sum(axis=1, dtype=np.int64)


def few_edits(a: list[str], b: list[str], most: np.ndarray, room: int = 1 << 21) -> np.ndarray:
    """For every pair: is it at most so many edits apart?

    Bit vectors count them in a band along the diagonal (`_banded`), for many pairs at a time whose tables take about `room`
    words; where more than `_MANY` edits are allowed, or for few pairs, pair by pair.
    """
    number: dict[str, int] = {}
    of_a, of_b = (np.array([number.setdefault(t, len(number)) for t in texts], np.int64) for texts in (a, b))
    if len(np.unique(of_b)) < len(np.unique(of_a)):
        of_a, of_b = of_b, of_a
    size = np.array([len(t) for t in number], np.int64)
    start = np.cumsum(size) - size
    codes = np.frombuffer("".join(number).encode("utf-32-le", "surrogatepass"), np.uint32)
    used = np.zeros(int(codes.max(initial=0)) + 1, bool)
    used[codes] = True
    letters = int(used.sum()) + 1
    codes = np.cumsum(used, dtype=np.uint32)[codes]
    out = np.zeros(len(a), bool)
    order = np.flatnonzero(np.abs(size[of_a] - size[of_b]) <= most)
    order = order[np.lexsort((of_a[order], most[order] // 32))]
    for k in order[most[order] > _MANY].tolist():
        out[k] = within(a[k], b[k], int(most[k]))
    order = order[most[order] <= _MANY]
    at = 0
    while at < len(order):
        wide = (int(most[order[at]]) // 32 + 1) * 5 // 4
        some = order[at : np.searchsorted(most[order] // 32, wide)][: (1 << 13) // wide]
        words = np.maximum.accumulate(np.maximum(size[of_a[some]], size[of_b[some]])) // 64 + 3 * wide + 2
        tables = np.cumsum(np.concatenate(([True], of_a[some[1:]] != of_a[some[:-1]])))
        some = some[: max(1, int(np.searchsorted(words * letters * tables, room, "right")))]
        at += len(some)
        if len(some) < _LITTLE:
            out[some] = [within(a[k], b[k], int(most[k])) for k in some]
            continue
        some = some[np.argsort(-size[of_b[some]], kind="stable")]
        out[some] = _banded(codes, start, size, of_a[some], of_b[some], int(most[some].max())) <= most[some]
    return out


def _profiles(texts: pa.Array) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Letters of each text, and its counts, with the letters of one counted: single letters in 64 bins, trigrams in 256 and in 1,024 (32,767 at most in a bin, so counts differ by less at most)."""
    if len(texts) > 512:
        some = [_profiles(texts.slice(k, 512)) for k in range(0, len(texts), 512)]
        return np.concatenate([x for x, _ in some]), [(each[0][0], np.concatenate([x for _, x in each])) for each in zip(*(counts for _, counts in some))]
    data, offsets = utf8(texts)
    codes = _codes(data)
    ends = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    length = np.diff(ends)
    binned = lambda bins, n, many: np.bincount(bins.astype(np.int64) + many * np.repeat(np.arange(len(length)), n), minlength=many * len(length)).clip(max=32767).astype(np.int16).reshape(-1, many)
    letters = binned(codes * U64(0x9E3779B97F4A7C15) >> U64(58), length, 64)
    hashed = mix(codes[:-2] * U64(0x9E3779B97F4A7C15) + codes[1:-1] * U64(0xC2B2AE3D27D4EB4F) + codes[2:] * U64(0x165667B19E3779F9)) & U64(1023)
    inner = np.maximum(length - 2, 0)
    trigrams = binned(hashed[counted_ranges(ends[:-1], inner)], inner, 1024)
    return length, [(1, letters), (3, trigrams.reshape(-1, 4, 256).sum(axis=1, dtype=np.int32).clip(max=32767).astype(np.int16)), (3, trigrams)]


def _may_link(x: tuple, y: tuple, i: np.ndarray, j: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs (i, j) of profiled texts may be similar, and the most edits these may be apart.

    An edit takes three trigrams at most and brings as many, and one letter: it bounds half of the counts that differ and of what one text has more.
    """
    (long_x, counts_x), (long_y, counts_y) = x, y
    most = ((1 - similarity) * np.maximum(long_x[i], long_y[j]) + 1e-9).astype(np.int64)
    ok = np.flatnonzero(np.abs(long_x[i] - long_y[j]) <= most)
    for (size, of_x), (_, of_y) in zip(counts_x, counts_y):
        more = np.abs(np.maximum(long_x[i[ok]] - size + 1, 0) - np.maximum(long_y[j[ok]] - size + 1, 0))
        differ = [np.abs(of_x[i[some]] - of_y[j[some]]).sum(axis=1, dtype=np.int32) for some in np.split(ok, range(2048, len(ok), 2048))]
        ok = ok[np.concatenate(differ) + more <= 2 * size * most[ok]]
    return ok, most[ok]


def _verify(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs whose edits are few enough; `_may_link` rules out most others."""
        held, letters = [], 0

        def counted() -> pa.Table:
            near, most = pa.Table.from_batches([x for x, _ in held]), np.concatenate([x for _, x in held])
            linked = few_edits(near["normal_a"].to_pylist(), near["normal_b"].to_pylist(), most)
            held.clear()
            return near.select(["a", "b"]).filter(pa.array(linked)).combine_chunks()

        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                x, y, row = _profiles(batch.column("normal_a")), _profiles(batch.column("normal_b")), np.arange(batch.num_rows)
                near, most = _may_link(x, y, row, row, similarity)
                held.append((batch.take(pa.array(near)), most))
                letters += int((x[0] + y[0])[near].sum())
                if letters > _HELD_LETTERS:
                    yield from counted().to_batches()
                    letters = 0
        if held:
            yield from counted().to_batches()

    return verify


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        kept, counts, gone = [], [], []
        for text, removed in zip(batch.column("text"), batch.column("removed")):
            lines = (text.as_py() or "").split("\n")
            removed = set(removed.as_py() or ())
            kept.append("\n".join(x for k, x in enumerate(lines) if k not in removed) if removed else text.as_py())
            counts.append(len(lines))
            gone.append(len(removed))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                                         ["doc_id", "row", "n_lines", "n_removed", "kept"])


def _picked(sieve: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(row, line, normal) of the lines with a word that the sieve lets through."""

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            starts, ends, counts = _line_cuts(data, offsets)
            row = np.repeat(batch.column("row").to_numpy(), counts)
            line = counted_ranges(np.zeros(len(counts), np.int64), counts)
            at = (row ^ line) & ((1 << _SIEVE) - 1)
            pick = np.flatnonzero((sieve[at >> 6] >> (at & 63).astype(U64)) & U64(1))
            size = ends[pick] - starts[pick] + 1
            cuts = np.cumsum(size) - size
            data = np.append(data, np.uint8(10))[counted_ranges(starts[pick], size)]  # a line feed or the next text's first byte after each
            data[cuts + size - 1] = 10
            word_a, word_b, first = normal_words(data, np.append(cuts, len(data))) if len(data) else (cuts, cuts, np.zeros(1, np.int64))
            full = np.flatnonzero(np.diff(first))
            raw, offsets = _normal_bytes(data, word_a, word_b, np.diff(first)[full])
            normal = pa.Array.from_buffers(pa.string(), len(full), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([pa.array(row[pick[full]]), pa.array(line[pick[full]]), normal], ["row", "line", "normal"])

    return picked


def _fetched(nodes: DataFrame, places: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, normal) of all nodes.

    Their lines are found by a shuffle join; before it a sieve of 2^23 bits, whose size does not depend on the data, drops
    most lines that are not wanted.
    """
    wanted = stored(nodes.join(places, "node").select("node", "row", "line"))
    at = F.col("row").bitwiseXOR(F.col("line")).bitwiseAND(F.lit((1 << _SIEVE) - 1))
    marks = wanted.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int")).alias("bit"))
    sieve = np.zeros(1 << (_SIEVE - 6), np.int64)
    for word, bits in marks.groupBy("word").agg(F.bit_or("bit")).collect():
        sieve[word] = bits
    likely = texts.select("row", "text").mapInArrow(_picked(sieve.view(U64)), "row long, line long, normal string").dropDuplicates(["row", "line"])
    return likely.join(wanted, ["row", "line"]).select("node", "normal")


def _confirmed(pairs: DataFrame, normal: DataFrame, similarity: float) -> DataFrame:
    both = pairs.join(normal.select(F.col("node").alias("a"), F.col("normal").alias("normal_a")), "a")
    both = both.join(normal.select(F.col("node").alias("b"), F.col("normal").alias("normal_b")), "b").select("a", "b", "normal_a", "normal_b")
    return stored(both.mapInArrow(_verify(similarity), "a long, b long"))


def _compare(similarity: float, lines: int) -> Callable[[pa.Table], pa.Table]:
    def compare(table: pa.Table) -> pa.Table:
        """Links between the left and right lines of every task in the table that lie in different components: a forest of them.

        `_may_link` rules out most pairs; edits are counted once for each of the pairs left, many at a time (32 for each of the `lines`
        of a block), unless the links found so far connect them.
        """
        table = table.sort_by([("block", "ascending"), ("p", "ascending"), ("q", "ascending")])
        side, node = (table[k].to_numpy() for k in ("side", "node"))
        task = np.stack([table[k].to_numpy() for k in ("block", "p", "q")])
        task = np.cumsum(np.concatenate(([False], (task[:, 1:] != task[:, :-1]).any(axis=0)))[: table.num_rows]) << 32
        _, first, text_of = np.unique(node, return_index=True, return_inverse=True)
        normal = table["normal"].take(pa.array(first)).combine_chunks()
        profile = _profiles(normal)
        length = profile[0]
        of, c = np.unique(table["c"].to_numpy(), return_inverse=True)
        root = np.arange(len(of))  # of every component; all of a group have the same

        links: list[tuple[int, int]] = []
        apart = np.zeros(0, np.int64)  # pairs counted and not linked
        held: list[np.ndarray] = []
        count = letters = 0

        def compared() -> None:
            nonlocal apart, count, letters
            i, j = np.concatenate(held, axis=1)
            held.clear()
            count = letters = 0
            t, u = np.minimum(text_of[i], text_of[j]), np.maximum(text_of[i], text_of[j])
            pair, once = np.unique(t * len(first) + u, return_index=True)
            new = (root[c[i[once]]] != root[c[j[once]]]) & ~np.isin(pair, apart, assume_unique=True)
            pair, once = pair[new], once[new]
            i, j, t, u = i[once], j[once], t[once], u[once]
            most = ((1 - similarity) * np.maximum(length[t], length[u]) + 1e-9).astype(np.int64)
            linked = few_edits(normal.take(pa.array(t)).to_pylist(), normal.take(pa.array(u)).to_pylist(), most)
            apart = np.union1d(apart, pair[~linked])
            for i, j in zip(i[linked].tolist(), j[linked].tolist()):
                x, y = int(root[c[i]]), int(root[c[j]])
                if x != y:
                    root[root == max(x, y)] = min(x, y)
                    links.append((int(node[i]), int(node[j])))

        # The lines of a task whose length is close enough to a left line's stand next to each other.
        left, right, size = np.flatnonzero(side != 1), np.flatnonzero(side != 0), length[text_of]
        right = right[np.argsort(task[right] + size[right], kind="stable")]
        low = np.searchsorted(task[right] + size[right], task[left] + np.floor(size[left] * similarity - 1e-6).astype(np.int64), "left")
        many = np.searchsorted(task[right] + size[right], task[left] + np.ceil(size[left] / similarity + 1e-6).astype(np.int64), "right") - low
        at, done = 0, np.cumsum(many)
        while at < len(left):
            to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + (1 << 15), "right")))
            i, j = np.repeat(left[at:to], many[at:to]), right[counted_ranges(low[at:to], many[at:to])]
            at = to
            near = np.flatnonzero((root[c[i]] != root[c[j]]) & ((side[j] != 2) | (j > i)))
            near = near[_may_link(profile, profile, text_of[i[near]], text_of[j[near]], similarity)[0]]
            i, j = i[near], j[near]
            held.append(np.stack((i, j)))
            count += len(i)
            letters += int((size[i] + size[j]).sum())
            if count > 32 * lines or letters > _HELD_LETTERS:
                compared()
        if held:
            compared()
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return compare


def _open_links(open_: DataFrame, normal: DataFrame, similarity: float, lines: int = 512, letters: int = 1 << 20) -> DataFrame:
    """Links between lines of a bucket that are in different components: (block, node, letters, c, main) of buckets with several.

    The bucket's commonest component and the other lines are cut into blocks of bounded size. Every block of the others meets
    every block of the component and of the others; such meetings are dealt into groups of some thousand lines, which return a
    forest of links, not pairs. Buckets of the same lines say the same once.
    """
    groups = pieces_of(open_.count(), 1 << 13)
    rest = F.col("c") != F.col("main")
    many = lambda of: F.greatest(F.lit(1), F.ceil(F.count_if(of) / lines), F.ceil(F.sum(F.when(of, F.col("letters")).otherwise(0)) / letters)).cast("int")
    sizes = open_.groupBy("block").agg(
        many(~rest).alias("m"), many(rest).alias("r"), F.min("node").alias("lowest"), F.count(F.lit(1)).alias("members"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("sum_a"),
        F.sum(F.xxhash64("letters", "node").cast("decimal(20,0)")).alias("sum_b"))
    once = sizes.groupBy("members", "sum_a", "sum_b").agg(F.min_by(F.struct("block", "m", "r", "lowest"), "block").alias("_")).select("_.*")
    part = F.pmod(F.xxhash64("node"), F.when(rest, F.col("r")).otherwise(F.col("m"))).cast("int")
    task = lambda p, q, side: F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"), F.lit(side).alias("side"))
    among = F.sequence(F.lit(0), F.col("r") - 1)
    of_main = F.transform(among, lambda q: task(F.col("part"), q, 0))
    of_rest = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda p: task(p, F.col("part"), 1)),
        F.transform(among, lambda o: F.when(o == F.col("part"), task(F.col("m") + o, o, 2)).when(o < F.col("part"), task(F.col("m") + o, F.col("part"), 1))
                    .otherwise(task(F.col("m") + F.col("part"), o, 0))))
    rows = open_.join(once, "block").withColumn("part", part).join(normal, "node")
    rows = rows.select("block", "lowest", "node", "c", "normal", F.inline(F.when(rest, of_rest).otherwise(of_main)))
    # Buckets that share their lowest line share most others: they meet in one group, which counts a pair's edits once.
    dealt = rows.withColumn("dealt", F.pmod(F.xxhash64("lowest", "p", "q"), F.lit(groups)).cast("int")).drop("lowest")
    return dealt.groupBy("dealt").applyInArrow(_compare(similarity, lines), "a long, b long").distinct()


def _groups(met: DataFrame, places: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(node, component) of all distinct normal lines that are linked with others.

    First each line is compared with the smallest line of each of its buckets, in small buckets with all lines; so groups of
    many alike lines become one component by as many comparisons. Then in every larger bucket the lines outside its commonest
    component are compared with those of other components, block by block.
    """
    pairs = stored(met.where("b is not null").select("a", "b").distinct())
    rest = met.where("block is not null").select("block", F.col("a").alias("node"), "letters")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(rest.select("node")).distinct()
    normal = stored(_fetched(nodes, places, texts))
    found = components(_confirmed(pairs, normal, similarity))
    placed = rest.join(found, "node", "left").withColumn("c", F.coalesce("component", "node"))
    mixed = placed.groupBy("block").agg(F.min("c").alias("c_min"), F.max("c").alias("c_max"), F.mode("c", True).alias("main")).where("c_min <> c_max")
    open_ = stored(placed.join(mixed.select("block", "main"), "block").select("block", "node", "letters", "c", "main"))
    if open_.isEmpty():
        return found
    more = stored(_open_links(open_, normal, similarity))
    return found if more.isEmpty() else joined(found, more)


def _row(id_col: str, text: str) -> Column:
    return F.xxhash64(id_col, text)


def repeated_lines(docs: DataFrame, similarity: float = 0.9, within: int = 12, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, removed): the numbers of the lines of each text that stand, alike, at an earlier place.

    Lines end at line feeds. Their normal form is the words (letters, digits, bytes above ASCII) in lower case; lines without
    a word are never removed. Lines of equal form, and forms that meet and whose edit similarity (1 - edits / longer length,
    over the joined words) is `similarity` or more, are linked; of every connected group the first line by
    (doc_id, line number) stays. Pairs whose similarity leaves up to five edits (59 letters at 0.9) always meet. Longer ones
    meet by 16 bands of 3 minima and maxima of their words, which is likely and not certain (README: 0.993 to 1.0 of simulated
    pairs with whole words changed, 0.87 to 0.92 with letters changed all over). Nothing else drops a pair before its edits
    are counted: `within` is kept for callers and is not read.

    `row` is the hash of id and text by which rows are told apart; rows that repeat both keep and lose the same lines.
    Null and empty texts have no line to remove; null ids come first in the order; an empty table gives no rows;
    other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), _row(id_col, text).alias("row"), F.col(text).alias("text"))
    lower = texts.select("doc_id", "row", F.lower("text").alias("text"))
    # One pass over the texts: their lines travel with the marks of the buckets and are stored with what meets there.
    parts = pieces_of(int(texts.agg(F.sum(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0) * _BANDS, 1 << 19)
    marks = lower.mapInArrow(_marked(similarity, parts), "part int, marks binary, lines binary")
    schema = "a long, b long, block long, letters long, doc_id long, row long, line long, form long, check long"
    met = stored(marks.groupBy("part").applyInArrow(_met(similarity), schema))
    lines = met.where("form is not null").select("doc_id", "row", "line", "form", "check")
    first = F.min(F.struct("doc_id", "line", "row"))
    forms = lines.groupBy("form", "check").agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
    forms = stored(forms.select(F.col("form").alias("node"), "form", "check", "first", "n", F.col("first.row").alias("row"), F.col("first.line").alias("line")))
    found = _groups(met, forms, lower, similarity)
    named = forms.join(found, "node", "left")
    several = named.where("component is not null").groupBy("component").agg(F.min("first").alias("keep"))
    grouped = named.join(several, "component").select("form", "check", "keep")
    repeated = grouped.unionByName(named.where("component is null and n > 1").select("form", "check", F.col("first").alias("keep")))
    gone = lines.select("doc_id", "row", "line", "form", "check").join(repeated, ["form", "check"])
    gone = gone.where("not (row <=> keep.row and line <=> keep.line)")
    return gone.groupBy("row").agg(F.collect_set("line").alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how: float) -> DataFrame:
    """(doc_id, row, n_lines, n_removed, kept): texts without the lines of `repeated_lines`.

    Null text counts as one empty line and stays null; otherwise a text comes back as it is, without these lines.
    """
    removed = repeated_lines(docs, id_col=id_col, text=text, **how)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), _row(id_col, text).alias("row"), F.col(text).alias("text"))
    cut = texts.join(removed, "row", "left").select("doc_id", "row", "text", "removed")
    return cut.mapInArrow(_cut, "doc_id long, row long, n_lines long, n_removed long, kept string")


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how: float) -> DataFrame:
    """The rows of `docs`, with all their columns, and the lines of `repeated_lines` cut from the text; rows that lose their last line go."""
    row, removed = free_name(docs, "_row"), free_name(docs, "_removed")
    numbers = repeated_lines(docs, id_col=id_col, text=text, **how).withColumnsRenamed({"row": row, "removed": removed})
    columns = list(docs.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            kept, keep = [], []
            for body, lines in zip(batch.column(text).to_pylist(), batch.column(removed).to_pylist()):
                if lines:
                    gone = set(lines)
                    left = [x for k, x in enumerate(body.split("\n")) if k not in gone]
                    keep.append(any(x.strip() for x in left))
                    body = "\n".join(left)
                else:
                    keep.append(True)
                kept.append(body)
            arrays = [pa.array(kept, pa.string()) if n == text else batch.column(n) for n in columns]
            yield pa.RecordBatch.from_arrays(arrays, columns).filter(pa.array(keep, pa.bool_()))

    joined = docs.withColumn(row, _row(id_col, text)).join(numbers, row, "left")
    return joined.select(*[f"`{c}`" for c in columns], removed).mapInArrow(cut, docs.schema)
