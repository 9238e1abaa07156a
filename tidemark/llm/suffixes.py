"""Removal of byte strings that start earlier: suffix arrays by two-stage sorting over the strings around shared anchors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, counted_ranges, mix, pieces_of, stored, text_bytes, utf8

_NO_ID = np.iinfo(np.int64).max
_BASE = 0x9E3779B97F4A7C15 | 1
_PLACE = U64((1 << 31) - 1)


# suffix arrays


def _eights(text: np.ndarray) -> np.ndarray:
    """The eight symbols from every place as one number; those after a separator (0) count as 0."""
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    out, open_ = np.zeros(len(text), U64), np.ones(len(text), bool)
    for k in range(8):
        symbol = padded[k : k + len(text)]
        open_ &= symbol != 0
        out = (out << U64(8)) | (symbol * open_).astype(U64)
    return out


def _sorted_directly(at: np.ndarray, eights: np.ndarray, depth: int) -> np.ndarray:
    """Places `at` (ascending) by their first `depth` symbols, eight at a time; equal ones stay in order of place."""
    order = at[np.argsort(eights[at], kind="stable")]
    key = eights[order]
    slots = np.arange(len(order))
    group = np.cumsum(np.concatenate(([0], key[1:] != key[:-1]))) if len(order) else slots
    for passed in range(8, depth, 8):
        size = np.bincount(group)
        left = (size[group] > 1) & (key & U64(255) != 0)
        slots, group = slots[left], group[left]
        if not len(slots):
            break
        key = eights[order[slots] + passed]
        mixed = np.zeros(int(group[-1]) + 1, bool)
        mixed[group[1:][(key[1:] != key[:-1]) & (group[1:] == group[:-1])]] = True
        at = np.flatnonzero(mixed[group])  # most groups are copies of one string, in order already
        inner = at[np.lexsort((key[at], group[at]))]
        order[slots[at]], key[at] = order[slots[inner]], key[inner]
        group = np.cumsum(np.concatenate(([0], (group[1:] != group[:-1]) | (key[1:] != key[:-1]))))
    return order


def suffix_order(text: np.ndarray, depth: int, eights: np.ndarray | None = None) -> np.ndarray:
    """All suffixes of `text` (symbols above 0, every string closed by a separator 0) by their first `depth` symbols.

    Two stages: the suffixes smaller than their successor are sorted directly; every other one stands where its successor
    puts it. One scan over the buckets of first symbols, in order, gives the rest: a finished bucket hands each of its
    suffixes' predecessors to the bucket of the predecessor's symbol. Separators count as all different, by place.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    eights = _eights(text) if eights is None else eights
    place = np.arange(n)
    differs = np.concatenate((text[:-1] != text[1:], [True]))
    turn = np.minimum.accumulate(np.where(differs, place, n)[::-1])[::-1]  # the end of the run of one symbol
    smaller = text[turn] < np.concatenate((text, [255]))[turn + 1]
    direct = _sorted_directly(np.flatnonzero(smaller), eights, depth)
    bounds = np.searchsorted(text[direct], np.arange(257))
    handed: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for symbol in range(256):
        part = np.concatenate(handed[symbol]) if handed[symbol] else np.zeros(0, np.int64)
        handed[symbol] = []
        grown, edge = [part], part
        while len(edge):  # runs of the symbol: one longer each turn
            edge = edge[edge > 0] - 1
            edge = edge[text[edge] == symbol]
            grown.append(edge)
        bucket = np.concatenate([*grown, direct[bounds[symbol] : bounds[symbol + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > symbol]
        if len(before):
            at = text[before]
            before = before[np.argsort(at, kind="stable")]
            cuts = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=256))))
            for s in np.unique(at):
                handed[s].append(before[cuts[s] : cuts[s + 1]])
    return np.concatenate(out)


def common_prefixes(order: np.ndarray, eights: np.ndarray, most: int) -> np.ndarray:
    """Symbols that each suffix shares with the one before it in `order`, `most` at the most (0 for the first)."""
    shared = np.zeros(len(order), np.int64)
    left = np.arange(1, len(order))
    for passed in range(0, most, 8):
        here = eights[order[left] + passed]
        x = here ^ eights[order[left - 1] + passed]
        same = x == 0
        ended = sum(((here >> U64(8 * k)) & U64(255) != 0).astype(np.int64) for k in range(8))  # symbols before a separator
        shared[left] += np.where(same, ended, sum((x < U64(1 << (64 - 8 * k))).astype(np.int64) for k in range(1, 8)))
        left = left[same & (ended == 8)]
    return np.minimum(shared, most)


# anchors


def _after(ids: np.ndarray, places: np.ndarray, other_ids: np.ndarray, other_places: np.ndarray) -> np.ndarray:
    """Does (id, place) come after the other one?"""
    return (ids > other_ids) | ((ids == other_ids) & (places > other_places))


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the `gram` bytes from every place, put together from halves."""
    part, length, power = data.astype(U64) + U64(1), 1, _BASE
    value, done = None, 0
    while gram:
        if gram & 1:
            if value is None:
                value, done = part, length
            else:
                n = max(0, min(len(value), len(part) - done))
                value, done = value[:n] * U64(power) + part[done : done + n], done + length
        gram >>= 1
        if gram:
            n = max(0, len(part) - length)
            part = part[:n] * U64(power) + part[length : length + n]
            length, power = 2 * length, power * power % (1 << 64)
    return mix(value)


def _least_in_window(keys: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        keys, span = np.minimum(keys[:-span], keys[span:]) if len(keys) > span else keys[:0], span * 2
    rest = width - span
    return np.minimum(keys[: max(0, len(keys) - rest)], keys[rest:]) if rest else keys


def _laid_out(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """The bytes of all strings one after another; the places of about `most` of them, eight bytes each and more, are held at a time."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(int(total[-1]), np.uint8)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(total, total[a] + most, "right")) - 1)
        out[total[a] : total[b]] = data[counted_ranges(starts[a:b], sizes[a:b])]
        a = b
    return out


def _strings(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_laid_out(data, starts, sizes))])


def _distinct(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int = 16 << 20) -> tuple[np.ndarray, pa.Array]:
    """A number for each string, the same for equal ones, and the distinct strings; `most` bytes are laid out at a time."""
    total = np.cumsum(sizes)
    numbers, found = [], []
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        part = _strings(data, starts[a:b], sizes[a:b]).dictionary_encode()
        numbers.append(part.indices.to_numpy() + sum(map(len, found)))
        found.append(part.dictionary)
        a = b
    if not found:
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    whole = pa.chunked_array(found).combine_chunks().dictionary_encode()
    return whole.indices.to_numpy()[np.concatenate(numbers)], whole.dictionary


class _Chunk:
    """Rows of one chunk in a fixed order, their bytes, and runs of windows that have one anchor at one place.

    A window is `length` bytes of one document; its anchor is the leftmost of the grams of least hash in it. Equal windows
    have equal anchors, and no two windows of one run are equal.
    """

    def __init__(self, table: pa.Table, length: int, gram: int) -> None:
        table = table.set_column(table.schema.get_field_index("doc_id"), "doc_id", pc.fill_null(table["doc_id"].cast(pa.int64()), int(_NO_ID)))
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.length = length
        self.ids = table["doc_id"].to_numpy()
        self.data, self.offsets = utf8(table["text"])
        if len(self.data) >= int(_PLACE):
            raise ValueError("a chunk holds 2 GB of text or more; lower chunk_bytes")
        hashes = _gram_hashes(self.data, gram)
        least = _least_in_window((hashes & ~_PLACE) | np.arange(len(hashes), dtype=U64), length - gram + 1)
        windows = np.maximum(0, np.diff(self.offsets) - length + 1)
        inside = counted_ranges(self.offsets[:-1], windows)
        least = least[inside]
        cut = np.concatenate(([True], (least[1:] != least[:-1]) | (inside[1:] != inside[:-1] + 1))) if len(inside) else np.zeros(0, bool)
        first = np.flatnonzero(cut)
        self.starts = inside[first]
        self.windows = np.diff(np.concatenate((first, [len(inside)])))
        self.anchor = hashes[(least[first] & _PLACE).astype(np.int64)]
        row = np.repeat(np.arange(len(self.ids)), windows)[first]
        self.id, self.start = self.ids[row], self.starts - self.offsets[row]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct anchors and how many different strings of runs each has here."""
        values, number, count = np.unique(self.anchor, return_inverse=True, return_counts=True)
        several = np.flatnonzero(count[number] > 1)
        code, _ = _distinct(self.data, self.starts[several], self.windows[several] + self.length - 1)
        _, one = np.unique(code, return_index=True)
        strings = np.where(count > 1, 0, 1)
        np.add.at(strings, number[several[one]], 1)
        return values, strings

    def asked(self, verdict: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
        """What is asked of other chunks, once a string: 1 in `verdict` asks the runs of an anchor, 2 each of their windows.

        (bucket, first piece of every string) in order of bucket, and for every piece (start, windows, id, place, string).
        """
        values, number = np.unique(self.anchor, return_inverse=True)
        level = verdict[number] if len(values) else np.zeros(0, np.uint8)
        runs, hot = np.flatnonzero(level == 1), np.flatnonzero(level == 2)
        apart = counted_ranges(np.zeros(len(hot), np.int64), self.windows[hot])
        hot = np.repeat(hot, self.windows[hot])
        start = np.concatenate((self.starts[runs], self.starts[hot] + apart))
        windows = np.concatenate((self.windows[runs], np.ones(len(hot), np.int64)))
        ids, place = np.concatenate((self.id[runs], self.id[hot])), np.concatenate((self.start[runs], self.start[hot] + apart))
        code, _ = _distinct(self.data, start, windows + self.length - 1)
        order = np.lexsort((place, ids, code))
        first = order[np.concatenate(([True], np.diff(code[order]) != 0))] if len(order) else order
        key = np.concatenate((self.anchor[runs], self._contents(start[len(runs) :])))[first]
        bucket = ((mix(key) >> U64(33)) * U64(buckets) >> U64(31)).astype(np.int64)
        by_bucket = np.lexsort((first, bucket))
        return bucket[by_bucket], first[by_bucket], start, windows, ids, place, code

    def removed(self, verdict: np.ndarray, answers: pa.Table, buckets: int) -> np.ndarray:
        """Per byte: is it covered by a window that also starts earlier? `answers` to the asked strings, by bucket."""
        bucket, first, start, windows, ids, place, code = self.asked(verdict, buckets)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1))
        counts = np.add.reduceat(windows[first], cuts) if len(first) else []
        bits = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=int(n)) for x, n in zip(answers.sort_by("bucket")["verdict"], counts)]
        base, least = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        base[code[first]], least[code[first]] = np.cumsum(windows[first]) - windows[first], first
        later = _after(ids, place, ids[least[code]], place[least[code]])
        gone = np.repeat(later, windows)
        if bits:
            gone |= np.concatenate(bits)[counted_ranges(base[code], windows)].astype(bool)
        values, number = np.unique(self.anchor, return_inverse=True)
        alone = np.flatnonzero(verdict[number] == 0) if len(values) else number
        order = alone[np.lexsort((self.start[alone], self.id[alone], number[alone]))]
        lead = np.zeros(len(values), np.int64)
        lead[number[order[::-1]]] = order[::-1]
        lead = lead[number[alone]]
        copies = alone[_after(self.id[alone], self.start[alone], self.id[lead], self.start[lead])]
        at = np.concatenate((counted_ranges(start, windows)[gone], counted_ranges(self.starts[copies], self.windows[copies])))
        steps = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(steps, at, 1)
        np.subtract.at(steps, at + self.length, 1)
        return np.cumsum(steps[:-1]) > 0

    def _contents(self, starts: np.ndarray) -> np.ndarray:
        """Hash of the window at each place."""
        value = np.zeros(len(starts), U64)
        for k in range(self.length):
            value = value * U64(_BASE) + self.data[starts + k].astype(U64) + U64(1)
        return value


def _ask_anchors(length: int, gram: int, buckets: int) -> Callable[[pa.Table], pa.Table]:
    def ask(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        values, strings = _Chunk(table, length, gram).anchors()
        bucket = (values >> U64(33)) * U64(buckets) >> U64(31)  # ascending like the values
        cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=U64))
        rows = [(b, chunk, values[x:y].tobytes(), np.minimum(strings[x:y], 1 << 20).astype(np.int32).tobytes())
                for b, x, y in zip(range(buckets), cuts, cuts[1:]) if x < y]
        columns = list(zip(*rows)) or [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["bucket", "chunk", "anchors", "strings"])

    return ask


def _weigh(hot: int) -> Callable[[pa.Table], pa.Table]:
    """For each asked anchor one byte: 0 if it has one string everywhere, 2 if more than `hot`, else 1."""

    def weigh(table: pa.Table) -> pa.Table:
        anchors = [np.frombuffer(x.as_py(), U64) for x in table["anchors"]]
        cuts = np.cumsum([len(a) for a in anchors])[:-1]
        _, number = np.unique(np.concatenate(anchors), return_inverse=True)
        total = np.zeros(int(number.max()) + 1, np.int64)
        np.add.at(total, number, np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in table["strings"]]))
        verdict = np.where(total[number] > hot, 2, np.where(total[number] > 1, 1, 0)).astype(np.uint8)
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "verdict": pa.array([x.tobytes() for x in np.split(verdict, cuts)], pa.binary())})

    return weigh


def _joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
    parts = [np.frombuffer(x.as_py(), kind) for x in table.sort_by("bucket")[name]]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _ask_strings(length: int, gram: int, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def ask(table: pa.Table, verdicts: pa.Table) -> pa.Table:
        rows = []
        if table.num_rows:
            chunk, number = _Chunk(table, length, gram), table["chunk"][0].as_py()
            bucket, first, start, windows, ids, place, _ = chunk.asked(_joined(verdicts, "verdict", np.uint8), buckets)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
            for x, y in zip(cuts, cuts[1:]):
                if x < y:
                    of = first[x:y]
                    size = windows[of] + length - 1
                    rows.append((int(bucket[x]), number, _laid_out(chunk.data, start[of], size).tobytes(), size.astype(np.int32).tobytes(),
                                 ids[of].tobytes(), place[of].astype(np.int32).tobytes()))
        columns = list(zip(*rows)) or [[]] * 6
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], ["bucket", "chunk", "strings", "sizes", "ids", "places"])

    return ask


def earlier_windows(strings: pa.Array, sizes: np.ndarray, ids: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """For every window of every string, one string after another: does an equal window start at a smaller (id, place)?

    A suffix array of the distinct strings brings equal windows together: neighbours that share `length` bytes.
    """
    encoded = strings.dictionary_encode()
    code, (data, offsets) = encoded.indices.to_numpy().astype(np.int64), _bytes(encoded.dictionary)
    size = np.diff(offsets)
    head = np.cumsum(np.concatenate(([0], size + 1)))[:-1]  # of every string in the text
    text = np.zeros(len(data) + len(size), np.uint8)
    text[counted_ranges(head, size)] = data + np.uint8(1)  # no UTF-8 byte is 255
    by_place = np.lexsort((places, ids, code))
    least = by_place[np.concatenate(([True], np.diff(code[by_place]) != 0))]
    n_windows = size - length + 1
    at = counted_ranges(head, n_windows)
    owner = np.repeat(np.arange(len(size)), n_windows)
    window = np.full(len(text), -1, np.int64)
    window[at] = np.arange(len(at))
    eights = _eights(text)
    order = suffix_order(text, length, eights)
    order = order[window[order] >= 0]
    cut = np.flatnonzero(common_prefixes(order, eights, length) < length)
    rank = window[order]
    who = owner[rank]
    first_id = ids[least][who]
    least_id = np.minimum.reduceat(first_id, cut)
    group = np.repeat(np.arange(len(cut)), np.diff(np.concatenate((cut, [len(order)]))))
    start = np.where(first_id == least_id[group], places[least][who] + order - head[who], _NO_ID)
    least_start = np.minimum.reduceat(start, cut)
    best_id, best_start = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    best_id[rank], best_start[rank] = least_id[group], least_start[group]
    base = np.concatenate(([0], np.cumsum(n_windows)))[:-1]
    count = sizes - length + 1
    of = counted_ranges(base[code], count)
    own_id, own_start = np.repeat(ids, count), counted_ranges(places, count)
    return _after(own_id, own_start, best_id[of], best_start[of])


def _bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _answer_strings(length: int) -> Callable[[pa.Table], pa.Table]:
    def answer(table: pa.Table) -> pa.Table:
        data = np.frombuffer(b"".join(x.as_py() for x in table["strings"]), np.uint8)
        parts = [np.frombuffer(x.as_py(), np.int32) for x in table["sizes"]]
        sizes = np.concatenate(parts).astype(np.int64)
        ids = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table["ids"]])
        places = np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in table["places"]]).astype(np.int64)
        strings = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(sizes)))), pa.py_buffer(data)])
        earlier = earlier_windows(strings, sizes, ids, places, length)
        cuts = np.cumsum([int(p.sum()) - len(p) * (length - 1) for p in parts])[:-1]
        bits = [np.packbits(x).tobytes() for x in np.split(earlier, cuts)]
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "verdict": pa.array(bits, pa.binary())})

    return answer


def _cut(length: int, gram: int, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = _Chunk(table, length, gram)
        of_anchors = pc.equal(answers["kind"], "anchors")
        gone = chunk.removed(_joined(answers.filter(of_anchors), "verdict", np.uint8), answers.filter(pc.invert(of_anchors)), buckets)
        step = np.diff(np.concatenate(([0], gone.view(np.int8), [0])))
        edge = np.zeros(len(gone) + 1, bool)
        edge[chunk.offsets] = True  # a span ends with its document
        inner = edge & np.concatenate(([False], gone)) & np.concatenate((gone, [False]))
        opens, closes = np.flatnonzero((step > 0) | inner), np.flatnonzero((step < 0) | inner)
        total, first = np.concatenate(([0], np.cumsum(gone))), np.searchsorted(opens, chunk.offsets)
        shift = np.repeat(chunk.offsets[:-1], np.diff(first))
        spans = pa.StructArray.from_arrays([pa.array(opens - shift), pa.array(closes - shift)], ["start", "stop"])
        ends = chunk.offsets - total[chunk.offsets]
        kept = pa.Array.from_buffers(pa.large_binary(), len(chunk.ids), [None, pa.py_buffer(ends), pa.py_buffer(chunk.data[~gone])])
        return pa.table({"doc_id": pa.array(chunk.ids, mask=chunk.ids == _NO_ID), "n_bytes": np.diff(chunk.offsets), "n_removed": np.diff(total[chunk.offsets]),
                         "removed": pa.ListArray.from_arrays(pa.array(first, pa.int32()), spans), "kept": kept.cast(pa.binary())})

    return cut


def remove_repeated_bytes(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text: str = "text", gram: int = 32,
                          chunk_bytes: int = 4 << 20, bucket_bytes: int = 4 << 20, hot_strings: int = 1 << 16) -> DataFrame:
    """(doc_id, n_bytes, n_removed, removed, kept): UTF-8 texts without bytes of strings of `length` that also start earlier.

    A string is earlier in a smaller id, or in the same document at a smaller place. Removed strings may overlap; they merge
    into the maximal spans of `removed` (byte places, stop excluded). `kept` is binary: a cut may fall inside a letter.

    Every window of `length` bytes has an anchor: the leftmost of its grams of least hash, the same in equal windows. Runs of
    windows with one anchor are one string of fewer than 2 * length bytes. Documents are dealt into chunks of about
    `chunk_bytes` by id and text. A chunk first asks which anchors have more than one string anywhere. Only strings around
    those, once a chunk, go to the bucket of their anchor; there a suffix array of the distinct ones, built by two-stage
    sorting, brings equal windows together as neighbours that share `length` bytes, compared byte by byte. One bit a window
    comes back. An anchor with more than `hot_strings` strings is cut into single windows dealt by their content, so no
    bucket holds a passage's many surroundings. Copies inside a chunk are one string; a bucket gets one entry a chunk.

    Null text is empty; texts shorter than `length` lose nothing; a null id counts as larger than all ids; rows of one id
    count as one document laid over itself: a string is earlier in any of them at a smaller place, and at the same place in
    none. An empty table gives no rows; other columns are ignored. `gram` is 8 at least and `length` at most.
    """
    if not 8 <= gram <= length or length < 16:
        raise ValueError("gram must be from 8 to length, and length 16 at least")
    size, _ = text_bytes(docs, text)
    chunks, anchor_buckets, buckets = pieces_of(size, chunk_bytes), pieces_of(size // 24, 1 << 20), pieces_of(size, bucket_bytes)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.pmod(F.xxhash64(id_col, text), F.lit(chunks)).cast("int").alias("chunk"))
    anchors = rows.groupBy("chunk").applyInArrow(_ask_anchors(length, gram, anchor_buckets), "bucket int, chunk int, anchors binary, strings binary")
    verdicts = stored(anchors.groupBy("bucket").applyInArrow(_weigh(hot_strings), "chunk int, bucket int, verdict binary"))
    strings = rows.groupBy("chunk").cogroup(verdicts.groupBy("chunk")).applyInArrow(
        _ask_strings(length, gram, buckets), "bucket int, chunk int, strings binary, sizes binary, ids binary, places binary")
    earlier = strings.groupBy("bucket").applyInArrow(_answer_strings(length), "chunk int, bucket int, verdict binary")
    answers = verdicts.withColumn("kind", F.lit("anchors")).unionByName(earlier.withColumn("kind", F.lit("strings")))
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _cut(length, gram, buckets), "doc_id long, n_bytes long, n_removed long, removed array<struct<start: long, stop: long>>, kept binary")
