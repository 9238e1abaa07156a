"""Removal of passages that start in an earlier document: Rabin-Karp hashes of every token window, counted in Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, pieces_of, rolled, span_hashes, text_bytes, utf8, words

_NO_ID = np.iinfo(np.int64).max


class _Chunk:
    """Rows of one chunk in a fixed order, their words, and their windows grouped by hash.

    `firsts` are the windows that come first in the chunk with their hash, by bucket and then by place; they are the
    questions the chunk asks, and the answers come back in the same order.
    """

    def __init__(self, table: pa.Table, window: int, buckets: int) -> None:
        table = table.set_column(table.schema.get_field_index("doc_id"), "doc_id", pc.fill_null(table["doc_id"].cast(pa.int64()), int(_NO_ID)))
        self.table = table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids = table["doc_id"].to_numpy()
        self.data, offsets = utf8(table["text"])
        self.starts, self.ends, self.first_word = words(self.data, offsets)
        self.n_words = np.diff(self.first_word)
        values = rolled(span_hashes(self.data, self.starts, self.ends), window)
        doc_of = np.repeat(np.arange(len(self.ids)), self.n_words)
        whole = doc_of[: len(values)] == doc_of[window - 1 :] if len(values) else np.zeros(0, bool)
        self.at = np.flatnonzero(whole)  # the first word of every window
        self.owner = doc_of[self.at]
        values = values[self.at]
        self.hashes, first, self.group = np.unique(values, return_index=True, return_inverse=True)
        bucket = ((self.hashes >> U64(33)) * U64(buckets) >> U64(31)).astype(np.int64)
        order = np.lexsort((first, bucket))
        self.order, self.bucket, self.first = order, bucket[order], first[order]

    def questions(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per bucket: the hashes, and the ids of their first documents as runs (id, how many hashes)."""
        cuts = np.flatnonzero(np.diff(self.bucket)) + 1
        for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(self.bucket)]))):
            if a < b:
                owner = self.owner[self.first[a:b]]
                run = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1))
                yield int(self.bucket[a]), self.hashes[self.order[a:b]], self.ids[owner[run]], np.diff(np.concatenate((run, [b - a])))

    def removed(self, earlier: np.ndarray, window: int) -> np.ndarray:
        """Per word: is it covered by a window that starts in a smaller document? earlier: the answers to all questions."""
        before = np.zeros(len(self.hashes), bool)
        before[self.order] = earlier
        least = np.zeros(len(self.hashes), np.int64)
        least[self.order] = self.ids[self.owner[self.first]]
        gone = self.at[before[self.group] | (self.ids[self.owner] > least[self.group])]
        steps = np.zeros(len(self.starts) + 1, np.int32)
        steps[gone] += 1
        np.subtract.at(steps, gone + window, 1)
        return np.cumsum(steps[:-1]) > 0


def _ask(window: int, buckets: int) -> Callable[[pa.Table], pa.Table]:
    def ask(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        rows = [(b, chunk, h.tobytes(), i.tobytes(), n.astype(np.int32).tobytes()) for b, h, i, n in _Chunk(table, window, buckets).questions()]
        columns = list(zip(*rows)) or [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                        ["bucket", "chunk", "hashes", "ids", "runs"])

    return ask


def _answer(table: pa.Table) -> pa.Table:
    """For each question: is there a smaller document with the same hash in another chunk? One bit each."""
    hashes = [np.frombuffer(x.as_py(), U64) for x in table["hashes"]]
    ids = np.concatenate([np.repeat(np.frombuffer(i.as_py(), np.int64), np.frombuffer(n.as_py(), np.int32)) for i, n in zip(table["ids"], table["runs"])])
    cuts = np.cumsum([len(h) for h in hashes])[:-1]
    _, group = np.unique(np.concatenate(hashes), return_inverse=True)
    least = np.full(int(group.max()) + 1, _NO_ID)
    np.minimum.at(least, group, ids)
    bits = [np.packbits(x).tobytes() for x in np.split(ids > least[group], cuts)]
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "bits": pa.array(bits, pa.binary())})


def _cut(window: int, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = _Chunk(table, window, buckets)
        sizes = dict(zip(*np.unique(chunk.bucket, return_counts=True)))
        answers = answers.sort_by("bucket")
        earlier = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=int(sizes[b.as_py()])).astype(bool) for b, x in zip(answers["bucket"], answers["bits"])]
        gone = chunk.removed(np.concatenate(earlier) if earlier else np.zeros(0, bool), window)
        edge = np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))
        edge_at = np.zeros(len(gone) + 1, bool)
        edge_at[chunk.first_word] = True  # an interval ends with its document
        steps = np.flatnonzero(edge | (edge_at & np.concatenate((gone, [False])) & np.concatenate(([False], gone))))
        total = np.concatenate(([0], np.cumsum(gone)))
        n_removed = np.diff(total[chunk.first_word])
        kept, spans = [], []
        raw = chunk.data.tobytes()
        for d, (a, b) in enumerate(zip(chunk.first_word[:-1], chunk.first_word[1:])):
            if a == b:
                kept.append("")
                spans.append([])
                continue
            tokens = raw[chunk.starts[a] : chunk.ends[b - 1]].split()
            cuts = steps[np.searchsorted(steps, a) : np.searchsorted(steps, b)] if n_removed[d] else ()
            marks = sorted({a, b, *(int(x) for x in cuts)})
            runs = [(x - a, y - a) for x, y in zip(marks, marks[1:]) if gone[x]]
            spans.append([{"start": int(x), "stop": int(y)} for x, y in runs])
            if runs:
                ends = [0, *(y for _, y in runs)]
                tokens = [t for x, y in zip(ends, [*(x for x, _ in runs), b - a]) for t in tokens[x:y]]
            kept.append(b" ".join(tokens).decode())
        ids = pa.array(chunk.ids, mask=chunk.ids == _NO_ID)
        return pa.table({"doc_id": ids, "n_words": pa.array(chunk.n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                         "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), "kept": pa.array(kept, pa.string())})

    return cut


def remove_repeated_passages(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text: str = "text",
                             chunk_bytes: int = 4 << 20, bucket_windows: int = 1 << 20) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept): texts without the words of windows that an earlier document has.

    Words are runs of anything but ASCII white space. Every window of `window` words of one document gets a 64-bit
    Rabin-Karp hash; a word goes when a window over it has its hash in a document with a smaller id. Overlapping windows
    merge into the maximal intervals of `removed` (word numbers, stop excluded); `kept` joins the other words by one space.

    Documents are dealt into chunks of about `chunk_bytes` of text by the hash of their id. A chunk sends each of its
    distinct hashes once, with its smallest document, to one of the hash buckets; the bucket answers one bit each. So a
    passage of a third of all documents puts one entry a chunk into its bucket. Documents are shuffled once.

    Null text has no words; documents shorter than the window lose nothing; a null id counts as larger than all ids;
    rows with equal ids do not affect each other; an empty table gives no rows; other columns are ignored. Two different
    windows share a hash with probability 2**-64 a pair.
    """
    size, _ = text_bytes(docs, text)
    chunks, buckets = pieces_of(size, chunk_bytes), pieces_of(size // 6, bucket_windows)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.pmod(F.xxhash64(id_col), F.lit(chunks)).cast("int").alias("chunk"))
    asked = rows.groupBy("chunk").applyInArrow(_ask(window, buckets), "bucket int, chunk int, hashes binary, ids binary, runs binary")
    answered = asked.groupBy("bucket").applyInArrow(_answer, "chunk int, bucket int, bits binary")
    return rows.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(
        _cut(window, buckets), "doc_id long, n_words long, n_removed long, removed array<struct<start: long, stop: long>>, kept string")
