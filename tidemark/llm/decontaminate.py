"""Benchmark passages in documents: pigeonhole pieces found exactly, confirmed by Myers' bit-parallel edit distance over words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, free_name, pieces_of, rolled, slices, utf8
from .lexicon import edit_distance, normal_hashes

SCHEMA = "doc_id long, item_id long, distance int, start long, stop long"


class _Items:
    """Test items as word hashes, cut into error-budget-plus-one pieces each; pieces of one length share a lookup table."""

    def __init__(self, ids: list, texts: list[str], errors: float) -> None:
        data, offsets = utf8(pa.array(texts, pa.string()))
        hashes, first = normal_hashes(data, offsets)
        self.ids, self.words, self.budget = [], [], []
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for item, a, b in zip(ids, first[:-1], first[1:]):
            n = int(b - a)
            if not n or item is None:
                continue
            budget = int(n * errors)
            at = np.linspace(0, n, budget + 2).astype(int)
            for x, y in zip(at, at[1:]):
                pieces.setdefault(int(y - x), []).append((int(rolled(hashes[a + x : a + y], int(y - x))[0]), len(self.ids), int(x)))
            self.ids.append(item)
            self.words.append(hashes[a:b])
            self.budget.append(budget)
        self.pieces = {}
        for length, found in pieces.items():
            found.sort()
            values = np.array([f[0] for f in found], U64)
            seen = np.zeros(1 << 16, bool)
            seen[(values >> U64(48)).astype(np.int64)] = True
            self.pieces[length] = values, np.array([f[1:] for f in found], np.int64), seen

    def hits(self, hashes: np.ndarray, doc_of: np.ndarray) -> np.ndarray:
        """Distinct (document, item, place of the item's first word) of all exact piece hits that lie in one document."""
        found = []
        for length, (values, where, seen) in self.pieces.items():
            rolls = rolled(hashes, length)
            at = np.flatnonzero(seen[(rolls >> U64(48)).astype(np.int64)])
            at = at[doc_of[at] == doc_of[at + length - 1]]
            low, high = np.searchsorted(values, rolls[at], "left"), np.searchsorted(values, rolls[at], "right")
            at, low, count = at[high > low], low[high > low], (high - low)[high > low]
            total = int(count.sum())
            which = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(total) if total else low
            at = np.repeat(at, count)
            found.append(np.stack([doc_of[at], where[which, 0], at - where[which, 1]], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


    def best(self, texts: pa.Array) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(distance, start, stop) of the closest confirmed place by (row of the text, item)."""
        hashes, first = normal_hashes(*utf8(texts))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, i, place in self.hits(hashes, np.repeat(np.arange(len(texts)), np.diff(first))):
            n, budget = len(self.words[i]), self.budget[i]
            a, b = max(int(first[d]), int(place) - budget), min(int(first[d + 1]), int(place) + n + budget)
            pattern, text = self.words[i].tolist(), hashes[a:b].tolist()
            distance, end = edit_distance(pattern, text, anywhere=True)
            if distance <= budget:
                back = edit_distance(pattern[::-1], text[:end][::-1], anywhere=True)[1]
                found = distance, a + end - back - int(first[d]), a + end - int(first[d])
                best[int(d), int(i)] = min(best.get((int(d), int(i)), found), found)
        return best


def _search(items: _Items) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            best = items.best(batch.column("text"))
            doc_ids = batch.column("doc_id").to_pylist()
            rows = [(doc_ids[d], items.ids[i], *found) for (d, i), found in sorted(best.items())]
            columns = list(zip(*rows)) or [[]] * 5
            kinds = pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "item_id", "distance", "start", "stop"])

    return search


def _item_blocks(benchmark: DataFrame, errors: float, block_bytes: int, item_col: str, item_text: str) -> Iterator[_Items]:
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.lower(item_text).alias("text"))
    blocks = pieces_of(int(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0), block_bytes)
    for block in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        yield _Items([r[0] for r in some], [r[1] or "" for r in some], errors)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, errors: float = 0.2, block_bytes: int = 16 << 20, id_col: str = "doc_id",
                      text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, start, stop): the closest place of every test item found in every document.

    Texts are compared as words in lower case without punctuation. An item of n words may be found with floor(n * errors)
    word edits (put in, left out, replaced). It is cut into one piece more than that, so one piece at least stands unchanged
    in any such place; the words around each exact piece hit are confirmed by Myers' bit-parallel distance. start and stop
    count normal words of the document, stop excluded; of several closest places the first is returned.

    The items go to the tasks in blocks of about `block_bytes` of item text, one pass over the documents each, so nothing
    grows with the benchmark or the documents; documents are not shuffled.

    Null and empty documents, and items without a word or without id, match nothing; rows that repeat an id answer each; a
    null doc_id is returned as null; empty tables give no rows; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(text).alias("text"))
    found = None
    for items in _item_blocks(benchmark, errors, block_bytes, item_col, item_text):
        one = texts.mapInArrow(_search(items), SCHEMA)
        found = one if found is None else found.unionByName(one)
    return found


def without_benchmark(docs: DataFrame, benchmark: DataFrame, errors: float = 0.2, block_bytes: int = 16 << 20, text: str = "text",
                      item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, in which no test item is found; items and places as in `benchmark_matches`."""
    lower = free_name(docs, "_lower")
    for items in _item_blocks(benchmark, errors, block_bytes, item_col, item_text):
        def clean(batches: Iterator[pa.RecordBatch], items: _Items = items) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, lower):
                keep = np.ones(batch.num_rows, bool)
                keep[[d for d, _ in items.best(batch.column(lower))]] = False
                yield batch.drop_columns([lower]).filter(pa.array(keep))

        docs = docs.withColumn(lower, F.lower(text)).mapInArrow(clean, docs.schema)
    return docs
