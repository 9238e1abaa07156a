"""Language-model scoring: a bigram trie in Elias-Fano levels, built and queried shard by shard."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, crc_mod, lowered, mix, pieces_of, slices, span_hashes, stored, text_bytes, utf8, words
from .eliasfano import Trie

END = np.array([0x5DEECE66D1CE1F3B], U64)  # stands for the end of a text among the word hashes
UNKNOWN, START, FIRST = 0, 1, 2  # numbers of words; known words from FIRST on
STEP = 1024  # codes a power of ten: a quantised logarithm is off by 1 / 2048 at most
_CODEC = pa.Codec("zstd", compression_level=1)


def _squeeze(values: np.ndarray) -> bytes:
    """Whole numbers as 32-bit, byte planes one after another, compressed; behind their number."""
    planes = np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)
    return np.int64(len(values)).tobytes() + (_CODEC.compress(planes.tobytes(), asbytes=True) if len(values) else b"")


def _expand(raw: bytes | pa.Buffer) -> np.ndarray:
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(_CODEC.decompress(memoryview(raw)[8:], 4 * n, asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.int64)


def quantise(probability: np.ndarray) -> np.ndarray:
    """Code of a probability above 0: rounded logarithm, 1 for the probability 1."""
    return np.clip(np.round(-np.log10(probability) * STEP) + 1, 1, 65535).astype(np.uint16)


def dequantise(code: np.ndarray) -> np.ndarray:
    """0 for code 0, else the probability."""
    return np.where(code > 0, 10.0 ** (-(code.astype(float) - 1) / STEP), 0.0)


def _tokens(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of every text, an end after each, and the n + 1 offsets."""
    data, offsets = utf8(column)
    data = lowered(data)
    starts, ends, first = words(data, offsets)
    hashes = np.insert(span_hashes(data, starts, ends), first[1:], END[0])
    return hashes, first + np.arange(len(first))


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """By range of the hash, so sorted hashes fall into runs."""
    return ((hashes >> U64(33)) * U64(buckets) >> U64(31)).astype(np.int64)


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, from, to) of every run of equal keys."""
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)])) if len(keys) else np.zeros(1, int)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield int(keys[a]), a, b


def _table(rows: list[tuple], **kinds: pa.DataType) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * len(kinds)
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds.values())], list(kinds))


def _count_words(buckets: int, flush: int = 1 << 21) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        hashes, counts = np.unique(np.concatenate(parts), return_counts=True)
        rows = [(k, hashes[a:b].tobytes(), _squeeze(counts[a:b])) for k, a, b in _runs(_bucket(hashes, buckets))]
        return _table(rows, bucket=pa.int32(), hashes=pa.binary(), counts=pa.binary()).combine_chunks().to_batches()[0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in slices(batches, "text"):
            parts.append(_tokens(batch.column("text"))[0])
            held += len(parts[-1])
            if held > flush:
                yield counted(parts)
                parts, held = [], 0
        if held:
            yield counted(parts)

    return count


def _vocabulary_shard(table: pa.Table) -> pa.Table:
    """One bucket of the vocabulary: hashes by falling count, their counts, and the bucket's part of the totals."""
    hashes = np.concatenate([np.frombuffer(x.as_buffer(), U64) for x in table["hashes"]])
    counts = np.concatenate([_expand(x.as_buffer()) for x in table["counts"]])
    hashes, group = np.unique(hashes, return_inverse=True)
    counts = np.bincount(group, counts).astype(np.int64)
    order = np.lexsort((hashes, -counts))
    return _table([(table["bucket"][0].as_py(), hashes[order].tobytes(), counts[order].tobytes(), int(counts.sum()), len(hashes), int((counts == 1).sum()), int((counts == 2).sum()))],
                  bucket=pa.int32(), hashes=pa.binary(), counts=pa.binary(), tokens=pa.int64(), types=pa.int64(), ones=pa.int64(), twos=pa.int64())


class _Chunk:
    """Rows of a chunk in a fixed order, and their tokens as places in the chunk's sorted distinct hashes."""

    def __init__(self, table: pa.Table) -> None:
        self.table = table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        hashes, self.first = _tokens(table["text"])
        self.hashes, self.token = np.unique(hashes, return_inverse=True)

    def numbered(self, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Number and training count of every token; replies of the vocabulary in the order of their buckets."""
        replies = replies.filter(pc.equal(replies["kind"], 0)).sort_by("part")
        number = np.concatenate([np.zeros(0, np.int64), *[_expand(x.as_buffer()) for x in replies["first"]]])
        count = np.concatenate([np.zeros(0, np.int64), *[_expand(x.as_buffer()) for x in replies["second"]]])
        return number[self.token], count[self.token]

    def pairs(self, number: np.ndarray, count: np.ndarray, parts: int, pair_limit: int) -> tuple[np.ndarray, ...]:
        """Distinct (shard, context, successor) of known contexts, where each token finds its own, and context counts."""
        before = np.concatenate(([START], number[:-1]))
        before_count = np.concatenate(([0], count[:-1]))
        before[self.first[:-1]] = START
        known = np.flatnonzero(before != UNKNOWN)
        key = (before[known].astype(U64) << U64(32)) | number[known].astype(U64)
        key, at, place = np.unique(key, return_index=True, return_inverse=True)
        context, successor = (key >> U64(32)).astype(np.int64), (key & U64(0xFFFFFFFF)).astype(np.int64)
        context_count = before_count[known][at]
        # A context of many occurrences is dealt over several shards by its successor.
        split = np.where(context == START, parts, np.minimum(context_count // pair_limit + 1, parts)).astype(U64)
        shard = ((mix(context.astype(U64)) + mix(successor.astype(U64) ^ U64(0x94D049BB133111EB)) % split) % U64(parts)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return shard[order], context[order], successor[order], context_count[order], known, back[place]


def _ask_words(buckets: int) -> Callable[[pa.Table], pa.Table]:
    def ask(table: pa.Table) -> pa.Table:
        chunk = _Chunk(table)
        rows = [(k, table["chunk"][0].as_py(), chunk.hashes[a:b].tobytes()) for k, a, b in _runs(_bucket(chunk.hashes, buckets))]
        return _table(rows, bucket=pa.int32(), chunk=pa.int32(), hashes=pa.binary())

    return ask


def _number_words(buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def number(asked: pa.Table, vocabulary: pa.Table) -> pa.Table:
        """Numbers interleave the buckets by rank, so common words have small ones all over the vocabulary."""
        known, counts = np.zeros(0, U64), np.zeros(0, np.int64)
        if vocabulary.num_rows:
            known, counts = np.frombuffer(vocabulary["hashes"][0].as_buffer(), U64), np.frombuffer(vocabulary["counts"][0].as_buffer(), np.int64)
        order = np.argsort(known)
        rows = []
        for bucket, chunk, raw in zip(asked["bucket"].to_pylist(), asked["chunk"].to_pylist(), asked["hashes"]):
            hashes = np.frombuffer(raw.as_buffer(), U64)
            place = np.minimum(np.searchsorted(known, hashes, sorter=order), max(len(known) - 1, 0))
            rank = order[place] if len(known) else np.zeros(len(hashes), np.int64)
            hit = known[rank] == hashes if len(known) else np.zeros(len(hashes), bool)
            number = np.where(hit, rank * buckets + bucket + FIRST, UNKNOWN)
            rows.append((chunk, 0, bucket, _squeeze(number), _squeeze(np.where(hit, counts[rank] if len(known) else 0, 0))))
        return _table(rows, chunk=pa.int32(), kind=pa.int32(), part=pa.int32(), first=pa.binary(), second=pa.binary())

    return number


def _ask_pairs(parts: int, pair_limit: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def ask(table: pa.Table, replies: pa.Table) -> pa.Table:
        chunk = _Chunk(table)
        number, count = chunk.numbered(replies)
        shard, context, successor, context_count, known, place = chunk.pairs(number, count, parts, pair_limit)
        learned = np.repeat(chunk.table["learned"].to_numpy(), np.diff(chunk.first))[known]
        times = np.bincount(place[learned], minlength=len(shard))
        rows = []
        for part, a, b in _runs(shard):
            first = np.concatenate(([0], np.flatnonzero(np.diff(context[a:b])) + 1))
            many = np.diff(np.concatenate((first, [b - a])))
            rows.append((part, table["chunk"][0].as_py(), *[_squeeze(x) for x in (
                np.diff(context[a:b][first], prepend=0), many, np.minimum(context_count[a:b][first], 0xFFFFFFFF), successor[a:b], times[a:b])]))
        return _table(rows, shard=pa.int32(), chunk=pa.int32(), contexts=pa.binary(), many=pa.binary(), context_counts=pa.binary(), successors=pa.binary(), times=pa.binary())

    return ask


def _answer_pairs(starts: int, prior: float) -> Callable[[pa.Table], pa.Table]:
    def answer(table: pa.Table) -> pa.Table:
        """Build the shard's trie from the counts of all chunks, then look up the pairs of each chunk."""
        asked = [[_expand(x.as_buffer()) for x in row] for row in zip(*(table[c] for c in ("contexts", "many", "context_counts", "successors", "times")))]
        keys, times, totals = [], [], []
        for contexts, many, counts, successors, learned in asked:
            np.cumsum(contexts, out=contexts)
            here = np.flatnonzero(learned)
            keys.append(((np.repeat(contexts, many) << 32) | successors)[here])
            times.append(learned[here])
            totals.append(np.repeat(np.where(contexts == START, starts, counts), many)[here])
        key, at, group = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        count, total = np.bincount(group, np.concatenate(times), minlength=len(key)), np.concatenate(totals)[at]
        codes = quantise(count / (total + prior)) if len(key) else np.zeros(0, np.uint16)
        trie = Trie.open(Trie.build(key >> 32, key & 0xFFFFFFFF, codes))
        rows = [(chunk, 1, shard, _squeeze(trie.lookup(contexts, many, successors)), b"")
                for chunk, shard, (contexts, many, _, successors, _) in zip(table["chunk"].to_pylist(), table["shard"].to_pylist(), asked)]
        return _table(rows, chunk=pa.int32(), kind=pa.int32(), part=pa.int32(), first=pa.binary(), second=pa.binary())

    return answer


def _score(parts: int, pair_limit: int, prior: float, starts: int, tokens: int, types: int, ones: int, twos: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    discount = ones / (ones + 2 * twos) if ones and twos else 0.5

    def score(table: pa.Table, replies: pa.Table) -> pa.Table:
        chunk = _Chunk(table)
        number, count = chunk.numbered(replies)
        shard, context, _, context_count, known, place = chunk.pairs(number, count, parts, pair_limit)
        seen = replies.filter(pc.equal(replies["kind"], 1)).sort_by("part")
        codes = np.concatenate([np.zeros(0, np.int64), *[_expand(x.as_buffer()) for x in seen["first"]]])
        base = np.log10((count + 0.5) / (tokens + 0.5 * (types + 1)))
        if tokens:
            single = np.where(count > 0, (count - discount) / tokens, discount * types / tokens)
        else:
            single = np.ones(len(count))
        final = single.copy()
        total = np.where(context == START, starts, context_count)[place]
        final[known] = dequantise(codes[place]) + prior / (total + prior) * single[known]
        sums = [np.add.reduceat(x, chunk.first[:-1]) for x in (base, np.log10(np.minimum(final, 1.0)), (count > 0).astype(np.int64))]
        return pa.table({"doc_id": chunk.table["doc_id"], "held_out": pc.invert(chunk.table["learned"]), "n_tokens": pa.array(np.diff(chunk.first), pa.int64()),
                         "n_known": pa.array(sums[2], pa.int64()), "train_tokens": pa.array(np.full(len(sums[0]), tokens), pa.int64()), "base_score": sums[0], "score": sums[1]})

    return score


def language_scores(docs: DataFrame, prior: float = 60.0, chunk_bytes: int = 4 << 20, bucket_bytes: int = 16 << 20, shard_bytes: int = 6 << 20,
                    pair_limit: int = 1 << 18, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): log10 probabilities of whole texts.

    Tokens are the lower-cased (A-Z) words and one end a text. The model learns from texts whose crc32(doc_id as text) mod 5
    is not 1. A known word's own probability is its count less a discount over all tokens, the discounted mass belongs to
    unknown words together (discount n1 / (n1 + 2 n2)); behind a known word or the start it is
    (count of the pair + prior * own probability) / (count of the first word + prior), else the own probability.
    Pair probabilities are quantised logarithms (1024 codes a power of ten).

    Words are counted in buckets of the hash range, which number them by frequency. Chunks of documents ask the buckets for
    the numbers of their distinct words, then send their distinct pairs with counts to shards by context; contexts of many
    occurrences are dealt over shards by successor. A shard builds its trie (Elias-Fano contexts, pointers and successors,
    see `eliasfano`) from all counts and answers each chunk from it. No task holds the whole model.

    Null and empty texts have the one token end; null ids hash as the empty text; rows that repeat an id count and are scored
    each; without a training text n_known and train_tokens are 0 and score is 0; an empty table gives no rows; other columns are ignored.
    """
    size, _ = text_bytes(docs, text)
    chunks, buckets, parts = pieces_of(size, chunk_bytes), pieces_of(size, bucket_bytes), pieces_of(size, shard_bytes)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), (crc_mod(id_col, 5) != 1).alias("learned"))
    counted = texts.where("learned").select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_count_words(buckets), "bucket int, hashes binary, counts binary")
    vocabulary = stored(counted.groupBy("bucket").applyInArrow(
        _vocabulary_shard, "bucket int, hashes binary, counts binary, tokens long, types long, ones long, twos long"))
    totals = [int(x or 0) for x in vocabulary.agg(*[F.sum(c) for c in ("tokens", "types", "ones", "twos")]).first()]
    starts = texts.where("learned").count()
    rows = texts.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int"))
    reply = "chunk int, kind int, part int, first binary, second binary"
    asked = rows.groupBy("chunk").applyInArrow(_ask_words(buckets), "bucket int, chunk int, hashes binary")
    numbered = asked.groupBy("bucket").cogroup(vocabulary.select("bucket", "hashes", "counts").groupBy("bucket")).applyInArrow(_number_words(buckets), reply)
    pairs = rows.groupBy("chunk").cogroup(numbered.groupBy("chunk")).applyInArrow(
        _ask_pairs(parts, pair_limit), "shard int, chunk int, contexts binary, many binary, context_counts binary, successors binary, times binary")
    answered = pairs.groupBy("shard").applyInArrow(_answer_pairs(starts, prior), reply)
    return rows.groupBy("chunk").cogroup(numbered.unionByName(answered).groupBy("chunk")).applyInArrow(
        _score(parts, pair_limit, prior, starts, *totals),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
