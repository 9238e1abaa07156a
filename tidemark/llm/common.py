"""Text and hashing helpers shared by the operators: words and their hashes over Arrow strings, stored tables, sizes."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import written as stored  # noqa: F401

U64 = np.uint64
#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = U64(0x9E3779B97F4A7C15 | 1)


def text_bytes(df: DataFrame, text: str = "text") -> tuple[int, int]:
    """Total UTF-8 bytes of the texts and number of rows: one aggregated row comes to the driver."""
    row = df.agg(F.sum(F.octet_length(text)), F.count(F.lit(1))).first()
    return int(row[0] or 0), int(row[1])


def free_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pieces_of(total: int, each: int) -> int:
    """How many pieces of about `each` make up `total`, one at least."""
    return max(1, math.ceil(total / each))


def sieved(df: DataFrame, keys: DataFrame, column: str, bits: int = 23) -> DataFrame:
    """Rows of `df` whose `column` may be among that of `keys`, and all that are: most others are dropped before any shuffle.

    The keys mark a table of 2^bits bits, 2^(bits - 6) rows at most whatever the data, so it may be broadcast. Follow it with an
    inner join: Spark pushes a semi join below it, to where the rows have not been dropped yet.
    """
    at = F.pmod(F.xxhash64(column), F.lit(1 << bits))
    bit = lambda word, place: F.call_function(word, place, F.pmod(F.col("_at"), F.lit(64)).cast("int"))
    marks = keys.select(at.alias("_at")).groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.bit_or(bit("shiftleft", F.lit(1).cast("long"))).alias("_bits"))
    placed = df.withColumn("_at", at).withColumn("_word", F.shiftright("_at", 6))
    return placed.join(F.broadcast(marks), "_word").where(bit("shiftright", F.col("_bits")).bitwiseAND(1) == 1).select(*df.columns)


def crc_mod(column: str, divisor: int) -> Column:
    """crc32 of the column as text, modulo `divisor`; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and the n + 1 offsets; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(data, np.uint8)[first:last] if data and last > first else np.zeros(0, np.uint8)
    return data, offsets - first


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes stay."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the index of its first word (n + 1 entries)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 17) -> np.ndarray:
    """64-bit polynomial hash of each of the sorted, disjoint byte spans, mixed with its length."""
    out = np.zeros(len(starts), U64)
    powers = np.ones(1, U64)
    for a in range(0, len(starts), block):
        s, e = starts[a : a + block], ends[a : a + block]
        length = e - s
        if int(length.max()) > len(powers):
            powers = np.multiply.accumulate(np.full(int(length.max()) + 64, _BASE, U64))
        first = np.concatenate(([0], np.cumsum(length)[:-1]))
        at = np.arange(int(length.sum())) - np.repeat(first, length)
        terms = (data[at + np.repeat(s, length)].astype(U64) + U64(1)) * powers[at]
        filled = np.flatnonzero(length)
        sums = np.zeros(len(s), U64)
        if len(filled):
            sums[filled] = np.add.reduceat(terms, first[filled])
        out[a : a + block] = mix(sums + length.astype(U64) * U64(0xD6E8FEB86659FD93))
    return out


def rolled(hashes: np.ndarray, window: int) -> np.ndarray:
    """Rabin-Karp value of every `window` consecutive hashes (fewer entries by window - 1)."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, U64)
    value = hashes[:n].copy()
    for j in range(1, window):
        value *= _BASE
        value += hashes[j : n + j]
    return mix(value)


def counted_ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), then those of first[1], and so on."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) + np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count)


def slices(batches: Iterable[pa.RecordBatch], text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about `most` bytes of text (a longer text alone)."""
    for batch in batches:
        size = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False)).astype(np.int64))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + most, "right")))
            yield batch.slice(a, b - a)
            a = b
