"""Periodic runs of words: lags at which a text repeats itself, followed word by word on sparse diagonals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import counted_ranges, slices, utf8, words

SPACES = "[\\x20\\x09-\\x0D]+"


def _word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same number for equal words, compared byte by byte."""
    sizes = ends - starts
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    laid = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[counted_ranges(starts, sizes)])])
    return laid.dictionary_encode().indices.to_numpy().astype(np.int64)


def _numbered(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def grams(numbers: np.ndarray, size: int) -> np.ndarray:
    """The same number for equal sequences of `size` consecutive numbers (fewer entries by size - 1), put together from halves."""
    part, length, whole, done = numbers, 1, None, 0
    while True:
        if size & 1:
            if whole is None:
                whole, done = part, length
            else:
                n = max(0, min(len(whole), len(part) - done))
                whole, done = _numbered(whole[:n] * (len(numbers) + 1) + part[done : done + n]), done + length
        size >>= 1
        if not size:
            return whole
        n = max(0, len(part) - length)
        part, length = _numbered(part[:n] * (len(numbers) + 1) + part[length : length + n]), 2 * length


class Diagonals:
    """Match lengths of a sequence with itself on the diagonals that are active, one lag each.

    A step takes the next symbol: each of its earlier places lengthens the match on one lag; a lag without a match at this
    step has ended and gives a run if the match is long enough. A lag is opened only if the symbol that would make its match
    long enough is in place too. Inside a run of period p that is long enough already, lags above p are not opened: multiples
    of p end with the run and say nothing new, others match for fewer than p symbols inside it. Those that go on beyond the
    run's end are opened there, with their match counted backwards.
    """

    def __init__(self, symbols: list[int], span: int, shortest: int) -> None:
        self.symbols, self.span, self.shortest = symbols, span, shortest  # a symbol stands for `span` words
        self.places: dict[int, list[int]] = {}
        self.since: dict[int, int] = {}  # active lag: where its match began
        self.long: dict[int, int] = {}  # active lag whose match is long enough for a run: since when it is
        self.runs: list[tuple[int, int, int]] = []

    def close(self, lag: int, at: int) -> None:
        """The match on this lag ends before `at`."""
        since = self.since.pop(lag)
        if lag in self.long:
            del self.long[lag]
            self.runs.append((since - lag, at - since + self.span - 1 + lag, lag))

    def step(self, at: int) -> None:
        symbols, since = self.symbols, self.since
        symbol = symbols[at]
        ended = [lag for lag in since if symbols[at - lag] != symbol]
        over = [self.long[lag] for lag in ended if lag in self.long]  # runs that end here held lags back since these steps
        for lag in ended:
            self.close(lag, at)
        held = [lag for lag, when in self.long.items() if not over or when <= min(over)]
        most = min(held, default=at)
        places = self.places.setdefault(symbol, [])
        for place in reversed(places):
            lag = at - place
            if lag > most:
                break
            if lag not in since:
                first = at
                while over and first > lag and symbols[first - 1] == symbols[first - 1 - lag]:
                    first -= 1
                needed = first + max(lag, self.shortest - lag) - self.span  # the last place of a match long enough
                if needed < len(symbols) and symbols[needed] == symbols[needed - lag]:
                    since[lag] = first
        places.append(at)
        for lag, first in since.items():
            if lag not in self.long and at - first + self.span + lag >= max(self.shortest, 2 * lag):
                self.long[lag] = at

    def finish(self, at: int) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs, by start, then period; each stretch once, with its smallest period."""
        for lag in list(self.since):
            self.close(lag, at)
        least: dict[tuple[int, int], int] = {}
        for start, length, lag in self.runs:
            least[start, length] = min(lag, least.get((start, length), lag))
        return sorted((start, length, lag) for (start, length), lag in least.items())


def runs_of(symbols: np.ndarray, repeated: np.ndarray, span: int, shortest: int) -> list[tuple[int, int, int]]:
    """Runs of one text. Steps are taken where a symbol occurs twice; elsewhere all matches end."""
    diagonals = Diagonals(symbols.tolist(), span, shortest)
    last = -1
    for at in np.flatnonzero(repeated).tolist():
        if at != last + 1 and diagonals.since:
            for lag in list(diagonals.since):
                diagonals.close(lag, last + 1)
        diagonals.step(at)
        last = at
    return diagonals.finish(last + 1)


def _scan(shortest: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    #: A match of m words on lag q counts if m >= max(shortest - q, q): at least half of `shortest`.
    span = max(1, (shortest + 1) // 2)
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", most):
            data, offsets = utf8(batch.column("text"))
            starts, ends, first = words(data, offsets)
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            symbols = grams(_word_numbers(data, starts, ends), span)
            whole = np.flatnonzero(row[: len(symbols)] == row[span - 1 :]) if len(symbols) else np.zeros(0, np.int64)
            _, key, count = np.unique(symbols[whole] * batch.num_rows + row[whole], return_inverse=True, return_counts=True)
            repeated = np.zeros(len(symbols), bool)
            repeated[whole] = count[key] > 1
            busy = set(np.unique(row[np.flatnonzero(repeated)]).tolist())
            raw = data.tobytes()
            found, collapsed = [], []
            for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                tokens = raw[offsets[d] : offsets[d + 1]].split()
                runs = runs_of(symbols[a : max(a, b - span + 1)], repeated[a : max(a, b - span + 1)], span, shortest) if d in busy else []
                if runs:
                    steps = np.zeros(b - a + 1, np.int64)
                    for start, length, period in runs:
                        steps[start + period] += 1
                        steps[start + length] -= 1
                    gone = np.cumsum(steps[:-1]) > 0
                    tokens = [tokens[i] for i in np.flatnonzero(~gone).tolist()]
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                collapsed.append(b" ".join(tokens).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(found, kinds), pa.array(collapsed, pa.string())],
                                             ["doc_id", "n_words", "runs", "collapsed"])

    return scan


def periodic_runs(docs: DataFrame, shortest: int = 12, id_col: str = "doc_id", text: str = "text", slice_bytes: int = 2 << 20) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): stretches of words that repeat with a period, and the text with each period once.

    Words are runs of anything but ASCII white space, numbered from 0. A run (start, length, period) is a stretch whose
    smallest period is `period`, of `shortest` words and two periods at least, that no neighbouring word extends. `runs` is
    ordered by start, then period; `collapsed` drops every word that a run holds after its first period and joins the others
    by one space.

    The work is one pass without a shuffle. A run needs half of `shortest` consecutive matches at least, so only places whose
    next that many words occur twice in the text are followed (compared by number, never by hash); most texts have none. Of
    those texts Python keeps the active lags. A long text costs as many steps as it has pairs of equal places outside of runs.

    Null and empty texts have no words and no runs; rows with equal or null ids do not affect each other; an empty table gives
    no rows; other columns are ignored.
    """
    if shortest < 2:
        raise ValueError("shortest must be 2 at least")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_scan(shortest, slice_bytes), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def looped_text(doc_id: Column, text: Column, every: int = 10) -> Column:
    """The text, ending in a loop for one id in `every`: with h the crc32 of the id and g its quotient by `every`, word i >= a
    becomes word a + (i - a) % p, a = g % n and p = 1 + (n - a) // (3 + g % 8). Null ids, and texts without words, stay as they are.
    """
    tokens = F.filter(F.split(text, SPACES), lambda w: w != "")
    digest = F.crc32(doc_id.cast("string").cast("binary"))
    quotient = F.floor(digest / F.lit(every)).cast("bigint")

    def placed(row: Column) -> Column:
        n, w, g = F.size(row["w"]).cast("bigint"), row["w"], row["g"]
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8)))).cast("bigint")
        source = lambda i: F.when(i >= a, a + F.pmod(i - a, p)).otherwise(i)
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(w, source(i).cast("int"))), " ")

    looped = F.transform(F.array(F.struct(tokens.alias("w"), quotient.alias("g"))), placed)[0]
    return F.when((digest % every == 0) & text.rlike("[^\\x20\\x09-\\x0D]"), looped).otherwise(text)
