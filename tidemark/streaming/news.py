"""Duplicate suppression on a news stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..operators.news import first_per_key, news_fingerprint, title_url_key
from ..session import require_keyed_state

KEYS = {"title_url": title_url_key, "fingerprint": news_fingerprint}


def dedupe_stream(news: DataFrame, by: str = "title_url", watermark: str = "1 day", tie: str = "news_id") -> DataFrame:
    """Keep the first item per (title, url) or per fingerprint.

    A stream keeps a key in state until the watermark passes and lets the first to arrive through at once; `earliest_stream`
    waits for the earliest. A static table keeps the earliest of all.
    """
    key: Column = KEYS[by]()
    if not news.isStreaming:
        return first_per_key(news, key, [news["published_at"], news[tie]])
    return (
        news.withWatermark("published_at", watermark)
        .withColumn("_key", key)
        .dropDuplicatesWithinWatermark(["_key"])
        .drop("_key")
    )


def _rank(item: tuple) -> tuple:
    at, tie, _ = item
    return (at, tie is not None, tie)  # a missing tie comes first, as in the batch form


class _Earliest(StatefulProcessor):
    """One key: the earliest item seen, let through when no earlier one can come, then remembered for `memory_ms`."""

    def __init__(self, tie: str, memory_ms: int | None) -> None:
        self.tie, self.memory_ms = tie, memory_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", f"at long, tie {self.tie}, item string")
        self.passed = handle.getValueState("passed", "until long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        if self.passed.exists():
            return
        best = min(((r.at, r.tie, r.item) for r in rows), key=_rank)
        if self.waiting.exists():
            held = tuple(self.waiting.get())
            if _rank(held) <= _rank(best):
                return
            self.handle.deleteTimer(held[0] // 1000 + 1)
        self.waiting.update(best)
        self.handle.registerTimer(best[0] // 1000 + 1)
        return
        yield

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if not self.waiting.exists():
            self.passed.clear()  # remembered for long enough
            return
        yield Row(item=self.waiting.get()[2])
        self.waiting.clear()
        until = -1 if self.memory_ms is None else expiredTimerInfo.getExpiryTimeInMs() + self.memory_ms
        self.passed.update((until,))
        if self.memory_ms is not None:
            self.handle.registerTimer(until)


def earliest_stream(news: DataFrame, by: str = "title_url", watermark: str = "1 day", tie: str = "news_id", memory_hours: int | None = None) -> DataFrame:
    """The earliest item by (published_at, tie) per (title, url) or per fingerprint, in append mode: the rows of the batch form.

    An item waits in its key's state until the watermark has passed it, so an earlier one that arrives late, but within the
    watermark, takes its place. What has been let through is remembered as a time only: for good, or for `memory_hours` of
    event time, after which the key may pass again and its state is gone. Items later than the watermark are dropped; those without a time
    count as earliest.
    """
    require_keyed_state(news.sparkSession)
    fields = news.schema
    told = news.withWatermark("published_at", watermark).select(
        KEYS[by]().alias("_key"), "published_at", F.coalesce(F.unix_micros(F.col("published_at").cast("timestamp")), F.lit(0)).alias("at"),
        F.col(tie).alias("tie"), F.to_json(F.struct(*news.columns), {"ignoreNullFields": "false"}).alias("item"))
    passed = told.groupBy("_key").transformWithState(
        _Earliest(fields[tie].dataType.simpleString(), None if memory_hours is None else memory_hours * 3_600_000), "item string", "Append", "EventTime")
    return passed.select(F.from_json("item", fields).alias("item")).select("item.*")
