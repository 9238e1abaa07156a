"""Tick bars and open-position decisions, for static and streaming inputs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..functions.numeric import clip
from ..operators.quality import enforce
from ..operators.scoring import hold_exit_cancel
from ..session import require_keyed_state


def tick_bars(ticks: DataFrame, width: str = "5 minutes", watermark: str = "10 minutes") -> DataFrame:
    """OHLCV bars of fixed width from (symbol, ts, event_id, price, qty) ticks.

    On a stream the watermark bounds the state: a bar is final once the watermark passes its end. Partial aggregates
    are combined before the shuffle, so a symbol with most of the ticks sends one row per bar and input split.
    """
    if ticks.isStreaming:
        ticks = ticks.withWatermark("ts", watermark)
    return (
        ticks.groupBy("symbol", F.window("ts", width).alias("w"))
        .agg(
            F.min_by("price", "event_id").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "event_id").alias("close"),
            F.sum("qty").alias("volume"),
        )
        .select("symbol", F.col("w.start").alias("timestamp"), "open", "high", "low", "close", "volume")
    )


def _decided(joined: DataFrame, has_score: bool, *more: str) -> DataFrame:
    """Decision columns from entry_price, entry_score, close and an optional payload score; `more` columns are handed on."""
    ret = F.col("close") / F.col("entry_price") - 1.0
    if has_score:
        current: Column = F.coalesce(F.col("score"), F.col("entry_score"))
    else:
        current = clip(F.lit(50.0) + F.lit(500.0) * ret, 0.0, 100.0)
    decision = hold_exit_cancel(F.col("entry_score"), current, ret)
    return joined.select(
        "symbol", *more,
        ret.alias("current_return"),
        current.alias("current_score"),
        F.when(F.col("close").isNull(), "CANCEL").otherwise(decision).alias("decision"),
    )


def _latest(bars: DataFrame, keys: list[str], has_score: bool, newest: bool = False) -> DataFrame:
    aggs = [F.max_by("close", "timestamp").alias("close")]
    if newest:
        aggs.append(F.max("timestamp").alias("timestamp"))
    if has_score:
        aggs.append(F.max_by("score", "timestamp").alias("score"))
    return bars.groupBy(*keys).agg(*aggs)


def intraday_decisions(
    bars: DataFrame, positions: DataFrame, now: Column | str | None = None, lookback_hours: int = 8,
    payload_score: bool = False, on_missing: str = "cancel",
) -> DataFrame:
    """HOLD / EXIT / CANCEL per position from its last bar in the lookback.

    A position without a bar is a CANCEL, or an error with `on_missing="fail"`.

    The current score follows from the return, or with `payload_score` is the bar's own score (the entry score
    where it has none). `now` defaults to the newest bar.
    """
    end = bars.agg(F.max("timestamp")).scalar() if now is None else (F.lit(now) if isinstance(now, str) else now)
    kind = bars.schema["timestamp"].dataType
    start = end.cast(kind) - F.make_dt_interval(hours=F.lit(lookback_hours))
    recent = bars.filter((F.col("timestamp") >= start) & (F.col("timestamp") <= end.cast(kind)))
    joined = positions.join(_latest(recent, ["symbol"], payload_score), "symbol", "left")
    if on_missing == "fail":
        joined = enforce(joined, {"no intraday data": F.col("close").isNull()}, "fail", "position")
    return _decided(joined, payload_score)


def intraday_decisions_stream(bars: DataFrame, positions: DataFrame, payload_score: bool = False) -> DataFrame:
    """The same decisions on a stream of bars joined to a static position table; run in update mode.

    State is one row per open position. A position without bars has no stream row, and the lookback is not applied;
    `decide_batches` gives both.
    """
    keys = ["symbol", "entry_price", "entry_score"]
    return _decided(_latest(bars.join(positions, "symbol"), keys, payload_score), payload_score)


def latest_bars_stream(bars: DataFrame, payload_score: bool = False) -> DataFrame:
    """The newest bar of every symbol of a stream, one row of state each; run in complete mode."""
    return _latest(bars, ["symbol"], payload_score, newest=True)


def decide_batches(
    positions: DataFrame, sink: Callable[[DataFrame, int], None], lookback_hours: int = 8, payload_score: bool = False
) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer for `latest_bars_stream`: after every batch `sink` gets the decisions of all positions.

    They are those of `intraday_decisions` over all bars so far: positions whose newest bar lies outside the lookback before
    the newest bar of all, and positions without a bar, are CANCEL.
    """

    def decide(latest: DataFrame, batch: int) -> None:
        sink(intraday_decisions(latest, positions, lookback_hours=lookback_hours, payload_score=payload_score), batch)

    return decide


class _OpenPositions(StatefulProcessor):
    """One symbol: its position and newest bar, until `silence_ms` pass without a bar."""

    def __init__(self, silence_ms: int) -> None:
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.position = handle.getValueState("position", "entry_price double, entry_score double, due long, at long, close double, score double")

    def _wait(self, due: int, before: int | None) -> None:
        if before is not None:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(due)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: TimerValues) -> None:
        due = max(0, timerValues.getCurrentWatermarkInMs()) + self.silence_ms
        self._wait(due, None)
        self.position.update((initialState.entry_price, initialState.entry_score, due, None, None, None))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        newest = max(((r.at, r.close, r.score) for r in rows), key=lambda r: r[0])
        if not self.position.exists():
            return  # not held, or closed by silence
        price, entry_score, due, at, *_ = self.position.get()
        if at is not None and newest[0] < at:
            return
        self._wait(newest[0] + self.silence_ms, due)
        self.position.update((price, entry_score, newest[0] + self.silence_ms, *newest))
        yield Row(symbol=key[0], at=newest[0], entry_price=price, entry_score=entry_score, close=newest[1], score=newest[2])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        price, entry_score, due, *_ = self.position.get()
        if due <= expiredTimerInfo.getExpiryTimeInMs():
            self.position.clear()
            yield Row(symbol=key[0], at=due, entry_price=price, entry_score=entry_score, close=None, score=None)


def open_positions_stream(
    bars: DataFrame, positions: DataFrame, lookback_hours: int = 8, payload_score: bool = False, watermark: str = "10 minutes",
) -> DataFrame:
    """(symbol, at, current_return, current_score, decision): a decision at every newer bar of an open position, and CANCEL once
    the watermark is `lookback_hours` past its last bar; run in append mode.

    `positions` open the state: one row a symbol, each with a timer. A bar moves its symbol's timer; an expired timer emits the
    CANCEL of `intraday_decisions` and drops the symbol, so the state is the open positions, whatever bars come. A position that
    never gets a bar is cancelled when the watermark first moves. Bars of other symbols, of closed positions, and older than the
    newest give nothing. Two positions of one symbol are not told apart: the last one read is kept.
    """
    require_keyed_state(bars.sparkSession)
    ms = F.unix_millis(F.col("timestamp").cast("timestamp"))
    score = F.col("score") if payload_score else F.lit(None)
    told = bars.withWatermark("timestamp", watermark).select("symbol", "timestamp", ms.alias("at"), "close", score.cast("double").alias("score"))
    opening = positions.select("symbol", F.col("entry_price").cast("double").alias("entry_price"), F.col("entry_score").cast("double").alias("entry_score"))
    seen = told.groupBy("symbol").transformWithState(
        _OpenPositions(lookback_hours * 3_600_000), "symbol string, at long, entry_price double, entry_score double, close double, score double",
        "Append", "EventTime", initialState=opening.groupBy("symbol"))
    return _decided(seen, payload_score, "at").withColumn("at", F.timestamp_millis("at"))
