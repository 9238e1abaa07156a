"""Running peak and drawdown per account over micro-batches.

A stream keeps one row of state an account in the state store: a batch reads and writes only the accounts it touches, and a
restarted or replayed batch starts from the store's version before it. Rows of an account inside a batch are put in order of
(timestamp, seq); rows that arrive after later rows of their account count in the batch they arrive in. A static table is
split by `chunk` inside a busy account instead.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues

from ..functions.chunked import running
from ..session import require_keyed_state

STATE = "account string, peak double, max_drawdown double, last_equity double, last_at timestamp, last_seq bigint, observations bigint"


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE)


def advance(state: DataFrame, batch: DataFrame, initial_equity: float, chunk: Column) -> DataFrame:
    """State after `batch` of (account, timestamp, seq, equity)."""
    if initial_equity <= 0:
        raise ValueError("initial_equity must be positive")
    start = F.lit(float(initial_equity))
    before = state.select("account", F.col("peak").alias("_before"))
    peaked = running(batch, ["account"], ["timestamp", "seq"], chunk, {"_peak": ("max", "equity")})
    peak = F.greatest(start, F.col("_before"), F.col("_peak"))
    at = F.struct("timestamp", "seq")
    fresh = (
        peaked.join(before, "account", "left")
        .groupBy("account")
        .agg(
            F.max(peak).alias("peak"),
            F.min(F.col("equity") / peak - 1.0).alias("max_drawdown"),
            F.max_by("equity", at).alias("last_equity"),
            F.max(at).alias("_at"),
            F.count(F.lit(1)).alias("observations"),
        )
        .withColumns({"last_at": F.col("_at.timestamp").cast("timestamp"), "last_seq": F.col("_at.seq")})
        .select(*state.columns)
    )
    newest = F.struct("last_at", "last_seq")
    return (
        state.unionByName(fresh)
        .groupBy("account")
        .agg(
            F.max("peak").alias("peak"),
            F.least(F.lit(0.0), F.min("max_drawdown")).alias("max_drawdown"),
            F.max_by("last_equity", newest).alias("last_equity"),
            F.max(newest).alias("_at"),
            F.sum("observations").alias("observations"),
        )
        .withColumns({"last_at": F.col("_at.last_at"), "last_seq": F.col("_at.last_seq")})
        .select(*state.columns)
    )


def metrics(state: DataFrame, initial_equity: float) -> DataFrame:
    return state.select(
        "account",
        (F.col("last_equity") / F.lit(float(initial_equity)) - 1.0).alias("net_return"),
        "max_drawdown",
        F.col("observations").cast("double").alias("observations"),
    )


class _Drawdown(StatefulProcessor):
    """One account: peak, deepest drawdown, newest equity, and rows seen."""

    def __init__(self, initial_equity: float) -> None:
        self.initial_equity = initial_equity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("account", "peak double, deepest double, equity double, at long, seq long, seen long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        peak, deepest, equity, last, seen = self.initial_equity, 0.0, None, None, 0
        if self.state.exists():
            peak, deepest, equity, *last, seen = self.state.get()
            last = tuple(last)
        for at, value in sorted(((r.at, r.seq), r.equity) for r in rows):
            peak = max(peak, value)
            deepest = min(deepest, value / peak - 1.0)
            seen += 1
            if last is None or at >= last:
                last, equity = at, value
        self.state.update((peak, deepest, equity, *last, seen))
        yield Row(account=key[0], net_return=equity / self.initial_equity - 1.0, max_drawdown=deepest, observations=float(seen))


def equity_stream(rows: DataFrame, initial_equity: float) -> DataFrame:
    """(account, net_return, max_drawdown, observations) of every account that a batch touches; run in update mode.

    `rows` is a stream of (account, timestamp, seq, equity). What a batch writes grows with the accounts in it, not with all
    accounts; an account's rows of one batch are sorted in its task, so the source's rate limit bounds them.
    """
    if initial_equity <= 0:
        raise ValueError("initial_equity must be positive")
    require_keyed_state(rows.sparkSession)
    numbered = rows.select("account", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("at"), "seq", "equity")
    return numbered.groupBy("account").transformWithState(
        _Drawdown(float(initial_equity)), "account string, net_return double, max_drawdown double, observations double", "Update", "None")
