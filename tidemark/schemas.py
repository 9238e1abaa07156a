"""Column contracts. Schemas are fixed and checked on the driver; nothing is inferred."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

BAR_COLUMNS = ("symbol", "timestamp", "open", "high", "low", "close", "volume")
PRICE_COLUMNS = ("open", "high", "low", "close", "volume")
WATCH_LEVELS = ("last_price", "entry_low", "entry_high", "target", "stop")

BARS = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("timestamp", T.TimestampType())]
    + [T.StructField(name, T.DoubleType()) for name in PRICE_COLUMNS]
)

# One superset schema for every kind of fact in an append-only research ledger.
LEDGER = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("signal_id", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("feature_contributions", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("source_ids", T.ArrayType(T.StringType())),
        T.StructField("outcome_return", T.DoubleType()),
        T.StructField("hit", T.BooleanType()),
        T.StructField("closed_at", T.StringType()),
        T.StructField("experiment_id", T.StringType()),
        T.StructField("hypothesis", T.StringType()),
        T.StructField("result", T.StringType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("created_at", T.StringType()),
    ]
)

EQUITY = T.StructType(
    [
        T.StructField("account", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("seq", T.LongType()),
        T.StructField("equity", T.DoubleType()),
        T.StructField("cash", T.DoubleType()),
        T.StructField("invested", T.DoubleType()),
    ]
)

FEEDBACK = T.StructType(
    [
        T.StructField("experiment_id", T.StringType()),
        T.StructField("observed_at", T.StringType()),
        T.StructField("accepted", T.BooleanType()),
        T.StructField("top_k_precision", T.DoubleType()),
        T.StructField("net_pnl", T.DoubleType()),
        T.StructField("max_drawdown", T.DoubleType()),
        T.StructField("note", T.StringType()),
    ]
)


def require(df: DataFrame, columns: Iterable[str], what: str = "frame") -> DataFrame:
    """Fail on the driver, before any job, when a contract column is absent."""
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing columns: {missing}")
    return df
