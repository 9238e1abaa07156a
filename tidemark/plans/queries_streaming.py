"""Batch forms of the streaming operators; the tests run the same operators as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import written
from ..sources import sample
from ..streaming import equity, intraday, news
from .domain_sql import fold_sql, moment, r6, strip_sql
from .registry import query


@query("bars_5m", tables=("ticks",), sql=f"""
SELECT symbol, {moment("time_bucket(INTERVAL '5 minutes', ts)")} AS timestamp, {r6('min_by(price, event_id)')} AS open, {r6('max(price)')} AS high,
       {r6('min(price)')} AS low, {r6('max_by(price, event_id)')} AS close, {r6('sum(qty)')} AS volume
FROM ticks GROUP BY symbol, time_bucket(INTERVAL '5 minutes', ts)""")
def bars_5m(spark: SparkSession, d: str) -> DataFrame:
    return intraday.tick_bars(sample.ticks(spark, d))


@query("bars_hourly", tables=("ticks",), sql=f"""
SELECT symbol, {moment("date_trunc('hour', ts)")} AS timestamp, {r6('min_by(price, event_id)')} AS open, {r6('max(price)')} AS high,
       {r6('min(price)')} AS low, {r6('max_by(price, event_id)')} AS close, {r6('sum(qty)')} AS volume
FROM ticks GROUP BY symbol, date_trunc('hour', ts)""")
def bars_hourly(spark: SparkSession, d: str) -> DataFrame:
    return intraday.tick_bars(sample.ticks(spark, d), "1 hour")


@query("intraday_decisions", tables=("ticks", "positions"), sql=f"""
, e AS (SELECT max(ts) AS now FROM ticks),
   l AS (SELECT symbol, max_by(price, ts) AS close FROM ticks, e WHERE ts >= now - INTERVAL 8 HOUR GROUP BY symbol),
   r AS (SELECT p.symbol, entry_score, close, close / entry_price - 1 AS ret FROM positions p LEFT JOIN l ON l.symbol = p.symbol),
   s AS (SELECT *, CASE WHEN ret IS NOT NULL THEN least(100.0, greatest(0.0, 50 + 500 * ret)) END AS cur FROM r)
SELECT symbol, {r6('ret')} AS current_return, {r6('cur')} AS current_score,
       CASE WHEN close IS NULL THEN 'CANCEL' WHEN ret <= -0.03 THEN 'EXIT' WHEN cur < 55 AND cur < entry_score * 0.80::DOUBLE THEN 'EXIT'
            WHEN cur >= entry_score * 0.95::DOUBLE THEN 'HOLD' ELSE 'CANCEL' END AS decision
FROM s""")
def intraday_decisions(spark: SparkSession, d: str) -> DataFrame:
    bars = sample.ticks(spark, d).select("symbol", F.col("ts").alias("timestamp"), F.col("price").alias("close"))
    return intraday.intraday_decisions(bars, sample.positions(spark, d))


@query("stream_dedupe_news", tables=("news",), sql=f"""
SELECT news_id, {moment('published_at')} AS published_at FROM news
QUALIFY row_number() OVER (PARTITION BY {strip_sql(fold_sql('title'))}, trim(url) ORDER BY published_at, news_id) = 1""")
def stream_dedupe_news(spark: SparkSession, d: str) -> DataFrame:
    return news.dedupe_stream(sample.news(spark, d)).select("news_id", "published_at")


@query("stream_equity", tables=("equity_snapshots",), sql=f"""
, p AS (SELECT *, max(equity) OVER (PARTITION BY account ORDER BY timestamp, seq ROWS UNBOUNDED PRECEDING) AS peak FROM equity_snapshots)
SELECT account, {r6('max_by(equity, row(timestamp, seq)) / 1000000.0 - 1')} AS net_return,
       {r6('least(0.0, min(equity / greatest(1000000.0, peak) - 1))')} AS max_drawdown, CAST(count(*) AS DOUBLE) AS observations
FROM p GROUP BY account""")
def stream_equity(spark: SparkSession, d: str) -> DataFrame:
    rows = written(sample.equity_snapshots(spark, d).withColumn("timestamp", F.col("timestamp").cast("timestamp")))
    middle = F.lit("2024-01-15").cast("timestamp")
    day = F.to_date("timestamp")
    first = equity.advance(equity.empty_state(spark), rows.filter(F.col("timestamp") < middle), 1_000_000.0, day)
    second = equity.advance(written(first), rows.filter(F.col("timestamp") >= middle), 1_000_000.0, day)
    return equity.metrics(second, 1_000_000.0)
