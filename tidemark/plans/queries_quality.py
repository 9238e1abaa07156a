"""Registered quality, point-in-time and constraint queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality as ops
from ..sources import sample
from .domain_sql import day, moment, r6
from .registry import query

_BROKEN_SQL = """
, broken AS (SELECT symbol, timestamp, open, CASE WHEN l_returnflag = 'R' THEN low * 0.9::DOUBLE ELSE high END AS high, low, close,
                    CASE WHEN l_returnflag = 'N' THEN -volume WHEN volume < 3 THEN NULL ELSE volume END AS volume, seq
             FROM trades)
"""
_FLAGS = """(symbol IS NULL OR timestamp IS NULL OR open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL) AS f0,
            (coalesce(open < 0, false) OR coalesce(high < 0, false) OR coalesce(low < 0, false) OR coalesce(close < 0, false)
             OR coalesce(volume < 0, false)) AS f1,
            high < greatest(open, close, low) AS f2, low > least(open, close, high) AS f3"""


def _broken(spark: SparkSession, d: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return sample.trades(spark, d).withColumns({
        "high": F.when(flag == "R", F.col("low") * 0.9).otherwise(F.col("high")),
        "volume": F.when(flag == "N", -F.col("volume")).when(F.col("volume") >= 3, F.col("volume")),
    })


@query("validate_ohlcv", tables=("trades",), sql=_BROKEN_SQL + f"""
, f AS (SELECT {_FLAGS}, count(*) OVER (PARTITION BY symbol, timestamp) > 1 AS f4,
               coalesce(timestamp < lag(timestamp) OVER (PARTITION BY symbol ORDER BY seq), false) AS f5 FROM broken)
SELECT position, code FROM (
  SELECT 0::BIGINT AS position, 'null_values' AS code, max(f0) AS broken FROM f UNION ALL
  SELECT 1, 'negative_values', max(f1) FROM f UNION ALL SELECT 2, 'high_below_ohlc', max(f2) FROM f UNION ALL
  SELECT 3, 'low_above_ohlc', max(f3) FROM f UNION ALL SELECT 4, 'duplicate_bars', max(f4) FROM f UNION ALL
  SELECT 5, 'timestamp_not_monotonic', max(f5) FROM f) WHERE broken""")
def validate_ohlcv(spark: SparkSession, d: str) -> DataFrame:
    return ops.validate_ohlcv(_broken(spark, d), ["seq"], F.floor(F.col("l_orderkey") / 4096))


@query("assert_ohlcv_quality", tables=("bars",), sql="SELECT symbol, count(*) AS bars FROM bars GROUP BY symbol")
def assert_ohlcv_quality(spark: SparkSession, d: str) -> DataFrame:
    bars = sample.bars(spark, d)
    ops.assert_ohlcv_quality(bars, ["timestamp"], F.year("timestamp"))
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"))


@query("bar_violations", tables=("trades",), sql=_BROKEN_SQL + f"""
, f AS (SELECT *, {_FLAGS} FROM broken)
SELECT symbol, {day('timestamp')} AS timestamp, {r6('close')} AS close,
       array_to_string(list_filter([CASE WHEN f0 THEN 'null_values' END, CASE WHEN f1 THEN 'negative_values' END,
                                    CASE WHEN f2 THEN 'high_below_ohlc' END, CASE WHEN f3 THEN 'low_above_ohlc' END],
                                   lambda x: x IS NOT NULL), ',') AS violations
FROM f""")
def bar_violations(spark: SparkSession, d: str) -> DataFrame:
    return ops.bar_violations(_broken(spark, d)).select("symbol", "timestamp", "close", "violations")


@query("validate_point_in_time", sql=f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {moment('o_orderdate')} AS as_of, {moment('l_shipdate')} AS observed_at,
       o_orderdate > l_shipdate AS lookahead
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def validate_point_in_time(spark: SparkSession, d: str) -> DataFrame:
    facts = sample.table(spark, d, "lineitem").join(
        sample.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    ).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("o_orderdate").alias("as_of"), F.col("l_shipdate").alias("observed_at"))
    return ops.validate_point_in_time(facts, mode="quarantine")


@query("asof_cutoff", tables=("holdings",), sql=f"""
SELECT {day('as_of')} AS as_of, manager, fund_code, symbol, {r6('portfolio_weight')} AS portfolio_weight
FROM holdings WHERE as_of <= (SELECT max(last_day(CAST(o_orderdate AS DATE))) FROM orders)""")
def asof_cutoff(spark: SparkSession, d: str) -> DataFrame:
    orders = sample.table(spark, d, "orders")
    cutoff = orders.agg(F.max(F.last_day(F.col("o_orderdate").cast("date")))).scalar()
    return ops.asof_cutoff(sample.holdings(spark, d), cutoff).select(
        "as_of", "manager", "fund_code", "symbol", "portfolio_weight")


@query("row_constraints", tables=("news",), sql="""
SELECT news_id, array_to_string(list_filter([CASE WHEN NOT (sentiment * 1.25::DOUBLE BETWEEN -1 AND 1) THEN 'sentiment_range' END,
                  CASE WHEN NOT (reliability + 0.2::DOUBLE BETWEEN 0 AND 1) THEN 'reliability_range' END],
                  lambda x: x IS NOT NULL), ',') AS violations
FROM news""")
def row_constraints(spark: SparkSession, d: str) -> DataFrame:
    stretched = sample.news(spark, d).withColumns(
        {"sentiment": F.col("sentiment") * 1.25, "reliability": F.col("reliability") + 0.2})
    return ops.enforce(stretched, ops.row_constraints("news"), "quarantine").select("news_id", "violations")


@query("row_constraints_holdings", tables=("holdings",), sql=f"""
SELECT {day('as_of')} AS as_of, fund_code, symbol,
       array_to_string(list_filter([CASE WHEN trim(manager) = '' OR trim(sector) = '' THEN 'blank_key' END,
                                    CASE WHEN NOT (portfolio_weight * 10 BETWEEN 0 AND 1) THEN 'weight_range' END,
                                    CASE WHEN fund_aum - 800000 < 0 THEN 'negative_aum' END],
                                   lambda x: x IS NOT NULL), ',') AS violations
FROM holdings""")
def row_constraints_holdings(spark: SparkSession, d: str) -> DataFrame:
    held = sample.holdings(spark, d)
    shifted = held.select(
        "as_of", "manager", "fund_code", F.col("symbol").alias("name"), F.col("sector").alias("symbol"),
        (F.col("portfolio_weight") * 10).alias("portfolio_weight"), (F.col("fund_aum") - 800000).alias("fund_aum"))
    checked = ops.enforce(shifted, ops.row_constraints("institutional_holding"), "quarantine")
    return checked.select("as_of", "fund_code", F.col("name").alias("symbol"), "violations")


@query("row_constraints_signal", sql="""
SELECT doc_id, array_to_string(list_filter([CASE WHEN NOT (n_chars / 50.0::DOUBLE - 5 BETWEEN 0 AND 100) THEN 'score_range' END,
                  CASE WHEN NOT ((doc_id % 13 - 1) / 10.0::DOUBLE BETWEEN 0 AND 1) THEN 'confidence_range' END],
                  lambda x: x IS NOT NULL), ',') AS violations
FROM documents""")
def row_constraints_signal(spark: SparkSession, d: str) -> DataFrame:
    signals = sample.table(spark, d, "documents").select(
        "doc_id", (F.col("n_chars") / 50.0 - 5).alias("score"), ((F.col("doc_id") % 13 - 1) / 10.0).alias("confidence"))
    return ops.enforce(signals, ops.row_constraints("signal"), "quarantine").select("doc_id", "violations")


@query("row_constraints_fund_holding", tables=("holdings",), sql=f"""
SELECT {day('as_of')} AS as_of, fund_code, symbol,
       CASE WHEN NOT (portfolio_weight * 10 BETWEEN 0 AND 1) THEN 'weight_range' ELSE '' END AS violations FROM holdings""")
def row_constraints_fund_holding(spark: SparkSession, d: str) -> DataFrame:
    held = sample.holdings(spark, d).withColumn("portfolio_weight", F.col("portfolio_weight") * 10)
    return ops.enforce(held, ops.row_constraints("fund_holding"), "quarantine").select("as_of", "fund_code", "symbol", "violations")


@query("row_constraints_evidence", sql="""
SELECT o_orderkey AS order_id, array_to_string(list_filter([
         CASE WHEN NOT (o_orderkey % 12 / 10.0::DOUBLE BETWEEN 0 AND 1) THEN 'confidence_range' END,
         CASE WHEN o_orderkey % 5 < 2 THEN 'lookahead' END], lambda x: x IS NOT NULL), ',') AS violations
FROM orders""")
def row_constraints_evidence(spark: SparkSession, d: str) -> DataFrame:
    day_of = F.col("o_orderdate").cast("date")
    evidence = sample.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("order_id"), (F.col("o_orderkey") % 12 / 10.0).alias("confidence"),
        day_of.alias("as_of"), F.date_add(day_of, (F.col("o_orderkey") % 5 - 2).cast("int")).alias("observed_at"))
    return ops.enforce(evidence, ops.row_constraints("evidence"), "quarantine").select("order_id", "violations")


@query("validate_watchlist", tables=("trades",), sql=f"""
, w AS (SELECT symbol, close AS last_price, low AS entry_low, CASE WHEN l_returnflag = 'R' THEN NULL ELSE high END AS entry_high,
               open * 1.05::DOUBLE AS target, low * 0.99::DOUBLE AS stop FROM trades)
SELECT symbol, {r6('last_price')} AS last_price, {r6('entry_low')} AS entry_low, {r6('entry_high')} AS entry_high,
       {r6('target')} AS target, {r6('stop')} AS stop,
       array_to_string(list_filter([CASE WHEN entry_high IS NULL THEN 'missing_levels' END,
         CASE WHEN coalesce(entry_low > entry_high OR stop >= entry_low OR target <= entry_high OR last_price <= 0, false)
              THEN 'invalid_levels' END], lambda x: x IS NOT NULL), ',') AS violations
FROM w""")
def validate_watchlist(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: c.cast("string")
    raw = sample.trades(spark, d)
    watch = raw.select(
        "symbol", text(F.col("close")).alias("last_price"), text(F.col("low")).alias("entry_low"),
        F.when(F.col("l_returnflag") == "R", F.lit("n/a")).otherwise(text(F.col("high"))).alias("entry_high"),
        text(F.col("open") * 1.05).alias("target"), text(F.col("low") * 0.99).alias("stop"))
    return ops.validate_watchlist(watch, "quarantine")


@query("time_split", tables=("bars",), sql=f"""
SELECT CASE WHEN timestamp < date '1998-01-01' THEN 'train' ELSE 'test' END AS part, symbol, count(*) AS bars,
       {day('min(timestamp)')} AS first_day, {day('max(timestamp)')} AS last_day
FROM bars GROUP BY ALL""")
def time_split(spark: SparkSession, d: str) -> DataFrame:
    train, test = ops.time_split(sample.bars(spark, d), "1998-01-01")
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part", "symbol").agg(
        F.count(F.lit(1)).alias("bars"), F.min("timestamp").alias("first_day"), F.max("timestamp").alias("last_day"))


@query("order_limit_flags", tables=("order_requests",), sql=f"""
, f AS (SELECT *, CASE WHEN quantity <= 0 OR price <= 0 THEN 'INVALID_ORDER'
                       WHEN quantity * price > 100000 THEN 'ORDER_NOTIONAL_LIMIT'
                       WHEN NOT already_held AND open_positions >= 5 THEN 'MAX_OPEN_POSITIONS'
                       WHEN quantity * price > equity * 0.10::DOUBLE THEN 'POSITION_SIZE_LIMIT'
                       WHEN equity < day_start_equity * 0.97::DOUBLE THEN 'DAILY_LOSS_LIMIT' ELSE 'OK' END AS reason
        FROM order_requests)
SELECT order_id, {r6('price')} AS price, reason, reason = 'OK' AS allowed FROM f""")
def order_limit_flags(spark: SparkSession, d: str) -> DataFrame:
    return ops.order_limit_flags(sample.order_requests(spark, d)).select("order_id", "price", "reason", "allowed")
