"""Registered time-series queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.chunked import over_chunks
from ..operators import features as ops
from ..operators.evaluation import topk_daily
from ..sources import sample
from .domain_sql import day, moment, r6
from .registry import query

_RANKER = ["ret_1", "ret_5", "vol_mean_20", "volume_ratio", "high_20_prev", "breakout", "score"]


SNAPSHOT_SQL = f"""
, t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS b,
               count(*) OVER (PARTITION BY symbol) AS n,
               CASE WHEN lag(close) OVER s = 0 THEN 0.0 ELSE close / lag(close) OVER s END - 1 AS r
        FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY timestamp)),
   a AS (SELECT symbol, max(timestamp) AS timestamp, max(n) AS n,
                max(close) FILTER (b = 1) AS close, max(high) FILTER (b = 1) AS high, max(low) FILTER (b = 1) AS low,
                max(volume) FILTER (b = 1) AS volume, max(close) FILTER (b = 2) AS prev,
                max_by(close, b) FILTER (b <= 6) AS a5, max_by(close, b) FILTER (b <= 21) AS a20,
                avg(volume) FILTER (b BETWEEN 2 AND 21) AS mv, avg(close) FILTER (b <= 20) AS ma20,
                max(high) FILTER (b <= 20) AS high20,
                coalesce(stddev_samp(r) FILTER (b <= 20 AND b < n), 0) AS volatility_20
         FROM t GROUP BY symbol)
SELECT symbol, {day('timestamp')} AS timestamp,
       {r6('coalesce(close / nullif(prev, 0), 0) - 1')} AS return_1, {r6('coalesce(close / nullif(a5, 0), 0) - 1')} AS return_5,
       {r6('coalesce(volume / nullif(mv, 0), 0)')} AS volume_ratio, {r6('coalesce((high - low) / nullif(close, 0), 0)')} AS range_pct,
       {r6('CASE WHEN high <> low THEN (close - low) / (high - low) ELSE 0.5 END')} AS close_location,
       {r6('coalesce(close / nullif(a20, 0), 0) - 1')} AS return_20, {r6('coalesce(close / nullif(ma20, 0), 0) - 1')} AS distance_ma20,
       {r6('coalesce(close / nullif(high20, 0), 0)')} AS breakout_20, {r6('volatility_20')} AS volatility_20
FROM a WHERE n >= 2"""


@query("feature_snapshot", tables=("bars",), sql=SNAPSHOT_SQL)
def feature_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return ops.feature_snapshot(sample.stored_bars(spark, d))


@query("ranker_features", tables=("featured",), sql=f"""
SELECT symbol, {day('timestamp')} AS timestamp, {', '.join(f'{r6(c)} AS {c}' for c in _RANKER)} FROM featured""")
def ranker_features(spark: SparkSession, d: str) -> DataFrame:
    return ops.ranker_features(sample.stored_bars(spark, d)).select("symbol", "timestamp", *_RANKER)


@query("limit_up_dataset", tables=("limit_up_rows",), sql=f"""
SELECT symbol, {day('timestamp')} AS timestamp, {', '.join(f'{r6(c)} AS {c}' for c in ops.MODEL_FEATURES)}, target
FROM limit_up_rows""")
def limit_up_dataset(spark: SparkSession, d: str) -> DataFrame:
    return ops.limit_up_dataset(sample.stored_bars(spark, d)).select("symbol", "timestamp", *ops.MODEL_FEATURES, "target")


@query("forward_labels", tables=("bars",), sql=f"""
SELECT symbol, {day('timestamp')} AS timestamp,
       coalesce(lead(high, 3) OVER w >= close * 1.10::DOUBLE, false) AS hit_limit_forward,
       lead(high, 3) OVER w IS NOT NULL AS label_available
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)""")
def forward_labels(spark: SparkSession, d: str) -> DataFrame:
    labelled = ops.forward_labels(sample.stored_bars(spark, d), limit_pct=0.10, horizon_bars=3)
    return labelled.select("symbol", "timestamp", "hit_limit_forward", "label_available")


@query("flow_anomalies", tables=("fund_flows",), per_column={"net_flow": 2}, sql=f"""
, z AS (SELECT fund_code, as_of, net_flow,
               CASE WHEN count(net_flow) OVER p < 2 THEN 0
                    WHEN min(net_flow) OVER p = max(net_flow) OVER p AND net_flow = min(net_flow) OVER p THEN 0
                    WHEN min(net_flow) OVER p = max(net_flow) OVER p
                         THEN CASE WHEN net_flow > min(net_flow) OVER p THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END
                    ELSE (net_flow - avg(net_flow) OVER p) / stddev_pop(net_flow) OVER p END AS z
        FROM fund_flows
        WINDOW p AS (PARTITION BY fund_code ORDER BY as_of ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT fund_code, {day('as_of')} AS as_of, {r6('net_flow', 2)} AS net_flow, {r6('z')} AS z_score, abs(z) >= 2 AS is_anomalous
FROM z""")
def flow_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return ops.flow_anomalies(sample.fund_flows(spark, d))


_BOARD_SQL = """
, t AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS b FROM bars),
   e AS (SELECT symbol, max(close) FILTER (b = 1) AS c0, max(close) FILTER (b = 21) AS c1, max(close) FILTER (b = 41) AS c2
         FROM t GROUP BY symbol),
   r AS (SELECT symbol, (c0 / c1 - 1) * 100 AS cur, (c1 / c2 - 1) * 100 AS prev FROM e WHERE c1 > 0 AND c2 > 0),
   board AS (SELECT symbol, round_even(cur, 2) AS period_return_pct, round_even(prev, 2) AS previous_period_return_pct,
              row_number() OVER (ORDER BY cur DESC, symbol) AS rank, row_number() OVER (ORDER BY prev DESC, symbol) AS previous_rank
       FROM r)
"""


@query("performance_board", tables=("bars",), sql=_BOARD_SQL + f"""
SELECT *, previous_rank - rank AS rank_change, {r6('period_return_pct - previous_period_return_pct')} AS acceleration_pct
FROM board WHERE rank <= 20""")
def performance_board(spark: SparkSession, d: str) -> DataFrame:
    return ops.performance_board(sample.bars(spark, d))


@query("limit_price", tables=("trades",), sql=f"""
SELECT symbol, {day('timestamp')} AS timestamp, {r6('open')} AS reference_price, {r6('close')} AS close_price,
       {r6('open * 1.05::DOUBLE')} AS limit_price, close >= open * 1.05::DOUBLE - 1e-6 AS is_limit_up_close
FROM trades""")
def limit_price(spark: SparkSession, d: str) -> DataFrame:
    reference, close = F.col("open"), F.col("close")
    return sample.trades(spark, d).select(
        "symbol", "timestamp", reference.alias("reference_price"), close.alias("close_price"),
        ops.limit_price(reference, 0.05).alias("limit_price"),
        ops.is_limit_up_close(close, reference, 0.05).alias("is_limit_up_close"),
    )


@query("is_limit_up_close", tables=("bars",), sql=f"""
, p AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY timestamp) AS ref FROM bars)
SELECT symbol, {day('timestamp')} AS timestamp, {r6('ref')} AS reference_price, close >= ref * 1.10::DOUBLE - 1e-6 AS is_limit_up_close
FROM p WHERE ref IS NOT NULL""")
def is_limit_up_close(spark: SparkSession, d: str) -> DataFrame:
    """Closes at the limit over the previous close."""
    def previous(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumn("reference_price", F.lag("close").over(w))

    rows = over_chunks(sample.stored_bars(spark, d), ["symbol"], ["timestamp"], F.year("timestamp"), previous, before=1, needs=["close"])
    flag = ops.is_limit_up_close(F.col("close"), F.col("reference_price"), 0.10)
    return rows.filter("reference_price is not null").select("symbol", "timestamp", "reference_price", flag.alias("is_limit_up_close"))


@query("first_touch", tables=("ticks", "positions"), sql=f"""
SELECT t.symbol, {moment("min(CASE WHEN price >= entry_price * 1.10::DOUBLE - 1e-6 THEN ts END)")} AS first_touch_time
FROM ticks t JOIN positions p ON t.symbol = p.symbol GROUP BY t.symbol""")
def first_touch(spark: SparkSession, d: str) -> DataFrame:
    bars = sample.ticks(spark, d).select("symbol", F.col("ts").alias("timestamp"), F.col("price").alias("high"))
    entered = bars.join(sample.positions(spark, d), "symbol")
    return ops.first_touch(entered, F.col("entry_price"), 0.10, ["symbol"])


@query("limit_up_events", tables=("bars",), sql=f"""
, p AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY timestamp) AS ref FROM bars),
   h AS (SELECT *, coalesce(high >= ref * 1.10::DOUBLE - 1e-6, false) AS touched FROM p),
   f AS (SELECT *, NOT coalesce(lag(touched) OVER (PARTITION BY symbol ORDER BY timestamp), false) AS first_touch FROM h)
SELECT symbol, {day('timestamp')} AS event_time, {r6('ref')} AS reference_price, {r6('ref * 1.10::DOUBLE')} AS limit_price,
       {r6('close')} AS close_price, first_touch, close >= ref * 1.10::DOUBLE - 1e-6 AS held_at_close
FROM f WHERE touched""")
def limit_up_events(spark: SparkSession, d: str) -> DataFrame:
    return ops.limit_up_events(sample.stored_bars(spark, d))


@query("latest_per_symbol", tables=("bars",), sql=f"""
SELECT symbol, {day('timestamp')} AS timestamp, {r6('open')} AS open, {r6('high')} AS high, {r6('low')} AS low,
       {r6('close')} AS close, {r6('volume')} AS volume
FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) = 1""")
def latest_per_symbol(spark: SparkSession, d: str) -> DataFrame:
    return ops.latest_per_symbol(sample.bars(spark, d))


@query("estimate_revisions", tables=("estimates",), sql=f"""
, r AS (SELECT *, estimate / lag(estimate) OVER (PARTITION BY symbol, period ORDER BY observed_at) - 1 AS rev FROM estimates)
SELECT symbol, round_even(least(100.0, greatest(0.0, 50 +
         coalesce(max_by(rev, row(period, observed_at)) FILTER (rev IS NOT NULL), 0.0) * 500)), 2) AS analyst_revision_score
FROM r GROUP BY symbol""")
def estimate_revisions(spark: SparkSession, d: str) -> DataFrame:
    return ops.estimate_revisions(sample.estimates(spark, d))


_TOPK_SQL = """
, sel AS (SELECT * FROM predictions QUALIFY row_number() OVER (PARTITION BY timestamp ORDER BY score DESC, symbol) <= 5),
   daily AS (SELECT timestamp, avg(future_return) AS daily_return, count(*) AS selected,
                    count(*) FILTER (future_return >= 0.0025) AS hits FROM sel GROUP BY timestamp),
   eq AS (SELECT *, product(1 + daily_return) OVER (ORDER BY timestamp) AS equity FROM daily),
   dd AS (SELECT *, equity / max(equity) OVER (ORDER BY timestamp) - 1 AS drawdown FROM eq)
"""


@query("equity_curve", tables=("predictions",), sql=_TOPK_SQL + f"""
SELECT {day('timestamp')} AS timestamp, {r6('daily_return')} AS daily_return, {r6('equity')} AS equity,
       {r6('drawdown')} AS drawdown FROM dd""")
def equity_curve(spark: SparkSession, d: str) -> DataFrame:
    daily = topk_daily(sample.stored_predictions(spark, d), top_k=5, event_threshold=0.0025)
    return ops.equity_curve(daily).select("timestamp", "daily_return", "equity", "drawdown")


@query("ledger_metrics", tables=("equity_snapshots",), sql=f"""
, p AS (SELECT *, max(equity) OVER (PARTITION BY account ORDER BY timestamp, seq ROWS UNBOUNDED PRECEDING) AS peak
        FROM equity_snapshots)
SELECT account, {r6('max_by(equity, row(timestamp, seq)) / 1000000.0 - 1')} AS net_return,
       {r6('least(0.0, min(equity / greatest(1000000.0, peak) - 1))')} AS max_drawdown, CAST(count(*) AS DOUBLE) AS observations
FROM p GROUP BY account""")
def ledger_metrics(spark: SparkSession, d: str) -> DataFrame:
    return ops.ledger_metrics(
        sample.equity_snapshots(spark, d), 1_000_000.0, ["account"], ["timestamp", "seq"], F.to_date("timestamp")
    )
