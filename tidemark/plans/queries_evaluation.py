"""Registered metric queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as ops
from ..sources import sample
from .domain_sql import r6
from .queries_features import _TOPK_SQL
from .registry import query


@query("ranking_metrics", tables=("predictions",), sql=f"""
, p AS (SELECT timestamp AS day, actual AS t, score >= 0.6 AS p FROM predictions),
   dly AS (SELECT day, count(*) FILTER (p) AS n FROM p GROUP BY day),
   tot AS (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn FROM p)
SELECT {r6('tp / nullif(tp + fp, 0)')} AS precision, {r6('tp / nullif(tp + fn, 0)')} AS recall,
       (SELECT {r6('avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END)')} FROM dly) AS daily_hit_day_rate,
       (SELECT {r6('avg(n)')} FROM dly) AS average_daily_hits FROM tot""")
def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = sample.predictions(spark, d).withColumn("predicted", F.col("score") >= 0.6)
    return ops.ranking_metrics(rows, "actual", "predicted", "timestamp")


@query("backtest_metrics", tables=("predictions",), sql=f"""
, p AS (SELECT timestamp AS day, actual AS t, score >= 0.5 AS p FROM predictions),
   dly AS (SELECT day, count(*) FILTER (p) AS n FROM p GROUP BY day),
   mon AS (SELECT date_trunc('month', day) AS m, count(*) AS n FROM p WHERE t AND p GROUP BY 1),
   tot AS (SELECT count(*) AS signals, count(*) FILTER (t) AS positives, count(*) FILTER (t AND p) AS tp,
                  count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn FROM p),
   dd AS (SELECT count(*) FILTER (n > 0) AS hit_days, count(*) AS total_days, avg(n) AS adh FROM dly),
   mm AS (SELECT count(*) FILTER (n >= 10) AS m10, coalesce(avg(n), 0) AS amh FROM mon)
SELECT signals, positives, tp AS true_positives, fp AS false_positives, fn AS false_negatives,
       {r6('coalesce(tp / nullif(tp + fp, 0), 0)')} AS precision, {r6('coalesce(tp / nullif(tp + fn, 0), 0)')} AS recall,
       hit_days, total_days, {r6('hit_days / total_days')} AS daily_hit_day_rate, {r6('adh')} AS average_daily_hits,
       m10 AS months_with_10_hits, {r6('amh')} AS average_monthly_hits FROM tot, dd, mm""")
def backtest_metrics(spark: SparkSession, d: str) -> DataFrame:
    return ops.backtest_metrics(sample.predictions(spark, d).withColumn("prediction", F.lit(False)), 0.5)


@query("topk_metrics", tables=("predictions",), sql=_TOPK_SQL + f"""
, u AS (SELECT timestamp, count(*) FILTER (future_return >= 0.0025) AS events FROM predictions GROUP BY timestamp),
   hd AS (SELECT date_diff('day', lag(timestamp) OVER (ORDER BY timestamp), timestamp) AS gap FROM daily WHERE hits > 0)
SELECT {r6('(SELECT sum(hits) / sum(selected) FROM daily)')} AS top_k_precision,
       {r6('(SELECT avg(CASE WHEN events > 0 THEN 1.0 ELSE 0.0 END) FROM u)')} AS hit_day_rate,
       {r6('(SELECT sum(hits) FROM daily) / (SELECT sum(events) FROM u)')} AS recall,
       {r6('(SELECT avg(gap) FROM hd)')} AS mean_hit_gap_days, {r6('(SELECT avg(gap) FROM hd)')} AS mean_lead_days,
       {r6('(SELECT max_by(equity, timestamp) - 1 FROM dd)')} AS net_pnl, {r6('(SELECT min(drawdown) FROM dd)')} AS max_drawdown""")
def topk_metrics(spark: SparkSession, d: str) -> DataFrame:
    return ops.topk_metrics(sample.stored_predictions(spark, d), top_k=5, event_threshold=0.0025)


@query("learning_report", tables=("predictions",), sql=f"""
SELECT count(*) AS closed_signals, {r6('avg(CASE WHEN future_return >= 0.0025 THEN 1.0 ELSE 0.0 END)', 4)} AS hit_rate,
       {r6('avg(future_return)')} AS mean_return, {r6('median(future_return)')} AS median_return, {r6('stddev_samp(future_return)')} AS return_std,
       'READY_FOR_RESEARCH' AS recommended_action,
       CASE WHEN avg(CASE WHEN future_return >= 0.0025 THEN 1.0 ELSE 0.0 END) < 0.5 OR avg(future_return) <= 0 THEN 'AUDIT_SIGNAL_QUALITY,' ELSE '' END
         || 'RUN_FEATURE_ABLATION,RUN_WALK_FORWARD_REWEIGHTING_EXPERIMENT' AS research_actions
FROM predictions""")
def learning_report(spark: SparkSession, d: str) -> DataFrame:
    return ops.learning_report(sample.outcomes(sample.stored_predictions(spark, d)), hit_threshold=0.0025)


@query("learning_feature_edge", tables=("predictions",), digits=8, sql="""
, parts AS (SELECT symbol, timestamp, unnest(['momentum', 'volume', 'breakout']) AS feature,
                   unnest([coalesce(ret_5, 0), coalesce(volume_ratio, 0), coalesce(breakout, 0)]) AS v FROM featured)
SELECT feature, round_even(avg(v * future_return), 8) AS edge
FROM parts JOIN predictions p ON p.symbol = parts.symbol AND p.timestamp = parts.timestamp GROUP BY feature""")
def learning_feature_edge(spark: SparkSession, d: str) -> DataFrame:
    signals = sample.signals(sample.stored_bars(spark, d))
    return ops.feature_edge(signals, sample.outcomes(sample.predictions(spark, d)), "timestamp")


@query("accept_model", tables=("predictions",), sql=f"""
, m AS (SELECT symbol, coalesce(count(*) FILTER (actual AND score >= 0.6) / nullif(count(*) FILTER (score >= 0.6), 0), 0) AS precision,
               count(*) FILTER (score >= 0.6) / count(*) AS hit_day_rate FROM predictions GROUP BY symbol)
SELECT symbol, {r6('precision')} AS precision, {r6('hit_day_rate')} AS hit_day_rate, precision >= 0.35 AND hit_day_rate >= 0.25 AS accepted FROM m""")
def accept_model(spark: SparkSession, d: str) -> DataFrame:
    called = F.col("score") >= 0.6
    per_symbol = sample.predictions(spark, d).groupBy("symbol").agg(
        ops.ratio(F.count_if(F.col("actual") & called), F.count_if(called)).alias("precision"),
        ops.ratio(F.count_if(called), F.count(F.lit(1))).alias("hit_day_rate"))
    return ops.accept_model(per_symbol)
