"""Registered ranking and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranking as ops
from ..operators.exposure import attach_layers, stock_flows
from ..operators.features import performance_board, ranker_features
from ..sources import sample
from .domain_sql import day, r6
from .queries_features import _BOARD_SQL
from .queries_joins import _LAYERS_SQL, LAYER_TABLES, flow_day, layers
from .queries_scoring import _RR, _SNAP, snapshot_ctes
from .registry import query

_COLUMNS = ("symbol", "timestamp", "close", "score", "institutional_score", "institutional_data_coverage")
_COVER = " + ".join(f"CAST({c} <> 50 AS INT)" for c in ("m", "sm", "co", "re", "fu"))


def _lay(c: str) -> str:
    return f"least(100.0, greatest(0.0, coalesce({c}, 50.0)))"


_BLEND = f"""
, lay AS (SELECT *, {_lay('score')} AS m, {_lay('smart_money_score')} AS sm, 50.0::DOUBLE AS co, {_lay('research_score')} AS re,
                 {_lay('fundamental_score')} AS fu FROM joined),
   comp AS (SELECT *, round_even(0.50::DOUBLE * m + 0.20::DOUBLE * sm + 0.10::DOUBLE * co + 0.10::DOUBLE * re + 0.10::DOUBLE * fu, 2) AS institutional_score,
                 round_even(({_COVER}) / 5.0::DOUBLE, 2) AS institutional_data_coverage FROM lay)
"""
_LATEST_SQL = """
, joined AS (SELECT * FROM (SELECT * FROM featured QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) = 1)
             LEFT JOIN flow_l USING (symbol) LEFT JOIN res_l USING (symbol) LEFT JOIN fund_l USING (symbol))
"""
_GATED = _LAYERS_SQL + _LATEST_SQL + _BLEND + ", levels AS (SELECT * FROM watchlist)" + _RR + """
, gated AS (SELECT c.symbol, c.timestamp, c.close, c.score, institutional_data_coverage, technical_watch_score, risk_reward,
                   CASE WHEN risk_reward >= 1 THEN round_even(0.9::DOUBLE * institutional_score + 0.1::DOUBLE * technical_watch_score, 2)
                        ELSE institutional_score END AS institutional_score
            FROM comp c LEFT JOIN rr ON rr.symbol = c.symbol WHERE rr.symbol IS NULL OR risk_reward >= 1),
   ranked AS (SELECT *, row_number() OVER (ORDER BY institutional_score DESC, symbol) AS n FROM gated
              QUALIFY row_number() OVER (ORDER BY institutional_score DESC, symbol) <= 20)
"""
_TABLES = ("featured", "watchlist", *LAYER_TABLES)


def ranked(spark: SparkSession, d: str, min_score: float = 0.0) -> DataFrame:
    bars = sample.stored_bars(spark, d)
    return ops.rank_latest(bars, layers(spark, d), sample.watchlist(bars), min_score=min_score)


@query("composite_score", tables=("featured", *LAYER_TABLES), sql=_LAYERS_SQL + """
, joined AS (SELECT * FROM featured LEFT JOIN flow_l USING (symbol) LEFT JOIN res_l USING (symbol) LEFT JOIN fund_l USING (symbol))
""" + _BLEND + f"""
SELECT symbol, {day('timestamp')} AS timestamp, {r6('score')} AS score, institutional_score, institutional_data_coverage FROM comp""")
def composite_score(spark: SparkSession, d: str) -> DataFrame:
    scored = ops.composite_score(attach_layers(ranker_features(sample.stored_bars(spark, d)), layers(spark, d)))
    return scored.select("symbol", "timestamp", "score", "institutional_score", "institutional_data_coverage")


@query("rank_latest", tables=_TABLES, sql=_GATED + f"""
SELECT symbol, {day('timestamp')} AS timestamp, {r6('close')} AS close, {r6('score')} AS score, institutional_score,
       institutional_data_coverage, technical_watch_score, risk_reward FROM ranked""")
def rank_latest(spark: SparkSession, d: str) -> DataFrame:
    return ranked(spark, d).select(*_COLUMNS, "technical_watch_score", "risk_reward")


@query("rank_candidates", sql=snapshot_ctes(("holdings", "fund_flows")) + f"""
, flow AS (SELECT h.symbol, round_even(sum(net_flow * portfolio_weight), 2) AS flow
           FROM holdings h JOIN fund_flows f ON h.fund_code = f.fund_code AND h.as_of = f.as_of
           WHERE f.as_of = (SELECT max(as_of) FROM fund_flows) GROUP BY h.symbol),
   base AS (SELECT snap.*, flow, {_SNAP} AS b FROM snap LEFT JOIN flow USING (symbol)),
   sc AS (SELECT *, round_even(least(100.0, greatest(0.0, CASE WHEN flow IS NULL THEN b ELSE
            round_even(b * 0.8::DOUBLE + (tanh(flow / 1000000.0::DOUBLE) + 1.0) * 50.0 * 0.2::DOUBLE, 2) END)), 2) AS score FROM base)
SELECT symbol, score, array_to_string(list_filter([CASE WHEN volume_ratio >= 2 THEN 'volume anomaly' END,
         CASE WHEN breakout_20 >= 0.98 THEN 'near 20-bar high' END, CASE WHEN return_5 > 0.03 THEN 'positive 5-bar momentum' END,
         CASE WHEN flow >= 1e6 THEN 'smart money accumulation' WHEN flow <= -1e6 THEN 'smart money distribution' END],
         lambda x: x IS NOT NULL), ',') AS reasons,
       {r6('least(0.99, greatest(0.01, 0.35::DOUBLE + score / 150.0))')} AS confidence
FROM sc WHERE score >= 40 ORDER BY score DESC, symbol LIMIT 20""")
def rank_candidates(spark: SparkSession, d: str) -> DataFrame:
    flows = stock_flows(sample.fund_flows(spark, d), sample.holdings(spark, d), flow_day(spark, d))
    flows = flows.select("symbol", F.col("estimated_flow").alias("flow"))
    return ops.rank_candidates(sample.bars(spark, d), flows, min_score=40.0, flow_scale=1_000_000.0)


@query("daily_signal", tables=_TABLES, sql=_GATED + """
SELECT symbol, institutional_score, CASE WHEN score >= 85 THEN 'STRONG' ELSE 'WATCH' END AS signal FROM ranked""")
def daily_signal(spark: SparkSession, d: str) -> DataFrame:
    return ops.daily_signal(ranked(spark, d)).select("symbol", "institutional_score", "signal")


@query("ranking_status", tables=_TABLES, sql=_GATED + """
SELECT count(*) AS candidates, CASE WHEN count(*) > 0 THEN 'SIGNAL' ELSE 'NO_QUALITY_SIGNAL' END AS status
FROM ranked WHERE institutional_score >= 99""")
def ranking_status(spark: SparkSession, d: str) -> DataFrame:
    return ops.ranking_status(ranked(spark, d, min_score=99.0))


@query("morning_report", tables=_TABLES, sql=_GATED + """
SELECT 1::BIGINT AS line, 'Morning ranking' AS text
UNION ALL SELECT 2, (SELECT printf('Evren: %d | OHLCV satırı: %d', count(DISTINCT symbol), count(*)) FROM bars)
UNION ALL SELECT n + 2, printf('%d. %s | skor=%.2f | veri-kapsamı=%.0f%%', n, symbol, institutional_score, institutional_data_coverage * 100) FROM ranked""")
def morning_report(spark: SparkSession, d: str) -> DataFrame:
    bars = sample.stored_bars(spark, d)
    return ops.morning_report(ranked(spark, d), bars, bars.select("symbol"), "Morning ranking")


@query("board_lines", tables=("bars",), sql=_BOARD_SQL + """
SELECT rank AS line, printf('%2d. %-8s %%%7.2f %s%02d', rank, symbol, period_return_pct,
       CASE WHEN previous_rank > rank THEN '↑' WHEN previous_rank < rank THEN '↓' ELSE '→' END, abs(previous_rank - rank)) AS text
FROM board WHERE rank <= 20""")
def board_lines(spark: SparkSession, d: str) -> DataFrame:
    return ops.board_lines(performance_board(sample.bars(spark, d)))


@query("paper_selection", tables=_TABLES, sql=_GATED + f"""
SELECT symbol, {r6('close * 1.001::DOUBLE')} AS entry_price, {r6('100000 / (close * 1.001::DOUBLE)')} AS quantity,
       {r6('100000 * 1.001::DOUBLE')} AS entry_cost FROM ranked WHERE n <= 5""")
def paper_selection(spark: SparkSession, d: str) -> DataFrame:
    return ops.paper_selection(ranked(spark, d))
