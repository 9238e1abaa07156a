"""Registered row-wise scoring queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import clip_or
from ..operators import scoring as ops
from ..operators.features import feature_snapshot, ranker_features
from ..sources import sample
from .domain_sql import day, r6, with_tables
from . import queries_features
from .registry import query

# Candidate dimensions of every bar, on the scales the scores expect.
_DIMENSIONS = {
    "volume_anomaly": "volume_ratio / 3.0",
    "price_momentum": "ret_5 * 4.0 + 0.5",
    "flow_strength": "ret_1 * 5.0 + 0.5",
    "catalyst_strength": "breakout * 5.0 + 0.6",
    "sector_strength": "score / 100.0",
    "orderbook_strength": "volume / 100.0",
    "social_attention": "(high - low) / close * 5.0",
    "manipulation_risk": "volume_ratio / 2.0 - 0.5",
}
_SQL_DIMS = ", ".join(f"{e.replace('.0', '.0::DOUBLE').replace('0.5', '0.5::DOUBLE').replace('0.6', '0.6::DOUBLE')} AS {n}" for n, e in _DIMENSIONS.items())


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    bars = ranker_features(sample.stored_bars(spark, d))
    return bars.select("symbol", "timestamp", *[F.expr(e.replace(".0", ".0D").replace("0.5", "0.5D").replace("0.6", "0.6D")).alias(n) for n, e in _DIMENSIONS.items()])


def _clip01(c: str) -> str:
    return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce({c}, 0.0::DOUBLE)))"


_UP = {n: w for n, w in ops.CANDIDATE_WEIGHTS.items() if w > 0}
_POS = "(" + " + ".join(f"{w}::DOUBLE * {_clip01(n)}" for n, w in _UP.items()) + f") / {sum(_UP.values())!r}::DOUBLE"
_SCORE = f"round_even(least(100.0, greatest(0.0, 100.0 * greatest(0.0::DOUBLE, {_POS} - 0.10::DOUBLE * {_clip01('manipulation_risk')}))), 2)"
_REASONS = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN coalesce({n}, 0) >= 0.70 THEN '{n}' END" for n in _UP) + "], lambda x: x IS NOT NULL), ',')"
_CAND = f"""
, cand AS (SELECT symbol, timestamp, {_SQL_DIMS} FROM featured),
   scored AS (SELECT symbol, timestamp, {_SCORE} AS score, {_REASONS} AS reasons, coalesce(manipulation_risk, 0) AS risk FROM cand),
   gated AS (SELECT *, least(1.0, greatest(0.0, 0.55::DOUBLE + 0.35::DOUBLE * (score / 100.0) - 0.25::DOUBLE * greatest(0.0, risk))) AS conf FROM scored)
"""


@query("score_candidate", tables=("featured",), sql=_CAND + f"SELECT symbol, {day('timestamp')} AS timestamp, score, reasons FROM scored")
def score_candidate(spark: SparkSession, d: str) -> DataFrame:
    return ops.score_candidate(_candidates(spark, d)).select("symbol", "timestamp", "score", "reasons")


@query("score_evidence", tables=("featured",), sql=f"""
, cand AS (SELECT symbol || '@' || {day('timestamp')} AS symbol, {_SQL_DIMS} FROM featured),
   ev AS (SELECT symbol, volume_anomaly, price_momentum, flow_strength, catalyst_strength, manipulation_risk,
                 0.0::DOUBLE AS sector_strength, 0.0::DOUBLE AS orderbook_strength, 0.0::DOUBLE AS social_attention FROM cand)
SELECT symbol, {_SCORE} AS score FROM ev""")
def score_evidence(spark: SparkSession, d: str) -> DataFrame:
    rows = _candidates(spark, d).select(
        F.concat_ws("@", "symbol", F.col("timestamp").cast("string")).alias("symbol"),
        F.col("price_momentum").alias("pattern"), F.col("catalyst_strength").alias("catalyst"),
        "volume_anomaly", "flow_strength", "manipulation_risk")
    return ops.score_evidence(rows)


_GATE = "score >= 70 AND conf >= 0.55 AND risk <= 0.65 AS quality"


@query("quality_gate", tables=("featured",), sql=_CAND + f"""
SELECT symbol, {day('timestamp')} AS timestamp, score, round_even(conf, 4) AS confidence, {_GATE}, reasons FROM gated""")
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    return ops.quality_gate(_candidates(spark, d)).select("symbol", "timestamp", "score", "confidence", "quality", "reasons")


@query("rank_opportunities", tables=("featured",), sql=_CAND + f"""
SELECT symbol, {day('timestamp')} AS timestamp, score, round_even(conf, 4) AS confidence, {_GATE}
FROM gated ORDER BY quality DESC, score DESC, confidence DESC, symbol""")
def rank_opportunities(spark: SparkSession, d: str) -> DataFrame:
    return ops.rank_opportunities(_candidates(spark, d)).select("symbol", "timestamp", "score", "confidence", "quality")


@query("probability_proxy", tables=("featured",), sql=_CAND + f"""
SELECT symbol, {day('timestamp')} AS timestamp, round_even(score / 100.0, 4) AS probability_proxy FROM scored""")
def probability_proxy(spark: SparkSession, d: str) -> DataFrame:
    return ops.probability_proxy(_candidates(spark, d)).select("symbol", "timestamp", "probability_proxy")


_REGIME = "momentum breadth volume_risk_appetite volatility_inverse global_risk_appetite flow".split()
_DAILY_SQL = """
, daily AS (SELECT timestamp, avg(score) / 100 AS momentum, avg(CASE WHEN ret_1 > 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS breadth,
               avg(least(1.0, greatest(0.0, coalesce(volume_ratio, 1) / 3))) AS volume_risk_appetite,
               avg(least(1.0, greatest(0.0, 1 - (high - low) / close))) AS volatility_inverse,
               avg(least(1.0, greatest(0.0, coalesce(ret_5, 0) + 0.5))) AS global_risk_appetite,
               avg(least(1.0, greatest(0.0, coalesce(breakout, 0) + 0.6))) AS flow
            FROM featured GROUP BY timestamp)
"""


def _market_days(spark: SparkSession, d: str) -> DataFrame:
    f = ranker_features(sample.stored_bars(spark, d))
    bounded = lambda c: F.avg(clip_or(c, 0.0, 0.0, 1.0))
    zero = lambda c, v=0.0: F.coalesce(F.col(c), F.lit(v))
    return f.groupBy("timestamp").agg(
        (F.avg("score") / 100).alias("momentum"),
        F.avg(F.when(F.col("ret_1") > 0, 1.0).otherwise(0.0)).alias("breadth"),
        bounded(zero("volume_ratio", 1.0) / 3).alias("volume_risk_appetite"),
        bounded(1 - (F.col("high") - F.col("low")) / F.col("close")).alias("volatility_inverse"),
        bounded(zero("ret_5") + 0.5).alias("global_risk_appetite"),
        bounded(zero("breakout") + 0.6).alias("flow"),
    )


def _label(labels: tuple) -> str:
    return "CASE " + " ".join(
        f"WHEN fear_greed < {limit} THEN '{name}'" if limit is not None else f"ELSE '{name}'" for limit, name in labels) + " END"


@query("fear_greed_avg", tables=("featured",), sql=_DAILY_SQL + f"""
, s AS (SELECT timestamp, round_even(({' + '.join(_REGIME)}) / 6 * 100, 2) AS fear_greed FROM daily)
SELECT {day('timestamp')} AS timestamp, fear_greed, {_label(ops.REGIME_LABELS)} AS regime FROM s""")
def fear_greed_avg(spark: SparkSession, d: str) -> DataFrame:
    return ops.fear_greed_avg(_market_days(spark, d)).select("timestamp", "fear_greed", "regime")


_SIGNED = dict(zip(ops.WEIGHTED_REGIME, [*_REGIME, "momentum"]))


@query("fear_greed_weighted", tables=("featured",), sql=_DAILY_SQL + f"""
, s AS (SELECT timestamp, round_even(50.0 + 50.0 * ({' + '.join(
    f'{w}::DOUBLE * least(1.0, greatest(-1.0, {_SIGNED[n]} * 4 - 2))' for n, w in ops.WEIGHTED_REGIME.items())}), 2) AS fear_greed FROM daily)
SELECT {day('timestamp')} AS timestamp, fear_greed, {_label(ops.WEIGHTED_REGIME_LABELS)} AS regime FROM s""")
def fear_greed_weighted(spark: SparkSession, d: str) -> DataFrame:
    days = _market_days(spark, d)
    signed = days.select("timestamp", *[(F.col(c) * 4 - 2).alias(n) for n, c in _SIGNED.items()])
    return ops.fear_greed_weighted(signed).select("timestamp", "fear_greed", "regime")


_SAT = "CASE WHEN {0} >= 1 THEN 0.999999 WHEN {0} <= -1 THEN -0.999999 ELSE {0} END"


@query("flow_score", tables=("fund_flows",), sql=f"""
SELECT {day('as_of')} AS as_of, fund_code, {r6(_SAT.format('tanh(net_flow / 1e7)'))} AS fund_level,
       {r6(_SAT.format('tanh(net_flow / 1e3)'))} AS stock_level, {r6('(tanh(net_flow / 1e7) + 1) * 50')} AS score_100
FROM fund_flows""")
def flow_score(spark: SparkSession, d: str) -> DataFrame:
    flow = F.col("net_flow")
    return sample.fund_flows(spark, d).select(
        "as_of", "fund_code", ops.flow_score(flow, 1e7).alias("fund_level"), ops.flow_score(flow, 1e3).alias("stock_level"),
        ops.flow_score_100(flow, 1e7).alias("score_100"))


@query("flow_direction", tables=("fund_flows",), sql=f"""
SELECT {day('as_of')} AS as_of, fund_code, CASE WHEN net_flow > 0 THEN 'INFLOW' WHEN net_flow < 0 THEN 'OUTFLOW' ELSE 'FLAT' END AS direction
FROM fund_flows""")
def flow_direction(spark: SparkSession, d: str) -> DataFrame:
    return sample.fund_flows(spark, d).select("as_of", "fund_code", ops.flow_direction("net_flow").alias("direction"))


@query("estimate_exposure", tables=("holdings",), per_column={"estimated_exposure": 2}, sql=f"""
SELECT {day('as_of')} AS as_of, fund_code, symbol, {r6('fund_aum * portfolio_weight', 2)} AS estimated_exposure FROM holdings""")
def estimate_exposure(spark: SparkSession, d: str) -> DataFrame:
    held = ops.estimate_exposure(sample.holdings(spark, d), "portfolio_weight", "fund_aum")
    return held.select("as_of", "fund_code", "symbol", "estimated_exposure")


_RR = """
, rr0 AS (SELECT *, (target / last_price - 1) * 100 AS up, (1 - stop / last_price) * 100 AS down,
                 CASE WHEN last_price < entry_low THEN (entry_low / last_price - 1) * 100
                      WHEN last_price > entry_high THEN (last_price / entry_high - 1) * 100 ELSE 0 END AS dist,
                 round_even((target - entry_high) / nullif(entry_high - stop, 0), 3) AS risk_reward FROM levels),
   rr AS (SELECT *, round_even(least(100.0, greatest(0.0, 50 + least(30.0, greatest(-20.0, up)) * 1.2::DOUBLE
              - least(20.0, greatest(0.0, down)) + least(3.0, greatest(-1.0, risk_reward - 1)) * 7)), 2) AS technical_watch_score FROM rr0)
"""


@query("risk_reward", tables=("trades",), sql="""
, levels AS (SELECT symbol, open AS last_price, low * 0.999::DOUBLE AS entry_low, low * 1.001::DOUBLE AS entry_high,
                    high * 1.05::DOUBLE AS target, low * 0.97::DOUBLE AS stop FROM trades)""" + _RR + f"""
SELECT symbol, {r6('last_price')} AS last_price, {r6('up')} AS target_upside_pct, {r6('down')} AS stop_downside_pct,
       {r6('dist')} AS entry_distance_pct, risk_reward, technical_watch_score FROM rr""")
def risk_reward(spark: SparkSession, d: str) -> DataFrame:
    levels = sample.trades(spark, d).select(
        "symbol", F.col("open").alias("last_price"), (F.col("low") * 0.999).alias("entry_low"),
        (F.col("low") * 1.001).alias("entry_high"), (F.col("high") * 1.05).alias("target"), (F.col("low") * 0.97).alias("stop"))
    return ops.add_risk_reward(levels).select(
        "symbol", "last_price", "target_upside_pct", "stop_downside_pct", "entry_distance_pct", "risk_reward", "technical_watch_score")


@query("trade_returns", tables=("trades",), digits=9, sql=f"""
SELECT symbol, {r6('10000 / open', 9)} AS quantity, {r6('close / open - 1', 9)} AS gross_return,
       {r6('close / open - 1 - 0.003::DOUBLE', 9)} AS net_return FROM trades""")
def trade_returns(spark: SparkSession, d: str) -> DataFrame:
    rows = sample.trades(spark, d).select(
        "symbol", F.col("open").alias("entry_price"), F.col("close").alias("exit_price"), F.lit(10000.0).alias("capital"))
    return ops.trade_returns(rows).select("symbol", "quantity", "gross_return", "net_return")


_DECIDE = """CASE WHEN ret <= -0.03 THEN 'EXIT' WHEN cur < 55 AND cur < entry_score * 0.80::DOUBLE THEN 'EXIT'
                  WHEN cur >= entry_score * 0.95::DOUBLE THEN 'HOLD' ELSE 'CANCEL' END"""


@query("hold_exit_cancel", tables=("featured",), sql=f"""
, f AS (SELECT symbol, timestamp, score AS cur, close / open - 1 AS ret, 60 + volume % 30 AS entry_score FROM featured)
SELECT symbol, {day('timestamp')} AS timestamp, {_DECIDE} AS decision FROM f""")
def hold_exit_cancel(spark: SparkSession, d: str) -> DataFrame:
    rows = ranker_features(sample.stored_bars(spark, d))
    decision = ops.hold_exit_cancel(F.lit(60.0) + F.col("volume") % 30, F.col("score"), F.col("close") / F.col("open") - 1)
    return rows.select("symbol", "timestamp", decision.alias("decision"))


@query("attribution", tables=("featured",), sql=f"""
, p AS (SELECT symbol, timestamp, score, unnest(['breakout', 'momentum', 'volume']) AS feature,
               unnest([coalesce(breakout, 0), coalesce(ret_5, 0), coalesce(volume_ratio, 0)]) AS v,
               greatest(0, coalesce(breakout, 0)) AS g3, greatest(0, coalesce(ret_5, 0)) AS g1, greatest(0, coalesce(volume_ratio, 0)) AS g2
        FROM featured)
SELECT symbol || '@' || {day('timestamp')} AS signal_id, feature,
       {r6('CASE WHEN g1 + g2 + g3 <> 0 THEN v / (g1 + g2 + g3) * score ELSE 0 END')} AS contribution FROM p""")
def attribution(spark: SparkSession, d: str) -> DataFrame:
    rows = sample.signals(sample.stored_bars(spark, d)).withColumnRenamed("feature_contributions", "feature_scores")
    shared = ops.attribution(rows)
    return shared.select("signal_id", F.explode("feature_contributions").alias("feature", "contribution"))


_SNAP = """round_even(least(100.0, greatest(0.0, 50 + least(10.0, greatest(-10.0, return_5 * 100)) + least(10.0, greatest(-10.0, return_20 * 60))
  + least(18.0, greatest(-12.0, (volume_ratio - 1) * 12)) + least(8.0, greatest(-8.0, distance_ma20 * 50))
  + least(8.0, greatest(-8.0, (breakout_20 - 1) * 80)) + least(5.0, greatest(-5.0, (close_location - 0.5) * 10)))), 2)"""


def snapshot_ctes(also: tuple[str, ...] = ()) -> str:
    """The feature_snapshot SQL with unrounded values as CTE `snap`, after any further tables."""
    ctes, select = queries_features.SNAPSHOT_SQL.rsplit("\nSELECT symbol,", 1)
    exact = re.sub(r"round_even\(CAST\((.*?) AS DOUBLE\), 6\) AS", r"(\1) AS", "SELECT symbol," + select)
    return with_tables(f"{ctes}, snap AS ({exact})", ("bars", *also))


@query("snapshot_score", sql=snapshot_ctes() + f" SELECT symbol, {_SNAP} AS snapshot_score FROM snap")
def snapshot_score(spark: SparkSession, d: str) -> DataFrame:
    return feature_snapshot(sample.stored_bars(spark, d)).select("symbol", ops.snapshot_score().alias("snapshot_score"))
