"""Row-wise scores, labels and trade arithmetic: pure projections that stay inside code generation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip, clip_or, rounded, saturated_tanh
from ..schemas import WATCH_LEVELS, require
from .quality import enforce, validate_watchlist

# Default weights and label limits.
CANDIDATE_WEIGHTS = {
    "volume_anomaly": 0.15,
    "price_momentum": 0.15,
    "flow_strength": 0.15,
    "catalyst_strength": 0.15,
    "sector_strength": 0.10,
    "orderbook_strength": 0.10,
    "social_attention": 0.10,
    "manipulation_risk": -0.10,
}
REGIME_INPUTS = (
    "momentum", "breadth", "volume_risk_appetite", "volatility_inverse", "global_risk_appetite", "flow",
)
REGIME_LABELS = (
    (20, "EXTREME_FEAR"), (35, "FEAR"), (50, "NEUTRAL"), (65, "GREED"), (80, "STRONG_GREED"), (None, "EXTREME_GREED"),
)
WEIGHTED_REGIME = {
    "index_momentum": 0.20,
    "breadth": 0.20,
    "volume_pressure": 0.15,
    "volatility": 0.10,
    "global_risk": 0.10,
    "fx_pressure": 0.10,
    "sentiment": 0.15,
}
WEIGHTED_REGIME_LABELS = (
    (20, "EXTREME_FEAR"), (35, "FEAR"), (50, "CAUTIOUS"), (65, "NEUTRAL"), (80, "GREED"), (None, "EXTREME_GREED"),
)
REASON_FLOOR = 0.70


def _dimension(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def score_candidate(df: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Weighted 0-100 candidate score with a separate manipulation penalty, and the dimensions that drive it."""
    weights = dict(weights or CANDIDATE_WEIGHTS)
    upward = {name: w for name, w in weights.items() if w > 0}
    if not upward:
        raise ValueError("weights need at least one positive entry")
    full = df.withColumns({name: F.lit(0.0) for name in CANDIDATE_WEIGHTS if name not in df.columns})
    strength = F.lit(0.0)
    for name, w in upward.items():
        strength = strength + F.lit(w) * clip(_dimension(name), 0.0, 1.0)
    strength = strength / F.lit(sum(upward.values()))
    penalty = F.lit(abs(weights.get("manipulation_risk", 0.0))) * clip(_dimension("manipulation_risk"), 0.0, 1.0)
    score = clip(F.lit(100.0) * F.greatest(F.lit(0.0), strength - penalty), 0.0, 100.0)
    drivers = [
        F.when(_dimension(name) >= REASON_FLOOR, F.lit(name)) for name in CANDIDATE_WEIGHTS if weights.get(name, 0) > 0
    ]
    return full.withColumn("score", rounded(score, 2)).withColumn("reasons", F.array_compact(F.array(*drivers)))


def score_evidence(df: DataFrame) -> DataFrame:
    """Candidate score of (pattern, catalyst, volume_anomaly, flow_strength, manipulation_risk) evidence, best first."""
    mapped = df.select(
        "symbol",
        F.col("pattern").alias("price_momentum"),
        F.col("catalyst").alias("catalyst_strength"),
        "volume_anomaly", "flow_strength", "manipulation_risk",
    )
    return score_candidate(mapped).select("symbol", "score").orderBy(F.col("score").desc(), "symbol")


def quality_gate(
    df: DataFrame, min_score: float = 70.0, min_confidence: float = 0.55, max_manipulation_risk: float = 0.65
) -> DataFrame:
    """Candidate score plus confidence and a pass/fail quality flag (judged on the unrounded confidence)."""
    scored = score_candidate(df)
    risk = _dimension("manipulation_risk")
    confidence = clip(
        F.lit(0.55) + F.lit(0.35) * (F.col("score") / 100.0) - F.lit(0.25) * F.greatest(F.lit(0.0), risk), 0.0, 1.0
    )
    passed = (F.col("score") >= min_score) & (confidence >= min_confidence) & (risk <= max_manipulation_risk)
    return scored.withColumn("confidence", rounded(confidence, 4)).withColumn("quality", passed)


def rank_opportunities(df: DataFrame, **limits: float) -> DataFrame:
    order = [F.col(c).desc() for c in ("quality", "score", "confidence")]
    return quality_gate(df, **limits).orderBy(*order, "symbol")


def probability_proxy(df: DataFrame) -> DataFrame:
    return score_candidate(df).withColumn("probability_proxy", rounded(F.col("score") / 100.0, 4))


def _labelled(score: Column, labels: tuple) -> Column:
    chain = F.when(F.lit(False), F.lit(""))
    for limit, label in labels:
        chain = chain.otherwise(F.lit(label)) if limit is None else chain.when(score < limit, F.lit(label))
    return chain


def fear_greed_avg(df: DataFrame, mode: str = "fail") -> DataFrame:
    """Mean of six 0..1 regime inputs on a 0-100 scale, with its label."""
    outside = F.lit(False)
    for name in REGIME_INPUTS:
        outside = outside | F.coalesce(~F.col(name).between(0, 1), F.lit(True))
    checked = enforce(df, {"inputs_outside_0_1": outside}, mode, "regime row")
    total = F.lit(0.0)
    for name in REGIME_INPUTS:
        total = total + F.col(name)
    scored = checked.withColumn("fear_greed", rounded(total / len(REGIME_INPUTS) * 100.0, 2))
    return scored.withColumn("regime", _labelled(F.col("fear_greed"), REGIME_LABELS))


def fear_greed_weighted(df: DataFrame) -> DataFrame:
    """Weighted -1..1 regime inputs on a 0-100 scale; its labels differ from the plain mean's."""
    total = F.lit(0.0)
    for name, weight in WEIGHTED_REGIME.items():
        total = total + F.lit(weight) * clip_or(name, 0.0, -1.0, 1.0)
    scored = df.withColumn("fear_greed", rounded(F.lit(50.0) + F.lit(50.0) * total, 2))
    return scored.withColumn("regime", _labelled(F.col("fear_greed"), WEIGHTED_REGIME_LABELS))


def flow_score(flow: str | Column, scale: float = 1_000_000_000.0) -> Column:
    """Net flow on an open (-1, 1) scale. Fund level by default; use 1e8 for single stocks."""
    return saturated_tanh(flow, scale)


def flow_score_100(flow: Column, scale: float = 100_000_000.0) -> Column:
    if scale <= 0:
        raise ValueError("scale must be positive")
    return (F.tanh(flow / F.lit(float(scale))) + 1.0) * 50.0


def flow_direction(flow: str | Column) -> Column:
    flow = F.col(flow) if isinstance(flow, str) else flow
    return F.when(flow > 0, "INFLOW").when(flow < 0, "OUTFLOW").otherwise("FLAT")


def estimate_exposure(positions: DataFrame, weight: str = "weight", aum: str = "aum") -> DataFrame:
    """AUM x weight; NULL where AUM is unknown, never imputed. Positions have a symbol, a manager and a weight."""
    require(positions, ("symbol", "manager", weight), "positions")
    value = F.col(aum) * F.col(weight) if aum in positions.columns else F.lit(None).cast("double")
    return positions.withColumn("estimated_exposure", value)


def add_risk_reward(watch: DataFrame, mode: str = "fail") -> DataFrame:
    """Upside, downside, entry distance, reward/risk and the 0-100 watch score of price levels."""
    df = validate_watchlist(watch, mode)
    last, low, high, target, stop = (F.col(c) for c in WATCH_LEVELS)
    pct = lambda c: c * 100.0
    distance = (
        F.when(last < low, pct(F.try_divide(low, last) - 1.0))
        .when(last > high, pct(F.try_divide(last, high) - 1.0))
        .otherwise(F.lit(0.0))
    )
    upside, downside = pct(F.try_divide(target, last) - 1.0), pct(F.lit(1.0) - F.try_divide(stop, last))
    df = df.withColumns(
        {
            "target_upside_pct": upside,
            "stop_downside_pct": downside,
            "entry_distance_pct": distance,
            "risk_reward": rounded(F.try_divide(target - high, high - stop), 3),
        }
    )
    score = (
        F.lit(50.0)
        + clip("target_upside_pct", -20.0, 30.0) * 1.2
        - clip("stop_downside_pct", 0.0, 20.0)
        + clip(F.col("risk_reward") - 1.0, -1.0, 3.0) * 7.0
    )
    return df.withColumn("technical_watch_score", rounded(clip(score, 0.0, 100.0), 2))


def trade_returns(
    trades: DataFrame, commission_bps: float = 10.0, slippage_bps: float = 5.0, mode: str = "fail"
) -> DataFrame:
    """Gross and cost-adjusted return and quantity of (entry_price, exit_price, capital) rows."""
    bad = F.coalesce(F.least("entry_price", "exit_price", "capital") <= 0, F.lit(True))
    checked = enforce(trades, {"nonpositive_price_or_capital": bad}, mode, "trade")
    round_trip = 2 * (commission_bps + slippage_bps) / 10_000
    gross = rounded(F.try_divide("exit_price", "entry_price") - 1.0, 12)
    return checked.withColumns(
        {
            "quantity": F.try_divide("capital", "entry_price"),
            "gross_return": gross,
            "net_return": rounded(gross - F.lit(round_trip), 12),
        }
    )


def hold_exit_cancel(
    entry_score: Column, current_score: Column, current_return: Column,
    stop_return: float = -0.03, min_hold_score: float = 55.0,
) -> Column:
    """Decision for an open position: stop-loss, score decay, hold, or cancel."""
    return (
        F.when(current_return <= stop_return, "EXIT")
        .when((current_score < min_hold_score) & (current_score < entry_score * 0.80), "EXIT")
        .when(current_score >= entry_score * 0.95, "HOLD")
        .otherwise("CANCEL")
    )


def attribution(df: DataFrame, parts: str = "feature_scores", score: str = "score") -> DataFrame:
    """Split a score over its feature map in proportion to the positive feature mass; signs are kept."""
    mass = F.aggregate(F.map_values(parts), F.lit(0.0), lambda acc, v: acc + F.greatest(F.lit(0.0), v))
    share = F.transform_values(
        parts,
        lambda _, v: F.when(F.col("_mass") != 0, rounded(F.try_divide(v, F.col("_mass")) * F.col(score), 6)).otherwise(
            F.lit(0.0)
        ),
    )
    return df.withColumn("_mass", mass).withColumn("feature_contributions", share).drop("_mass")


def snapshot_score() -> Column:
    """0-100 score of a feature snapshot; each part is bounded so that no single feature dominates."""
    total = (
        F.lit(50.0)
        + clip(F.col("return_5") * 100.0, -10, 10)
        + clip(F.col("return_20") * 60.0, -10, 10)
        + clip((F.col("volume_ratio") - 1.0) * 12.0, -12, 18)
        + clip(F.col("distance_ma20") * 50.0, -8, 8)
        + clip((F.col("breakout_20") - 1.0) * 80.0, -8, 8)
        + clip((F.col("close_location") - 0.5) * 10.0, -5, 5)
    )
    return rounded(clip(total, 0.0, 100.0), 2)
