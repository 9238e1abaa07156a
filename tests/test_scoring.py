import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions.numeric import clip, rounded, saturated_tanh
from tidemark.operators import scoring as ops


def one(spark, **values):
    return spark.createDataFrame([values])


FULL = {name: 1.0 for name in ops.CANDIDATE_WEIGHTS if name != "manipulation_risk"}


def test_candidate_bounds_and_reasons(spark):
    best = ops.score_candidate(one(spark, **FULL, manipulation_risk=0.0)).first()
    assert best.score == 100.0 and best.reasons == list(FULL)
    assert ops.score_candidate(one(spark, **FULL, manipulation_risk=1.0)).first().score == 90.0
    assert ops.score_candidate(one(spark, volume_anomaly=0.0)).first().score == 0.0
    # unclipped value decides the reason, clipped value the score
    over = ops.score_candidate(one(spark, volume_anomaly=5.0)).first()
    assert over.reasons == ["volume_anomaly"] and over.score == pytest.approx(round(100 * 0.15 / 0.9, 2))
    with pytest.raises(ValueError):
        ops.score_candidate(one(spark, volume_anomaly=1.0), {"volume_anomaly": -1.0})


def test_quality_gate_never_forces(spark):
    good = ops.quality_gate(one(spark, symbol="A", **FULL, manipulation_risk=0.0)).first()
    assert good.quality and good.confidence == 0.9
    weak = ops.quality_gate(one(spark, symbol="A", volume_anomaly=0.1, manipulation_risk=0.0)).first()
    assert not weak.quality
    risky = ops.quality_gate(one(spark, symbol="A", **FULL, manipulation_risk=0.7)).first()
    assert not risky.quality
    ranked = ops.rank_opportunities(spark.createDataFrame([("A", 0.1), ("B", 0.9)], "symbol string, volume_anomaly double"))
    assert [r.symbol for r in ranked.collect()] == ["B", "A"]
    assert ops.probability_proxy(one(spark, **FULL)).first().probability_proxy == 1.0


def test_evidence(spark):
    df = spark.createDataFrame(
        [("A", 1.0, 1.0, 1.0, 1.0, 0.0), ("B", 0.2, 0.0, 0.0, 0.0, 0.0)],
        "symbol string, pattern double, catalyst double, volume_anomaly double, flow_strength double, manipulation_risk double")
    got = [(r.symbol, r.score) for r in ops.score_evidence(df).collect()]
    assert got == [("A", 66.67), ("B", 3.33)]


@pytest.mark.parametrize(("level", "label"), [(0.0, "EXTREME_FEAR"), (0.2, "FEAR"), (0.35, "NEUTRAL"), (0.5, "GREED"), (0.65, "STRONG_GREED"), (1.0, "EXTREME_GREED")])
def test_regime_mean(spark, level, label):
    got = ops.fear_greed_avg(one(spark, **{n: level for n in ops.REGIME_INPUTS})).first()
    assert (got.fear_greed, got.regime) == (pytest.approx(level * 100), label)


def test_regime_rejects_out_of_range(spark):
    with pytest.raises(PySparkException, match="inputs_outside"):
        ops.fear_greed_avg(one(spark, **{n: 1.1 for n in ops.REGIME_INPUTS})).collect()


@pytest.mark.parametrize(("level", "score", "label"), [(1.0, 100.0, "EXTREME_GREED"), (0.0, 50.0, "NEUTRAL"), (-0.1, 45.0, "CAUTIOUS"), (9.0, 100.0, "EXTREME_GREED")])
def test_regime_weighted(spark, level, score, label):
    got = ops.fear_greed_weighted(one(spark, **{n: level for n in ops.WEIGHTED_REGIME})).first()
    assert (got.fear_greed, got.regime) == (score, label)


def test_flow_scores(spark):
    got = one(spark, f=1e8).select(
        ops.flow_score("f", 1e8).alias("a"), ops.flow_score(F.col("f") * 1e6, 1e8).alias("b"), ops.flow_score(-F.col("f") * 1e6, 1e8).alias("c"),
        ops.flow_score_100(F.col("f")).alias("d"), ops.flow_direction("f").alias("e")).first()
    assert got.a == pytest.approx(math.tanh(1)) and (got.b, got.c) == (0.999999, -0.999999)
    assert got.d == pytest.approx((math.tanh(1) + 1) * 50) and got.e == "INFLOW"
    with pytest.raises(ValueError):
        saturated_tanh("f", 0)


def test_exposure_without_aum_is_null(spark):
    held = {"symbol": "A", "manager": "M", "weight": 0.5}
    assert ops.estimate_exposure(one(spark, **held)).first().estimated_exposure is None
    assert ops.estimate_exposure(one(spark, **held, aum=10.0)).first().estimated_exposure == 5.0
    with pytest.raises(ValueError, match="manager"):
        ops.estimate_exposure(one(spark, symbol="A", weight=0.5))


def test_risk_reward(spark):
    df = one(spark, symbol="ISMEN", last_price=33.22, entry_low=32.62, entry_high=33.50, target=36.40, stop=32.00)
    got = ops.add_risk_reward(df).first()
    assert got.risk_reward == 1.933 and got.entry_distance_pct == 0.0
    up, down = (36.40 / 33.22 - 1) * 100, (1 - 32.00 / 33.22) * 100
    assert got.technical_watch_score == pytest.approx(50 + up * 1.2 - down + (1.933 - 1) * 7, abs=0.006)


def test_trade(spark):
    got = ops.trade_returns(one(spark, entry_price=100.0, exit_price=110.0, capital=1000.0)).first()
    assert (got.quantity, got.gross_return, got.net_return) == (10.0, 0.1, 0.097)
    with pytest.raises(PySparkException):
        ops.trade_returns(one(spark, entry_price=0.0, exit_price=1.0, capital=1.0)).collect()


@pytest.mark.parametrize(("entry", "current", "ret", "want"), [(90, 90, 0.01, "HOLD"), (90, 90, -0.04, "EXIT"), (90, 50, 0.0, "EXIT"), (90, 80, 0.0, "CANCEL")])
def test_decisions(spark, entry, current, ret, want):
    df = one(spark, e=float(entry), c=float(current), r=ret)
    assert df.select(ops.hold_exit_cancel(F.col("e"), F.col("c"), F.col("r"))).first()[0] == want


def test_attribution_keeps_signs(spark):
    df = spark.createDataFrame([({"a": 3.0, "b": 1.0, "c": -2.0}, 80.0), ({"a": -1.0}, 80.0)], "feature_scores map<string,double>, score double")
    got = [r.feature_contributions for r in ops.attribution(df).collect()]
    assert got == [{"a": 60.0, "b": 20.0, "c": -40.0}, {"a": 0.0}]


def test_numeric_helpers(spark):
    df = spark.createDataFrame([(None,), (2.675,), (0.125,)], "x double")
    got = df.select(clip("x", 0, 1).alias("c"), rounded("x", 2).alias("r")).collect()
    assert [r.c for r in got] == [None, 1.0, 0.125] and [r.r for r in got] == [None, 2.68, 0.12]
