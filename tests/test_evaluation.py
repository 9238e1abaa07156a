import datetime as dt

import numpy as np
import pytest

from tidemark.operators import evaluation as ops

D = dt.date


def test_ranking_metrics(spark):
    df = spark.createDataFrame(
        [(True, True, D(2024, 1, 1)), (False, True, D(2024, 1, 1)), (True, False, D(2024, 1, 2)), (False, False, D(2024, 1, 2))],
        "t boolean, p boolean, day date")
    assert tuple(ops.ranking_metrics(df, "t", "p", "day").first()) == (0.5, 0.5, 0.5, 1.0)
    assert tuple(ops.ranking_metrics(df, "t", "p").first()) == (0.5, 0.5, 1.0, 1.0)
    assert tuple(ops.ranking_metrics(df.limit(0), "t", "p", "day").first()) == (0.0, 0.0, 0.0, 0.0)


def test_backtest_metrics(spark):
    rows = [(D(2024, 1, i % 20 + 1), True, True) for i in range(10)] + [(D(2024, 2, 1), True, False), (D(2024, 3, 1), False, True), (D(2024, 3, 2), True, True)]
    df = spark.createDataFrame(rows, "timestamp date, prediction boolean, actual boolean")
    got = ops.backtest_metrics(df).first()
    assert (got.signals, got.positives, got.true_positives, got.false_positives, got.false_negatives) == (13, 12, 11, 1, 1)
    assert (got.hit_days, got.total_days, got.months_with_10_hits, got.average_monthly_hits) == (12, 13, 1, 5.5)
    scored = df.selectExpr("timestamp", "prediction", "actual", "0.4D as score")
    assert ops.backtest_metrics(scored, 0.5).first().true_positives == 0
    with pytest.raises(ValueError):
        ops.backtest_metrics(df.drop("prediction"))


PRED = "timestamp date, symbol string, score double, future_return double"


def test_topk_metrics(spark):
    df = spark.createDataFrame(
        [(D(2024, 1, 1), "A", 0.9, 0.2), (D(2024, 1, 1), "B", 0.1, -0.1), (D(2024, 1, 2), "A", 0.9, -0.1), (D(2024, 1, 2), "B", 0.1, 0.2)], PRED)
    got = ops.topk_metrics(df, top_k=1).first()
    assert (got.top_k_precision, got.hit_day_rate, got.recall) == (0.5, 1.0, 0.5)
    assert got.max_drawdown == -0.1 and got.net_pnl == pytest.approx(0.08) and got.mean_lead_days == 0.0
    with pytest.raises(ValueError):
        ops.topk_metrics(df, top_k=0)


def test_topk_gap_and_compounding_match_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(D(2024, 1, 1) + dt.timedelta(days=7 * i), s, float(rng.random()), float(rng.normal(0, 0.1))) for i in range(30) for s in "ABCD"]
    got = ops.topk_metrics(spark.createDataFrame(rows, PRED), top_k=2, event_threshold=0.05).first()
    by_day = {}
    for day, s, score, ret in rows:
        by_day.setdefault(day, []).append((-score, s, ret))
    chosen = {day: [r for _, _, r in sorted(v)[:2]] for day, v in sorted(by_day.items())}
    hit_days = [d for d, v in chosen.items() if any(r >= 0.05 for r in v)]
    equity = np.cumprod([1 + np.mean(v) for v in chosen.values()])
    assert got.mean_hit_gap_days == pytest.approx(np.mean(np.diff([d.toordinal() for d in hit_days])), abs=1e-6)
    assert got.net_pnl == pytest.approx(equity[-1] - 1, abs=1e-6)
    assert got.max_drawdown == pytest.approx((equity / np.maximum.accumulate(equity) - 1).min(), abs=1e-6)


@pytest.mark.parametrize("n", [1, 2, 7, 400, 401])
def test_exact_median(spark, n):
    rng = np.random.default_rng(n)
    values = np.concatenate([rng.normal(0, 3, n), np.full(n // 3, 0.25)])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    median = lambda frame: spark.range(1).select(ops.exact_median(frame, "x").alias("m")).first().m
    assert median(df) == np.median(values)
    assert median(df.limit(0)) is None


def test_learning_report(spark):
    df = spark.createDataFrame([(f"s{i}", 0.12 if i % 2 else 0.04) for i in range(30)], "signal_id string, outcome_return double")
    got = ops.learning_report(df).first()
    assert (got.closed_signals, got.hit_rate, got.mean_return, got.median_return) == (30, 0.5, 0.08, 0.08)
    assert got.recommended_action == "READY_FOR_RESEARCH"
    assert got.research_actions == ["RUN_FEATURE_ABLATION", "RUN_WALK_FORWARD_REWEIGHTING_EXPERIMENT"]
    few = ops.learning_report(df.filter("outcome_return > 1")).first()
    assert (few.closed_signals, few.return_std, few.recommended_action) == (0, 0.0, "COLLECT_MORE_OUTCOMES")


def test_feature_edge_uses_the_latest_signal(spark):
    signals = spark.createDataFrame(
        [("s1", {"m": 9.0}, 1), ("s1", {"m": 2.0, "v": -1.0}, 2), ("s2", {"m": 4.0}, 1)], "signal_id string, feature_contributions map<string,double>, seq int")
    outcomes = spark.createDataFrame([("s1", 0.1), ("s2", 0.2), ("none", 5.0), ("s2", None)], "signal_id string, outcome_return double")
    got = {r.feature: r.edge for r in ops.feature_edge(signals, outcomes, "seq").collect()}
    assert got == {"m": 0.5, "v": -0.1}


def test_accept_model(spark):
    df = spark.createDataFrame([(0.35, 0.25), (0.34, 0.9)], "precision double, hit_day_rate double")
    assert [r.accepted for r in ops.accept_model(df).collect()] == [True, False]


def test_median_ignores_nan_and_runs_lazily(spark):
    values = [float("nan"), None, 3.0, 1.0, 2.0]
    outcomes = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "signal_id string, outcome_return double")
    row = ops.learning_report(outcomes).first()
    assert row.closed_signals == 3 and row.median_return == 2.0 and row.mean_return == 2.0
    many = [((i * 7919) % 1001) / 10 for i in range(5000)] + [55.5] * 700
    df = spark.createDataFrame([(v,) for v in many], "v double")
    assert spark.range(1).select(ops.exact_median(df, "v").alias("m")).first().m == np.median(many)
    assert spark.range(1).select(ops.exact_median(df.where("v < 0"), "v").alias("m")).first().m is None
