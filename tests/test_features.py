import datetime as dt
import math
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import features as ops

BAR = "symbol string, timestamp date, open double, high double, low double, close double, volume double"


def bars(spark, closes, start=dt.date(2024, 1, 1), step=1):
    out = []
    for symbol, series in closes.items():
        for i, c in enumerate(series):
            c = float(c)
            out.append((symbol, start + dt.timedelta(days=i * step), c, c * 1.01, c * 0.99, c, 100.0 + i))
    return spark.createDataFrame(out, BAR)


@pytest.fixture(scope="module")
def random_bars(spark):
    rng = np.random.default_rng(11)
    out = []
    for symbol in ("AAA", "BBB", "CCC"):
        price, day = 100.0, dt.date(2019, 10, 1)
        for _ in range(260):
            day += dt.timedelta(days=int(rng.integers(1, 6)))
            o = price * float(1 + rng.normal(0, 0.02))
            c = o * float(1 + rng.normal(0, 0.03))
            h, low = max(o, c) * 1.01, min(o, c) * 0.99
            v = float(rng.integers(0, 50))
            out.append((symbol, day, o, h, low, c, v))
            price = c
    return spark.createDataFrame(out, BAR)


def _sorted(df):
    return df.toPandas().sort_values(["symbol", "timestamp"]).reset_index(drop=True)


def test_ranker_features_match_pandas(random_bars):
    got = _sorted(ops.ranker_features(random_bars))
    g = got.groupby("symbol")
    assert np.allclose(got.ret_1, g.close.pct_change(), equal_nan=True)
    assert np.allclose(got.ret_5, g.close.pct_change(5), equal_nan=True)
    for _, rows in g:
        high, volume = rows.high.tolist(), rows.volume.tolist()
        for i, (close, mean, breakout) in enumerate(zip(rows.close, rows.vol_mean_20, rows.breakout)):
            seen, past = volume[max(0, i - 19) : i + 1], high[max(0, i - 20) : i]
            assert np.isnan(mean) if len(seen) < 5 else mean == pytest.approx(sum(seen) / len(seen))
            assert np.isnan(breakout) if len(past) < 5 else breakout == pytest.approx(close / max(past) - 1)
    assert got.score.between(0, 100).all()


def test_latest_features_equal_full_history(random_bars):
    full = _sorted(ops.latest_per_symbol(ops.ranker_features(random_bars)))
    tail = _sorted(ops.latest_ranker_features(random_bars))
    pd.testing.assert_frame_equal(full[tail.columns], tail, rtol=1e-12)


def test_finer_chunks_change_nothing(random_bars):
    fine = F.trunc("timestamp", "month")
    for operator in (ops.ranker_features, ops.limit_up_dataset, ops.forward_labels, ops.limit_up_events):
        a, b = operator(random_bars), operator(random_bars, chunk=fine)
        assert {tuple(r) for r in a.na.fill(-9.0).collect()} == {tuple(r) for r in b.select(*a.columns).na.fill(-9.0).collect()}


def test_limit_up_dataset_matches_pandas(random_bars):
    got = _sorted(ops.limit_up_dataset(random_bars))
    src = _sorted(random_bars)
    g = src.groupby("symbol")
    spreads, ratios = {}, {}
    for _, rows in g:
        close, volume = rows.close.tolist(), rows.volume.tolist()
        moves = [b / a - 1 for a, b in zip(close, close[1:])]
        for i, at in enumerate(rows.index):
            last, past = moves[max(0, i - 20) : i], volume[max(0, i - 20) : i]
            spreads[at] = statistics.stdev(last) if len(last) >= 10 else np.nan
            ratios[at] = volume[i] / (sum(past) / len(past)) if len(past) >= 5 and sum(past) else np.nan
    src["volatility_20"], src["volume_ratio"] = pd.Series(spreads), pd.Series(ratios)
    src["next_high"] = g.high.shift(-1)
    src["gap"] = src.open / g.close.shift(1) - 1
    want = src[src.next_high.notna()].dropna(subset=["volatility_20", "volume_ratio"])
    merged = got.merge(want, on=["symbol", "timestamp"], suffixes=("", "_w"))
    assert len(merged) == len(got) == len(want)
    for c in ("volatility_20", "volume_ratio", "gap"):
        assert np.allclose(merged[c], merged[c + "_w"])
    assert (merged.target == (merged.next_high >= merged.close * 1.1).astype(float)).all()


def test_zero_previous_price_is_infinite_not_an_error(spark):
    df = ops.ranker_features(bars(spark, {"Z": [0.0, 5.0, 5.0]}))
    got = {r.timestamp.day: r.ret_1 for r in df.collect()}
    assert math.isinf(got[2]) and got[3] == 0.0


def test_feature_snapshot_short_and_flat(spark, rows):
    got = rows(ops.feature_snapshot(bars(spark, {"ONE": [5.0], "TWO": [100.0, 110.0], "UP": list(range(1, 41))})))
    assert set(got) == {"TWO", "UP"}
    assert got["TWO"]["return_1"] == pytest.approx(0.10) and got["TWO"]["return_20"] == pytest.approx(0.10)
    assert got["TWO"]["volatility_20"] == 0.0
    up = got["UP"]
    assert up["return_5"] == pytest.approx(40 / 35 - 1) and up["return_20"] == pytest.approx(1.0)
    assert up["distance_ma20"] == pytest.approx(40 / np.mean(range(21, 41)) - 1)
    assert up["breakout_20"] == pytest.approx(1 / 1.01)
    returns = [i / (i - 1) - 1 for i in range(21, 41)]
    assert up["volatility_20"] == pytest.approx(np.std(returns, ddof=1))
    assert up["volume_ratio"] == pytest.approx(139 / np.mean(range(119, 139)))


def test_forward_labels_look_exactly_h_ahead(spark):
    df = ops.forward_labels(bars(spark, {"A": [100.0, 150.0, 100.0, 112.0]}), horizon_bars=2)
    got = [(r.hit_limit_forward, r.label_available) for r in df.orderBy("timestamp").collect()]
    assert got == [(False, True), (False, True), (False, False), (False, False)]
    with pytest.raises(ValueError):
        ops.forward_labels(bars(spark, {"A": [1.0]}), horizon_bars=0)


def _flows(spark, values, fund="F"):
    return spark.createDataFrame(
        [(fund, dt.date(2023, 12, 28) + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)],
        "fund_code string, as_of date, net_flow double")


def test_flow_anomaly_after_constant_history(spark):
    got = ops.flow_anomalies(_flows(spark, [1e8] * 4 + [9e8])).orderBy("as_of").collect()
    assert [r.is_anomalous for r in got] == [False, False, False, False, True]
    assert math.isinf(got[-1].z_score) and got[0].z_score == 0.0
    with pytest.raises(ValueError):
        ops.flow_anomalies(_flows(spark, [1]), lookback=1)
    with pytest.raises(ValueError):
        ops.flow_anomalies(_flows(spark, [1]), z_threshold=0)


def test_flow_anomaly_uses_population_deviation_of_the_past(spark):
    values = [1.0, 2.0, 4.0, 10.0]
    got = ops.flow_anomalies(_flows(spark, values), lookback=3).orderBy("as_of").collect()
    past = values[:3]
    assert got[3].z_score == pytest.approx((10 - np.mean(past)) / np.std(past))


def test_performance_board(spark, rows):
    data = {"AAA": [100, 110, 120, 130, 150], "BBB": [100, 90, 95, 100, 105], "CCC": [100] * 5, "SHORT": [1, 2, 3]}
    board = ops.performance_board(bars(spark, {k: [float(x) for x in v] for k, v in data.items()}), period_bars=2)
    got = rows(board)
    assert set(got) == {"AAA", "BBB", "CCC"}
    assert got["AAA"]["period_return_pct"] == 25.0 and got["AAA"]["rank"] == 1 and got["AAA"]["previous_rank"] == 1
    assert got["BBB"]["rank"] == 2 and got["BBB"]["previous_rank"] == 3 and got["BBB"]["rank_change"] == 1
    assert got["BBB"]["acceleration_pct"] == pytest.approx(15.53)
    top = rows(ops.performance_board(bars(spark, {k: [float(x) for x in v] for k, v in data.items()}), 2, top_k=1))
    assert set(top) == {"AAA"} and top["AAA"]["previous_rank"] == 1


def test_board_ranks_match_a_global_sort(random_bars):
    got = ops.performance_board(random_bars, period_bars=5, top_k=2).toPandas()
    src = _sorted(random_bars)
    ends = src.groupby("symbol").close.apply(lambda s: pd.Series({"cur": s.iloc[-1] / s.iloc[-6] - 1, "prev": s.iloc[-6] / s.iloc[-11] - 1})).unstack()
    ends["rank"] = ends.cur.rank(ascending=False).astype(int)
    ends["previous_rank"] = ends.prev.rank(ascending=False).astype(int)
    for r in got.itertuples():
        assert (r.rank, r.previous_rank) == (ends.loc[r.symbol, "rank"], ends.loc[r.symbol, "previous_rank"])


def test_limit_close_and_first_touch(spark):
    close = spark.createDataFrame([(110.0,), (109.9,)], "c double")
    flags = [r[0] for r in close.select(ops.is_limit_up_close(F.col("c"), F.lit(100.0), 0.10)).collect()]
    assert flags == [True, False]
    day = dt.datetime(2024, 1, 2, 10)
    minute = spark.createDataFrame(
        [("A", day, 105.0), ("A", day.replace(minute=1), 110.0), ("A", day.replace(minute=2), 111.0), ("B", day, 1.0)],
        "symbol string, timestamp timestamp_ntz, high double")
    got = {r.symbol: r.first_touch_time for r in ops.first_touch(minute, F.lit(100.0), 0.10, ["symbol"]).collect()}
    assert got == {"A": day.replace(minute=1), "B": None}
    with pytest.raises(ValueError):
        ops.limit_price(F.lit(1.0), 0.0)


def test_limit_up_events(spark):
    df = spark.createDataFrame(
        [("A", dt.date(2023, 12, 30), 100, 100, 100, 100.0, 1.0), ("A", dt.date(2024, 1, 1), 100, 110, 100, 108.0, 1.0),
         ("A", dt.date(2024, 1, 2), 100, 120, 100, 119.0, 1.0), ("A", dt.date(2024, 1, 3), 100, 121, 100, 120.0, 1.0)],
        "symbol string, timestamp date, open int, high int, low int, close double, volume double")
    got = ops.limit_up_events(df).orderBy("event_time").collect()
    assert [(r.event_time.day, r.first_touch, r.held_at_close) for r in got] == [(1, True, False), (2, False, True)]


def test_estimate_revisions(spark, rows):
    df = spark.createDataFrame(
        [("A", "2025", 10.0, dt.date(2024, 1, 1)), ("A", "2025", 11.0, dt.date(2025, 1, 1)), ("B", "2025", 3.0, dt.date(2024, 1, 1))],
        "symbol string, period string, estimate double, observed_at date")
    got = rows(ops.estimate_revisions(df))
    assert got["A"]["analyst_revision_score"] == 100.0 and got["B"]["analyst_revision_score"] == 50.0


def test_equity_curve_peak_starts_at_first_equity(spark):
    df = spark.createDataFrame(
        [(dt.date(2024, 1, 31), -0.5), (dt.date(2024, 2, 1), 0.1), (dt.date(2024, 2, 2), -0.2)], "timestamp date, daily_return double")
    got = ops.equity_curve(df).orderBy("timestamp").collect()
    assert [round(r.equity, 6) for r in got] == [0.5, 0.55, 0.44]
    assert [round(r.drawdown, 6) for r in got] == [0.0, 0.0, -0.2]


def test_ledger_metrics_peak_starts_at_initial_equity(spark):
    df = spark.createDataFrame([("a", 1, 90.0), ("a", 2, 120.0), ("a", 3, 60.0)], "account string, seq int, equity double")
    got = ops.ledger_metrics(df, 100.0, ["account"], ["seq"], F.floor(F.col("seq") / 2)).first()
    assert (round(got.net_return, 6), round(got.max_drawdown, 6), got.observations) == (-0.4, -0.5, 3.0)
    with pytest.raises(ValueError):
        ops.ledger_metrics(df, 0.0, ["account"], ["seq"], F.lit(1))


def test_missing_columns_are_reported_before_any_job(spark):
    with pytest.raises(ValueError, match="volume"):
        ops.ranker_features(spark.createDataFrame([("A",)], "symbol string"))
