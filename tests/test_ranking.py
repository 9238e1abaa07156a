import datetime as dt

import pytest

from tidemark.operators import ranking as ops

D = dt.date


@pytest.fixture(scope="module")
def bars(spark):
    out = []
    for symbol, drift in (("UP", 1.02), ("DOWN", 0.99)):
        price = 100.0
        for i in range(25):
            price *= drift
            out.append((symbol, D(2024, 1, 1) + dt.timedelta(days=i), price, price * 1.01, price * 0.99, price, 1000.0))
    return spark.createDataFrame(out, "symbol string, timestamp date, open double, high double, low double, close double, volume double")


def test_composite_layers(spark):
    df = spark.createDataFrame([("A", 80.0, 70.0, 90.0, 60.0, 75.0)], "symbol string, score double, smart_money_score double, consensus_score double, research_score double, fundamental_score double")
    got = ops.composite_score(df).first()
    assert got.institutional_score == 76.5 and got.institutional_data_coverage == 1.0
    bare = spark.createDataFrame([("A", 80.0, "oops", 50.0)], "symbol string, score double, smart_money_score string, research_score double")
    assert ops.composite_score(bare).first().institutional_data_coverage == 0.2
    assert ops.composite_score(bare, missing_is_null=True).first().institutional_data_coverage == 0.4
    with pytest.raises(ValueError):
        ops.composite_score(df, {**ops.LAYER_WEIGHTS, "market": 0.9})


def test_rank_latest_orders_and_limits(bars):
    ranked = ops.rank_latest(bars, min_score=0.0)
    assert [r.symbol for r in ranked.collect()] == ["UP", "DOWN"]
    assert ops.rank_latest(bars, min_score=0.0, top_k=1).count() == 1
    assert ops.rank_latest(bars).count() == 1
    assert ops.rank_latest(bars, min_score=101.0).count() == 0


WATCH = "symbol string, last_price double, entry_low double, entry_high double, target double, stop double"


def test_watch_gate(spark, bars, rows):
    every = {"min_score": 0.0}
    plain = rows(ops.rank_latest(bars, **every))
    good = spark.createDataFrame([("UP", 100.0, 98.0, 101.0, 115.0, 95.0)], WATCH)
    got = rows(ops.rank_latest(bars, watch=good, **every))
    assert set(got) == {"UP", "DOWN"}  # the uncovered symbol stays
    up = got["UP"]
    assert up["institutional_score"] == pytest.approx(0.9 * plain["UP"]["institutional_score"] + 0.1 * up["technical_watch_score"], abs=0.006)
    assert got["DOWN"]["institutional_score"] == plain["DOWN"]["institutional_score"]
    poor = spark.createDataFrame([("UP", 100.0, 98.0, 101.0, 103.0, 95.0), ("DOWN", 1.0, None, 2.0, 3.0, 0.5)], WATCH)
    assert set(rows(ops.rank_latest(bars, watch=poor, **every))) == {"DOWN"}
    # the same levels as columns of the bars
    on_bars = bars.join(good, "symbol", "left")
    assert rows(ops.rank_latest(on_bars, **every))["UP"]["institutional_score"] == up["institutional_score"]


def test_layers_reach_the_ranking(spark, bars, rows):
    layer = spark.createDataFrame([("DOWN", 100.0)], "symbol string, score double")
    got = rows(ops.rank_latest(bars, {"smart_money_score": layer}, min_score=0.0))
    assert got["DOWN"]["institutional_data_coverage"] == 0.4 and got["UP"]["institutional_data_coverage"] == 0.2


SNAP = "symbol string, return_1 double, return_5 double, volume_ratio double, range_pct double, close_location double, return_20 double, distance_ma20 double, breakout_20 double, volatility_20 double"


def test_flow_blend_and_reasons(spark, rows):
    snap = spark.createDataFrame([(s, 0.0, 0.04, 2.0, 0.02, 0.9, 0.08, 0.05, 1.0, 0.02) for s in ("IN", "NONE", "OUT")], SNAP)
    flows = spark.createDataFrame([("IN", 2e8), ("OUT", -2e8)], "symbol string, flow double")
    ranked = ops.rank_snapshots(snap, flows, 0.0, 20, 0.2, 1e8)
    assert [r.symbol for r in ranked.collect()] == ["IN", "NONE", "OUT"]
    got = rows(ranked)
    assert got["NONE"]["reasons"] == ["volume anomaly", "near 20-bar high", "positive 5-bar momentum"]
    assert got["IN"]["reasons"][-1] == "smart money accumulation" and got["OUT"]["reasons"][-1] == "smart money distribution"
    assert got["NONE"]["score"] == 77.3 and got["NONE"]["confidence"] == pytest.approx(min(0.99, 0.35 + 77.3 / 150))


def test_no_forced_signal(bars):
    none = ops.rank_candidates(bars, min_score=99.0)
    assert tuple(ops.ranking_status(none).first()) == (0, "NO_QUALITY_SIGNAL")
    assert ops.ranking_status(ops.rank_candidates(bars, min_score=0.0)).first().status == "SIGNAL"
    with pytest.raises(ValueError):
        ops.rank_candidates(bars, flow_weight=2.0)


def test_daily_signal(spark):
    df = spark.createDataFrame([("A", 85.0), ("B", 84.9)], "symbol string, score double")
    assert [r.signal for r in ops.daily_signal(df).collect()] == ["STRONG", "WATCH"]


def test_reports(spark, bars):
    ranked = ops.rank_latest(bars)
    lines = [r.text for r in ops.morning_report(ranked, bars, bars, "Report").orderBy("line").collect()]
    assert lines[:2] == ["Report", "Evren: 2 | OHLCV satırı: 50"] and lines[2].startswith("1. UP | skor=")
    empty = ops.morning_report(ranked.limit(0), bars, bars, "Report").orderBy("line").collect()
    assert [r.text for r in empty][2:] == [ops.NO_SIGNAL_LINE]
    board = spark.createDataFrame([("AAA", 25.0, 1, 2, 1)], "symbol string, period_return_pct double, rank int, previous_rank int, rank_change int")
    assert ops.board_lines(board).first().text == " 1. AAA      %  25.00 ↑01"


def test_paper_selection(bars):
    ranked = ops.rank_latest(bars, min_score=0.0)
    got = ops.paper_selection(ranked, top_k=0, slippage=0.0).collect()
    assert [r.symbol for r in got] == ["UP"]
    assert got[0].quantity * got[0].entry_price == pytest.approx(100_000.0) and got[0].entry_cost == pytest.approx(100_100.0)


def test_reports_say_when_there_is_nothing(spark):
    lines = lambda df: [r.text for r in df.orderBy("line").collect()]
    board = spark.createDataFrame([(1, "UP", 12.5, 2)], "rank int, symbol string, period_return_pct double, rank_change int")
    assert lines(ops.board_lines(board, ops.BOARD_TITLE))[0] == ops.BOARD_TITLE and len(lines(ops.board_lines(board, ops.BOARD_TITLE))) == 2
    assert lines(ops.board_lines(board.where("false"), ops.BOARD_TITLE)) == [ops.BOARD_TITLE, ops.EMPTY_BOARD_LINE]
    records = spark.createDataFrame([(2, None, 70.0), (1, "UP", None)], "n int, symbol string, score double")
    assert lines(ops.thin_report(records, "n", "T")) == ["T", "1. UP | skor=?", "2. ? | skor=70.0"]
    assert lines(ops.thin_report(records.where("false"), "n", "T")) == list(ops.NO_CANDIDATE_LINES)


def test_report_ends_with_its_sources(spark, bars):
    ranked = ops.rank_latest(bars, min_score=0.0)
    got = ops.morning_report(ranked, bars, bars, "T", sources=(bars.limit(3), bars.limit(0), bars.limit(1))).orderBy("line").collect()
    assert got[-1].text == "Kaynaklar: HISTORICAL + KAP:3 + NEWS:0 + FUND:1" and [r.line for r in got] == list(range(1, len(got) + 1))
