import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import quality as ops

BAR = "symbol string, timestamp date, open double, high double, low double, close double, volume double, seq int"
D = dt.date


def frame(spark, *rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], BAR)


def codes(df):
    return [r.code for r in ops.validate_ohlcv(df, ["seq"], F.floor(F.col("seq") / 2)).orderBy("position").collect()]


def test_interleaved_symbols_are_valid(spark):
    df = frame(spark, ("A", D(2024, 1, 1), 1.0, 2.0, 0.5, 1.5, 9.0), ("B", D(2024, 1, 1), 1.0, 2.0, 0.5, 1.5, 9.0),
               ("A", D(2024, 1, 2), 1.0, 2.0, 0.5, 1.5, 9.0))
    assert codes(df) == []
    ops.assert_ohlcv_quality(df, ["seq"], F.lit(0))


def test_every_code_in_order(spark):
    df = frame(spark, ("A", D(2024, 1, 2), 3.0, 2.0, 4.0, 1.0, -1.0), ("A", D(2024, 1, 1), None, 2.0, 1.0, 1.0, 1.0),
               ("A", D(2024, 1, 1), 1.0, 2.0, 1.0, 1.0, 1.0))
    want = ["null_values", "negative_values", "high_below_ohlc", "low_above_ohlc", "duplicate_bars", "timestamp_not_monotonic"]
    assert codes(df) == want
    with pytest.raises(ValueError, match="negative_values, high_below_ohlc"):
        ops.assert_ohlcv_quality(df, ["seq"], F.lit(0))


def test_nan_is_a_missing_value(spark):
    df = frame(spark, ("A", D(2024, 1, 1), float("nan"), 2.0, 0.5, 1.5, 9.0))
    assert codes(df) == ["null_values"]


def test_missing_columns_return_at_once(spark):
    df = spark.createDataFrame([("A", 1.0)], "symbol string, close double")
    assert codes(df) == ["missing:timestamp,open,high,low,volume"]


def test_row_violations(spark):
    df = frame(spark, ("A", D(2024, 1, 1), 3.0, 2.0, 1.0, 1.0, 1.0), ("A", D(2024, 1, 2), 1.0, 2.0, 1.0, 1.0, 1.0))
    got = [r.violations for r in ops.bar_violations(df).orderBy("seq").collect()]
    assert got == [["high_below_ohlc"], []]


def test_point_in_time(spark):
    df = spark.createDataFrame([(D(2024, 1, 1), D(2024, 1, 1), 1), (D(2024, 1, 3), D(2024, 1, 2), 2)], "as_of date, observed_at date, id int")
    assert [r.lookahead for r in ops.validate_point_in_time(df, mode="quarantine").orderBy("id").collect()] == [False, True]
    # the check survives column pruning
    with pytest.raises(PySparkException, match="lookahead"):
        ops.validate_point_in_time(df).select("id").collect()
    with pytest.raises(ValueError):
        ops.validate_point_in_time(df.drop("as_of"))
    assert ops.asof_cutoff(df, "2024-01-02").count() == 1


@pytest.mark.parametrize(
    ("kind", "row", "broken"),
    [
        ("signal", {"score": 101.0, "confidence": 0.5}, ["score_range"]),
        ("news", {"sentiment": -1.5, "reliability": 1.2}, ["sentiment_range", "reliability_range"]),
        ("fund_holding", {"portfolio_weight": 1.2}, ["weight_range"]),
        ("institutional_holding", {"manager": " ", "symbol": "A", "portfolio_weight": 0.1, "fund_aum": -1.0}, ["blank_key", "negative_aum"]),
        ("evidence", {"confidence": 0.5, "as_of": D(2024, 2, 1), "observed_at": D(2024, 1, 1)}, ["lookahead"]),
    ],
)
def test_constraints(spark, kind, row, broken):
    df = spark.createDataFrame([row])
    assert ops.enforce(df, ops.row_constraints(kind), "quarantine").first().violations == broken
    with pytest.raises(PySparkException, match=broken[0]):
        ops.enforce(df, ops.row_constraints(kind)).collect()


def test_unknown_constraint_kind():
    with pytest.raises(ValueError):
        ops.row_constraints("nothing")


def test_watchlist_levels(spark):
    schema = "symbol string, last_price string, entry_low double, entry_high double, target double, stop double"
    good = spark.createDataFrame([("A", "33.22", 32.62, 33.50, 36.40, 32.00)], schema)
    assert ops.validate_watchlist(good).first().last_price == 33.22
    for bad in (("A", "33.22", 32.62, 33.50, 36.40, 33.0), ("A", "x", 32.62, 33.50, 36.40, 32.0)):
        with pytest.raises(PySparkException, match="watchlist levels"):
            ops.validate_watchlist(spark.createDataFrame([bad], schema)).collect()


def test_time_split(spark):
    df = spark.createDataFrame([(D(2024, 1, 1),), (D(2024, 1, 2),)], "timestamp date")
    train, test = ops.time_split(df, "2024-01-02")
    assert (train.count(), test.count()) == (1, 1)


def test_order_limits(spark):
    schema = "quantity double, price double, equity double, day_start_equity double, open_positions int, already_held boolean"
    cases = {
        (100.0, 100.0, 100_000.0, 100_000.0, 0, False): "OK",
        (300.0, 100.0, 100_000.0, 100_000.0, 0, False): "ORDER_NOTIONAL_LIMIT",
        (0.0, 100.0, 100_000.0, 100_000.0, 0, False): "INVALID_ORDER",
        (100.0, 100.0, 100_000.0, 100_000.0, 5, False): "MAX_OPEN_POSITIONS",
        (100.0, 100.0, 100_000.0, 100_000.0, 5, True): "OK",
        (110.0, 100.0, 100_000.0, 100_000.0, 0, False): "POSITION_SIZE_LIMIT",
        (10.0, 100.0, 96_000.0, 100_000.0, 0, False): "DAILY_LOSS_LIMIT",
    }
    df = spark.createDataFrame(list(cases), schema)
    got = {tuple(r)[:6]: r.reason for r in ops.order_limit_flags(df, max_order_notional=20_000).collect()}
    assert got == cases
    with pytest.raises(ValueError):
        ops.order_limit_flags(df, max_position_pct=0)


def test_point_in_time_reads_offsets(spark):
    rows = spark.createDataFrame(
        [(1, "2024-01-02T10:00:00+03:00", "2024-01-02T08:00:00+00:00"), (2, "2024-01-02T09:00:00+00:00", "2024-01-02T11:00:00+03:00"), (3, "no time", "2024-01-02")],
        "k int, as_of string, observed_at string")
    got = {r.k: r.lookahead for r in ops.validate_point_in_time(rows, mode="quarantine").collect()}
    assert got == {1: False, 2: True, 3: False}


def test_refuse_empty(spark):
    rows = spark.range(3)
    assert ops.refuse_empty(rows, "nothing").count() == 3
    with pytest.raises(Exception, match="nothing"):
        ops.refuse_empty(rows.where("id > 5"), "nothing").collect()
