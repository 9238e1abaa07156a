"""Split windows must equal the unsplit ones, also with sparse and empty chunks."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.chunked import ordinal, over_chunks, running
from tidemark.functions.lineage import written


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(5)
    out = []
    for symbol, n in (("HOT", 900), ("SPARSE", 40), ("ONE", 1)):
        days = sorted(rng.choice(4000, size=n, replace=False))
        for day in days:
            out.append((symbol, dt.date(2010, 1, 1) + dt.timedelta(days=int(day)), float(rng.normal()), float(rng.integers(1, 9))))
    return written(spark.createDataFrame(out, "symbol string, timestamp date, x double, y double"))


def _features(df, w):
    past = w.rowsBetween(-7, -1)
    return df.withColumns({
        "lagged": F.lag("x", 5).over(w), "ahead": F.lead("x", 3).over(w),
        "mean": F.avg("x").over(past), "n": F.count("x").over(past), "top": F.max("y").over(w.rowsBetween(-6, 0)),
    })


@pytest.mark.parametrize("unit", ["month", "quarter", "year"])
def test_bounded_frames(series, unit):
    split = over_chunks(series, ["symbol"], ["timestamp"], F.trunc("timestamp", unit), _features, before=7, after=3)
    plain = _features(series, Window.partitionBy("symbol").orderBy("timestamp"))
    a = split.select(*plain.columns).toPandas().sort_values(["symbol", "timestamp"]).reset_index(drop=True)
    b = plain.toPandas().sort_values(["symbol", "timestamp"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-12)


def test_running_aggregates(series):
    measures = {"total": ("sum", "x"), "peak": ("max", "x"), "low": ("min", "x"), "grown": ("product", "g")}
    base = series.withColumn("g", 1 + F.col("x") / 50)
    out = running(base, ["symbol"], ["timestamp"], F.trunc("timestamp", "year"), measures).toPandas()
    out = out.sort_values(["symbol", "timestamp"])
    grouped = out.groupby("symbol")
    assert np.allclose(out.total, grouped.x.cumsum())
    assert (out.peak == grouped.x.cummax()).all() and (out.low == grouped.x.cummin()).all()
    assert np.allclose(out.grown, grouped.g.cumprod())


def test_ordinal_is_the_sorted_position(series):
    placed = ordinal(series, ["timestamp", "symbol"]).toPandas()
    placed = placed.sort_values(["timestamp", "symbol"]).reset_index(drop=True)
    assert (placed.pos == placed.index).all()
    assert (placed.n_rows == len(placed)).all()


def test_ordinal_puts_missing_keys_last_and_drops_none(spark):
    df = spark.createDataFrame([(2, "b"), (None, "a"), (2, None), (1, "z"), (None, None)], "t int, s string")
    assert [(r.t, r.s, r.n_rows) for r in ordinal(df, ["t", "s"]).orderBy("pos").collect()] == [
        (1, "z", 5), (2, "b", 5), (2, None, 5), (None, "a", 5), (None, None, 5)]


def test_ordinal_of_one_key_has_no_window_over_all_rows(spark):
    df = spark.range(500).selectExpr("timestamp'2024-01-01' AS t", "cast(id AS string) AS s")
    placed = ordinal(df, ["t", "s"])
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(_range" in plan
    assert [r.s for r in placed.orderBy("pos").collect()] == sorted(map(str, range(500)))


def test_no_task_sees_a_whole_key(series):
    """The only exchanges by the bare key carry chunk summaries."""
    plan = over_chunks(
        series, ["symbol"], ["timestamp"], F.year("timestamp"), _features, before=7, after=3
    )._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "hashpartitioning(symbol" in plan and "_chunk" in plan


@pytest.mark.parametrize(("before", "after"), [(1, 0), (0, 1), (1, 1)])
def test_single_row_rims(series, before, after):
    def near(df, w):
        return df.withColumns({"lagged": F.lag("x").over(w) if before else F.lit(0), "ahead": F.lead("x").over(w) if after else F.lit(0)})

    split = over_chunks(series, ["symbol"], ["timestamp"], F.trunc("timestamp", "month"), near, before=before, after=after)
    plain = near(series, Window.partitionBy("symbol").orderBy("timestamp"))
    assert {tuple(r) for r in split.select(*plain.columns).collect()} == {tuple(r) for r in plain.collect()}
