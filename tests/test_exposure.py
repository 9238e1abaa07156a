import datetime as dt
import re

import numpy as np
import pytest
from pyspark.errors import PySparkException

from tidemark.operators import aggregates as agg
from tidemark.operators import exposure as ops

D = dt.date
FLOW = "as_of date, fund_code string, net_flow double, sector string, seq int"
HOLD = "as_of date, fund_code string, symbol string, portfolio_weight double, sector string"
INST = "as_of date, manager string, fund_code string, symbol string, portfolio_weight double, fund_aum double"


@pytest.fixture(scope="module")
def flows(spark):
    day = D(2024, 1, 31)
    return spark.createDataFrame(
        [(day, "THF", 1e9, "BANK", 1), (day, "DFI", -5e8, "BANK", 1), (D(2023, 12, 31), "THF", 7.0, "BANK", 1)], FLOW)


@pytest.fixture(scope="module")
def held(spark):
    day = D(2024, 1, 31)
    return spark.createDataFrame(
        [(day, "THF", "AAA", 0.5, "BANKING"), (day, "THF", "BBB", 0.2, ""), (day, "DFI", "AAA", 0.4, "BANKING")], HOLD)


def test_stock_flows(flows, held, rows):
    got = rows(ops.stock_flows(flows, held))
    assert {k: v["estimated_flow"] for k, v in got.items()} == {"AAA": 3e8, "BBB": 2e8}
    assert got["AAA"]["funds"] == ["DFI", "THF"]


def test_mismatched_dates_are_empty(flows, held):
    assert ops.stock_flows(flows, held, as_of="2023-12-31").count() == 0


def test_last_flow_of_a_fund_wins(spark, held, rows):
    day = D(2024, 1, 31)
    flows = spark.createDataFrame([(day, "THF", 1.0, None, 1), (day, "THF", 100.0, None, 2)], FLOW)
    assert rows(ops.stock_flows(flows, held, order="seq"))["AAA"]["estimated_flow"] == 50.0


def test_sector_flows(flows, held):
    got = ops.sector_flows_est(flows, held).collect()
    assert [(r.sector, r.estimated_flow) for r in got] == [("BANKING", 3e8)]
    tagged = agg.sector_flows_tagged(flows).collect()
    assert [(r.sector, r.estimated_flow, r.funds) for r in tagged] == [("BANK", 5e8, ["DFI", "THF"])]


def test_asof_uses_the_latest_known_snapshot(spark):
    flows = spark.createDataFrame([(D(2024, 1, 20), "F", 100.0, None, 1), (D(2023, 1, 1), "F", 100.0, None, 1)], FLOW)
    held = spark.createDataFrame(
        [(D(2023, 12, 31), "F", "A", 0.1, None), (D(2024, 1, 10), "F", "A", 0.5, None), (D(2024, 1, 31), "F", "A", 0.9, None)], HOLD)
    got = ops.stock_flows_asof(flows, held).collect()
    assert [(r.flow_date, r.estimated_flow, r.max_age_days) for r in got] == [(D(2024, 1, 20), 50.0, 10)]


def test_position_changes(spark):
    old = spark.createDataFrame([("m", "A", 0.10), ("m", "B", 0.10), ("m", "C", 0.10), ("m", "D", 0.10)], "manager string, symbol string, portfolio_weight double")
    new = spark.createDataFrame([("m", "A", 0.07), ("m", "A", 0.05), ("m", "B", 0.08), ("m", "C", 0.101), ("m", "E", 0.2)], old.schema)
    got = {r.symbol: r.status for r in ops.position_changes(old, new).collect()}
    assert got == {"A": "INCREASE", "B": "DECREASE", "C": "STABLE", "D": "EXIT", "E": "NEW"}
    with pytest.raises(ValueError):
        ops.position_changes(old, new, -1)


def test_attach_watchlist_keeps_unmatched(spark, rows):
    base = spark.createDataFrame([("A", 9.0), ("B", 9.0)], "symbol string, risk_reward double")
    watch = spark.createDataFrame([("A", 33.22, 32.62, 33.50, 36.40, 32.00)], "symbol string, last_price double, entry_low double, entry_high double, target double, stop double")
    got = rows(ops.attach_watchlist(base, watch))
    assert got["A"]["risk_reward"] == 1.933 and got["B"]["risk_reward"] is None
    with pytest.raises(PySparkException):
        from pyspark.sql import functions as F

        ops.attach_watchlist(base, watch.withColumn("stop", F.lit(33.0))).collect()


def test_mark_to_market(spark):
    bars = spark.createDataFrame([("A", D(2024, 1, 1), 5.0), ("A", D(2024, 1, 2), 10.0)], "symbol string, timestamp date, close double")
    held = spark.createDataFrame([("A", 10.0, 60.0), ("GONE", 5.0, 20.0)], "symbol string, quantity double, entry_cost double")
    got = ops.mark_to_market(bars, held, 100.0, slippage=0.01).first()
    assert (got.cash, round(got.invested, 6), round(got.equity, 6)) == (20.0, 99.0, 119.0)


def test_flow_summary(spark):
    day = D(2024, 1, 31)
    flows = spark.createDataFrame(
        [(day, "THF", 2.89e9, None, 1), (day, "DFI", -3.05e9, None, 1), (day, "DOH", 8.6e8, None, 1), (D(2024, 1, 1), "OLD", 1.0, None, 1)], FLOW)
    got = agg.flow_summary(flows).first()
    assert (got.total_inflow, got.total_outflow, got.net_flow) == (3.75e9, 3.05e9, 0.7e9)
    assert got.inflow_funds == ["THF", "DOH"] and got.outflow_funds == ["DFI"]
    with pytest.raises(PySparkException, match="no fund-flow"):
        agg.flow_summary(flows.limit(0)).collect()


def test_broker_replacement(spark, rows):
    df = spark.createDataFrame(
        [("A", "X", "BUY", 1), ("A", "X", " sell ", 2), ("B", "X", "BUY", 1), ("B", "X", "unknown", 9), ("C", "Y", "overweight", 1)],
        "broker string, symbol string, action string, seq int")
    got = rows(agg.broker_consensus(df, ["seq"]))
    assert got["X"]["broker_consensus"] == 50.0 and got["Y"]["broker_consensus"] == 90.0


def test_consensus_recency(spark, rows):
    new, old = D(2024, 3, 1), D(2023, 12, 1)
    df = spark.createDataFrame(
        [(new, "m1", "f1", "A", 0.1, 100.0), (new, "m1", "f2", "A", 0.1, None), (new, "m2", "f3", "A", 0.1, None), (new, "m3", "f4", "A", 0.1, None),
         (old, "m1", "f1", "B", 0.1, None), (old, "m2", "f3", "B", 0.1, None), (old, "m3", "f4", "B", 0.1, None)], INST)
    changes = spark.createDataFrame([("m1", "A", "NEW"), ("m2", "A", "INCREASE"), ("zz", "A", "NEW")], "manager string, symbol string, status string")
    got = rows(agg.consensus_recency(df, changes, ["m1", "m2", "m3", "m4", "m1"]))
    a = got["A"]
    assert (a["manager_count"], a["fund_count"], a["new_manager_count"], a["increasing_manager_count"]) == (3, 4, 1, 1)
    assert a["managers"] == ["m1", "m2", "m3"] and a["estimated_value"] == 10.0 and got["B"]["estimated_value"] is None
    assert a["score"] == pytest.approx(0.4 * 75 + 0.2 * 40 + 0.15 * 50 + 0.15 * 75 + 0.1 * 25)
    assert a["score"] > got["B"]["score"]
    with pytest.raises(ValueError):
        agg.consensus_recency(df, managers=[])


def test_consensus_breadth(spark, rows):
    df = spark.createDataFrame(
        [("A", "m1", 0.1, 0.02, D(2024, 1, 1)), ("A", "m1", 0.2, -0.01, D(2024, 1, 1)), ("A", "m2", 0.1, 0.01, D(2024, 1, 1))],
        "symbol string, manager string, weight double, change double, as_of date")
    got = rows(agg.consensus_breadth(df))["A"]
    assert (got["manager_count"], got["fund_count"], got["positive_managers"], got["exits"]) == (2, 3, 2, 1)
    change = 50 + (0.02 / 3) / 0.02 * 50
    assert got["consensus_score"] == pytest.approx(0.3 * 20 + 0.25 * 100 + 0.25 * change + 0.2 * 100 - 0.2 * 50, abs=0.006)


def test_research_score(spark, rows):
    df = spark.createDataFrame(
        [("A", 1.0, "1", D(2024, 1, 1)), ("A", -1.0, "0", D(2024, 1, 1)), ("B", 1.0, "x", D(2024, 1, 1))],
        "symbol string, sentiment double, confidence string, observed_at date")
    got = rows(agg.research_score(df))
    assert got["A"]["research_score"] == 100.0 and got["B"]["research_score"] == 50.0


def test_portfolio_risk(spark):
    df = spark.createDataFrame([("p", "A", 0.6), ("p", "B", 0.4), ("p", "C", -1.0), ("zero", "A", 0.0)], "portfolio string, symbol string, weight double")
    got = {r.portfolio: r for r in agg.portfolio_risk(df).collect()}
    assert got["p"].top1_weight == pytest.approx(0.6) and got["p"].positions == 3
    assert got["p"].herfindahl == pytest.approx(0.52) and got["p"].effective_positions == pytest.approx(1 / 0.52)
    assert (got["zero"].herfindahl, got["zero"].effective_positions) == (0.0, 0.0)


def test_asof_splits_a_fund_that_holds_all_rows(spark):
    rng = np.random.default_rng(6)
    day = lambda n: dt.date(2015, 1, 1) + dt.timedelta(days=int(n))
    taken = sorted(rng.choice(3000, 40, replace=False))
    snapshots = [n for n in taken if not 700 <= n < 1900]  # some years have flows only
    flows = [("HOT", day(n), float(rng.integers(-99, 99))) for n in range(0, 3000, 7)]
    held = [("HOT", day(n), f"S{k}", 0.5) for n in snapshots for k in (0, 1)]
    got = ops.stock_flows_asof(spark.createDataFrame(flows, "fund_code string, as_of date, net_flow double"),
                               spark.createDataFrame(held, "fund_code string, as_of date, symbol string, portfolio_weight double"))
    want = {}
    for _, d, x in flows:
        known = [day(n) for n in snapshots if day(n) <= d]
        if known:
            want |= {(d, f"S{k}"): (x / 2, (d - known[-1]).days, 1) for k in (0, 1)}
    assert {(r.flow_date, r.symbol): (r.estimated_flow, r.max_age_days, r.positions) for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"windowspecdefinition\((fund_code#\d+, [^)]*)\)", plan)
    # every window over the bare fund runs over one row a year
    assert windows and all("_chunk" in w.split("specifiedwindowframe")[0] for w in windows)
