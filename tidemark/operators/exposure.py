"""Joins between flows, holdings, prices and score layers.

No join side is forced to broadcast: sides that are small at run time are broadcast by adaptive execution from their
measured size, larger ones shuffle and have skewed partitions split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunked import running
from ..functions.lineage import written
from ..functions.numeric import rounded
from ..schemas import require
from .quality import refuse_empty
from .scoring import add_risk_reward

LAYER_COLUMNS = ("smart_money_score", "consensus_score", "research_score", "fundamental_score")
WATCH_FEATURES = ("technical_watch_score", "target_upside_pct", "stop_downside_pct", "risk_reward")


def _both(flows: DataFrame, holdings: DataFrame) -> tuple[DataFrame, DataFrame]:
    return refuse_empty(flows, "no fund-flow observations"), refuse_empty(holdings, "no holdings")


def _latest_day(flows: DataFrame, holdings: DataFrame, as_of: str | Column | None) -> Column:
    if as_of is not None:
        return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")
    return F.greatest(flows.agg(F.max("as_of")).scalar(), holdings.agg(F.max("as_of")).scalar())


def _allocated(flows: DataFrame, holdings: DataFrame, day: Column, order: str | None) -> DataFrame:
    on_day = flows.filter(F.col("as_of") == day)
    flow = F.max_by("net_flow", order) if order else F.max("net_flow")
    per_fund = on_day.groupBy("fund_code").agg(flow.alias("net_flow"))
    held = holdings.filter(F.col("as_of") == day)
    return held.join(per_fund, "fund_code").withColumn("allocated", F.col("net_flow") * F.col("portfolio_weight"))


def _per_key(allocated: DataFrame, key: str) -> DataFrame:
    """Sum per key; funds are reduced to one row per (key, fund) before they are listed."""
    per_fund = allocated.groupBy(key, "fund_code").agg(F.sum("allocated").alias("part"))
    return (
        per_fund.groupBy(key)
        .agg(
            rounded(F.sum("part"), 2).alias("estimated_flow"),
            F.array_sort(F.collect_list("fund_code")).alias("funds"),
        )
        .orderBy(F.col("estimated_flow").desc(), key)
    )


def stock_flows(flows: DataFrame, holdings: DataFrame, as_of: str | Column | None = None, order: str | None = None) -> DataFrame:
    """Fund flows allocated to symbols by that day's portfolio weights.

    `order` ranks repeated flows of a fund, of which the last counts; without it flows must be unique per fund and day.
    No flow or no holding at all is an error.
    """
    flows, holdings = _both(flows, holdings)
    return _per_key(_allocated(flows, holdings, _latest_day(flows, holdings, as_of), order), "symbol")


def sector_flows_est(
    flows: DataFrame, holdings: DataFrame, as_of: str | Column | None = None, order: str | None = None
) -> DataFrame:
    flows, holdings = _both(flows, holdings)
    tagged = holdings.filter(F.col("sector").isNotNull() & (F.col("sector") != ""))
    return _per_key(_allocated(flows, tagged, _latest_day(flows, holdings, as_of), order), "sector")


def stock_flows_asof(flows: DataFrame, holdings: DataFrame) -> DataFrame:
    """Every flow allocated by the fund's latest known snapshot at or before the flow date, with its age in days.

    The as-of match is made between distinct (fund, date) keys only, year by year with the last known date carried over, so a
    fund of any length is split; then holdings join on equality.
    """
    dates = written(
        flows.select("fund_code", "as_of", F.lit(None).cast("date").alias("known"))
        .union(holdings.select("fund_code", "as_of", F.col("as_of").alias("known")))
        .groupBy("fund_code", "as_of")
        .agg(F.max("known").alias("known"))
    )
    known = running(dates, ["fund_code"], ["as_of"], F.year("as_of"), {"snapshot": ("last", "known")}).drop("known").filter("snapshot is not null")
    matched = flows.select("fund_code", F.col("as_of").alias("flow_date"), "net_flow").join(
        known.withColumnRenamed("as_of", "flow_date"), ["fund_code", "flow_date"]
    )
    held = holdings.select("fund_code", F.col("as_of").alias("snapshot"), "symbol", "portfolio_weight")
    return (
        matched.join(held, ["fund_code", "snapshot"])
        .groupBy("flow_date", "symbol")
        .agg(
            rounded(F.sum(F.col("net_flow") * F.col("portfolio_weight")), 2).alias("estimated_flow"),
            F.max(F.datediff("flow_date", "snapshot")).alias("max_age_days"),
            F.count(F.lit(1)).alias("positions"),
        )
    )


def position_changes(previous: DataFrame, current: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Weight change per (manager, symbol) between two snapshots. Both sides are summed in one grouping
    instead of two aggregates and an outer join, so there is one shuffle and hot keys combine on the map side."""
    if tolerance < 0:
        raise ValueError("tolerance must not be negative")
    zero = F.lit(0.0)
    both = previous.select("manager", "symbol", F.col("portfolio_weight").alias("old"), zero.alias("new")).unionByName(
        current.select("manager", "symbol", zero.alias("old"), F.col("portfolio_weight").alias("new"))
    )
    old, new = F.col("previous_weight"), F.col("current_weight")
    return (
        both.groupBy("manager", "symbol")
        .agg(F.sum("old").alias("previous_weight"), F.sum("new").alias("current_weight"))
        .withColumn("change", new - old)
        .withColumn(
            "status",
            F.when((old == 0) & (new > 0), "NEW")
            .when((new == 0) & (old > 0), "EXIT")
            .when(F.col("change") > tolerance, "INCREASE")
            .when(F.col("change") < -tolerance, "DECREASE")
            .otherwise("STABLE"),
        )
    )


def attach_watchlist(base: DataFrame, watch: DataFrame, mode: str = "fail") -> DataFrame:
    """Left join watch features by symbol; clashing columns of the base are replaced."""
    require(base, ("symbol",), "base")
    features = add_risk_reward(watch, mode).select("symbol", *WATCH_FEATURES)
    return base.drop(*WATCH_FEATURES).join(features, "symbol", "left")


def attach_layers(base: DataFrame, layers: dict[str, DataFrame]) -> DataFrame:
    """Left join one (symbol, score) table per layer column, by upper-case symbol (unique per layer)."""
    out = base.withColumn("_key", F.upper("symbol"))
    for column, scores in layers.items():
        value = next(c for c in scores.columns if c != "symbol")
        side = scores.select(F.upper("symbol").alias("_key"), F.col(value).alias(column))
        out = out.drop(column).join(side, "_key", "left")
    return out.drop("_key")


def mark_to_market(
    bars: DataFrame, positions: DataFrame, initial_equity: float, slippage: float = 0.001
) -> DataFrame:
    """Portfolio value from (symbol, quantity, entry_cost): a position without a price contributes nothing."""
    closes = bars.groupBy("symbol").agg(F.max_by("close", "timestamp").alias("close"))
    valued = positions.join(closes, "symbol", "left")
    invested = F.coalesce(F.sum(F.col("quantity") * F.col("close") * F.lit(1 - slippage)), F.lit(0.0))
    cost = F.coalesce(F.sum("entry_cost"), F.lit(0.0))
    return valued.agg(invested.alias("invested"), cost.alias("cost")).select(
        F.greatest(F.lit(0.0), F.lit(float(initial_equity)) - F.col("cost")).alias("cash"),
        "invested",
        (F.greatest(F.lit(0.0), F.lit(float(initial_equity)) - F.col("cost")) + F.col("invested")).alias("equity"),
    )
