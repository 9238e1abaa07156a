"""Grouped summaries of flows, consensus, research and portfolios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip, clip_or, number, rounded
from ..functions.strings import strip
from ..schemas import require
from .quality import refuse_empty

# Action weights and the default set of portfolio managers.
ACTION_WEIGHTS = {"BUY": 1.0, "OVERWEIGHT": 0.8, "HOLD": 0.0, "NEUTRAL": 0.0, "UNDERWEIGHT": -0.8, "SELL": -1.0}
DEFAULT_MANAGERS = (
    "Ak Portföy", "İş Portföy", "Yapı Kredi Portföy", "Garanti Portföy",
    "QNB Portföy", "TEB Portföy", "Deniz Portföy", "Oyak Portföy",
    "Ünlü Portföy", "Tacirler Portföy", "İnfo Portföy", "Tera Portföy",
    "Pusula Portföy", "Ata Portföy", "Azimut Portföy", "Albaraka Portföy",
)


def _day(flows: DataFrame, as_of: str | Column | None) -> Column:
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of).cast("date") if as_of is not None else flows.agg(F.max("as_of")).scalar()


def flow_summary(flows: DataFrame, as_of: str | Column | None = None) -> DataFrame:
    """One row: inflow, outflow and net of the day, with the funds listed by size. No rows at all is an error."""
    today = flows.filter(F.col("as_of") == _day(flows, as_of))
    flow = F.col("net_flow")

    def listed(side: Column, size: Column) -> Column:
        entries = F.sort_array(F.collect_list(F.when(side, F.struct(size.alias("size"), "fund_code"))))
        return F.transform(entries, lambda e: e["fund_code"])

    total = lambda side: rounded(F.coalesce(F.sum(F.when(side, flow)), F.lit(0.0)), 2)
    summary = today.agg(
        F.max("as_of").alias("as_of"),
        total(flow > 0).alias("total_inflow"),
        F.abs(total(flow < 0)).alias("total_outflow"),
        rounded(F.sum(flow), 2).alias("net_flow"),
        listed(flow > 0, -flow).alias("inflow_funds"),
        listed(flow < 0, flow).alias("outflow_funds"),
        F.count(F.lit(1)).alias("_n"),
    )
    empty = F.raise_error(F.lit("no fund-flow observations")).cast("boolean")
    return summary.filter(F.when(F.col("_n") == 0, empty).otherwise(F.lit(True))).drop("_n")


def sector_flows_tagged(flows: DataFrame, as_of: str | Column | None = None) -> DataFrame:
    """Flow per explicitly tagged sector on the day. No rows at all is an error."""
    flows = refuse_empty(flows, "no fund-flow observations")
    today = flows.filter(
        (F.col("as_of") == _day(flows, as_of)) & F.col("sector").isNotNull() & (F.col("sector") != "")
    )
    per_fund = today.groupBy("as_of", "sector", "fund_code").agg(F.sum("net_flow").alias("part"))
    return (
        per_fund.groupBy("as_of", "sector")
        .agg(
            rounded(F.sum("part"), 2).alias("estimated_flow"),
            F.array_sort(F.collect_list("fund_code")).alias("funds"),
        )
        .orderBy(F.col("estimated_flow").desc(), "sector")
    )


def broker_consensus(views: DataFrame, order: list[str]) -> DataFrame:
    """0-100 consensus: the last usable view of each broker on each symbol, averaged over brokers."""
    action = F.upper(strip("action"))
    weight = F.when(F.lit(False), F.lit(0.0))
    for name, value in ACTION_WEIGHTS.items():
        weight = weight.when(action == name, F.lit(value))
    return (
        views.withColumn("weight", weight)
        .filter(F.col("weight").isNotNull())
        .groupBy("symbol", "broker")
        .agg(F.max_by("weight", F.struct(*order)).alias("weight"))
        .groupBy("symbol")
        .agg(rounded(F.lit(50.0) + F.lit(50.0) * F.avg("weight"), 2).alias("broker_consensus"))
    )


def consensus_recency(
    holdings: DataFrame,
    changes: DataFrame | None = None,
    managers: Sequence[str] | DataFrame = DEFAULT_MANAGERS,
    reference_date: str | None = None,
    half_life_days: float = 45.0,
) -> DataFrame:
    """Cross-manager ownership score with exponential ageing of snapshots.

    `managers` is the universe the breadth is measured against: names, or a one-column table of them.
    """
    if half_life_days <= 0:
        raise ValueError("half_life_days must be positive")
    if isinstance(managers, DataFrame):
        universe = managers.agg(F.countDistinct(managers.columns[0]).cast("double")).scalar()
    else:
        if not managers:
            raise ValueError("managers must not be empty")
        universe = F.lit(float(len(set(managers))))
    ref = F.lit(reference_date).cast("date") if reference_date else holdings.agg(F.max("as_of")).scalar()

    def recency(as_of: Column) -> Column:
        return F.pow(F.lit(0.5), F.greatest(F.lit(0), F.datediff(ref, as_of)) / F.lit(float(half_life_days)))

    aged = holdings.withColumn("rec", recency(F.col("as_of")))
    value = F.col("fund_aum") * F.col("portfolio_weight") * F.col("rec")
    per_fund = aged.groupBy("symbol", "manager", "fund_code").agg(
        F.max("as_of").alias("as_of"),
        F.sum(F.col("portfolio_weight") * F.col("rec")).alias("weight"),
        F.count(F.lit(1)).alias("rows"),
        F.sum(value).alias("value"),
    )
    funds = per_fund.groupBy("symbol").agg(F.countDistinct("fund_code").alias("fund_count"))
    per_manager = per_fund.groupBy("symbol", "manager").agg(
        recency(F.max("as_of")).alias("rec"), F.sum("weight").alias("weight"),
        F.sum("rows").alias("rows"), F.sum("value").alias("value"),
    )
    if changes is not None:
        per_manager = per_manager.join(changes.select("manager", "symbol", "status"), ["manager", "symbol"], "left")
    else:
        per_manager = per_manager.withColumn("status", F.lit(None).cast("string"))
    share = lambda c: F.least(F.lit(100.0), F.lit(100.0) * c / universe)
    counted = per_manager.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("manager_count"),
        F.sum("rec").alias("rec"),
        F.sum("weight").alias("weight"),
        F.sum("rows").alias("rows"),
        F.sum("value").alias("value"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("NEW", "INCREASE", "DECREASE")],
        F.array_sort(F.collect_list("manager")).alias("managers"),
    )
    average = F.col("weight") / F.col("rows")
    score = (
        F.lit(0.40) * share(F.col("manager_count"))
        + F.lit(0.20) * F.least(F.lit(100.0), F.lit(100.0) * average / F.lit(0.25))
        + F.lit(0.15) * share(F.col("NEW") + F.col("INCREASE"))
        + F.lit(0.15) * share(F.col("rec"))
        + F.lit(0.10) * share(F.col("NEW"))
    )
    return (
        counted.join(funds, "symbol")
        .select(
            "symbol",
            "manager_count",
            "fund_count",
            rounded("weight", 6).alias("total_weight"),
            rounded(average, 6).alias("average_weight"),
            rounded("value", 2).alias("estimated_value"),
            F.col("NEW").alias("new_manager_count"),
            F.col("INCREASE").alias("increasing_manager_count"),
            F.col("DECREASE").alias("decreasing_manager_count"),
            rounded(clip(score, 0.0, 100.0), 2).alias("score"),
            "managers",
        )
        .orderBy(F.col("score").desc(), F.col("manager_count").desc(), F.col("average_weight").desc(), "symbol")
    )


def consensus_breadth(positions: DataFrame) -> DataFrame:
    """0-100 ownership score from manager breadth, weight and weight changes."""
    require(positions, ("symbol", "manager", "weight", "change", "as_of"), "positions")
    grouped = positions.groupBy("symbol").agg(
        F.countDistinct("manager").alias("manager_count"),
        F.count(F.lit(1)).alias("fund_count"),
        F.avg("weight").alias("mean_weight"),
        F.max("weight").alias("max_weight"),
        F.avg("change").alias("mean_change"),
        F.count_if(F.col("change") > 0).alias("positive_managers"),
        F.count_if(F.col("change") < -0.005).alias("exits"),
    )
    pct = lambda c: clip(c, 0.0, 100.0)
    managers = F.greatest(F.col("manager_count"), F.lit(1))
    score = (
        F.lit(0.30) * pct(F.col("manager_count") / 10.0 * 100.0)
        + F.lit(0.25) * pct(F.col("mean_weight") / 0.10 * 100.0)
        + F.lit(0.25) * pct(F.lit(50.0) + F.col("mean_change") / 0.02 * 50.0)
        + F.lit(0.20) * pct(F.col("positive_managers") / managers * 100.0)
        - F.lit(0.20) * pct(F.col("exits") / managers * 100.0)
    )
    return grouped.withColumn("consensus_score", rounded(pct(score), 2)).orderBy(
        F.col("consensus_score").desc(), "symbol"
    )


def research_score(documents: DataFrame) -> DataFrame:
    """Confidence-weighted sentiment per symbol on a 0-100 scale."""
    require(documents, ("symbol", "sentiment", "confidence", "observed_at"), "documents")
    weight = clip_or(number("confidence"), 0.0, 0.0, 1.0)
    mean = F.coalesce(
        F.try_divide(F.sum(F.col("sentiment") * F.col("w")), F.sum(F.when(F.col("sentiment").isNotNull(), F.col("w")))),
        F.lit(0.0),
    )
    return (
        documents.withColumn("w", weight)
        .groupBy("symbol")
        .agg(rounded(clip(F.lit(50.0) + mean * 50.0, 0.0, 100.0), 2).alias("research_score"))
    )


def portfolio_risk(positions: DataFrame, keys: str = "portfolio") -> DataFrame:
    """Concentration of each portfolio: top-1, top-5, Herfindahl index and its inverse."""
    require(positions, (keys, "symbol", "weight"), "positions")
    weighed = positions.withColumn("w", F.greatest(F.lit(0.0), F.coalesce(number("weight"), F.lit(0.0))))
    totals = weighed.groupBy(keys).agg(
        F.count(F.lit(1)).alias("positions"),
        F.sum("w").alias("total"),
        F.max("w").alias("largest"),
        F.sum(F.col("w") * F.col("w")).alias("squares"),
    )
    largest = Window.partitionBy(keys).orderBy(F.col("w").desc(), "symbol")
    top5 = (
        weighed.withColumn("_n", F.row_number().over(largest))
        .filter(F.col("_n") <= 5)
        .groupBy(keys)
        .agg(F.sum("w").alias("five"))
    )
    part = lambda c: F.coalesce(F.try_divide(c, F.col("total")), F.lit(0.0))
    hhi = F.coalesce(F.try_divide(F.col("squares"), F.col("total") * F.col("total")), F.lit(0.0))
    return totals.join(top5, keys).select(
        keys,
        "positions",
        part(F.col("largest")).alias("top1_weight"),
        part(F.col("five")).alias("top5_weight"),
        hhi.alias("herfindahl"),
        F.coalesce(F.try_divide(F.lit(1.0), hhi), F.lit(0.0)).alias("effective_positions"),
    )
