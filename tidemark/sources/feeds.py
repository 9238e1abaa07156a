"""Institutional feeds: a point-in-time normal form and the union of all feed families."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.quality import validate_point_in_time
from ..schemas import require

DATASETS = (
    "market", "fundamentals", "estimates", "holdings", "flows", "research", "transactions", "alternative",
)


def _stamp(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.col(name).cast("timestamp")) if df.schema[name].dataType.typeName() == "string" else df


def feed_normalize(records: DataFrame, dataset: str, mode: str = "fail") -> DataFrame:
    """Require symbol and observed_at, reject facts dated after they were observed, tag the dataset."""
    require(records, ("symbol", "observed_at"), f"{dataset} feed")
    typed = _stamp(records, "observed_at")
    if "as_of" in typed.columns:
        typed = validate_point_in_time(_stamp(typed, "as_of"), mode=mode)
    return typed.withColumn("source_dataset", F.lit(dataset))


def feed_snapshot(feeds: dict[str, DataFrame], mode: str = "fail") -> DataFrame:
    """All given feed families as one table keyed by source_dataset; columns a feed lacks are NULL."""
    unknown = sorted(set(feeds) - set(DATASETS))
    if unknown:
        raise ValueError(f"unknown datasets: {unknown}")
    parts = [feed_normalize(feeds[name], name, mode) for name in DATASETS if name in feeds]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def source_coverage(sources: DataFrame) -> DataFrame:
    """Counts of known, enabled, and enabled point-in-time sources."""
    return sources.agg(
        F.count(F.lit(1)).alias("discovered"),
        F.count_if("enabled").alias("enabled"),
        F.count_if(F.col("enabled") & F.col("point_in_time")).alias("point_in_time_ready"),
    )
