"""Metrics of rankings, back-tests and closed signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunked import running
from ..functions.lineage import written
from ..functions.numeric import known, rounded
from ..schemas import require
from .features import equity_curve


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _outcomes(truth: Column, predicted: Column) -> list[Column]:
    return [
        F.count_if(truth & predicted).alias("tp"),
        F.count_if(~truth & predicted).alias("fp"),
        F.count_if(truth & ~predicted).alias("fn"),
        F.count_if(truth).alias("positives"),
        F.count_if(predicted).alias("predicted"),
        F.count(F.lit(1)).alias("rows"),
    ]


def ranking_metrics(df: DataFrame, truth: str, predicted: str, day: str | None = None) -> DataFrame:
    """Precision, recall, share of days with a prediction, and predictions per day."""
    t, p = F.col(truth).cast("boolean"), F.col(predicted).cast("boolean")
    if day is None:
        total = df.agg(*_outcomes(t, p))
        rate, average = F.when(F.col("tp") > 0, F.lit(1.0)).otherwise(F.lit(0.0)), F.col("tp").cast("double")
    else:
        daily = df.groupBy(F.to_date(day).alias("_day")).agg(*_outcomes(t, p))
        sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "predicted")]
        total = daily.agg(*sums, F.count(F.lit(1)).alias("days"), F.count_if(F.col("predicted") > 0).alias("hit_days"))
        rate, average = ratio(F.col("hit_days"), F.col("days")), ratio(F.col("predicted"), F.col("days"))
    return total.select(
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        rate.alias("daily_hit_day_rate"),
        average.alias("average_daily_hits"),
    )


def backtest_metrics(predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Thirteen classification and calendar metrics; a `score` column overrides the given prediction."""
    require(predictions, ("timestamp", "prediction", "actual"), "predictions")
    if "score" in predictions.columns:
        predicted = F.coalesce(F.col("score") >= threshold, F.lit(False))
    else:
        predicted = F.col("prediction").cast("boolean")
    daily = predictions.groupBy(F.to_date("timestamp").alias("day")).agg(
        *_outcomes(F.col("actual").cast("boolean"), predicted)
    )
    # Days roll up to months, months to one row: the rows themselves are grouped once.
    monthly = daily.groupBy(F.trunc("day", "month").alias("month")).agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "positives", "predicted", "rows")],
        F.count_if(F.col("predicted") > 0).alias("hit_days"),
        F.count(F.lit(1)).alias("days"),
    )
    total = monthly.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c)
          for c in ("tp", "fp", "fn", "positives", "predicted", "rows", "hit_days", "days")],
        F.count_if(F.col("tp") >= 10).alias("months_with_10_hits"),
        F.count_if(F.col("tp") > 0).alias("months_with_hits"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return total.select(
        F.col("rows").alias("signals"),
        "positives",
        tp.alias("true_positives"),
        fp.alias("false_positives"),
        fn.alias("false_negatives"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        "hit_days",
        F.col("days").alias("total_days"),
        ratio(F.col("hit_days"), F.col("days")).alias("daily_hit_day_rate"),
        ratio(F.col("predicted"), F.col("days")).alias("average_daily_hits"),
        "months_with_10_hits",
        ratio(tp, F.col("months_with_hits")).alias("average_monthly_hits"),
    )


def topk_daily(predictions: DataFrame, top_k: int = 5, event_threshold: float = 0.10) -> DataFrame:
    """One row per timestamp: universe events, and hits and mean return of the top-k by score."""
    require(predictions, ("timestamp", "symbol", "score", "future_return"), "predictions")
    if top_k < 1:
        raise ValueError("top_k must be positive")
    event = F.coalesce(F.col("future_return") >= event_threshold, F.lit(False))
    rows = predictions.select("timestamp", "symbol", "score", "future_return", event.alias("event"))
    universe = rows.groupBy("timestamp").agg(F.count_if("event").alias("events"))
    best = Window.partitionBy("timestamp").orderBy(F.col("score").desc(), "symbol")
    chosen = (
        rows.withColumn("_n", F.row_number().over(best))
        .filter(F.col("_n") <= top_k)
        .groupBy("timestamp")
        .agg(
            F.count(F.lit(1)).alias("selected"),
            F.count_if("event").alias("hits"),
            F.coalesce(F.avg("future_return"), F.lit(0.0)).alias("daily_return"),
        )
    )
    return universe.join(chosen, "timestamp")


def topk_metrics(predictions: DataFrame, top_k: int = 5, event_threshold: float = 0.10) -> DataFrame:
    """Top-k precision, recall, event-day rate of the universe, gap between hit days, compounded return, drawdown.

    The daily rows, one a day, are stored: the curve reads them several times.
    """
    curve = equity_curve(written(topk_daily(predictions, top_k, event_threshold)))
    hit_day = F.when(F.col("hits") > 0, F.unix_seconds(F.col("timestamp").cast("timestamp")))
    total = curve.agg(
        F.sum("hits").alias("hits"),
        F.sum("selected").alias("selected"),
        F.sum("events").alias("events"),
        F.count_if(F.col("events") > 0).alias("event_days"),
        F.count(F.lit(1)).alias("days"),
        F.count(hit_day).alias("hit_days"),
        # The mean gap between consecutive hit days telescopes to last minus first.
        (F.max(hit_day) - F.min(hit_day)).alias("span"),
        F.max_by("equity", "timestamp").alias("final"),
        F.min("drawdown").alias("worst"),
    )
    gap = F.when(F.col("hit_days") > 1, F.col("span") / 86400.0 / (F.col("hit_days") - 1)).otherwise(F.lit(0.0))
    return total.select(
        rounded(ratio(F.col("hits"), F.col("selected")), 6).alias("top_k_precision"),
        rounded(ratio(F.col("event_days"), F.col("days")), 6).alias("hit_day_rate"),
        rounded(ratio(F.col("hits"), F.col("events")), 6).alias("recall"),
        rounded(gap, 6).alias("mean_hit_gap_days"),
        rounded(gap, 6).alias("mean_lead_days"),
        rounded(F.coalesce(F.col("final") - 1.0, F.lit(0.0)), 6).alias("net_pnl"),
        rounded(F.coalesce("worst", F.lit(0.0)), 6).alias("max_drawdown"),
    )


def exact_median(df: DataFrame, column: str, accuracy: int = 10_000) -> Column:
    """Exact median as a scalar of the running query; missing and NaN values do not count, NULL without any other.

    A sketch brackets the middle within 2 / accuracy of the ranks. A second pass counts the values below the bracket and
    groups those inside, which are cumulated in 4096 slices of the bracket; no value outside is sorted or grouped.
    """
    rows = df.select(known(column).alias("v")).filter("v is not null")
    ends = F.percentile_approx("v", [0.5 - 2 / accuracy, 0.5 + 2 / accuracy], accuracy)
    bracket = rows.agg(F.struct(ends[0].alias("low"), ends[1].alias("high"))).scalar()
    low, high = bracket.getField("low"), bracket.getField("high")
    sizes = rows.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") < low).alias("below"))).scalar()
    n, below = sizes.getField("n"), sizes.getField("below")
    inside = rows.filter(F.col("v").between(low, high)).groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    slice_ = F.coalesce(F.floor(F.try_divide(F.col("v") - low, high - low) * 4096), F.lit(0))
    placed = running(inside, [], ["v"], slice_, {"upto": ("count", "c")})
    first, last = F.floor((n + 1) / 2) - below, F.floor(n / 2) + 1 - below
    covers = (F.col("upto") >= first) & (F.col("upto") - F.col("c") < last)
    return placed.filter(covers).agg((F.min("v") + F.max("v")) / 2.0).scalar()


def learning_report(outcomes: DataFrame, hit_threshold: float = 0.10) -> DataFrame:
    """One row of statistics over closed signals (a return that is a number), with the recommended next step."""
    closed = outcomes.withColumn("outcome_return", known("outcome_return")).filter(F.col("outcome_return").isNotNull())
    median = exact_median(closed, "outcome_return")
    r = F.col("outcome_return")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    ready = F.col("closed_signals") >= 30
    weak = (F.col("hit_rate") < 0.50) | (F.col("mean_return") <= 0)
    report = closed.agg(
        F.count(F.lit(1)).alias("closed_signals"),
        rounded(ratio(F.count_if(r >= hit_threshold), F.count(F.lit(1))), 4).alias("hit_rate"),
        rounded(zero(F.avg(r)), 6).alias("mean_return"),
        rounded(zero(F.stddev_samp(r)), 6).alias("return_std"),
    ).withColumn("median_return", rounded(zero(median), 6))
    action = F.when(ready, "READY_FOR_RESEARCH").otherwise("COLLECT_MORE_OUTCOMES")
    steps = (
        F.when(~ready, F.array(F.lit("COLLECT_MORE_OUTCOMES")))
        .when(weak, F.array(*map(F.lit, (
            "AUDIT_SIGNAL_QUALITY", "RUN_FEATURE_ABLATION", "RUN_WALK_FORWARD_REWEIGHTING_EXPERIMENT"))))
        .otherwise(F.array(*map(F.lit, ("RUN_FEATURE_ABLATION", "RUN_WALK_FORWARD_REWEIGHTING_EXPERIMENT"))))
    )
    return report.withColumn("recommended_action", action).withColumn("research_actions", steps)


def feature_edge(signals: DataFrame, outcomes: DataFrame, order: str) -> DataFrame:
    """Mean of contribution x outcome per feature, over outcomes whose (latest) signal record exists."""
    latest = signals.groupBy("signal_id").agg(F.max_by("feature_contributions", order).alias("parts"))
    closed = outcomes.select("signal_id", known("outcome_return").alias("outcome_return")).filter("outcome_return is not null")
    return (
        closed.join(latest, "signal_id")
        .select("outcome_return", F.explode("parts").alias("feature", "contribution"))
        .groupBy("feature")
        .agg(rounded(F.avg(F.col("contribution") * F.col("outcome_return")), 8).alias("edge"))
    )


def accept_model(metrics: DataFrame, min_precision: float = 0.35, min_hit_day_rate: float = 0.25) -> DataFrame:
    """Flag the metric rows that clear both gates."""
    passed = (F.col("precision") >= min_precision) & (F.col("hit_day_rate") >= min_hit_day_rate)
    return metrics.withColumn("accepted", passed)
