"""Time-series features over bars and flows.

Full-history operators run their frames per (symbol, year) with neighbouring rows copied in, so a symbol with
a very long history is spread over tasks. Operators that need only the end of a history first keep the last
rows of each symbol, which Spark prunes before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.chunked import over_chunks, running
from ..functions.numeric import INF, change, clip_or, div_float, div_or_zero, min_obs, nonzero, rounded
from ..schemas import BAR_COLUMNS, require

SNAPSHOT_COLUMNS = (
    "return_1", "return_5", "volume_ratio", "range_pct", "close_location",
    "return_20", "distance_ma20", "breakout_20", "volatility_20",
)
MODEL_FEATURES = (
    "ret1", "ret5", "volume_ratio", "close_location", "range_pct", "breakout_20", "volatility_20", "gap",
)


def by_year(chunk: Column | None, order: str = "timestamp") -> Column:
    """The caller's chunk, else the calendar year: at most 366 daily rows. Give a finer one for intraday rows."""
    return F.year(order) if chunk is None else chunk


def tail_rows(df: DataFrame, n: int, key: str = "symbol", order: str = "timestamp") -> DataFrame:
    """Last n rows of each key, numbered from the end in `_back` (1 = latest)."""
    newest = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") <= n)


def latest_per_symbol(df: DataFrame, key: str = "symbol", order: str = "timestamp") -> DataFrame:
    return tail_rows(df, 1, key, order).drop("_back")


def feature_snapshot(bars: DataFrame, volume_lookback: int = 20) -> DataFrame:
    """One row per symbol with at least two bars: features of its latest bar."""
    require(bars, BAR_COLUMNS, "bars")
    recent = tail_rows(bars, max(21, volume_lookback + 1)).withColumnRenamed("_back", "b")
    w = Window.partitionBy("symbol").orderBy(F.col("b").desc())
    recent = recent.withColumn("r", div_or_zero("close", F.lag("close").over(w)) - 1.0)
    within = lambda n: F.col("b") <= n

    def anchor(back: int) -> Column:
        """Close `back` bars ago, or the first close of a shorter history."""
        return F.max_by(F.when(within(back + 1), F.col("close")), F.when(within(back + 1), F.col("b")))

    def at(name: str, back: int = 1) -> Column:
        return F.max(F.when(F.col("b") == back, F.col(name)))

    steps = F.when(within(20) & (F.col("b") < F.col("n")), F.col("r"))
    sized = recent.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    flat = sized.groupBy("symbol").agg(
        F.max("timestamp").alias("timestamp"),
        F.count(F.lit(1)).alias("n"),
        *[at(name).alias(name) for name in ("high", "low", "close", "volume")],
        at("close", 2).alias("prev"),
        anchor(5).alias("a5"),
        anchor(20).alias("a20"),
        F.avg(F.when((F.col("b") > 1) & within(volume_lookback + 1), F.col("volume"))).alias("mean_volume"),
        F.avg(F.when(within(20), F.col("close"))).alias("ma20"),
        F.max(F.when(within(20), F.col("high"))).alias("high20"),
        F.coalesce(F.stddev_samp(steps), F.lit(0.0)).alias("volatility_20"),
    )
    close, spread = F.col("close"), F.col("high") - F.col("low")
    return flat.filter(F.col("n") >= 2).select(
        "symbol",
        "timestamp",
        (div_or_zero(close, "prev") - 1.0).alias("return_1"),
        (div_or_zero(close, "a5") - 1.0).alias("return_5"),
        div_or_zero("volume", "mean_volume").alias("volume_ratio"),
        div_or_zero(spread, close).alias("range_pct"),
        F.when(spread != 0, div_or_zero(close - F.col("low"), spread)).otherwise(F.lit(0.5)).alias("close_location"),
        (div_or_zero(close, "a20") - 1.0).alias("return_20"),
        (div_or_zero(close, "ma20") - 1.0).alias("distance_ma20"),
        div_or_zero(close, "high20").alias("breakout_20"),
        "volatility_20",
    )


def ranker_columns(df: DataFrame, w: WindowSpec) -> DataFrame:
    """Feature columns over a window per symbol in time order."""
    with_current, prior = w.rowsBetween(-19, 0), w.rowsBetween(-20, -1)
    close = F.col("close")
    framed = df.withColumns(
        {
            "ret_1": change(close, F.lag("close").over(w)),
            "ret_5": change(close, F.lag("close", 5).over(w)),
            "vol_mean_20": min_obs(F.avg("volume"), F.col("volume"), with_current, 5),
            "high_20_prev": min_obs(F.max("high"), F.col("high"), prior, 5),
        }
    )
    derived = framed.withColumns(
        {
            "volume_ratio": F.try_divide(F.col("volume"), nonzero("vol_mean_20")),
            "breakout": change(close, "high_20_prev"),
        }
    )
    return derived.withColumn("score", market_score())


def market_score() -> Column:
    raw = (
        F.lit(50.0)
        + clip_or("ret_1", 0.0, -0.05, 0.10) * 250
        + clip_or("ret_5", 0.0, -0.15, 0.30) * 100
        + (clip_or("volume_ratio", 1.0, 0.0, 5.0) - 1) * 8
        + clip_or("breakout", 0.0, -0.10, 0.10) * 150
    )
    return clip_or(raw, 50.0, 0.0, 100.0)


def ranker_features(bars: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Momentum, volume and breakout features with their 0-100 score for every bar."""
    require(bars, BAR_COLUMNS, "bars")
    needs = ["close", "high", "volume"]
    return over_chunks(bars, ["symbol"], ["timestamp"], by_year(chunk), ranker_columns, before=20, needs=needs)


def latest_ranker_features(bars: DataFrame) -> DataFrame:
    """`ranker_features` of the latest bar only; 21 rows per symbol are enough for its frames."""
    require(bars, BAR_COLUMNS, "bars")
    w = Window.partitionBy("symbol").orderBy("timestamp")
    recent = tail_rows(bars, 21)
    return ranker_columns(recent, w).filter(F.col("_back") == 1).drop("_back")


def _model_columns(df: DataFrame, w: WindowSpec) -> DataFrame:
    prior, last20 = w.rowsBetween(-20, -1), w.rowsBetween(-19, 0)
    close, spread = F.col("close"), F.col("high") - F.col("low")
    previous = F.lag("close").over(w)
    moved = df.withColumns(
        {
            "ret1": change(close, previous),
            "ret5": change(close, F.lag("close", 5).over(w)),
            "volume_ratio": F.try_divide("volume", nonzero(min_obs(F.avg("volume"), F.col("volume"), prior, 5))),
            "close_location": F.try_divide(close - F.col("low"), nonzero(spread)),
            "range_pct": F.try_divide(spread, nonzero(close)),
            "breakout_20": change(close, min_obs(F.max("high"), F.col("high"), prior, 5)),
            "gap": change("open", previous),
            "next_high": F.lead("high").over(w),
        }
    )
    return moved.withColumn("volatility_20", min_obs(F.stddev_samp("ret1"), F.col("ret1"), last20, 10))


def limit_up_dataset(bars: DataFrame, limit_pct: float = 0.10, chunk: Column | None = None) -> DataFrame:
    """Training rows: eight features per bar and whether the next high reaches the upper limit."""
    require(bars, BAR_COLUMNS, "bars")
    # 21 rows back: the oldest of 20 trailing returns needs the close before it.
    needs = ["open", "high", "low", "close", "volume"]
    rows = over_chunks(bars, ["symbol"], ["timestamp"], by_year(chunk), _model_columns, before=21, after=1, needs=needs)
    target = (F.col("next_high") >= F.col("close") * F.lit(1 + limit_pct)).cast("double")
    return (
        rows.filter(F.col("next_high").isNotNull())
        .withColumn("target", target)
        .drop("next_high")
        .na.drop(subset=list(MODEL_FEATURES))
    )


def forward_labels(
    bars: DataFrame, limit_pct: float = 0.10, horizon_bars: int = 1, chunk: Column | None = None
) -> DataFrame:
    """Whether the high exactly `horizon_bars` ahead reaches the limit over the current close."""
    if limit_pct <= 0 or horizon_bars < 1:
        raise ValueError("limit_pct must be positive and horizon_bars at least 1")

    def label(df: DataFrame, w: WindowSpec) -> DataFrame:
        ahead = F.lead("high", horizon_bars).over(w)
        hit = F.coalesce(ahead >= F.col("close") * F.lit(1 + limit_pct), F.lit(False))
        return df.withColumn("hit_limit_forward", hit).withColumn("label_available", ahead.isNotNull())

    return over_chunks(
        bars, ["symbol"], ["timestamp"], by_year(chunk), label, after=horizon_bars, needs=["high"]
    )


def flow_anomalies(
    flows: DataFrame, lookback: int = 20, z_threshold: float = 2.0, chunk: Column | None = None
) -> DataFrame:
    """z-score of each fund flow against that fund's preceding observations only."""
    if lookback < 2:
        raise ValueError("lookback must be at least 2")
    if z_threshold <= 0:
        raise ValueError("z_threshold must be positive")

    def score(df: DataFrame, w: WindowSpec) -> DataFrame:
        past, flow = w.rowsBetween(-lookback, -1), F.col("net_flow")
        seen, mean, std = F.count(flow).over(past), F.avg(flow).over(past), F.stddev_pop(flow).over(past)
        constant = F.min(flow).over(past) == F.max(flow).over(past)
        base = F.min(flow).over(past)
        z = (
            F.when(seen < 2, F.lit(0.0))
            .when(constant & (flow == base), F.lit(0.0))
            .when(constant & (flow > base), F.lit(INF))
            .when(constant, F.lit(-INF))
            .otherwise(div_float(flow - mean, std))
        )
        return df.withColumn("z_score", z)

    scored = over_chunks(
        flows, ["fund_code"], ["as_of"], by_year(chunk, "as_of"), score, before=lookback, needs=["net_flow"]
    )
    return scored.select(
        "fund_code", "as_of", "net_flow", "z_score",
        (F.abs("z_score") >= z_threshold).alias("is_anomalous"),
    )


def performance_board(bars: DataFrame, period_bars: int = 20, top_k: int = 20) -> DataFrame:
    """Leaders by trailing return with their rank one period ago.

    Ranks count over all eligible symbols, but nothing sorts them globally: the leaders come from a top-k, and
    their earlier ranks from counting how many symbols fall between their k earlier returns.
    """
    if period_bars < 1 or top_k < 1:
        raise ValueError("period_bars and top_k must be at least 1")
    back = lambda n: F.max(F.when(F.col("_back") == n, F.col("close")))
    eligible = (
        tail_rows(bars, 2 * period_bars + 1)
        .groupBy("symbol")
        .agg(back(1).alias("end"), back(period_bars + 1).alias("start"), back(2 * period_bars + 1).alias("before"))
        .filter((F.col("start") > 0) & (F.col("before") > 0))
        .select(
            "symbol",
            ((F.col("end") / F.col("start") - 1.0) * 100.0).alias("current"),
            ((F.col("start") / F.col("before") - 1.0) * 100.0).alias("previous"),
        )
    )
    leaders = eligible.orderBy(F.col("current").desc(), "symbol").limit(top_k)
    place = F.struct((-F.col("previous")).alias("p"), F.col("symbol").alias("s"))
    marks = leaders.agg(F.sort_array(F.collect_list(place)).alias("marks")).scalar()  # top_k entries
    slots = (
        eligible.select(place.alias("place"), marks.alias("marks"))
        .withColumn("slot", F.size(F.filter("marks", lambda m: m < F.col("place"))))
        .groupBy("slot")
        .agg(F.count(F.lit(1)).alias("n"))  # at most top_k + 1 groups
    )
    counts = slots.withColumn("previous_rank", F.sum("n").over(Window.orderBy("slot")))
    ranked = leaders.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("current").desc(), "symbol"))
    ).withColumn("slot", F.row_number().over(Window.orderBy(F.col("previous").desc(), "symbol")) - 1)
    now, then = rounded("current", 2), rounded("previous", 2)
    return (
        ranked.join(counts, "slot")
        .select(
            "symbol",
            now.alias("period_return_pct"),
            then.alias("previous_period_return_pct"),
            "rank",
            "previous_rank",
            (F.col("previous_rank") - F.col("rank")).alias("rank_change"),
            (now - then).alias("acceleration_pct"),
        )
        .orderBy("rank")
    )


def limit_price(reference: Column, limit_pct: float) -> Column:
    if limit_pct <= 0:
        raise ValueError("limit_pct must be positive")
    return reference * F.lit(1 + limit_pct)


def is_limit_up_close(close: Column, reference: Column, limit_pct: float, tolerance: float = 1e-6) -> Column:
    return close >= limit_price(reference, limit_pct) - F.lit(tolerance)


def first_touch(bars: DataFrame, reference: Column, limit_pct: float, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Earliest bar of each key whose high touches the limit; NULL when none does."""
    touched = F.col("high") >= limit_price(reference, limit_pct) - F.lit(tolerance)
    return bars.groupBy(*keys).agg(F.min(F.when(touched, F.col("timestamp"))).alias("first_touch_time"))


def limit_up_events(
    bars: DataFrame, limit_pct: float = 0.10, tolerance: float = 1e-6, chunk: Column | None = None
) -> DataFrame:
    """Bars whose high touches the limit over the previous close; the first touch of each run is flagged."""

    def touch(df: DataFrame, w: WindowSpec) -> DataFrame:
        reference = F.lag("close").over(w)
        df = df.withColumn("reference_price", reference)
        touched = F.col("high") >= limit_price(F.col("reference_price"), limit_pct) - F.lit(tolerance)
        df = df.withColumn("touched", F.coalesce(touched, F.lit(False)))
        return df.withColumn("first_touch", ~F.coalesce(F.lag("touched").over(w), F.lit(False)))

    marked = over_chunks(bars, ["symbol"], ["timestamp"], by_year(chunk), touch, before=2, needs=["high", "close"])
    reference = F.col("reference_price")
    return marked.filter("touched").select(
        "symbol",
        F.col("timestamp").alias("event_time"),
        "reference_price",
        limit_price(reference, limit_pct).alias("limit_price"),
        F.col("close").alias("close_price"),
        "first_touch",
        is_limit_up_close(F.col("close"), reference, limit_pct, tolerance).alias("held_at_close"),
    )


def estimate_revisions(estimates: DataFrame) -> DataFrame:
    """0-100 score from the latest known estimate change of each symbol."""
    require(estimates, ("symbol", "period", "estimate", "observed_at"), "estimates")

    def revise(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumn("revision", change("estimate", F.lag("estimate").over(w)))

    revised = over_chunks(
        estimates, ["symbol", "period"], ["observed_at"], F.year("observed_at"), revise, before=1, needs=["estimate"]
    )
    order = F.when(F.col("revision").isNotNull(), F.struct("period", "observed_at"))
    last = F.coalesce(F.max_by("revision", order), F.lit(0.0))
    return revised.groupBy("symbol").agg(
        rounded(clip_or(F.lit(50.0) + last * 500, 50.0, 0.0, 100.0), 2).alias("analyst_revision_score")
    )


def equity_curve(daily: DataFrame, order: str = "timestamp", returns: str = "daily_return") -> DataFrame:
    """Compounded equity of one row per day and its drawdown from the running peak of the equity itself."""
    month = F.date_format(order, "yyyy-MM")
    grown = daily.withColumn("_growth", F.lit(1.0) + F.coalesce(F.col(returns), F.lit(0.0)))
    curve = running(grown, [], [order], month, {"equity": ("product", "_growth")})
    peaked = running(curve, [], [order], month, {"_peak": ("max", "equity")})
    return peaked.withColumn("drawdown", div_float("equity", "_peak") - 1.0).drop("_growth", "_peak")


def ledger_metrics(
    snapshots: DataFrame, initial_equity: float, keys: list[str], order: list[str], chunk: Column
) -> DataFrame:
    """Net return, worst drawdown (peak starts at the initial equity) and row count per account."""
    if initial_equity <= 0:
        raise ValueError("initial_equity must be positive")
    start = F.lit(float(initial_equity))
    peaked = running(snapshots, keys, order, chunk, {"_peak": ("max", "equity")})
    drop = F.col("equity") / F.greatest(start, F.col("_peak")) - 1.0
    return peaked.groupBy(*keys).agg(
        F.coalesce(F.max_by("equity", F.struct(*order)) / start - 1.0, F.lit(0.0)).alias("net_return"),
        F.coalesce(F.least(F.lit(0.0), F.min(drop)), F.lit(0.0)).alias("max_drawdown"),
        F.count(F.lit(1)).cast("double").alias("observations"),
    )
