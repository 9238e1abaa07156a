"""Data quality, point-in-time and constraint checks.

Row checks come in two modes: "quarantine" keeps the rows and adds the list of broken rules; "fail" raises inside
the job at the first bad row, so nothing is collected to find out.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from ..functions.chunked import over_chunks
from ..functions.numeric import known, number
from ..functions.strings import strip
from ..schemas import BAR_COLUMNS, PRICE_COLUMNS, WATCH_LEVELS, require


def violations(rules: Mapping[str, Column]) -> Column:
    """Array of the names of the rules a row breaks; a rule that evaluates to NULL is not broken."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))


def enforce(df: DataFrame, rules: Mapping[str, Column], mode: str = "fail", what: str = "row") -> DataFrame:
    """Apply rules: "fail" raises on the first violation, "quarantine" adds a `violations` array."""
    if mode == "quarantine":
        return df.withColumn("violations", violations(rules))
    if mode != "fail":
        raise ValueError("mode is 'fail' or 'quarantine'")
    broken = F.lit(False)
    for rule in rules.values():
        broken = broken | F.coalesce(rule, F.lit(False))
    # The message is built only for a bad row. A filter, not a projected column: pruning cannot drop the check.
    message = F.concat(F.lit(f"invalid {what}: "), F.array_join(violations(rules), ", "))
    return df.filter(F.when(broken, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))


def refuse_empty(df: DataFrame, message: str) -> DataFrame:
    """`df`, or an error when it has no row; checked while it runs, by a branch that never gives a row."""
    found = df.limit(1).agg(F.count(F.lit(1))).scalar()
    check = F.when(found == 0, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(False))
    none = df.sparkSession.range(1).filter(check)
    return df.unionByName(none.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]))


def bar_rules() -> dict[str, Column]:
    values = {name: known(name) for name in PRICE_COLUMNS}
    o, h, l, c = (values[name] for name in ("open", "high", "low", "close"))
    missing = F.col("symbol").isNull() | F.col("timestamp").isNull()
    negative = F.lit(False)
    for value in values.values():
        missing = missing | value.isNull()
        negative = negative | F.coalesce(value < 0, F.lit(False))
    return {
        "null_values": missing,
        "negative_values": negative,
        "high_below_ohlc": h < F.greatest(o, c, l),
        "low_above_ohlc": l > F.least(o, c, h),
    }


def bar_violations(bars: DataFrame) -> DataFrame:
    """Row form of the bar checks, for quarantine."""
    return require(bars, BAR_COLUMNS, "bars").withColumn("violations", violations(bar_rules()))


def validate_ohlcv(bars: DataFrame, seq: list[str], seq_chunk: Column) -> DataFrame:
    """One row per broken check, in check order: (position, code). No rows means valid data.

    `seq` is the ingest order the per-symbol timestamp order is judged in, and `seq_chunk` a coarse, never
    decreasing function of it.
    """
    missing = [name for name in BAR_COLUMNS if name not in bars.columns]
    if missing:
        spark = bars.sparkSession
        return spark.createDataFrame([(0, "missing:" + ",".join(missing))], "position int, code string")

    def step_back(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumn("_back", F.coalesce(F.col("timestamp") < F.lag("timestamp").over(w), F.lit(False)))

    rules = bar_rules()
    ordered = over_chunks(bars, ["symbol"], seq, seq_chunk, step_back, before=1, needs=["timestamp"])
    rowwise = ordered.agg(
        *[F.max(F.coalesce(broken, F.lit(False))).alias(name) for name, broken in rules.items()],
        F.max("_back").alias("timestamp_not_monotonic"),
    )
    repeated = (
        bars.groupBy("symbol", "timestamp").agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.col("n") > 1)).scalar()
    )
    codes = [*rules, "duplicate_bars", "timestamp_not_monotonic"]
    flags = rowwise.withColumn("duplicate_bars", repeated)
    checks = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(code).alias("code"), F.col(code).alias("broken"))
                       for i, code in enumerate(codes)])
    return flags.select(F.inline(checks)).filter("broken").select("position", "code")


def assert_ohlcv_quality(bars: DataFrame, seq: list[str], seq_chunk: Column) -> None:
    """Raise with all broken checks (at most six rows reach the driver)."""
    found = [row.code for row in validate_ohlcv(bars, seq, seq_chunk).orderBy("position").collect()]
    if found:
        raise ValueError("invalid OHLCV data: " + ", ".join(found))


def validate_point_in_time(
    df: DataFrame, as_of: str = "as_of", observed: str = "observed_at", mode: str = "fail"
) -> DataFrame:
    """Reject (or flag in `lookahead`) rows known before the date they are about.

    Text stamps are read as times, so offsets count; text that is no time compares as missing.
    """
    require(df, (as_of, observed), "frame")
    moment = lambda c: F.col(c).try_cast("timestamp") if isinstance(df.schema[c].dataType, T.StringType) else F.col(c)
    future = F.coalesce(moment(as_of) > moment(observed), F.lit(False))
    if mode == "quarantine":
        return df.withColumn("lookahead", future)
    return enforce(df, {f"lookahead detected, {as_of} is later than {observed}": future}, "fail", "row")


def asof_cutoff(df: DataFrame, cutoff: str | Column, as_of: str = "as_of") -> DataFrame:
    limit = cutoff if isinstance(cutoff, Column) else F.lit(cutoff).cast(df.schema[as_of].dataType)
    return df.filter(F.col(as_of) <= limit)


def _outside(c: str, low: float, high: float) -> Column:
    return ~F.col(c).between(low, high)


def _blank(c: str) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def row_constraints(kind: str) -> dict[str, Column]:
    """The range and key rules of each record kind."""
    tables = {
        "signal": lambda: {"score_range": _outside("score", 0, 100), "confidence_range": _outside("confidence", 0, 1)},
        "news": lambda: {
            "sentiment_range": _outside("sentiment", -1, 1), "reliability_range": _outside("reliability", 0, 1)},
        "fund_holding": lambda: {"weight_range": _outside("portfolio_weight", 0, 1)},
        "institutional_holding": lambda: {
            "blank_key": _blank("manager") | _blank("symbol"),
            "weight_range": _outside("portfolio_weight", 0, 1),
            "negative_aum": F.col("fund_aum") < 0,
        },
        "evidence": lambda: {
            "confidence_range": _outside("confidence", 0, 1), "lookahead": F.col("as_of") > F.col("observed_at")},
    }
    if kind not in tables:
        raise ValueError(f"no constraints for {kind!r}; known: {sorted(tables)}")
    return tables[kind]()


def watchlist_rules() -> dict[str, Column]:
    missing = F.lit(False)
    for name in WATCH_LEVELS:
        missing = missing | F.col(name).isNull()
    levels = (
        (F.col("entry_low") > F.col("entry_high"))
        | (F.col("stop") >= F.col("entry_low"))
        | (F.col("target") <= F.col("entry_high"))
        | (F.col("last_price") <= 0)
    )
    return {"missing_levels": missing, "invalid_levels": F.coalesce(levels, F.lit(False))}


def validate_watchlist(watch: DataFrame, mode: str = "fail") -> DataFrame:
    """Numeric price levels with stop < entry range < target."""
    require(watch, ("symbol", *WATCH_LEVELS), "watchlist")
    typed = watch.withColumns({name: number(name) for name in WATCH_LEVELS})
    return enforce(typed, watchlist_rules(), mode, "watchlist levels, expected stop < entry range < target")


def time_split(df: DataFrame, test_start: str, order: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """Rows before the cutoff, rows from the cutoff on; both are pushable filters."""
    cutoff = F.lit(test_start).cast(df.schema[order].dataType)
    return df.filter(F.col(order) < cutoff), df.filter(F.col(order) >= cutoff)


def order_limit_flags(
    orders: DataFrame,
    max_position_pct: float = 0.10,
    max_open_positions: int = 5,
    max_daily_loss_pct: float = 0.03,
    max_order_notional: float = 100_000.0,
) -> DataFrame:
    """First failing risk rule of each order against its account snapshot, or OK."""
    if not 0 < max_position_pct <= 1 or max_open_positions < 1:
        raise ValueError("invalid position limits")
    if not 0 < max_daily_loss_pct <= 1 or max_order_notional <= 0:
        raise ValueError("invalid loss or order limits")
    notional = F.col("quantity") * F.col("price")
    reason = (
        F.when((F.col("quantity") <= 0) | (F.col("price") <= 0), "INVALID_ORDER")
        .when(notional > max_order_notional, "ORDER_NOTIONAL_LIMIT")
        .when(~F.col("already_held") & (F.col("open_positions") >= max_open_positions), "MAX_OPEN_POSITIONS")
        .when(notional > F.col("equity") * max_position_pct, "POSITION_SIZE_LIMIT")
        .when(F.col("equity") < F.col("day_start_equity") * (1 - max_daily_loss_pct), "DAILY_LOSS_LIMIT")
        .otherwise("OK")
    )
    return orders.withColumn("reason", reason).withColumn("allowed", F.col("reason") == "OK")
