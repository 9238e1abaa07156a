"""Market tables derived from the star-schema sample tables.

Every table is a lazy DataFrame over the whole input, so its size follows the data. Columns named in a
``struct`` order key replace the missing input order of distributed rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.chunked import over_chunks, running
from ..functions.lineage import written
from ..operators.features import ranker_columns, ranker_features

# Declared, so that opening a table starts no job to read its footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def line_key() -> Column:
    """Unique order of line items as one fixed-width number, so that min_by/max_by stay hash aggregates.

    A struct of the four keys would order alike but turn them into sort aggregates. Line numbers are 1 to 7.
    """
    wide = "decimal(38,0)"
    line = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast(wide) * F.lit(str(10**22)).cast("decimal(23,0)")
    part = F.col("l_partkey").cast("decimal(12,0)") * F.lit(str(10**11)).cast("decimal(12,0)")
    return (line.cast(wide) + (part + F.col("l_suppkey")).cast(wide)).cast(wide)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mini-bar per line item, before any normalization; `seq` is the ingest order."""
    price = F.col("p_retailprice")
    return (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("p_brand").alias("symbol"),
            F.col("l_suppkey"),
            F.col("l_orderkey"),
            F.col("l_shipdate").cast("date").alias("timestamp"),
            price.alias("open"),
            (price * (1 + F.col("l_tax"))).alias("high"),
            (price * (1 - F.col("l_discount"))).alias("low"),
            (price * (1 + F.col("l_tax") - F.col("l_discount"))).alias("close"),
            F.col("l_quantity").alias("volume"),
            F.col("l_returnflag"),
            line_key().alias("seq"),
        )
    )


def _daily(raw: DataFrame) -> DataFrame:
    return raw.groupBy("symbol", "timestamp").agg(
        F.min_by("open", "seq").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "seq").alias("close"),
        F.sum("volume").alias("volume"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars keyed by brand."""
    return _daily(trades(spark, sf_dir))


def bars_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars keyed by supplier: many symbols, sparse days."""
    return _daily(trades(spark, sf_dir).withColumn("symbol", F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )


def fund_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly net flow per fund (customer nation); sector is the customer's region."""
    amount = (
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
        .when(F.col("o_orderstatus") == "O", -F.col("o_totalprice"))
        .otherwise(F.lit(0.0))
    )
    return (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(_nations(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(
            F.last_day(F.col("o_orderdate").cast("date")).alias("as_of"),
            F.col("n_name").alias("fund_code"),
            F.col("r_name").alias("sector"),
        )
        .agg(F.sum(amount).alias("net_flow"))
    )


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly portfolio snapshots: fund (supplier nation) x brand, with weight, AUM (partly unknown) and sector."""
    value = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(_nations(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(
            F.last_day(F.col("l_shipdate").cast("date")).alias("as_of"),
            F.col("r_name").alias("manager"),
            F.col("n_name").alias("fund_code"),
            F.col("p_brand").alias("symbol"),
        )
        .agg(F.sum("l_extendedprice").alias("v"))
    )
    total = F.sum("v").over(Window.partitionBy("as_of", "fund_code"))  # at most one row per symbol
    sector = F.when(F.col("symbol").rlike("[05]$"), F.lit("")).otherwise(
        F.concat(F.lit("SECTOR"), F.substring("symbol", -1, 1))
    )
    return value.select(
        "as_of", "manager", "fund_code", "symbol",
        (F.col("v") / total).alias("portfolio_weight"),
        F.when(~F.col("fund_code").endswith("3"), total).alias("fund_aum"),
        sector.alias("sector"),
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a news item whose headline is its whole text."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("news_id"),
        "source",
        F.expr("timestampadd(MINUTE, cast(doc_id as int), timestamp_ntz'2024-01-01 00:00:00')").alias("published_at"),
        F.col("text").alias("title"),
        F.lit("").alias("url"),
        F.concat(F.lit("Brand#"), (F.col("doc_id") % 25 + 1).cast("string")).alias("symbol"),
        ((F.col("n_chars") % 201) - 100).cast("double").__truediv__(F.lit(100.0)).alias("sentiment"),
        F.when(F.col("quality") == 1, F.lit(0.9)).when(F.col("quality") == 0, F.lit(0.4)).alias("reliability"),
    )


def source_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability per source from its labelled documents; a source with a toxic document has no profile."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return (
        docs.join(table(spark, sf_dir, "labels"), "doc_id")
        .groupBy("source")
        .agg(F.avg("quality").alias("reliability"), F.max("toxic").alias("worst"))
        .filter(F.col("worst") == 0)
        .select("source", "reliability")
    )


def broker_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = (
        F.when(F.col("l_returnflag") == "A", F.lit(" buy "))
        .when(F.col("l_returnflag") == "R", F.lit("SELL"))
        .when(F.col("l_linenumber") == 7, F.lit("no view"))
        .otherwise(F.lit("hold"))
    )
    return (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("n_name").alias("broker"), F.col("p_brand").alias("symbol"), action.alias("action"),
            F.col("l_shipdate").alias("observed_at"), line_key().alias("seq"),
        )
    )


def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(
            F.col("p_brand").alias("symbol"),
            F.year("l_shipdate").cast("string").alias("period"),
            F.last_day(F.col("l_shipdate").cast("date")).alias("observed_at"),
        )
        .agg(F.avg("l_extendedprice").alias("estimate"))
    )


def latest_closes(bars_df: DataFrame) -> DataFrame:
    return bars_df.groupBy("symbol").agg(F.max_by("close", "timestamp").alias("close"))


def watchlist(bars_df: DataFrame) -> DataFrame:
    """Price levels around the last close; brands divisible by 3 get a poor target, divisible by 5 have no row."""
    number = F.substring("symbol", 7, 9).cast("int")
    close = F.col("close")
    return (
        latest_closes(bars_df)
        .filter(number % 5 != 0)
        .select(
            "symbol",
            close.alias("last_price"),
            (close * 0.98).alias("entry_low"),
            (close * 1.01).alias("entry_high"),
            (close * F.when(number % 3 == 0, F.lit(1.03)).otherwise(F.lit(1.10))).alias("target"),
            (close * 0.95).alias("stop"),
        )
    )


def portfolios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every monthly fund snapshot as one portfolio."""
    return holdings(spark, sf_dir).select(
        F.concat_ws("@", "fund_code", F.col("as_of").cast("string")).alias("portfolio"),
        "symbol",
        F.col("portfolio_weight").alias("weight"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"),
        F.col("ts"),
        F.col("event_id"),
        (F.lit(100.0) + F.col("value")).alias("price"),
        F.lit(1.0).alias("qty"),
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One open position per tick symbol, entered at its first price."""
    return (
        table(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(F.min_by(F.lit(100.0) + F.col("value"), "event_id").alias("entry_price"))
        .select(
            F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"),
            "entry_price",
            (F.lit(50.0) + F.col("user_id") % 50).alias("entry_score"),
        )
    )


def cash_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed cash movements per account, the increments of its equity."""
    sign = (
        F.when(F.col("event_type").isin("purchase", "signup"), F.lit(1.0))
        .when(F.col("event_type") == "error", F.lit(-1.0))
        .otherwise(F.lit(0.0))
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("account"), F.col("ts").alias("timestamp"),
        F.col("event_id").alias("seq"), (F.col("value") * sign).alias("move"),
    )


def order_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders joined to the account state they are checked against."""
    equity = F.lit(500000.0) + F.lit(50.0) * F.col("c_acctbal")
    return (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("order_id"),
            F.when(F.col("o_orderkey") % 11 == 0, F.lit(-1.0)).otherwise(F.lit(1.0)).alias("quantity"),
            F.col("o_totalprice").alias("price"),
            equity.alias("equity"),
            (equity * (F.lit(1.0) + (F.col("o_custkey") % 5) * F.lit(0.01))).alias("day_start_equity"),
            (F.col("o_custkey") % 7).cast("int").alias("open_positions"),
            (F.col("o_orderkey") % 4 == 0).alias("already_held"),
        )
    )


def equity_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equity of each account after every movement; running sums are split by day."""
    moves = cash_moves(spark, sf_dir)
    summed = running(moves, ["account"], ["timestamp", "seq"], F.to_date("timestamp"), {"_sum": ("sum", "move")})
    return summed.select("account", "timestamp", "seq", (F.lit(1_000_000.0) + F.col("_sum")).alias("equity"))


def stored_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as a written table, for operators that read their input several times (rims and carries of chunks)."""
    return written(bars(spark, sf_dir))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored bars with the damped return to the next bar; `actual` marks a move of a quarter percent."""

    def scored(df: DataFrame, w: WindowSpec) -> DataFrame:
        move = F.lit(0.05) * (F.lead("close").over(w) / F.col("close") - 1)
        return ranker_columns(df, w).withColumn("future_return", move)

    rows = over_chunks(
        stored_bars(spark, sf_dir), ["symbol"], ["timestamp"], F.year("timestamp"), scored,
        before=20, after=1, needs=["close", "high", "volume"],
    )
    return rows.filter(F.col("future_return").isNotNull()).select(
        "symbol", "timestamp", (F.col("score") / 100).alias("score"), "future_return",
        (F.col("future_return") >= 0.0025).alias("actual"),
    )


def stored_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions as a written table, for metrics that read them several times."""
    return written(predictions(spark, sf_dir))


def signals(bars_df: DataFrame) -> DataFrame:
    """One attributed signal per bar: its score split over momentum, volume and breakout."""
    scored = ranker_features(bars_df)
    parts = F.map_from_arrays(
        F.array(F.lit("momentum"), F.lit("volume"), F.lit("breakout")),
        F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in ("ret_5", "volume_ratio", "breakout")]),
    )
    return scored.select(
        F.concat_ws("@", "symbol", F.col("timestamp").cast("string")).alias("signal_id"),
        "symbol", F.col("timestamp").cast("string").alias("timestamp"), "score", parts.alias("feature_contributions"),
    )


def outcomes(predictions_df: DataFrame) -> DataFrame:
    return predictions_df.select(
        F.concat_ws("@", "symbol", F.col("timestamp").cast("string")).alias("signal_id"),
        F.col("future_return").alias("outcome_return"),
    )


def stored_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdings as a written table, for plans that read them several times."""
    return written(holdings(spark, sf_dir))
