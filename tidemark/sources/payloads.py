"""Shaping of provider payloads: JSON envelopes, parallel chart arrays, aliased rows, RSS items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import number
from ..functions.strings import TICKER_SUFFIX, strip
from ..operators.quality import enforce, refuse_empty
from ..schemas import PRICE_COLUMNS

RSS_SYMBOL = "^[A-Z0-9]{3,6}$"


def explode_payload(df: DataFrame, payload: str, record_schema: str) -> DataFrame:
    """One row per record of a JSON payload column.

    A bare list wins, then a `data` list, then an `items` list; anything else raises, as does a list member that
    is not an object.
    """
    text = F.col(payload)
    bare = F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>"))
    wrapped = F.from_json(text, "data string, items string")

    def member(name: str) -> Column:
        value = wrapped[name]
        return F.when(F.ltrim(value).startswith("["), F.from_json(value, "array<string>"))

    records = F.coalesce(bare, member("data"), member("items"))
    listed = enforce(df.withColumn("_records", records), {"no record list": F.col("_records").isNull()}, "fail", "payload")
    each = listed.select(*df.columns, F.explode("_records").alias("_record"))
    objects = enforce(
        each, {"record is not an object": ~F.coalesce(F.ltrim("_record").startswith("{"), F.lit(False))}, "fail", "payload"
    )
    return objects.withColumn("_r", F.from_json("_record", record_schema)).select(*df.columns, "_r.*")


def zip_chart_arrays(df: DataFrame, keep: list[str]) -> DataFrame:
    """Parallel arrays (timestamp in epoch seconds, open..volume) to bars; a row with any missing value is dropped."""
    names = ["timestamp", *PRICE_COLUMNS]
    rows = df.select(*keep, F.inline(F.arrays_zip(*names)))
    typed = rows.na.drop(subset=names)
    return typed.withColumn("timestamp", F.timestamp_seconds("timestamp"))


def provider_bars(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Provider rows (all text) to bars: `timestamp` else `date`, volume 0 when absent.

    The lenient form skips rows whose prices are not numbers, and raises when none is left; the strict form raises on
    the first of them.
    """
    stamp = F.coalesce(*[F.col(c) for c in ("timestamp", "date") if c in rows.columns])
    volume = F.coalesce(F.col("volume"), F.lit("0")) if "volume" in rows.columns else F.lit("0")
    typed = rows.withColumns({"timestamp": stamp, "volume": volume})
    convert = (lambda c: F.col(c).cast("double")) if strict else number
    bars = typed.select("symbol", "timestamp", *[convert(c).alias(c) for c in PRICE_COLUMNS])
    if strict:
        missing = F.lit(False)
        for c in PRICE_COLUMNS:
            missing = missing | F.col(c).isNull()
        return enforce(bars, {"missing price": missing}, "fail", "provider row")
    return refuse_empty(bars.na.drop(subset=list(PRICE_COLUMNS)), "provider rows hold no usable bar")


def _first(df: DataFrame, *names: str) -> Column:
    known = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*known) if known else F.lit(None).cast("string")


def symbol_universe(rows: DataFrame, seq: str) -> DataFrame:
    """Distinct normalized symbols with the position of their first appearance. No symbol at all is an error."""
    raw = F.coalesce(_first(rows, "symbol", "code", "ticker"), F.lit(""))
    symbol = F.regexp_replace(strip(F.upper(raw)), TICKER_SUFFIX, "")
    symbols = (
        rows.select(symbol.alias("symbol"), F.col(seq).alias("first_seen"))
        .filter(F.col("symbol") != "")
        .groupBy("symbol")
        .agg(F.min("first_seen").alias("first_seen"))
    )
    return refuse_empty(symbols, "no symbols")


def disclosure_alias(rows: DataFrame) -> DataFrame:
    text = lambda *names: F.coalesce(_first(rows, *names), F.lit(""))
    return rows.select(
        F.upper(text("symbol", "stockCode", "memberCode")).alias("symbol"),
        text("title", "subject").alias("title"),
        text("text", "summary").alias("text"),
        _first(rows, "published_at", "publishDate").alias("published_at"),
        _first(rows, "id", "disclosureId").alias("source_id"),
    )


def fund_flow_alias(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.upper(F.coalesce(_first(rows, "symbol", "stockCode", "ticker"), F.lit(""))).alias("symbol"),
        _first(rows, "score").alias("score"),
        F.coalesce(_first(rows, "net_flow", "netFlow"), F.lit("0")).alias("net_flow"),
        _first(rows, "id", "fundId").alias("source_id"),
    )


RSS_ITEM = "category array<string>, title string, description string, link string, pubDate string"


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Raw <item> elements of RSS files."""
    return spark.read.format("xml").option("rowTag", "item").schema(RSS_ITEM).load(path)


def parse_rss_items(df: DataFrame, xml: str, keep: list[str]) -> DataFrame:
    """Raw items from a column that holds one <item> element per row."""
    return df.select(*keep, F.from_xml(F.col(xml), RSS_ITEM).alias("_i")).select(*keep, "_i.*")


def news_rss_rows(items: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """News rows; the symbol is the first category that looks like a ticker, else ''."""
    tags = F.transform("category", lambda c: F.upper(strip(c)))
    tickers = F.filter(tags, lambda c: c.rlike(RSS_SYMBOL))
    clean = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    return items.select(
        *(keep or []),
        F.lit("rss").alias("source"),
        F.coalesce(F.try_element_at(tickers, F.lit(1)), F.lit("")).alias("symbol"),
        clean("title").alias("title"),
        clean("description").alias("description"),
        clean("link").alias("url"),
        clean("pubDate").alias("published_at"),
    )
