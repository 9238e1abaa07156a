"""Registered source, payload, feed and ledger queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sources import bars as bar_io
from ..sources import feeds, ledger, payloads, sample
from .domain_sql import day, moment, r6, strip_sql
from .registry import query

_PRICES = "open high low close volume".split()
_FILES, _FILE_ROWS = 12, 1_000_000  # ingest files: so many at least, and no more rows in one, which a task sorts


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return sample.table(spark, d, "lineitem")


@query("read_bars", sql=f"""
SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS symbol, {moment('l_shipdate')} AS timestamp,
       {r6('l_extendedprice')} AS open, {r6('l_extendedprice * (1 + l_tax)')} AS high,
       {r6('l_extendedprice * (1 - l_discount)')} AS low, {r6('l_extendedprice')} AS close, {r6('l_quantity')} AS volume
FROM lineitem WHERE l_shipdate BETWEEN timestamp '1990-01-01' AND timestamp '2030-12-31'""")
def read_bars(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("l_extendedprice")
    columns = {
        "symbol": F.concat(F.lit("S"), F.col("l_suppkey").cast("string")), "timestamp": F.col("l_shipdate"),
        "open": price, "high": price * (1 + F.col("l_tax")), "low": price * (1 - F.col("l_discount")),
        "close": price, "volume": F.col("l_quantity"),
    }
    return bar_io.read_bars(spark, f"{d}/lineitem.parquet", start="1990-01-01", end="2030-12-31", columns=columns)


@query("explode_payload", sql="SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def explode_payload(spark: SparkSession, d: str) -> DataFrame:
    props, kind = F.col("props"), F.col("event_type")
    payload = (
        F.when(kind.isin("view", "click"), F.concat(F.lit("["), props, F.lit("]")))
        .when(kind == "error", F.concat(F.lit('{"items":['), props, F.lit('],"data":"none"}')))
        .otherwise(F.concat(F.lit('{"data":['), props, F.lit('],"items":[]}')))
    )
    rows = sample.table(spark, d, "events").select("event_id", payload.alias("payload"))
    return payloads.explode_payload(rows, "payload", "k bigint").drop("payload")


@query("zip_chart_arrays", sql=f"""
, two AS (SELECT *, unnest([0, 1]) AS step FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {moment('l_shipdate + to_days(step)')} AS timestamp,
       {r6('l_extendedprice')} AS open, {r6('l_extendedprice * (1 + l_tax)')} AS high,
       {r6('l_extendedprice * (1 - l_discount)')} AS low, {r6('l_extendedprice + step')} AS close, {r6('l_quantity')} AS volume
FROM two WHERE NOT (step = 1 AND l_returnflag = 'N')""")
def zip_chart_arrays(spark: SparkSession, d: str) -> DataFrame:
    price, stamp = F.col("l_extendedprice"), F.unix_seconds(F.col("l_shipdate").cast("timestamp"))
    keep = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    gap = F.when(F.col("l_returnflag") != "N", price * (1 - F.col("l_discount")))
    charts = _lines(spark, d).select(
        *keep,
        F.array(stamp, stamp + 86400).alias("timestamp"),
        F.array(price, price).alias("open"),
        F.array(price * (1 + F.col("l_tax")), price * (1 + F.col("l_tax"))).alias("high"),
        F.array(price * (1 - F.col("l_discount")), gap).alias("low"),
        F.array(price, price + 1).alias("close"),
        F.array("l_quantity", "l_quantity").alias("volume"),
    )
    return payloads.zip_chart_arrays(charts, keep)


@query("provider_bars", sql=f"""
SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS symbol, {day('l_shipdate')} AS timestamp,
       {r6('l_extendedprice')} AS open, {r6('l_extendedprice * (1 + l_tax)')} AS high,
       {r6('l_extendedprice * (1 - l_discount)')} AS low, {r6('l_extendedprice')} AS close,
       {r6("CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END")} AS volume
FROM lineitem WHERE NOT (l_linestatus = 'F' AND l_tax = 0)""")
def provider_bars(spark: SparkSession, d: str) -> DataFrame:
    price, shipped = F.col("l_extendedprice"), F.date_format("l_shipdate", "yyyy-MM-dd")
    text = lambda c: c.cast("string")
    rows = _lines(spark, d).select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"),
        F.when(F.col("l_returnflag") == "A", shipped).alias("timestamp"),
        shipped.alias("date"),
        F.when((F.col("l_linestatus") == "F") & (F.col("l_tax") == 0), F.lit("n/a")).otherwise(text(price)).alias("open"),
        text(price * (1 + F.col("l_tax"))).alias("high"),
        text(price * (1 - F.col("l_discount"))).alias("low"),
        text(price).alias("close"),
        F.when(F.col("l_returnflag") != "R", text(F.col("l_quantity"))).alias("volume"),
    )
    return payloads.provider_bars(rows)


@query("records_to_bars", tables=("trades",), sql=f"""
SELECT symbol, {day('timestamp')} AS timestamp, {', '.join(f'{r6(c)} AS {c}' for c in _PRICES)}
FROM trades WHERE l_returnflag <> 'N'""")
def records_to_bars(spark: SparkSession, d: str) -> DataFrame:
    raw = sample.trades(spark, d)
    records = raw.select(
        F.col("symbol").alias("ticker"),
        F.col("timestamp").alias("time"),
        *[F.col(c).cast("string").alias(c) for c in _PRICES[:-1]],
        F.when(F.col("l_returnflag") == "N", F.lit("-")).otherwise(F.col("volume").cast("string")).alias("volume"),
    )
    return bar_io.records_to_bars(records)


@query("normalize_ohlcv", tables=("trades",), sql=f"""
SELECT upper(symbol) AS symbol, {day('timestamp')} AS timestamp, {', '.join(f'{r6(c)} AS {c}' for c in _PRICES)}
FROM trades QUALIFY row_number() OVER (PARTITION BY symbol, timestamp ORDER BY seq DESC) = 1""")
def normalize_ohlcv(spark: SparkSession, d: str) -> DataFrame:
    raw = sample.trades(spark, d).withColumn("symbol", F.concat(F.lit(" \t"), F.lower("symbol"), F.lit("\n")))
    return bar_io.normalize_ohlcv(raw, ["seq"])


@query("normalize_ohlcv_files", tables=("trades",), sql=f"""
SELECT upper(symbol) AS symbol, {day('timestamp')} AS timestamp, {', '.join(f'{r6(c)} AS {c}' for c in _PRICES)}
FROM trades QUALIFY row_number() OVER (PARTITION BY symbol, timestamp ORDER BY seq DESC) = 1""")
def normalize_ohlcv_files(spark: SparkSession, d: str) -> DataFrame:
    """Files in ingest order and rows in it inside each, without a column that tells so."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/bars/{uuid.uuid4().hex}"
    files = max(_FILES, -(-_lines(spark, d).count() // _FILE_ROWS))
    sample.trades(spark, d).repartitionByRange(files, "seq").sortWithinPartitions("seq").drop("seq").write.parquet(path)
    return bar_io.normalize_ohlcv(bar_io.read_bars(spark, path, ingest_order=True))


@query("read_tolerant", tables=("bars",), sql="""
SELECT symbol, 1 AS files, 0 AS failed_files, count(*) AS rows FROM bars GROUP BY symbol UNION ALL SELECT 'BROKEN', 1, 1, 0""")
def read_tolerant(spark: SparkSession, d: str) -> DataFrame:
    """A file a symbol, and one that is no parquet file."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/bars/{uuid.uuid4().hex}"
    sample.bars(spark, d).withColumn("timestamp", F.col("timestamp").cast("timestamp")).repartition("symbol").write.partitionBy("symbol").parquet(path)
    spark.createDataFrame([("no bars",)], "value string").coalesce(1).write.text(f"{path}/symbol=BROKEN")
    return bar_io.read_tolerant(spark, path)[1]


@query("symbol_universe", sql=f"""
, s AS (SELECT regexp_replace({strip_sql("upper(coalesce(CASE WHEN p_size % 3 = 1 THEN ' ' || p_brand || ' ' END, CASE WHEN p_size % 3 = 2 THEN p_brand || '.is ' END, p_type))")}, '\\.IS$', '') AS symbol, p_partkey
        FROM part)
SELECT symbol, min(p_partkey) AS first_seen FROM s WHERE symbol <> '' GROUP BY symbol""")
def symbol_universe(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size") % 3
    rows = sample.table(spark, d, "part").select(
        F.when(size == 1, F.concat(F.lit(" "), "p_brand", F.lit(" "))).alias("symbol"),
        F.when(size == 2, F.concat("p_brand", F.lit(".is "))).alias("code"),
        F.col("p_type").alias("ticker"),
        "p_partkey",
    )
    return payloads.symbol_universe(rows, "p_partkey")


@query("disclosure_alias", sql=f"""
SELECT upper(source) AS symbol, lang AS title, text, {day("timestamp '2024-01-01' + to_days(CAST(doc_id % 28 AS INT))")} AS published_at,
       CAST(doc_id AS VARCHAR) AS source_id FROM documents""")
def disclosure_alias(spark: SparkSession, d: str) -> DataFrame:
    rows = sample.table(spark, d, "documents").select(
        F.when(F.col("lang") == "en", F.col("source")).alias("stockCode"),
        F.col("source").alias("memberCode"),
        F.col("lang").alias("subject"),
        F.col("text").alias("summary"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 28).cast("int")), "yyyy-MM-dd").alias("publishDate"),
        F.col("doc_id").cast("string").alias("disclosureId"),
    )
    return payloads.disclosure_alias(rows)


@query("fund_flow_alias", sql="""
SELECT upper(o_orderstatus) AS symbol, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS score,
       CASE WHEN o_orderstatus = 'F' THEN '0' ELSE CAST(o_custkey AS VARCHAR) END AS net_flow,
       CAST(o_orderkey AS VARCHAR) AS source_id FROM orders""")
def fund_flow_alias(spark: SparkSession, d: str) -> DataFrame:
    status = F.col("o_orderstatus")
    rows = sample.table(spark, d, "orders").select(
        F.lower(status).alias("stockCode"),
        F.when(status == "P", F.col("o_orderpriority")).alias("score"),
        F.when(status != "F", F.col("o_custkey").cast("string")).alias("netFlow"),
        F.col("o_orderkey").cast("string").alias("fundId"),
    )
    return payloads.fund_flow_alias(rows)


@query("news_rss_rows", sql="""
SELECT page_id, 'rss' AS source, CASE WHEN page_id % 4 = 0 THEN '' ELSE 'P' || CAST(page_id % 90 + 10 AS VARCHAR) END AS symbol,
       url AS title, '' AS description, url, 'page ' || CAST(page_id AS VARCHAR) AS published_at
FROM pages""")
def news_rss_rows(spark: SparkSession, d: str) -> DataFrame:
    safe = F.replace(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    tag = F.when(F.col("page_id") % 4 == 0, F.lit("no-ticker")).otherwise(
        F.concat(F.lit(" p"), (F.col("page_id") % 90 + 10).cast("string"), F.lit(" "))
    )
    xml = F.concat(
        F.lit("<item><category>market news</category><category>"), tag, F.lit("</category><title> "), safe,
        F.lit(" </title><link>"), safe, F.lit("</link><pubDate>page "), F.col("page_id").cast("string"),
        F.lit("</pubDate></item>"),
    )
    items = payloads.parse_rss_items(sample.table(spark, d, "pages").select("page_id", xml.alias("xml")), "xml", ["page_id"])
    return payloads.news_rss_rows(items, ["page_id"])


@query("feed_normalize", sql=f"""
SELECT 'C' || CAST(o_custkey AS VARCHAR) AS symbol, {moment('l_shipdate')} AS observed_at, {moment('o_orderdate')} AS as_of,
       {r6('l_extendedprice')} AS value, o_orderdate > l_shipdate AS lookahead, 'transactions' AS source_dataset
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def feed_normalize(spark: SparkSession, d: str) -> DataFrame:
    records = _lines(spark, d).join(sample.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    records = records.select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"),
        F.col("l_shipdate").alias("observed_at"), F.col("o_orderdate").alias("as_of"),
        F.col("l_extendedprice").alias("value"),
    )
    return feeds.feed_normalize(records, "transactions", mode="quarantine")


@query("feed_snapshot", tables=("bars", "estimates", "holdings", "fund_flows", "news"), per_column={"net_flow": 2}, sql=f"""
, u AS (SELECT symbol, timestamp AS observed_at, NULL AS as_of, close AS value, 'market' AS source_dataset FROM bars
        UNION ALL SELECT symbol, observed_at, NULL, estimate, 'estimates' FROM estimates
        UNION ALL SELECT symbol, as_of, as_of, portfolio_weight, 'holdings' FROM holdings
        UNION ALL SELECT fund_code, as_of, as_of, net_flow, 'flows' FROM fund_flows
        UNION ALL SELECT symbol, CAST(published_at AS DATE), NULL, sentiment, 'research' FROM news)
SELECT symbol, {day('observed_at')} AS observed_at, {day('CAST(as_of AS DATE)')} AS as_of, {r6('value', 4)} AS value, source_dataset FROM u""",
       digits=4)
def feed_snapshot(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda df, symbol, observed, value: df.select(
        F.col(symbol).alias("symbol"), F.col(observed).cast("date").alias("observed_at"), F.col(value).alias("value"))
    dated = lambda df: df.withColumn("as_of", F.col("observed_at"))
    snapshot = feeds.feed_snapshot({
        "market": pick(sample.bars(spark, d), "symbol", "timestamp", "close"),
        "estimates": pick(sample.estimates(spark, d), "symbol", "observed_at", "estimate"),
        "holdings": dated(pick(sample.holdings(spark, d), "symbol", "as_of", "portfolio_weight")),
        "flows": dated(pick(sample.fund_flows(spark, d), "fund_code", "as_of", "net_flow")),
        "research": pick(sample.news(spark, d), "symbol", "published_at", "sentiment"),
    })
    return snapshot.select("symbol", "observed_at", "as_of", "value", "source_dataset")


@query("append_ledger", tables=("predictions",), sql=f"""
SELECT 'signal_outcome' AS type, symbol || '@' || {day('timestamp')} AS signal_id, {r6('future_return')} AS outcome_return,
       future_return >= 0.0025 AS hit FROM predictions""")
def append_ledger(spark: SparkSession, d: str) -> DataFrame:
    facts = ledger.outcome_facts(sample.outcomes(sample.predictions(spark, d)), hit_threshold=0.0025)
    path = f"{checkpoint_dir(spark).rstrip('/')}/ledgers/{uuid.uuid4().hex}"
    ledger.append_ledger(ledger.as_ledger(facts), path)
    return ledger.read_ledger(spark, path).select("type", "signal_id", "outcome_return", "hit")


@query("ledger_summary", tables=("bars", "predictions"), sql="""
SELECT (SELECT count(*) FROM benchmark) AS experiments, (SELECT count(*) FROM bars) AS signals,
       (SELECT count(*) FROM predictions) AS outcomes""")
def ledger_summary(spark: SparkSession, d: str) -> DataFrame:
    experiments = sample.table(spark, d, "benchmark").select(
        F.col("item_id").cast("string").alias("experiment_id"), F.col("text").alias("hypothesis"))
    return ledger.ledger_summary(ledger.as_ledger(
        ledger.experiment_facts(experiments),
        ledger.signal_facts(sample.signals(sample.bars(spark, d))),
        ledger.outcome_facts(sample.outcomes(sample.predictions(spark, d))),
    ))


@query("feedback_summary", sql=f"""
, r AS (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500)
SELECT CAST(count(*) AS DOUBLE) AS experiments, {r6("avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END)")} AS acceptance_rate,
       {r6('avg((o_custkey % 100) / 100.0::DOUBLE)')} AS mean_precision, {r6('avg(o_totalprice / 100000.0::DOUBLE)')} AS mean_pnl
FROM r""")
def feedback_summary(spark: SparkSession, d: str) -> DataFrame:
    feedback = sample.table(spark, d, "orders").select(
        "o_orderdate", "o_orderkey", (F.col("o_orderstatus") == "F").alias("accepted"),
        ((F.col("o_custkey") % 100) / 100.0).alias("top_k_precision"), (F.col("o_totalprice") / 100000.0).alias("net_pnl"),
    )
    return ledger.feedback_summary(feedback, [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])


@query("source_coverage", sql="""
SELECT count(*) AS discovered, count(*) FILTER (url LIKE 'https%') AS enabled,
       count(*) FILTER (url LIKE 'https%' AND contains(html, '<article>')) AS point_in_time_ready FROM pages""")
def source_coverage(spark: SparkSession, d: str) -> DataFrame:
    return feeds.source_coverage(sample.table(spark, d, "pages").select(
        F.col("url").startswith("https").alias("enabled"), F.contains("html", F.lit("<article>")).alias("point_in_time")))


@query("collect_universe", tables=("bars",), sql="""
, u AS (SELECT DISTINCT p_brand AS symbol FROM part UNION SELECT n_name FROM nation),
   c AS (SELECT u.symbol, count(b.symbol) AS n FROM u LEFT JOIN bars b ON b.symbol = u.symbol GROUP BY u.symbol)
SELECT count(*) AS universe, CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (n = 0) AS failed_symbols FROM c""")
def collect_universe(spark: SparkSession, d: str) -> DataFrame:
    universe = sample.table(spark, d, "part").select(F.col("p_brand").alias("symbol")).union(
        sample.table(spark, d, "nation").select("n_name"))
    return bar_io.collect_universe(sample.bars(spark, d), universe)[1]
