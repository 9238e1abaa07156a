"""Registered news and text queries. Headlines are whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import news as ops
from ..sources import sample
from .domain_sql import day, fold_sql, moment, r6, strip_sql
from .registry import query

_HEAD = strip_sql(
    "regexp_replace(regexp_replace(regexp_replace({0}, 'https?://[^\\s]+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')"
).format(fold_sql("title"))
_KEY = f"{strip_sql(fold_sql('title'))}, trim(url)"


@query("dedupe_news", tables=("news",), sql=f"""
SELECT news_id, source, {moment('published_at')} AS published_at, md5(title) AS title_md5 FROM news
QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY published_at, news_id) = 1""")
def dedupe_news(spark: SparkSession, d: str) -> DataFrame:
    kept = ops.dedupe_news(sample.news(spark, d), "news_id")
    return kept.select("news_id", "source", "published_at", F.md5("title").alias("title_md5"))


def _wide(news: DataFrame) -> DataFrame:
    """Titles with some letters in their full-width form, which the compatibility form takes back."""
    return news.withColumn("title", F.translate("title", "aeinsthr", "ａｅｉｎｓｔｈｒ"))


@query("normalize_title", tables=("news",), sql=f"SELECT news_id, {_HEAD} AS normalized_title FROM news")
def normalize_title(spark: SparkSession, d: str) -> DataFrame:
    return ops.with_headline(_wide(sample.news(spark, d))).select("news_id", "normalized_title")


@query("normalize_title_folded", tables=("news",), sql=f"SELECT news_id, {_HEAD} AS normalized_title FROM news")
def normalize_title_folded(spark: SparkSession, d: str) -> DataFrame:
    return ops.with_headline(sample.news(spark, d), unicode_form=False).select("news_id", "normalized_title")


@query("news_fingerprint", tables=("news",), sql=f"""
SELECT news_id, sha256(strftime(published_at, '%Y-%m-%dT%H:%M:%S') || '|' || source || '|' || {_HEAD}) AS fingerprint FROM news""")
def news_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return ops.with_fingerprint(_wide(sample.news(spark, d))).select("news_id", "fingerprint")


@query("dedupe_fingerprint", tables=("news",), sql=f"""
, n AS (SELECT *, date_trunc('day', published_at) AS stamp FROM news)
SELECT news_id, source, {day('stamp')} AS published_on FROM n
QUALIFY row_number() OVER (PARTITION BY stamp, {_HEAD} ORDER BY news_id) = 1""")
def dedupe_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    # Daily stamps and one feed name, so that copies of a text on one day share a fingerprint.
    news = sample.news(spark, d).select(
        "news_id", F.col("source").alias("outlet"), F.lit("wire").alias("source"), "title",
        F.col("published_at").cast("date").cast("timestamp_ntz").alias("published_at"))
    kept = ops.dedupe_fingerprint(_wide(news), "news_id")
    return kept.select("news_id", F.col("outlet").alias("source"), F.to_date("published_at").alias("published_on"))


_RISK_SQL = f"""
round_even(least(1.0, greatest(0.0, (1.0 - profile_reliability) * 0.45::DOUBLE + least(0.35::DOUBLE, duplicate_count * 0.05::DOUBLE)
  + least(0.35::DOUBLE, len(regexp_extract_all({fold_sql('title')}, 'tavan|uçacak|roket|garanti|kesin')) * 0.08::DOUBLE))), 6) AS manipulation_risk,
round_even(least(1.0, greatest(-1.0, sentiment)), 6) AS sentiment,
round_even(least(1.0, greatest(0.0, coalesce(reliability, 0.5::DOUBLE) * profile_reliability)), 6) AS reliability"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    news = sample.news(spark, d)
    return news.withColumns({
        "symbols": F.array("symbol", F.lit("INDEX"), "symbol"), "reliability": F.coalesce("reliability", F.lit(0.5))})


@query("event_risk", tables=("news",), sql=f"""
, e AS (SELECT *, 0.7::DOUBLE AS profile_reliability, news_id % 9 AS duplicate_count FROM news)
SELECT news_id, symbol || ',INDEX' AS symbols, {_RISK_SQL} FROM e""")
def event_risk(spark: SparkSession, d: str) -> DataFrame:
    events = _events(spark, d).withColumns({"profile_reliability": F.lit(0.7), "duplicate_count": F.col("news_id") % 9})
    return ops.event_risk(events).select("news_id", "symbols", "manipulation_risk", "sentiment", "reliability")


@query("event_batch", tables=("news", "source_profiles"), sql=f"""
, c AS (SELECT *, count(*) OVER (PARTITION BY {strip_sql(fold_sql('title'))}) - 1 AS duplicate_count FROM news),
   u AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY published_at, news_id) = 1),
   e AS (SELECT u.*, coalesce(p.reliability, 0.25::DOUBLE) AS profile_reliability FROM u LEFT JOIN source_profiles p ON u.source = p.source)
SELECT news_id, source, duplicate_count, symbol || ',INDEX' AS symbols, {_RISK_SQL} FROM e""")
def event_batch(spark: SparkSession, d: str) -> DataFrame:
    batch = ops.event_batch(_events(spark, d), sample.source_profiles(spark, d), "news_id")
    return batch.select(
        "news_id", "source", "duplicate_count", "symbols", "manipulation_risk", "sentiment", "reliability")


def _present(terms: tuple[str, ...]) -> str:
    return " + ".join(f"CAST(contains(txt, '{t}') AS INT)" for t in terms)


@query("keyword_scores", tables=("news",), sql=f"""
, t AS (SELECT CASE WHEN source = 'src0' THEN '' ELSE upper(symbol) END AS symbol, lower(source || ' ' || title) AS txt FROM news)
SELECT symbol, {r6(f"least(100.0, greatest(0.0, 50 + 12.5 * avg(({_present(ops.BULLISH_TERMS)}) - ({_present(ops.BEARISH_TERMS)}))))")} AS event_score
FROM t WHERE symbol <> '' GROUP BY symbol""")
def keyword_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = sample.news(spark, d).withColumn(
        "symbol", F.when(F.col("source") != "src0", F.concat(F.lit(" "), F.lower("symbol"), F.lit(".is "))))
    return ops.keyword_scores(rows, ["source", "title"])


@query("fund_scores", sql=f"""
, r AS (SELECT upper(n_name) AS symbol, row(o_orderdate, o_orderkey) AS seq,
               CASE WHEN o_orderpriority LIKE '1%' THEN NULL
                    WHEN o_orderpriority LIKE '2%' THEN least(100.0, greatest(0.0, floor(o_totalprice / 2000)))
                    WHEN o_orderpriority LIKE '5%' THEN NULL
                    ELSE 50 + 50 * tanh(floor(o_totalprice) * 1000 / 100000000.0::DOUBLE) END AS score
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT symbol, {r6('max_by(score, seq)')} AS fund_score FROM r WHERE score IS NOT NULL GROUP BY symbol""")
def fund_scores(spark: SparkSession, d: str) -> DataFrame:
    priority, price = F.col("o_orderpriority"), F.col("o_totalprice")
    rows = (
        sample.table(spark, d, "orders")
        .join(sample.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(sample.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat(F.lit(" "), F.lower("n_name"), F.lit(".is ")).alias("symbol"),
            F.when(priority.startswith("1"), F.lit("n/a"))
            .when(priority.startswith("2"), F.floor(price / 2000).cast("string")).alias("score"),
            F.when(priority.startswith("5"), F.lit("bad")).otherwise((F.floor(price) * 1000).cast("string")).alias("net_flow"),
            "o_orderdate", "o_orderkey",
        )
    )
    return ops.fund_scores(rows, F.struct("o_orderdate", "o_orderkey"))
