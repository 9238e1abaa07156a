"""News and disclosure operators: duplicates, event risk, keyword and fund scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip, clip_or, number
from ..functions.lineage import written
from ..functions.strings import casefold, digest, headline, iso_timestamp, strip, ticker

# These words and numbers define the scores and must stay as they are.
HYPE_PATTERN = "tavan|uçacak|roket|garanti|kesin"
BULLISH_TERMS = ("yatırım", "sözleşme", "sipariş", "kar", "kâr", "temettü", "geri alım", "ihale")
BEARISH_TERMS = ("zarar", "iflas", "dava", "soruşturma", "sermaye artırımı")
UNKNOWN_SOURCE_RELIABILITY = 0.25
FUND_FLOW_SCALE = 100_000_000.0


def first_per_key(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """First row of each key. The key is a digest, and Spark prunes to one row per key before the shuffle,
    so a text copied millions of times reaches its task as one row per input split."""
    w = Window.partitionBy("_key").orderBy(*order)
    return (
        df.withColumn("_key", key)
        .withColumn("_n", F.row_number().over(w))
        .filter(F.col("_n") == 1)
        .drop("_key", "_n")
    )


def title_url_key(folded: Column | None = None) -> Column:
    """Key of (title, url); `folded` is the title in its folded form where a column has it."""
    title = strip(casefold("title")) if folded is None else folded
    return digest(F.to_json(F.struct(title.alias("t"), strip("url").alias("u"))))


def dedupe_news(news: DataFrame, tie: str) -> DataFrame:
    """Earliest item per (folded title, url)."""
    return first_per_key(news, title_url_key(), [F.col("published_at"), F.col(tie)])


def news_fingerprint(unicode_form: bool = True) -> Column:
    """sha-256 of publication time, source and normalized headline; the url is not part of it."""
    return digest(iso_timestamp("published_at"), "source", headline("title", unicode_form))


def with_headline(news: DataFrame, unicode_form: bool = True) -> DataFrame:
    return news.withColumn("normalized_title", headline("title", unicode_form))


def with_fingerprint(news: DataFrame, unicode_form: bool = True) -> DataFrame:
    return news.withColumn("fingerprint", news_fingerprint(unicode_form))


def dedupe_fingerprint(news: DataFrame, tie: str, unicode_form: bool = True) -> DataFrame:
    """Earliest item per fingerprint."""
    return first_per_key(news, news_fingerprint(unicode_form), [F.col("published_at"), F.col(tie)])


def event_risk(events: DataFrame) -> DataFrame:
    """Discount promotional, repeated and unreliable items.

    Expects `profile_reliability` and `duplicate_count` beside the news columns and a `symbols` array.
    """
    hype = F.regexp_count(casefold("title"), F.lit(HYPE_PATTERN))
    risk = (
        (F.lit(1.0) - F.col("profile_reliability")) * 0.45
        + F.least(F.lit(0.35), F.col("duplicate_count") * F.lit(0.05))
        + F.least(F.lit(0.35), hype * F.lit(0.08))
    )
    return (
        events.withColumn("manipulation_risk", clip(risk, 0.0, 1.0))
        .withColumn("symbols", F.array_sort(F.array_distinct("symbols")))
        .withColumn("sentiment", clip("sentiment", -1.0, 1.0))
        .withColumn("reliability", clip(F.col("reliability") * F.col("profile_reliability"), 0.0, 1.0))
    )


def event_batch(events: DataFrame, profiles: DataFrame, tie: str) -> DataFrame:
    """Deduplicate by (title, url), count repeats by title alone, apply source profiles, score risk.

    The texts are read and their keys made once: one grouping keeps the first item of each (title, url) and how many there
    were, and is stored; the repeats of a title are summed over that smaller table.
    """
    folded = events.withColumn("_folded", strip(casefold("title")))
    keyed = folded.withColumns({"_title": digest("_folded"), "_key": title_url_key(F.col("_folded"))}).drop("_folded")
    reduced = written(
        keyed.groupBy("_title", "_key")
        .agg(F.min_by(F.struct(*events.columns), F.struct("published_at", tie)).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .select("_title", "_n", "_first.*")
    )
    repeats = reduced.groupBy("_title").agg((F.sum("_n") - 1).alias("duplicate_count"))
    known = profiles.select("source", F.col("reliability").alias("profile_reliability"))
    joined = (
        reduced.drop("_n")
        .join(repeats, "_title")
        .join(known, "source", "left")
        .withColumn("profile_reliability", F.coalesce("profile_reliability", F.lit(UNKNOWN_SOURCE_RELIABILITY)))
        .drop("_title")
    )
    return event_risk(joined)


def keyword_scores(rows: DataFrame, text_columns: list[str]) -> DataFrame:
    """0-100 tone per symbol: terms present minus terms present, averaged over the symbol's items."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in text_columns]))

    def present(terms: tuple[str, ...]) -> Column:
        total = F.lit(0)
        for term in terms:
            total = total + F.contains(text, F.lit(term)).cast("int")
        return total

    tone = (present(BULLISH_TERMS) - present(BEARISH_TERMS)).cast("double")
    return (
        rows.select(ticker("symbol").alias("symbol"), tone.alias("tone"))
        .filter(F.col("symbol") != "")
        .groupBy("symbol")
        .agg(clip_or(F.lit(50.0) + F.lit(12.5) * F.avg("tone"), 50.0, 0.0, 100.0).alias("event_score"))
    )


def fund_scores(rows: DataFrame, order: Column) -> DataFrame:
    """0-100 fund score per symbol: a given score, else one from net flow; the last usable row wins."""
    from_flow = F.lit(50.0) + F.lit(50.0) * F.tanh(number("net_flow") / F.lit(FUND_FLOW_SCALE))
    value = F.when(F.col("score").isNotNull(), number("score")).otherwise(from_flow)
    return (
        rows.select(ticker("symbol").alias("symbol"), clip(value, 0.0, 100.0).alias("score"), order.alias("seq"))
        .filter((F.col("symbol") != "") & F.col("score").isNotNull())
        .groupBy("symbol")
        .agg(F.max_by("score", "seq").alias("fund_score"))
    )
