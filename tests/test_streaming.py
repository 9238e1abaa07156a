"""Each stream must end with what its batch form gives."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators.features import ledger_metrics
from tidemark.sources import sample
from tidemark.streaming import equity, intraday, news


@pytest.fixture
def ticks_dir(spark, sf_dir, tmp_path):
    """Three files of ticks in time order."""
    ticks = sample.ticks(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    for part, (a, b) in enumerate((("2024-01-01", "2024-01-10"), ("2024-01-10", "2024-01-20"), ("2024-01-20", "2024-03-01"))):
        ticks.filter((F.col("ts") >= a) & (F.col("ts") < b)).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    return str(tmp_path / "t"), ticks


def run(stream, name, mode, tmp_path, **options):
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True)
    for key, value in options.items():
        writer = getattr(writer, key)(value)
    query = (writer if "foreachBatch" in options else writer.format("memory").queryName(name)).start()
    query.awaitTermination(120)
    assert query.exception() is None


def test_tick_bars(spark, ticks_dir, tmp_path):
    path, ticks = ticks_dir
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(path)
    run(intraday.tick_bars(stream), "bars", "append", tmp_path)
    batch = intraday.tick_bars(ticks)
    # Append mode emits a bar once the watermark passes its end; the last bars stay open.
    closed = ticks.agg((F.max("ts") - F.expr("interval 10 minutes")).alias("m")).first().m
    want = {tuple(r) for r in batch.collect() if r.timestamp + dt.timedelta(minutes=5) <= closed}
    got = {tuple(r) for r in spark.table("bars").collect()}
    assert got and got == want


def test_decisions(spark, sf_dir, ticks_dir, tmp_path):
    path, ticks = ticks_dir
    held = sample.positions(spark, sf_dir)
    shape = lambda df: df.select("symbol", F.col("ts").alias("timestamp"), F.col("price").alias("close"))
    stream = shape(spark.readStream.schema(ticks.schema).parquet(path))
    run(intraday.intraday_decisions_stream(stream, held), "decisions", "complete", tmp_path)
    batch = intraday.intraday_decisions(shape(ticks), held, lookback_hours=24 * 365)
    assert {tuple(r) for r in spark.table("decisions").collect()} == {tuple(r) for r in batch.collect()}


def test_decisions_of_every_batch_have_the_lookback_and_cancel(spark, sf_dir, ticks_dir, tmp_path):
    path, ticks = ticks_dir
    held = sample.positions(spark, sf_dir)
    held = held.unionByName(held.limit(1).withColumn("symbol", F.lit("NOBAR")))
    shape = lambda df: df.select("symbol", F.col("ts").alias("timestamp"), F.col("price").alias("close"))
    stream = shape(spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(path))
    seen = []
    writer = intraday.decide_batches(held, lambda df, _: seen.append({tuple(r) for r in df.collect()}))
    run(intraday.latest_bars_stream(stream), "each", "complete", tmp_path, foreachBatch=writer)
    batch = {tuple(r) for r in intraday.intraday_decisions(shape(ticks), held).collect()}
    assert len(seen) == 3 and seen[-1] == batch
    assert ("NOBAR", None, None, "CANCEL") in batch and {r[3] for r in batch} > {"CANCEL"}


def test_no_bar_cancels_and_payload_scores(spark):
    bars = spark.createDataFrame(
        [("A", dt.datetime(2024, 1, 1, 10), 100.0, 40.0), ("B", dt.datetime(2024, 1, 1, 10), 100.0, None), ("OLD", dt.datetime(2024, 1, 1, 1), 100.0, 99.0)],
        "symbol string, timestamp timestamp, close double, score double")
    held = spark.createDataFrame([(s, 100.0, 80.0) for s in ("A", "B", "OLD")], "symbol string, entry_price double, entry_score double")
    got = {r.symbol: r.decision for r in intraday.intraday_decisions(bars, held, payload_score=True).collect()}
    assert got == {"A": "EXIT", "B": "HOLD", "OLD": "CANCEL"}
    with pytest.raises(PySparkException, match="no intraday data"):
        intraday.intraday_decisions(bars, held, payload_score=True, on_missing="fail").collect()


def test_news_dedupe(spark, sf_dir, tmp_path):
    items = sample.news(spark, sf_dir).withColumn("published_at", F.col("published_at").cast("timestamp"))
    items.write.parquet(str(tmp_path / "n"))
    stream = spark.readStream.schema(items.schema).parquet(str(tmp_path / "n"))
    run(news.dedupe_stream(stream, watermark="30 days"), "fresh", "append", tmp_path)
    title = F.md5(F.lower("title"))
    got = [r[0] for r in spark.table("fresh").select(title).collect()]
    want = [r[0] for r in news.dedupe_stream(items).select(title).collect()]
    assert len(got) == len(set(got)) and set(got) == set(want)


def arrive(spark, rows, schema, path):
    """A file that the next batch reads."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_silent_positions_are_cancelled_and_dropped(spark, tmp_path):
    at = lambda hour, minute=0: dt.datetime(2024, 1, 1, hour, minute)
    held = spark.createDataFrame([(s, 100.0, 60.0) for s in ("LIVE", "SILENT", "NEVER", "LATE")], "symbol string, entry_price double, entry_score double")
    shape, path = "symbol string, timestamp timestamp, close double", str(tmp_path / "b")
    batches = [
        [("LIVE", at(1), 101.0), ("SILENT", at(1), 95.0), ("LATE", at(2), 102.0), ("OTHER", at(2), 1.0)],
        [("LIVE", at(6), 102.0), ("LATE", at(1, 55), 50.0)],  # an older bar than the newest changes nothing
        [("LIVE", at(9, 30), 103.0)],  # SILENT is over eight hours old, LATE is not
        [("LIVE", at(9, 40), 103.0), ("SILENT", at(9, 40), 150.0), ("LATE", at(9, 35), 99.0)],  # too late for SILENT
    ]
    got = []
    for rows in batches:  # every batch is a restart from the checkpoint
        arrive(spark, rows, shape, path)
        stream = intraday.open_positions_stream(spark.readStream.schema(shape).parquet(path), held)
        run(stream, "open", "append", tmp_path, foreachBatch=lambda df, _: got.append({(r.symbol, r.decision, r.at) for r in df.collect()}))
    told = set().union(*got)
    assert ("SILENT", "CANCEL", at(9)) in told and [s for s, d, _ in told if d == "CANCEL"].count("SILENT") == 1
    assert ("SILENT", "EXIT", at(1)) in told and not any(s == "OTHER" for s, *_ in told)
    assert {s for s, d, _ in told if s == "NEVER"} == {"NEVER"} and {d for s, d, _ in told if s == "NEVER"} == {"CANCEL"}
    last = {s: d for batch in got for s, d, _ in sorted(batch, key=lambda r: r[2])}
    bars = spark.createDataFrame([r for rows in batches for r in rows if (r[0], r[1]) != ("SILENT", at(9, 40))], shape)
    assert last == {r.symbol: r.decision for r in intraday.intraday_decisions(bars, held).collect()}
    state = spark.read.format("statestore").option("stateVarName", "position").load(str(tmp_path / "c_open"))
    assert {r.key[0] for r in state.collect()} == {"LIVE", "LATE"}


def test_the_earliest_item_within_the_watermark_passes(spark, tmp_path):
    at = lambda day, hour=0: dt.datetime(2024, 1, day, hour)
    shape, path = "news_id long, title string, url string, source string, published_at timestamp", str(tmp_path / "w")
    batches = [
        [(5, "Alpha ", "u", "s", at(2)), (7, "Beta", "u", "s", at(2, 3)), (9, "Gamma", "v", None, at(2, 5))],
        [(6, "alpha", " u", "t", at(1, 20)), (3, "BETA", "u", "s", at(2, 3)), (20, "Alpha", "u", "s", at(2, 9))],  # earlier, and a tie
        [(30, "Delta", "u", "s", at(9))],
        [(31, "beta", "u", "s", at(9, 1)), (32, "Epsilon", "u", "s", at(15))],  # a key that has passed
        [(40, "End", "u", "s", at(20))],
    ]
    got = []
    for rows in batches:
        arrive(spark, rows, shape, path)
        stream = news.earliest_stream(spark.readStream.schema(shape).parquet(path))
        run(stream, "earliest", "append", tmp_path, foreachBatch=lambda df, _: got.extend(tuple(r) for r in df.collect()))
    everything = spark.createDataFrame([r for rows in batches for r in rows], shape)
    want = {tuple(r) for r in news.dedupe_stream(everything).collect() if r.news_id != 40}  # the last one still waits
    assert len(got) == len(set(got)) and set(got) == want and {r[0] for r in got} == {6, 3, 9, 30, 32}


def test_equity_state(spark, sf_dir, tmp_path):
    rows = sample.equity_snapshots(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    rows = rows.select("account", "timestamp", "seq", "equity")
    batch = ledger_metrics(rows, 1e6, ["account"], ["timestamp", "seq"], F.to_date("timestamp"))
    latest = {}

    def keep(changed, _):
        latest.update({r.account: (round(r.net_return, 9), round(r.max_drawdown, 9), r.observations) for r in changed.collect()})

    for a, b in (("2024-01-01", "2024-01-12"), ("2024-01-12", "2024-03-01")):  # the second run starts from the first one's state
        rows.filter((F.col("timestamp") >= a) & (F.col("timestamp") < b)).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))
        run(equity.equity_stream(stream, 1e6), "equity", "update", tmp_path, foreachBatch=keep)
    assert latest == {r.account: (round(r.net_return, 9), round(r.max_drawdown, 9), r.observations) for r in batch.collect()}
    # one account more: only its state is touched
    one = rows.limit(1).withColumn("account", F.lit("NEW")).withColumn("equity", F.lit(2e6))
    one.write.mode("append").parquet(str(tmp_path / "e"))
    latest.clear()
    run(equity.equity_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e")), 1e6), "equity", "update", tmp_path, foreachBatch=keep)
    assert latest == {"NEW": (1.0, 0.0, 1.0)}
    with pytest.raises(ValueError, match="positive"):
        equity.equity_stream(rows, 0.0)
