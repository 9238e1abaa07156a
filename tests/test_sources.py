import datetime as dt
import json
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.sources import bars as bar_io
from tidemark.sources import feeds, ledger, payloads, sample

BAR_TEXT = "symbol,timestamp,open,high,low,close,volume\nAAA,2024-01-02T00:00:00Z,1,2,0.5,1.5,10\nAAA,2024-02-02T00:00:00Z,1,2,0.5,1.5,10\nBBB,2024-01-02T00:00:00Z,1,2,0.5,1.5,10\n"


def test_read_bars_formats(spark, tmp_path):
    (tmp_path / "b.csv").write_text(BAR_TEXT)
    csv = bar_io.read_bars(spark, str(tmp_path / "b.csv"), "csv", symbols=["AAA"], start="2024-01-01", end="2024-01-31")
    assert [(r.symbol, r.close) for r in csv.collect()] == [("AAA", 1.5)]
    full = bar_io.read_bars(spark, str(tmp_path / "b.csv"), "csv")
    for fmt in ("json", "parquet", "orc"):
        full.write.format(fmt).save(str(tmp_path / fmt))
        assert bar_io.read_bars(spark, str(tmp_path / fmt), fmt).count() == 3
    with pytest.raises(ValueError):
        bar_io.read_bars(spark, "x", "avro2")


def test_read_bars_pushes_filters_and_prunes_columns(spark, sf_dir):
    columns = {
        "symbol": F.col("l_suppkey").cast("string"), "timestamp": F.col("l_shipdate"), "open": F.col("l_extendedprice"),
        "high": F.col("l_extendedprice"), "low": F.col("l_extendedprice"), "close": F.col("l_extendedprice"), "volume": F.col("l_quantity")}
    df = bar_io.read_bars(spark, f"{sf_dir}/lineitem.parquet", start="1995-01-01", columns=columns).select("symbol", "close")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "l_quantity" not in plan


def test_payload_envelopes(spark):
    texts = ['[{"k":1},{"k":2}]', '{"data":[{"k":3}],"items":[{"k":9}]}', '{"data":"no","items":[{"k":4}]}']
    df = spark.createDataFrame([(t,) for t in texts], "payload string")
    got = sorted(r.k for r in payloads.explode_payload(df, "payload", "k int").collect())
    assert got == [1, 2, 3, 4]
    for bad, message in (('{"error":[]}', "no record list"), ("[1]", "not an object")):
        with pytest.raises(PySparkException, match=message):
            payloads.explode_payload(spark.createDataFrame([(bad,)], "payload string"), "payload", "k int").collect()


def test_chart_arrays_drop_incomplete_rows(spark):
    df = spark.createDataFrame(
        [("A", [0, 86400], [1.0, 1.0], [2.0, None], [0.5, 0.5], [1.5, 1.5], [9.0, 9.0])],
        "symbol string, timestamp array<bigint>, open array<double>, high array<double>, low array<double>, close array<double>, volume array<double>")
    got = payloads.zip_chart_arrays(df, ["symbol"]).collect()
    assert len(got) == 1 and got[0].timestamp == dt.datetime(1970, 1, 1)


def test_provider_bars_lenient_and_strict(spark):
    df = spark.createDataFrame(
        [("A", None, "2024-01-01", "1", "2", "0.5", "1.5", None), ("A", "2024-01-02", None, "x", "2", "0.5", "1.5", "3")],
        "symbol string, timestamp string, date string, open string, high string, low string, close string, volume string")
    got = payloads.provider_bars(df).collect()
    assert [(r.timestamp, r.volume) for r in got] == [("2024-01-01", 0.0)]
    with pytest.raises(PySparkException):
        payloads.provider_bars(df, strict=True).collect()


def test_records_to_bars(spark):
    df = spark.createDataFrame(
        [("A", "2024-01-01", "1", "2", "0.5", "1.5", "10"), ("A", "2024-01-02", "?", "2", "0.5", "1.5", "10")],
        "ticker string, datetime string, open string, high string, low string, close string, volume string")
    got = bar_io.records_to_bars(df).collect()
    assert len(got) == 1 and got[0].symbol == "A"
    with pytest.raises(ValueError):
        bar_io.records_to_bars(df.drop("volume"))


def test_normalize_keeps_the_last_duplicate(spark):
    schema = "symbol string, timestamp string, open double, high double, low double, close double, volume double, seq int"
    df = spark.createDataFrame([(" aaa ", "2024-01-01", 1.0, 2.0, 1.0, 1.0, 5.0, 0), ("AAA", "2024-01-01", 1.0, 2.0, 1.0, 2.0, 5.0, 1)], schema)
    got = bar_io.normalize_ohlcv(df, ["seq"]).collect()
    assert [(r.symbol, r.close) for r in got] == [("AAA", 2.0)]
    with pytest.raises(PySparkException, match="negative"):
        bar_io.normalize_ohlcv(df.withColumn("low", F.lit(-1.0)), ["seq"]).select("symbol").collect()


def test_universe_and_failures(spark):
    raw = spark.createDataFrame([(None, " thyao.is ", 0), ("ASELS", None, 1), ("asels.IS", None, 2), ("", None, 3)], "symbol string, code string, seq int")
    universe = payloads.symbol_universe(raw, "seq")
    assert [r.symbol for r in universe.orderBy("first_seen").collect()] == ["THYAO", "ASELS"]
    bars = spark.createDataFrame([("THYAO", 1.0), ("OTHER", 1.0)], "symbol string, close double")
    present, coverage = bar_io.collect_universe(bars, universe)
    assert present.count() == 1 and coverage.first().failed_symbols == 1
    with pytest.raises(PySparkException, match="no market rows"):
        bar_io.collect_universe(bars.filter("symbol = 'OTHER'"), universe)[1].collect()


def test_aliases(spark):
    rows = spark.createDataFrame([("asels", "T", "S", "2024-01-01", "7")], "stockCode string, subject string, summary string, publishDate string, disclosureId string")
    got = payloads.disclosure_alias(rows).first()
    assert (got.symbol, got.title, got.text, got.published_at, got.source_id) == ("ASELS", "T", "S", "2024-01-01", "7")
    flow = payloads.fund_flow_alias(spark.createDataFrame([("thf", None, "9")], "ticker string, score string, fundId string")).first()
    assert (flow.symbol, flow.score, flow.net_flow, flow.source_id) == ("THF", None, "0", "9")


def test_rss_files(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(
        "<rss><channel><item><category>markets today</category><category> asels </category><title> A &amp; B </title>"
        "<description>d</description><link>http://x</link><pubDate>Mon</pubDate></item>"
        "<item><category>ab</category><title>t2</title></item></channel></rss>")
    got = {r.title: r for r in payloads.news_rss_rows(payloads.read_rss(spark, str(tmp_path / "feed.xml"))).collect()}
    assert got["A & B"].symbol == "ASELS" and got["A & B"].url == "http://x"
    assert got["t2"].symbol == "" and got["t2"].description == ""


def test_feed_guard(spark):
    ok = spark.createDataFrame([("A", "2024-01-02", "2024-01-01", 1.0)], "symbol string, observed_at string, as_of string, v double")
    bad = spark.createDataFrame([("A", "2024-01-01", "2024-01-02", 1.0)], "symbol string, observed_at string, as_of string, v double")
    assert feeds.feed_normalize(ok, "flows").first().source_dataset == "flows"
    with pytest.raises(PySparkException, match="lookahead"):
        feeds.feed_normalize(bad, "flows").collect()
    with pytest.raises(ValueError):
        feeds.feed_normalize(ok.drop("symbol"), "flows")
    both = feeds.feed_snapshot({"market": ok.drop("as_of"), "flows": ok})
    assert {(r.source_dataset, r.as_of is None) for r in both.collect()} == {("market", True), ("flows", False)}
    with pytest.raises(ValueError):
        feeds.feed_snapshot({"other": ok})


def test_source_coverage(spark):
    df = spark.createDataFrame([(True, True), (False, True)], "enabled boolean, point_in_time boolean")
    assert tuple(feeds.source_coverage(df).first()) == (2, 1, 1)


def test_ledger_round_trip(spark, tmp_path):
    path = str(tmp_path / "ledger")
    signals = spark.createDataFrame([("s1", "A", 80.0, {"m": 1.0})], "signal_id string, symbol string, score double, feature_contributions map<string,double>")
    closed = spark.createDataFrame([("s1", 0.10), ("s2", 0.09)], "signal_id string, outcome_return double")
    ledger.append_ledger(ledger.as_ledger(ledger.signal_facts(signals)), path)
    ledger.append_ledger(ledger.as_ledger(ledger.outcome_facts(closed)), path)
    back = ledger.read_ledger(spark, path)
    assert tuple(ledger.ledger_summary(back).first()) == (0, 1, 2)
    assert {r.signal_id: r.hit for r in back.filter("type = 'signal_outcome'").collect()} == {"s1": True, "s2": False}
    assert back.filter("type = 'signal'").first().feature_contributions == {"m": 1.0}
    lines = [json.loads(line) for f in (tmp_path / "ledger" / "type=signal").glob("*.json") for line in f.read_text().splitlines()]
    assert lines[0]["signal_id"] == "s1"


def test_equity_and_feedback_files(spark, tmp_path):
    from tidemark.operators.features import ledger_metrics
    from tidemark.schemas import EQUITY, FEEDBACK

    path = str(tmp_path / "equity")
    for seq, value in enumerate((90.0, 120.0, 60.0)):
        one = spark.createDataFrame([("a", dt.datetime(2024, 1, 1 + seq), seq, value, 0.0, value)], EQUITY)
        ledger.append_rows(one, path, EQUITY)
    got = ledger_metrics(ledger.read_rows(spark, path, EQUITY), 100.0, ["account"], ["timestamp", "seq"], F.to_date("timestamp")).first()
    assert (round(got.net_return, 6), round(got.max_drawdown, 6)) == (-0.4, -0.5)
    notes = spark.createDataFrame([("e1", "2024-01-01", True, 0.5, 0.1, -0.1, "")], FEEDBACK)
    ledger.append_rows(notes, str(tmp_path / "feedback"), FEEDBACK)
    assert ledger.read_rows(spark, str(tmp_path / "feedback"), FEEDBACK).first().accepted
    with pytest.raises(ValueError, match="note"):
        ledger.append_rows(notes.drop("note"), path, FEEDBACK)


def test_feedback_summary(spark):
    schema = "seq int, accepted boolean, top_k_precision double, net_pnl double"
    df = spark.createDataFrame([(1, True, 0.0, 0.0), (2, True, 0.5, 1.0), (3, False, 1.0, 3.0)], schema)
    assert tuple(ledger.feedback_summary(df, [F.col("seq").desc()], limit=2).first()) == (2.0, 0.5, 0.75, 2.0)
    assert tuple(ledger.feedback_summary(df.limit(0), [F.col("seq").desc()]).first()) == (0.0, 0.0, 0.0, 0.0)


def test_sample_bars_are_valid(spark, sf_dir):
    from tidemark.operators.quality import validate_ohlcv

    bars = sample.bars(spark, sf_dir)
    assert validate_ohlcv(bars, ["timestamp"], F.year("timestamp")).count() == 0


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    path, facts = str(tmp_path / "ledger"), str(tmp_path / "facts")
    shape = "signal_id string, symbol string, score double, type string"
    assert ledger.read_batches(spark, path).count() == 0
    write, seen = ledger.ledger_writer(path), []

    def failing(batch, batch_id):
        """The second batch fails after its facts are written, as when the driver is lost before the checkpoint."""
        write(batch, batch_id)
        seen.append(batch_id)
        if seen == [0, 1]:
            raise RuntimeError("lost")

    for k in range(2):
        spark.createDataFrame([(f"s{k}{i}", "A", 1.0, "signal" if i else "experiment") for i in range(3)], shape).coalesce(1).write.mode("append").parquet(facts)
        stream = spark.readStream.schema(shape).parquet(facts).writeStream.foreachBatch(failing)
        query = stream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        if k:
            with pytest.raises(PySparkException, match="lost"):
                query.awaitTermination(60)
            query = stream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(60)
    assert seen == [0, 1, 1]
    got = ledger.read_batches(spark, path)
    assert sorted((r.batch, r.signal_id) for r in got.collect()) == [(k, f"s{k}{i}") for k in range(2) for i in range(3)]
    assert tuple(ledger.ledger_summary(got).first()) == (2, 4, 0)
    # files without a commit record are not read, and the next attempt replaces them
    torn = ledger.as_ledger(spark.createDataFrame([("torn", "signal")], "signal_id string, type string"))
    torn.write.partitionBy("type").json(f"{path}/batch=2")
    assert ledger.read_batches(spark, path).count() == 6
    whole = ledger.as_ledger(spark.createDataFrame([("whole", "signal")], "signal_id string, type string"))
    assert ledger.append_batch(whole, path, 2) and not ledger.append_batch(torn, path, 2)
    assert {r.signal_id for r in ledger.read_batches(spark, path).where("batch = 2").collect()} == {"whole"}


def test_the_order_of_files_decides_under_any_split(spark, tmp_path):
    path, day = str(tmp_path / "bars"), dt.datetime(2024, 1, 2)
    rows = [(f" s{i % 5}", day, 1.0, 2.0, 0.5, float(i), 1.0) for i in range(4000)]
    shape = "symbol string, timestamp timestamp, open double, high double, low double, close double, volume double"
    for part in range(4):  # files are read in the order of their paths
        spark.createDataFrame(rows[part * 1000 : part * 1000 + 1000], shape).coalesce(1).write.option("parquet.block.size", 4096).parquet(f"{path}/day={part}")
    results = []
    for split in ("1k", "128m"):
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            results.append({r.symbol: r.close for r in bar_io.normalize_ohlcv(bar_io.read_bars(spark, path, ingest_order=True)).collect()})
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert results == [{f"S{k}": 3995.0 + k for k in range(5)}] * 2
    with pytest.raises(ValueError, match="parquet"):
        bar_io.read_bars(spark, path, "csv", ingest_order=True)


def test_broken_files_are_skipped_and_counted(spark, tmp_path):
    path, day = tmp_path / "many", dt.datetime(2024, 1, 2)
    shape = "symbol string, timestamp timestamp, open double, high double, low double, close double, volume double"
    rows = [(s, day + dt.timedelta(days=k), 1.0, 2.0, 0.5, 1.5, 9.0) for s in "ABC" for k in range(3)]
    for _ in range(2):  # two files a symbol
        spark.createDataFrame(rows, shape).repartition(1).write.mode("append").partitionBy("symbol").parquet(str(path))
    next((path / "symbol=A").glob("part-*")).write_bytes(b"PAR1 not a parquet file PAR1")
    for file in (path / "symbol=B").glob("part-*"):
        file.write_bytes(b"PAR1")
    for crc in path.glob("symbol=*/.*.crc"):
        crc.unlink()
    bars, report = bar_io.read_tolerant(spark, str(path))
    assert {r.symbol: (r.files, r.failed_files, r.rows) for r in report.collect()} == {"A": (2, 1, 3), "B": (2, 2, 0), "C": (2, 0, 6)}
    assert sorted(r.symbol for r in bars.collect()) == list("AAACCCCCC")
    for file in path.glob("symbol=[AC]/part-*"):
        file.write_bytes(b"x")
    with pytest.raises(PySparkException, match="no market rows"):
        bar_io.read_tolerant(spark, str(path))[1].collect()


def test_files_in_ingest_order_grow_in_number_with_the_rows(spark, sf_dir, monkeypatch):
    """A task sorts one file's rows, so more rows are more files; the bars are the same."""
    from tidemark.plans import queries_ingest
    plain = sorted(map(tuple, queries_ingest.normalize_ohlcv_files(spark, sf_dir).collect()))
    monkeypatch.setattr(queries_ingest, "_FILE_ROWS", 200)
    bars = queries_ingest.normalize_ohlcv_files(spark, sf_dir)
    assert len(bars.inputFiles()) >= spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // 200
    assert sorted(map(tuple, bars.collect())) == plain


def test_rows_with_file_paths_are_reduced_before_they_are_sorted(spark, tmp_path):
    path = str(tmp_path / "ordered")
    spark.sql("select 'A' symbol, date'2024-01-02' timestamp, 1D open, 1D high, 1D low, double(id) close, 1D volume from range(100)").write.parquet(path)
    plan = bar_io.normalize_ohlcv(bar_io.read_bars(spark, path, ingest_order=True))._jdf.queryExecution().sparkPlan().toString()
    kinds = re.findall(r"(\w+Aggregate)\(", plan)
    assert kinds[-1] == "HashAggregate" and "SortAggregate" in kinds
