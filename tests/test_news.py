import datetime as dt
import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidemark.operators import news as ops

T0 = dt.datetime(2024, 1, 1, 9)
NEWS = "id int, source string, published_at timestamp_ntz, title string, url string, symbols array<string>, sentiment double, reliability double"


def items(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], NEWS)


def test_same_title_other_url(spark):
    df = items(spark, ("s", T0, "Big  News!", "u1", ["A"], 0.1, 0.5), ("s", T0, "big news", "u2", ["A"], 0.1, 0.5),
               ("s", T0, " BIG  NEWS! ", "u1", ["A"], 0.1, 0.5))
    assert sorted(r.id for r in ops.dedupe_news(df, "id").collect()) == [0, 1]
    assert [r.id for r in ops.dedupe_fingerprint(df, "id").collect()] == [0]


def test_headline_matches_python(spark):
    titles = ["ﬁrst “Quote” https://x.y/z?q=1 end", "Straße 10%\t\nÇOK İyi", "  a_b—c  ", "½ ١٢ é́"]
    df = spark.createDataFrame([(t,) for t in titles], "title string")

    def reference(text):
        text = unicodedata.normalize("NFKC", text).casefold()
        text = re.sub(r"[^\w\s]", " ", re.sub(r"https?://\S+", " ", text))
        return re.sub(r"\s+", " ", text).strip()

    got = [r.normalized_title for r in ops.with_headline(df).collect()]
    assert got == [reference(t) for t in titles]


def test_fingerprint_format(spark):
    df = items(spark, ("s", T0, "Hello, World", "u", ["A"], 0.0, 0.5), ("s", T0.replace(microsecond=1500), "x", "u", ["A"], 0.0, 0.5))
    got = [r.fingerprint for r in ops.with_fingerprint(df).orderBy("id").collect()]
    want = [hashlib.sha256(s.encode()).hexdigest() for s in ("2024-01-01T09:00:00|s|hello world", "2024-01-01T09:00:00.001500|s|x")]
    assert got == want


def test_hype_and_copies_raise_risk(spark):
    df = items(spark, ("social", T0, "TAVAN garanti roket", "u1", ["B", "A", "A"], 2.0, 0.8),
               ("social", T0, "TAVAN garanti roket", "u2", ["A"], 0.2, 0.8), ("wire", T0, "calm", "u3", ["A"], 0.2, 0.8))
    profiles = spark.createDataFrame([("social", 0.4)], "source string, reliability double")
    got = {r.id: r for r in ops.event_batch(df, profiles, "id").collect()}
    assert len(got) == 3
    assert got[0].manipulation_risk == pytest.approx(0.6 * 0.45 + 0.05 + 0.24)
    assert got[0].reliability == pytest.approx(0.32) and got[0].sentiment == 1.0 and got[0].symbols == ["A", "B"]
    assert got[2].manipulation_risk == pytest.approx(0.75 * 0.45) and got[2].reliability == pytest.approx(0.2)


def test_risk_parts_are_capped(spark):
    df = items(spark, ("s", T0, "roket " * 20, "u", ["A"], 0.0, 0.5)).withColumns(
        {"profile_reliability": F.lit(0.0), "duplicate_count": F.lit(100)})
    assert ops.event_risk(df).first().manipulation_risk == pytest.approx(1.0)


def test_keyword_scores_count_presence(spark, rows):
    df = spark.createDataFrame(
        [("aaa.is", "kar kar kar", None), (" AAA", "dava", "zarar"), ("", "kar", "x"), ("BBB", "YATIRIM ihale", "")],
        "symbol string, title string, text string")
    got = rows(ops.keyword_scores(df, ["title", "text"]))
    assert set(got) == {"AAA", "BBB"}
    assert got["AAA"]["event_score"] == pytest.approx(50 + 12.5 * (1 - 2) / 2)


def test_fund_scores_last_usable_row_wins(spark, rows):
    df = spark.createDataFrame(
        [("a.is", "80", None, 1), ("A", None, "bad", 2), ("B", None, "100000000", 1), ("B", "x", None, 2), ("C", "150", None, 1), ("", "1", None, 1)],
        "symbol string, score string, net_flow string, seq int")
    got = rows(ops.fund_scores(df, F.col("seq")))
    assert {k: round(v["fund_score"], 4) for k, v in got.items()} == {"A": 80.0, "B": 88.0797, "C": 100.0}


def test_copies_are_pruned_before_the_shuffle(spark):
    df = items(spark, ("s", T0, "t", "u", ["A"], 0.0, 0.5))
    plan = ops.dedupe_news(df, "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")
