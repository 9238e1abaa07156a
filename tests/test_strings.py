"""Text keys against Python's own rules."""

import sys

from pyspark.sql import functions as F

from tidemark.functions.strings import casefold, strip


def test_casefold_and_strip_follow_unicode(spark):
    letters = [chr(i) for i in range(1, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    changed = [c for c in letters if c.casefold() != c or c.isspace() or c.lower() != c]
    df = spark.createDataFrame([(c, f"x{c}X") for c in changed], "c string, t string")
    got = df.select("c", "t", casefold("t").alias("f"), strip(F.concat("c", F.lit("a b"), "c")).alias("s")).collect()
    assert [r.c for r in got if r.f != r.t.casefold()] == []
    assert [r.c for r in got if r.s != f"{r.c}a b{r.c}".strip()] == []


def test_compatibility_form_makes_few_python_strings_at_a_time():
    """A batch of 26 MB becomes Python strings a MB at a time, with nulls, empty texts and a long text in place."""
    import tracemalloc

    import pyarrow as pa

    from tidemark.functions.strings import nfkc

    texts = [None, "", "\uff41" * 700_000, "\ufb01n"] + [chr(0xFF42) * k for k in range(390, 410)] * 1000 + [None]
    tracemalloc.start()
    batch = pa.array(texts)
    del texts
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    out = nfkc.func(batch)
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert out.slice(0, 4).to_pylist() == [None, "", "a" * 700_000, "fin"] and out.slice(4, 20).to_pylist() == ["b" * k for k in range(390, 410)] and out[20_004].as_py() is None
    assert peak < 8 << 20
    assert len(nfkc.func(pa.array([], pa.string()))) == 0
