"""Distances between sources against plain sums over all terms."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm.divergence import source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, min_docs, top=50):
    """rows of (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    out = []
    for lang in {r[1] for r in rows}:
        mine = [(TERM.findall(t.translate(UPPER)), s) for t, g, s in rows if g == lang]
        docs = collections.Counter(w for t, _ in mine for w in set(t))
        kept = [w for w in docs if docs[w] >= min_docs]

        def shares(of, kept=kept):
            n = collections.Counter(w for t in of for w in t)
            total = sum(n[w] for w in kept)
            return n, {w: 1 + 10**9 * (n[w] + 5) // (total + 5 * len(kept)) for w in kept}

        whole = shares([t for t, _ in mine])[1]
        groups = {s: shares([t for t, x in mine if x == s]) for s in {s for _, s in mine}}
        for s, (n, p) in groups.items():
            pairs = [(o, sum(abs(p[w] - q[w]) for w in kept)) for o, (_, q) in groups.items() if o != s]
            marks = [(w, p[w] - whole[w]) for w in kept if n[w] and p[w] > whole[w]]
            for part, items in (("pair", pairs), ("term", marks)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)


def result(docs, **options):
    return sorted(tuple(r) for r in source_divergence(docs, **options).collect())


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 20, "held": 30}])
def test_divergence(spark, sizes):
    rng = random.Random(4)
    vocabulary = ["the", "The", "été", "Été", "x1y", "zz-top", "日本", "a", "Ω", "ünder"] + [f"{a}{b}" for a in "bcdf" for b in "klmnp"]
    rows = []
    for i in range(250):
        source = "hot" if i % 3 == 0 else f"s{i % 7}"
        words = [rng.choice(vocabulary[: 10 + i % 20]) for _ in range(rng.randint(0, 25))]
        rows.append((None if i == 5 else " ".join(words), rng.choice(["de", "en", None]), None if i % 50 == 1 else source))
    rows += [("", "lonely", "only"), ("", "bare", "s1"), (None, "bare", "s2")]
    docs = spark.createDataFrame([(1, *r, 0, 0) for r in rows], "doc_id long, text string, lang string, source string, place long, zero long").repartition(3)
    got = result(docs, min_docs=6, **sizes)
    assert got == expected(rows, 6)
    assert {r[2] for r in got} == {"pair", "term"} and ("bare", "s1", "pair", "s2", 0, 1) in got


def test_divergence_of_awkward_rows(awkward, empty):
    rows = [(r.text, "l", r.source) for r in awkward.collect()]
    docs = awkward.withColumn("lang", F.lit("l"))
    assert result(docs, min_docs=2) == expected(rows, 2)
    assert result(docs, min_docs=99) == expected(rows, 99)
    assert source_divergence(empty.withColumn("lang", F.lit("l"))).count() == 0
