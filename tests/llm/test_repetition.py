"""Periodic runs and repeated bytes against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from conftest import LONG, ROWS
from tidemark.llm import queries
from tidemark.llm.periods import grams, periodic_runs, runs_of
from tidemark.llm.suffixes import _eights, common_prefixes, remove_repeated_bytes, suffix_order

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


# 11: periodic runs


def all_runs(w, shortest=12):
    """Every lag over the whole text; a stretch counts if no smaller lag holds on all of it."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            s, n = i - q, j - i + q
            if j > i and n >= max(shortest, 2 * q) and not any(all(w[k] == w[k - p] for k in range(s + p, j)) for p in range(1, q)):
                out.append((s, n, q))
            i = j + 1
    return sorted(out)


def looped(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(w), h // 10
    if doc_id is None or h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def digest(doc_id, text):
    w = looped(doc_id, WORD.findall((text or "").encode()))
    runs = all_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    s, n, q = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None,) * 3
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return (doc_id, len(runs), s, n, q, 1000 * n // q if runs else None, hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def sequences(rng, kind):
    if kind == 0:
        return "".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))
    if kind == 1:
        return "".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) * rng.randint(1, 6) for _ in range(rng.randint(1, 6)))
    if kind == 2:
        a, b = "a", "ab"
        for _ in range(7):
            a, b = b, b + a
        return b[: rng.randint(0, 80)] * rng.randint(1, 2)
    u, v = "".join(rng.choice("aaab") for _ in range(rng.randint(8, 30))), "a" * rng.randint(3, 14)
    return (u + v + rng.choice("bc")) * rng.randint(1, 4) + v + u


@pytest.mark.parametrize("kind", range(4))
def test_runs_of_sequences(kind):
    rng = random.Random(kind)
    for _ in range(400):
        w, shortest = sequences(rng, kind), rng.choice([2, 3, 5, 12])
        span = max(1, (shortest + 1) // 2)
        symbols = grams(np.array([ord(c) for c in w], np.int64), span)
        _, number, count = np.unique(symbols, return_inverse=True, return_counts=True)
        assert runs_of(symbols, count[number] > 1, span, shortest) == all_runs(w, shortest), (w, shortest)


def test_runs_of_awkward_rows(awkward):
    got = {(r.doc_id, r.n_words, r.collapsed): [tuple(x) for x in r.runs] for r in periodic_runs(awkward).collect()}
    for doc_id, text, _ in ROWS:
        w = WORD.findall((text or "").encode())
        runs = [(0, 30_000, 1)] if text == LONG else all_runs(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert got[doc_id, len(w), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()] == runs


def test_runs_of_no_rows(empty):
    assert periodic_runs(empty).count() == 0


def test_digests_of_loops(spark, tmp_path):
    rng = random.Random(5)
    docs = [(i, None if i % 40 == 7 else " ".join(rng.choice(["to", "be", "or", "not"] if i % 3 else [f"w{k}" for k in range(99)]) for _ in range(rng.randint(0, 90)))) for i in range(300)]
    docs += [(300, "a b c\x0bd " * 9), (None, "x y " * 20)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((digest(*d) for d in docs), key=str)
    assert sum(1 for d in docs if looped(d[0], [1, 2]) != [1, 2]) > 5


# 12: repeated bytes


def test_suffix_order_and_prefixes():
    rng = random.Random(1)
    for trial in range(200):
        strings = [bytes(rng.choice(b"ab" if trial % 2 else b"abcde") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 6))]
        text = np.concatenate([np.append(np.frombuffer(x, np.uint8) + 1, 0) for x in strings]).astype(np.uint8)
        apart = [int(v) if v else i - 1000 for i, v in enumerate(text)]
        order = suffix_order(text, 64)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: apart[i:])

        def shared(i, j, t=text):
            k = 0
            while t[i + k] and t[i + k] == t[j + k]:
                k += 1
            return k

        assert common_prefixes(order, _eights(text), 64)[1:].tolist() == [shared(a, b) for a, b in zip(order, order[1:])]


def cut_bytes(rows, length):
    rows = [(float("inf") if d is None else d, (t or "").encode()) for d, t in rows]
    least = {}
    for d, t in rows:
        for i in range(len(t) - length + 1):
            least[t[i : i + length]] = min((d, i), least.get(t[i : i + length], (d, i)))
    out = []
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if (d, i) > least[t[i : i + length]]:
                gone[i : i + length] = b"\1" * length
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", gone)]
        out.append((None if d == float("inf") else d, len(t), sum(gone), spans, bytes(c for c, x in zip(t, gone) if not x)))
    return sorted(out, key=str)


def rows_of(df, **sizes):
    got = remove_repeated_bytes(df, **sizes).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, [tuple(x) for x in r.removed], bytes(r.kept)) for r in got), key=str)


SMALL = [{}, {"chunk_bytes": 2000, "bucket_bytes": 3000}, {"chunk_bytes": 1500, "bucket_bytes": 3000, "hot_strings": 2}]


@pytest.mark.parametrize("sizes", SMALL)
def test_repeated_bytes(spark, sizes):
    rng = random.Random(2)
    for alphabet, gram in (("abcé日 ", 8), ("ab", 11), ("a", 16)):
        base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(5)]
        docs = []
        for i in range(40):
            cuts = [(rng.choice(base), rng.randint(0, 150)) for _ in range(rng.randint(0, 4))]
            docs.append((rng.choice([i, i, i, 3, None]), None if i == 11 else "".join(b[x : x + 90] + "a" * rng.randint(0, 60) for b, x in cuts)))
        docs += [(100 + j, "q" * rng.randint(30, 140) + base[0] + f"w{j}") for j in range(8)]
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        assert rows_of(df, length=16, gram=gram, **sizes) == cut_bytes(docs, 16)


def test_repeated_bytes_of_awkward_rows(awkward, empty):
    assert rows_of(awkward) == cut_bytes([r[:2] for r in ROWS], 100)
    assert remove_repeated_bytes(empty).count() == 0
    with pytest.raises(ValueError, match="gram"):
        remove_repeated_bytes(empty, length=20, gram=32)
