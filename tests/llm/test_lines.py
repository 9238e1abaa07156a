"""Lines of one bucket that the first comparison left apart: blocks must link what all pairs link, by a forest."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm.components import components
from tidemark.llm.lexicon import edit_distance
from tidemark.llm import lines as module
from tidemark.llm.lines import _LINE, _MARK, _Lines, _marked, _may_link, _meet, _met, _open_links, _profiles, budget, few_edits, similar, within


def reached(links, start):
    out = dict(start)
    while True:
        changed = False
        for a, b in links:
            low = min(out[a], out[b])
            for old in {out[a], out[b]} - {low}:
                out = {k: low if v == old else v for k, v in out.items()}
                changed = True
        if not changed:
            return out


@pytest.mark.parametrize("lines, letters", [(512, 1 << 20), (7, 1 << 20), (512, 300)])
def test_open_lines_of_a_bucket(spark, lines, letters):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    fixed = " ".join(rng.sample(words, 9))
    texts = [f"{fixed} {' '.join(rng.sample(words, 3))}" for _ in range(60)]  # a template: alike, most below the threshold
    texts += [t[:20] + "x" + t[21:] for t in texts[:15]] + [t + "y" for t in texts[5:20]] + ["short", "shorx", "é" * 30, "é" * 29 + "e"]
    component = {k: (0 if k < 25 else k) for k in range(len(texts))}  # the first 25 are one component already
    rows = [(b, k, len(t), component[k], 0) for b in (1, 2) for k, t in enumerate(texts)]  # two buckets of the same lines
    open_ = spark.createDataFrame(rows, "block long, node long, letters long, c long, main long").repartition(3)
    normal = spark.createDataFrame(list(enumerate(texts)), "node long, normal string")
    got = [(r.a, r.b) for r in _open_links(open_, normal, 0.9, lines, letters).collect()]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if component[i] != component[j] and similar(texts[i], texts[j], 0.9)]
    assert reached(got, component) == reached(pairs, component)
    assert all(similar(texts[a], texts[b], 0.9) for a, b in got) and len(pairs) > 20
    if lines == 512 and letters > 1000:
        assert len(got) < len(texts)  # a forest, and equal buckets once


def test_edits_of_many_pairs_at_a_time():
    rng = random.Random(1)
    a, b, most = [], [], []
    for n in range(600):
        letters = rng.choice(["ab", "abcdefgh", "aé中", "a\U0001f600b"])
        x = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40) if n else 2000))
        y = list(x)
        for _ in range(rng.randint(0, 9)):
            k = rng.randint(0, len(y))
            y[k : k + rng.randint(0, 1)] = rng.choice(["", *letters])
        a.append(x)
        b.append("".join(y))
        most.append(rng.randint(0, 9) if n else 200)
    want = [edit_distance(list(x), list(y))[0] <= k for x, y, k in zip(a, b, most)]
    assert 100 < sum(want) < 550
    for room in (1 << 19, 50):
        assert few_edits(a, b, np.array(most), room).tolist() == want
    assert few_edits([], [], np.array([], int)).tolist() == []


def test_lines_of_a_bucket_meet_once():
    """Two to four lines are compared in all pairs and not opened again; of more, all but the smallest may be."""
    buckets = {7: range(2), 8: range(10, 14), 9: range(20, 26), 10: [30], 11: [40, 41]}
    marks = np.array([(key, node, 900 if node == 41 else 100 + node) for key, nodes in buckets.items() for node in [*nodes, *nodes][::-1]], _MARK)
    parts = [m.tobytes() for m in np.array_split(marks, 3)]
    met = _meet(0.9)(pa.table({"part": pa.array([5, 5, 5], pa.int32()), "marks": pa.array(parts, pa.binary())})).to_pylist()
    pairs = sorted((r["b"], r["a"]) for r in met if r["block"] is None)
    assert pairs == [(0, 1), *itertools.combinations(range(10, 14), 2), *((20, n) for n in range(21, 26))]
    assert sorted((r["block"], r["a"], r["letters"]) for r in met if r["block"] is not None) == [((5 << 32) + 9, n, 100 + n) for n in range(21, 26)]
    assert _meet(0.9)(pa.table({"part": pa.array([5], pa.int32()), "marks": pa.array([marks[:0].tobytes()], pa.binary())})).num_rows == 0


def test_segments_meet_within_five_edits():
    """Lines of up to 59 letters at similarity 0.9 share a segment key."""
    rng = random.Random(2)
    for _ in range(300):
        x = "".join(rng.choice("abcdeé ") for _ in range(rng.randint(12, 57))).strip() or "a"
        x = " ".join(x.split())
        y = list(x)
        for _ in range(budget(len(x), 0.9)):
            y[rng.randrange(len(y))] = rng.choice("xyz")
        y = " ".join("".join(y).split())
        if x != y and similar(x, y, 0.9) and budget(max(len(x), len(y)), 0.9):
            keys, whose = _Lines(pa.array([f"{x}!\n\n{y}", "other"])).segment_keys(np.arange(2), 0.9)
            assert set(keys[whose == 0]) & set(keys[whose == 1]), (x, y)


def _edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        k = rng.randint(0, len(out))
        out[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "é", " "])
    return "".join(out)


def test_long_pairs_are_counted_together(monkeypatch):
    """Lines of over 1,200 letters allow over 120 edits; many of them share one band instead of being counted pair by pair."""
    rng = random.Random(4)
    a = ["".join(rng.choice("abcdefg é") for _ in range(rng.randint(1300, 1700))) for _ in range(40)]
    b = [_edited(rng, x, rng.randint(100, 300)) for x in a]
    most = np.array([budget(max(len(x), len(y)), 0.9) for x, y in zip(a, b)])
    want = [edit_distance(list(x), list(y))[0] <= k for x, y, k in zip(a, b, most.tolist())]
    assert 5 < sum(want) < 35 and [within(x, y, k) for x, y, k in zip(a, b, most.tolist())] == want
    monkeypatch.setattr(module, "within", lambda *_: pytest.fail("counted alone"))
    assert few_edits(a, b, most).tolist() == want


def test_counts_rule_out_unlike_lines_and_no_like_ones():
    rng = random.Random(6)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    texts = [" ".join(rng.sample(words, 100)) for _ in range(40)]
    unlike = [" ".join(rng.sample(words, 100)) for _ in range(40)]
    like = [_edited(rng, t, rng.randint(0, budget(len(t), 0.9) - 20)) for t in texts] + [_edited(rng, t[:40], 3) for t in texts]
    row = np.arange(40)
    assert not len(_may_link(_profiles(pa.array(texts)), _profiles(pa.array(unlike)), row, row, 0.9)[0])
    mine, other = texts + [t[:40] for t in texts], like
    linked = [k for k in range(80) if similar(mine[k], other[k], 0.9)]
    assert len(linked) > 60
    assert set(linked) <= set(_may_link(_profiles(pa.array(mine)), _profiles(pa.array(other)), np.arange(80), np.arange(80), 0.9)[0].tolist())


def test_one_pass_gives_marks_and_lines():
    batch = pa.RecordBatch.from_arrays([pa.array([None, 2], pa.int64()), pa.array([10, 20]), pa.array(["one two three\n\n--\nfour", "one two thrxe\none two three"])], ["doc_id", "row", "text"])
    table = pa.Table.from_batches(list(_marked(0.9, 1)(iter([batch]))))
    rows = _met(0.9)(table).to_pylist()
    lines = [(r["doc_id"], r["row"], r["line"]) for r in rows if r["form"] is not None]
    assert lines == [(None, 10, 0), (None, 10, 3), (2, 20, 0), (2, 20, 1)]
    forms = {(r["row"], r["line"]): r["form"] for r in rows if r["form"] is not None}
    assert forms[10, 0] == forms[20, 1] != forms[20, 0]
    assert {frozenset((r["a"], r["b"])) for r in rows if r["b"] is not None} == {frozenset((forms[10, 0], forms[20, 0]))}
    assert all(r["form"] is None or r["a"] is None for r in rows) and set(_LINE.names) < set(rows[0])
