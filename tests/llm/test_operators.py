"""Each operator against brute force, on driver tables and on awkward rows."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import LONG, ROWS, passage
from oracle import check, connect
from tidemark.llm import queries
from tidemark.llm.components import components
from tidemark.llm.decontaminate import benchmark_matches, without_benchmark
from tidemark.llm.eliasfano import EliasFano, Trie
from tidemark.llm.embeddings import near_duplicate_vectors
from tidemark.llm.language import _expand, _squeeze, language_scores
from tidemark.llm.lexicon import edit_distance
from tidemark.llm.lines import dedup_lines, repeated_lines, similar, without_repeated_lines
from tidemark.llm.minhash import minhash_groups
from tidemark.llm.pieces import DEFAULT_MODEL, Encoder, PieceModel, decode_pieces, encode_pieces
from tidemark.llm.quality import isotonic, quality_kept, quality_scores
from tidemark.llm.sharding import interleave_shards
from tidemark.llm.substring import remove_repeated_passages
from tidemark.llm.token_counts import DEFAULT_RANKS, Counter, TokenTree, edited_token_counts, load_ranks, release_edits

SPACES = re.compile(rb"[^\x20\x09-\x0d]+")


def tokens(text, lower=False):
    raw = (text or "").encode()
    return SPACES.findall(raw.lower() if lower else raw)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def roots(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf_dir, name):
    problem, rows, _ = check(spark, connect(sf_dir), name, queries.QUERIES[name], queries.SQL[name], sf_dir)
    assert not problem and rows


# components


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links + [(None, 3)], "a long, b long")).collect()}
    nodes = {n for a, b in links for n in (a, b)}
    assert got == roots(links, nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1: substrings


def cut(rows, window):
    least = {}
    for d, text in rows:
        w = tokens(text)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(least.get(key, math.inf), math.inf if d is None else d)
    out = []
    for d, text in rows:
        w = tokens(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if (math.inf if d is None else d) > least[tuple(w[i : i + window])]:
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 2000, "bucket_windows": 500}])
def test_substrings_of_awkward_rows(awkward, sizes):
    got = remove_repeated_passages(awkward, window=5, **sizes).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got], key=str) == cut([r[:2] for r in ROWS], 5)
    eight = next(r for r in got if r.doc_id == 8)
    assert [(x.start, x.stop) for x in eight.removed] == [(0, 40)] and eight.kept == ""


def test_substrings_of_no_rows(empty):
    assert remove_repeated_passages(empty).count() == 0


# 2: pieces


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=DEFAULT_MODEL)


def test_pieces_agree_with_the_library(spark, sf_dir, awkward, library):
    for docs in (documents(spark, sf_dir), awkward):
        encoded = encode_pieces(docs)
        got = sorted((str(r.doc_id), r.ids) for r in encoded.collect())
        assert got == sorted((str(r.doc_id), library.encode(r.text or "")) for r in docs.select("doc_id", "text").collect())
        back = sorted((str(r.doc_id), r.decoded) for r in decode_pieces(encoded).collect())
        assert back == sorted((str(r.doc_id), (r.text or "").replace("▁", " ")) for r in docs.select("doc_id", "text").collect())


def test_pieces_of_random_texts(library):
    draw = np.random.default_rng(5)
    letters = list("abcdeéñ ▁  \n\t\r;.,!?ß日😀Theisin1290")
    texts = ["".join(draw.choice(letters, draw.integers(1, 50))) for _ in range(2000)] + [" " * k + "x" * (k % 3) for k in range(70)]
    ids, at = Encoder(PieceModel.load(DEFAULT_MODEL), batch_chars=3000, remembered=4000).texts(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode(t) for t in texts]


def test_pieces_of_no_rows_and_odd_ids(spark, empty):
    assert encode_pieces(empty).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [-5, 99_999, 1, 13 + 256])], "k int, ids array<int>")
    assert [r.decoded for r in decode_pieces(odd).orderBy("k").collect()][:2] == ["", ""]


# 3: quality


def test_quality_tells_labels_apart_on_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/labels.parquet")
    got = {r.doc_id: r for r in quality_scores(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    held = [(got[x.doc_id].predicted, x.quality) for x in labels.collect() if got[x.doc_id].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.95


def test_quality_learns_nothing_from_held_out_labels(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - quality, quality) as quality")
    rows = [sorted((r.doc_id, r.score) for r in quality_scores(docs, x).collect()) for x in (labels, turned)]
    assert rows[0] == rows[1]


def test_quality_of_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1), (5, 0), (9, 0), (9, None), (None, 1), (77, 1), (6, 0)], "doc_id long, quality int")
    got = quality_scores(awkward, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    none = quality_scores(awkward, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_scores(empty, labels).count() == 0
    kept = quality_kept(awkward, labels)
    assert kept.columns == awkward.columns and kept.count() <= len(ROWS)


def test_isotonic_pools_violators():
    at, mean = isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 0, 1]), np.array([1.0, 1, 1, 2]))
    assert mean.tolist() == [0, 0.5, 1] and at.tolist() == [0, 1.5, 3]


# 4: shards


def test_shards_are_even_and_hold_the_mixture(spark, sf_dir, awkward, empty):
    docs = documents(spark, sf_dir)
    got = {r.doc_id: r for r in interleave_shards(docs, bucket_rows=7).collect()}
    assert got == {r.doc_id: r for r in interleave_shards(docs).collect()}
    by = collections.Counter(r.shard for r in got.values())
    assert set(by) == set(range(8)) and max(by.values()) - min(by.values()) <= 1
    for shard in by:
        assert sorted(r.slot for r in got.values() if r.shard == shard) == list(range(by[shard]))
    source = {r.doc_id: r.source for r in docs.collect()}
    total = collections.Counter(source.values())
    mixed = collections.Counter((source[d], r.shard) for d, r in got.items())
    assert all(abs(mixed[s, k] - n / 8) < 2 for s, n in total.items() for k in range(8))
    odd = interleave_shards(awkward).collect()
    assert len(odd) == len(ROWS) and sorted(collections.Counter(r.shard for r in odd).values()) == [1, 1, 2, 2, 2, 2, 2, 2]
    assert sorted((r.size, r.text_crc32) for r in odd) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in ROWS)
    assert interleave_shards(empty).count() == 0


# 5: lines


def test_similar_counts_edits():
    assert similar("abcdefghij", "abcdefghiX", 0.9) and not similar("abcdefghij", "abcdefghXX", 0.9)
    for a, b in itertools.product(["", "a", "kitten", "sitting", "saturday", "sunday"], repeat=2):
        table = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, table[0] = table[0], i
            for j, y in enumerate(b, 1):
                before, table[j] = table[j], min(table[j] + 1, table[j - 1] + 1, before + (x != y))
        assert edit_distance(list(a), list(b))[0] == table[-1]
    assert edit_distance(list("abc"), list("xxabxcxx"), anywhere=True)[0] == 1


def test_lines_keep_one_of_each_group(spark, awkward, empty):
    base = [f"word{i}" for i in range(120)]
    texts = [(1, " ".join(base) + "\nown"), (2, "Own!\n" + " ".join(base[:60] + ["changed"] + base[61:])), (3, "\n---\n"), (4, " ".join(reversed(base)))]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(texts, "doc_id long, text string"), within=40).collect()}
    assert got[1].n_removed == 0 and got[1].kept == texts[0][1]
    assert got[2].n_lines == 2 and got[2].kept in ("", texts[1][1].split("\n")[1])
    assert got[3].kept == "\n---\n" and got[4].n_removed == 0
    odd = dedup_lines(awkward).collect()
    assert len(odd) == len(ROWS)
    assert {(r.n_removed, r.kept) for r in odd if r.doc_id == 2} == {(2, "")}

    assert dedup_lines(empty).count() == 0
    cut_rows = without_repeated_lines(awkward)
    assert cut_rows.columns == awkward.columns and 2 not in [r.doc_id for r in cut_rows.collect()]
    assert LONG in [r.text for r in cut_rows.collect()]


def test_lines_find_exact_and_most_near_repeats(spark, sf_dir):
    got = {r.doc_id: r for r in dedup_lines(documents(spark, sf_dir)).collect()}
    seen, exact = set(), collections.Counter()
    for r in documents(spark, sf_dir).orderBy("doc_id").collect():
        for line in r.text.split("\n"):
            form = " ".join(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", line.lower()))
            exact[r.doc_id] += bool(form) and form in seen
            seen.add(form)
    assert all(got[d].n_removed >= exact[d] for d in got) and sum(r.n_removed for r in got.values()) >= sum(exact.values())


def test_lines_with_a_word_changed_are_found(spark):
    draw = np.random.default_rng(8)
    rows = []
    for k, n in enumerate([4, 6, 10, 10, 10, 15, 20, 20, 30, 30, 50, 100] * 4):
        line = ["".join(draw.choice(list("abcdefghijklmnop"), 6)) for _ in range(n)]
        at = int(draw.integers(0, n))
        changed = [*line[:at], "q" + line[at][1:] if n < 10 else "changed"[:6], *line[at + 1 :]]
        rows += [(2 * k, " ".join(line)), (2 * k + 1, " ".join(changed))]
    got = {r.doc_id: r.n_removed for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d % 2 for d, _ in rows}


def test_lines_that_differ_in_case_and_a_word_are_found(spark):
    line = [f"word{k}" for k in range(20)]
    rows = [(1, " ".join(line).upper()), (2, " ".join([*line[:9], "other", *line[10:]])), (3, "ÉTÉ " + " ".join(reversed(line)).title()), (4, "été " + " ".join([*line[:9:-1], "chose", *line[8::-1]]))]
    got = {r.doc_id: r.n_removed for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1}


def lines_of(rows):
    """(doc_id, line number, normal form) in order, lines without a word left out."""
    found = [(d, k, " ".join(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", line.lower()))) for d, text in sorted(rows) for k, line in enumerate(text.split("\n"))]
    return [x for x in found if x[2]]


def alike(forms):
    """All pairs of forms within a tenth of the longer's letters; letter counts that differ by more than two an edit need no distance."""
    forms = sorted(forms, key=len)
    size = np.array([len(f) for f in forms])
    letters = np.stack([np.bincount(np.frombuffer(f.encode("utf-32-le"), np.uint32) % 64, minlength=64) for f in forms])
    pairs = []
    for a in range(len(forms)):
        last = np.searchsorted(size, size[a] / 0.9 + 1, "right")
        for b in np.flatnonzero(np.abs(letters[a + 1 : last] - letters[a]).sum(axis=1) <= 0.2 * size[a + 1 : last] + 1e-6) + a + 1:
            x, y = forms[a], forms[b]
            if edit_distance(list(x), list(y))[0] <= 0.1 * len(y) + 1e-9:
                pairs.append((x, y))
    return pairs


def test_lines_and_their_stage_agree_with_all_pairs(spark, sf_dir):
    import corpus_pipeline as pipeline

    draw = np.random.default_rng(9)
    docs = documents(spark, sf_dir).orderBy("doc_id").limit(60)
    rows = [(r.doc_id, "\n".join(r.text.split("\n")[:12])) for r in docs.collect()]
    for d, _, form in lines_of(rows)[::3]:
        words = form.split()
        words[int(draw.integers(0, len(words)))] = "zx"
        rows.append((d + 1_000_000, " ".join(words).upper() + "\nown"))
    df = spark.createDataFrame([(d, t, len(t)) for d, t in rows], "doc_id long, text string, n_chars long").groupBy("doc_id").agg(F.concat_ws("\n", F.sort_array(F.collect_list("text"))).alias("text")).withColumn("n_chars", F.char_length("text"))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    every = lines_of(rows)
    pairs = alike({f for *_, f in every})
    first = {}
    for d, k, f in every:
        first.setdefault(f, (d, k))
    group = roots([(first[x], first[y]) for x, y in pairs], set(first.values()))
    expected = {(d, k) for d, k, f in every if group[first[f]] != (d, k)}
    near = {(d, k) for d, k in expected if (d, k) in group}
    assert len(near) > 100
    got = {(r.row, k) for r in repeated_lines(df).collect() for k in r.removed}
    row = {r.doc_id: r.row for r in df.select("doc_id", F.xxhash64("doc_id", "text").alias("row")).collect()}
    assert got <= {(row[d], k) for d, k in expected} and len(got & {(row[d], k) for d, k in near}) >= 0.99 * len(near)
    assert {(row[d], k) for d, k in expected - near} <= got | {(row[d], k) for d, k in near}
    gone = {r.doc_id: r.n_removed for r in dedup_lines(df).collect()}
    left = {r.doc_id: r.text for r in pipeline.line_dedup(spark, df, sf_dir).collect()}
    for d, text in rows:
        lost = {k for r, k in got if r == row[d]}
        kept = [x for k, x in enumerate(text.split("\n")) if k not in lost]
        assert gone[d] == len(lost) and left.get(d, "") == ("\n".join(kept) if any(x.strip() for x in kept) else "")


# 7: vectors


def linked(vectors):
    x = {k: np.array(v, float) for k, v in vectors if v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = [(a, b) for a, b in itertools.combinations(x, 2) if len(x[a]) == len(x[b]) and x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) >= 0.9]
    return links, roots(links, [k for k, _ in vectors])


def test_vectors_agree_with_all_pairs(spark):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(20, 16))
    vectors = [(int(k), [float(c) for c in centres[k % 20] + draw.normal(size=16) * 0.15 * (k % 5)]) for k in range(300)]
    vectors += [(1000 + k, vectors[0][1]) for k in range(5)] + [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [1.0, None]), (2005, [1.0, 2.0]), (2006, [2.0, 4.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").selectExpr("*", "'x' as rep", "'y' as leaf", "1 as v")
    links, root = linked(vectors)
    count = collections.Counter(n for pair in links for n in pair)
    got = {r.vec_id: r for r in near_duplicate_vectors(df, trees=16, leaf_rows=60).collect()}
    assert set(got) == {k for k, _ in vectors}
    assert all(got[k].n_links <= count[k] for k in got)
    assert sum(r.n_links for r in got.values()) >= 0.95 * sum(count.values())
    assert sum(got[k].component_id == root[k] for k in got) >= 0.95 * len(got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert near_duplicate_vectors(df.where("false")).count() == 0


def test_vectors_of_a_dense_group_are_counted_in_full(spark):
    draw = np.random.default_rng(4)
    vectors = [(k, [float(c) for c in np.ones(8) + draw.normal(size=8) * 0.02]) for k in range(400)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert {(r.n_links, r.component_id) for r in near_duplicate_vectors(df, trees=4, leaf_rows=50).collect()} == {(399, 0)}


def test_vectors_linked_only_through_a_later_one(spark):
    """Three at steps of 20 degrees, the middle one in every order: both its links count, and all are one component."""
    for turns in itertools.permutations((0, 20, 40)):
        vectors = [(k, [float(np.cos(np.radians(t))), float(np.sin(np.radians(t)))]) for k, t in enumerate(turns)]
        got = near_duplicate_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<double>").coalesce(1)).collect()
        assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(k, 2 if t == 20 else 1, 0) for k, t in enumerate(turns)}


def test_links_of_a_loose_and_of_a_bridged_group_are_counted_in_full(spark):
    """Groups of many leaves: one at cosines on both sides of the limit, one tight with an outlier that links with a part of it."""
    draw = np.random.default_rng(6)
    centre, side = np.eye(32)[0], np.eye(32)[1]
    loose = centre + draw.normal(size=(1500, 32)) * 0.055
    tight = -centre + draw.normal(size=(900, 32)) * 0.01
    x = np.concatenate((loose, tight, [-centre + 0.483 * side], draw.normal(size=(200, 32))))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in near_duplicate_vectors(df, leaf_rows=100).collect()}
    assert [got[k].n_links for k in range(len(x))] == (near.sum(axis=1) - 1).tolist()
    assert 0 < near[2400, 1500:2400].sum() < 900 and near[:1500, :1500].mean() < 0.99
    assert {got[k].component_id for k in range(1500)} == {0} and {got[k].component_id for k in range(1500, 2401)} == {1500}


# 8: language model


def test_elias_fano_holds_and_finds():
    draw = np.random.default_rng(1)
    for n, bound in ((0, 5), (1, 1), (50, 60), (3000, 10**12)):
        values = np.sort(draw.integers(0, bound, n))
        packed = EliasFano.open(EliasFano.pack(values, bound))
        assert packed.at(np.arange(n)).astype(np.int64).tolist() == values.tolist()
        asked = np.concatenate((draw.integers(0, bound + 3, 200), values))
        assert (packed.successor(asked) == np.searchsorted(values, asked)).all()
    assert _expand(_squeeze(np.array([0, 5, 2**32 - 1]))).tolist() == [0, 5, 2**32 - 1]


def test_trie_reads_from_a_memory_map(tmp_path):
    context, successor, codes = np.array([2, 2, 5, 9]), np.array([1, 7, 7, 0]), np.array([10, 20, 30, 40])
    (tmp_path / "trie").write_bytes(Trie.build(context, successor, codes))
    trie = Trie.open(np.memmap(tmp_path / "trie", np.uint8, "r"))
    assert trie.lookup(np.array([2, 3, 5, 9]), np.array([3, 1, 2, 1]), np.array([1, 2, 7, 7, 0, 7, 0])).tolist() == [10, 0, 20, 0, 0, 30, 40]


def language(rows, prior):
    learned = [r for r in rows if zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 5 != 1]
    text = lambda r: [*tokens(r[1], True), None]
    single, pairs = collections.Counter(), collections.Counter()
    for r in learned:
        single.update(text(r))
        pairs.update(zip(["start", *text(r)], text(r)))
    total, types = sum(single.values()), len(single)
    ones, twos = (sum(c == k for c in single.values()) for k in (1, 2))
    discount = ones / (ones + 2 * twos) if ones and twos else 0.5
    out = []
    for r in rows:
        base = score = 0.0
        for before, w in zip(["start", *text(r)], text(r)):
            p = (single[w] - discount) / total if w in single else discount * types / total
            if before == "start" or before in single:
                c = len(learned) if before == "start" else single[before]
                p = (pairs[before, w] + prior * p) / (c + prior)
            base += math.log10((single[w] + 0.5) / (total + 0.5 * (types + 1)))
            score += math.log10(p)
        out.append((str(r[0]), len(text(r)), sum(w in single for w in text(r)), total, base, score))
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 20_000, "bucket_bytes": 50_000, "shard_bytes": 50_000, "pair_limit": 50}])
def test_language_scores_agree_with_plain_counting(spark, sf_dir, awkward, sizes):
    for docs in (documents(spark, sf_dir).limit(120), awkward):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in language_scores(docs, prior=20.0, **sizes).collect())
        for a, b in zip(got, language(rows, 20.0), strict=True):
            assert a[:4] == b[:4] and a[4] == pytest.approx(b[4]) and abs(a[5] - b[5]) <= a[1] / 1500 + 1e-9


def test_language_scores_beat_the_base_on_held_out_texts(spark, sf_dir, empty):
    held = [r for r in language_scores(documents(spark, sf_dir)).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert language_scores(empty).count() == 0


# 9: benchmark


def test_benchmark_items_are_found_within_the_budget(spark, awkward, empty):
    item = passage(5, 20).split()
    wrong = [x if i % 6 else "other" for i, x in enumerate(item)]  # 4 replaced
    far = [x if i % 3 else "other" for i, x in enumerate(item)]  # 7 replaced
    texts = [(1, "Before. " + ", ".join(item).upper() + "! After"), (2, "a b " + " ".join(wrong) + " c"), (3, " ".join(far)), (4, " ".join(item[:10] + ["x"] + item[10:15] + item[17:])), (None, " ".join(item))]
    items = spark.createDataFrame([(7, " ".join(item)), (8, None), (None, "x"), (9, "...")], "item_id long, text string").selectExpr("*", "'x' as doc_id")
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for size in (1 << 20, 10):
        got = {r.doc_id: r for r in benchmark_matches(docs, items, block_bytes=size).collect()}
        assert {d: r.distance for d, r in got.items()} == {1: 0, 2: 4, 4: 3, None: 0}
        assert (got[1].start, got[1].stop) == (1, 21)
    assert [r.doc_id for r in without_benchmark(docs, items).collect()] == [3]
    assert benchmark_matches(awkward, items).count() == 0 and without_benchmark(awkward, items).count() == len(ROWS)
    assert benchmark_matches(empty, items).count() == 0 and benchmark_matches(docs, items.where("false")).count() == 0


def test_benchmark_finds_every_whole_item(spark, sf_dir):
    form = lambda t: " " + " ".join(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", t.lower())) + " "
    docs, items = documents(spark, sf_dir).collect(), spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    whole = {(d.doc_id, i.item_id) for d in docs for i in items if form(i.text) in form(d.text)}
    got = {(r.doc_id, r.item_id): r.distance for r in queries.QUERIES["op9_benchmark_decontamination"](spark, sf_dir).collect()}
    assert whole == {k for k, d in got.items() if d == 0}


# 10: near duplicates


def near(rows, percent):
    sets = {}
    for k, (_, text) in enumerate(rows):
        w = tokens(text, True)
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, links


@pytest.mark.parametrize("percent", [85, 60])
def test_near_duplicates_agree_with_all_pairs(spark, sf_dir, percent):
    docs = documents(spark, sf_dir)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    sets, links = near(rows, percent)
    root = roots([(rows[a][0], rows[b][0]) for a, b in links], [d for d, _ in rows])
    got = {r.doc_id: r for r in minhash_groups(docs, percent=percent, rows=3).collect()}
    assert {d: (len(sets[k]), root[d], root[d] == d) for k, (d, _) in enumerate(rows)} == {d: (r.n_shingles, r.component_id, r.kept) for d, r in got.items()}


def test_near_duplicates_around_a_hub(spark):
    """Copies that are near the hub and not near each other are one group, whichever id the hub has."""
    words = [f"w{i}" for i in range(60)]
    texts = [(k, " ".join(words[: 3 * k] + ["edit"] * 1 + words[3 * k + 1 :])) for k in range(1, 18)]
    for hub in (0, 9.5, 99):
        rows = [(2 * k, t) for k, t in texts] + [(int(2 * hub), " ".join(words))]
        sets, links = near(rows, 80)
        root = roots([(rows[a][0], rows[b][0]) for a, b in links], [d for d, _ in rows])
        got = {r.doc_id: r.component_id for r in minhash_groups(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()}
        assert got == root and len(set(root.values())) < len(rows)


def test_near_duplicates_of_awkward_rows(awkward, empty):
    got = minhash_groups(awkward).collect()
    assert len(got) == len(ROWS)
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.n_shingles > 0, r.component_id, r.kept))
    assert by[1] == {(True, 1, True)} and by[2] == {(True, 1, False)} and by[3] == {(False, 3, True)} and by[4] == {(False, 4, True)}
    assert by[None] == {(True, None, True), (False, None, True)} and by[9] == {(True, 9, True)}
    assert minhash_groups(empty).count() == 0


# pipeline


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as pipeline

    docs, labels = documents(spark, sf_dir), {}
    names, kept = [n for n, _ in pipeline.STAGES], {}
    for name, stage in pipeline.STAGES:
        labels[name] = docs = pipeline.stored(stage(spark, docs, sf_dir))
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert name == names[-1] or docs.columns == documents(spark, sf_dir).columns
    good = {r.doc_id: r.predicted for r in queries.QUERIES["op3_quality_classifier"](spark, sf_dir).collect()}
    assert kept["quality"] == {d for d, p in good.items() if p}
    assert all(len(r.text) == r.n_chars for r in labels["line_dedup"].collect())
    rows = sorted((r.doc_id, r.text) for r in labels["line_dedup"].collect())
    sets, links = near(rows, 80)
    root = roots([(rows[a][0], rows[b][0]) for a, b in links], [d for d, _ in rows])
    assert kept["near_dedup"] == {d for d, r in root.items() if d == r}
    found = {r.doc_id for r in benchmark_matches(labels["near_dedup"], spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert kept["decontamination"] == kept["near_dedup"] - found and kept["encoding"] == kept["decontamination"]
    assert hashlib.sha256(str(sorted(kept["encoding"])).encode()).hexdigest() == hashlib.sha256(
        str(sorted(r.doc_id for r in pipeline.run(spark, sf_dir).collect())).encode()).hexdigest()


# 6: token counts under edits


@pytest.fixture(scope="module")
def byte_counter():
    return Counter(load_ranks(DEFAULT_RANKS))


def plain_count(counter, text):
    return len(counter.encoding.encode_ordinary(text))


def test_token_trees_follow_any_edits(byte_counter):
    draw = np.random.default_rng(6)
    letters = list("ab'slrevtm  \n\t!?.1é日😀")
    some = lambda n: "".join(draw.choice(letters, draw.integers(0, n)))
    for size in [40] * 300 + [5000] * 10:
        tree = TokenTree(some(size) or "x", byte_counter)
        for _ in range(6):
            start = int(draw.integers(0, len(tree.text) + 2))
            stop, put, before = start + int(draw.integers(0, 9)), some(7), tree.text
            tree.edit(start, stop, put)
            start = min(start, len(before))
            assert tree.text == before[:start] + put + before[max(start, min(stop, len(before))) :]
            assert tree.total == plain_count(byte_counter, tree.text) and tree.chars[1] == len(tree.text)
            assert [n for b in tree.blocks for n, _ in b] == [len(p) for p in byte_counter.pieces(tree.text)]


def test_token_trees_encode_only_around_the_edit(byte_counter):
    text = " ".join(f"word{i}" for i in range(20_000))
    tree = TokenTree(text, byte_counter)
    tree.edit(60_000, 60_003, "new")
    assert tree.encoded < 12 and tree.total == plain_count(byte_counter, tree.text)
    tree.edit(100, 100, " and".join(map(str, range(3000))))  # a block that outgrows its size is dealt anew
    assert tree.total == plain_count(byte_counter, tree.text) and max(map(len, tree.blocks)) <= TokenTree.BLOCK


def test_edited_counts_of_all_rows(spark, sf_dir, awkward, empty, byte_counter):
    for docs in (documents(spark, sf_dir), awkward):
        got = edited_token_counts(release_edits(docs)).collect()
        texts = sorted((str(r.doc_id), r.text or "") for r in docs.select("doc_id", "text").collect())
        assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((d, plain_count(byte_counter, t)) for d, t in texts)
        assert all(r.n_tokens_edited == plain_count(byte_counter, r.edited) for r in got)
    by = {r.doc_id: r.edited for r in edited_token_counts(release_edits(awkward)).collect()}
    assert by[2] == "s0: The quick brown fox jumps over the lazy dog again and again" and by[4] == "unknown: "
    odd = spark.createDataFrame([(1, "abc", None), (2, None, [(5, 1, "x"), None, (None, None, None)])], "doc_id long, text string, edits array<struct<start:int,stop:int,put:string>>")
    assert {r.doc_id: r.edited for r in edited_token_counts(odd).collect()} == {1: "abc", 2: "x"}
    assert edited_token_counts(release_edits(empty)).count() == 0


def test_release_masks_the_first_address(spark):
    df = spark.createDataFrame([(1, "write to a.b@c.org or d@e.com\nlast x@y.org", "s"), (2, "only\nx@y.org", "s")], "doc_id long, text string, source string")
    assert {r.doc_id: r.edited for r in edited_token_counts(release_edits(df)).collect()} == {1: "s: write to [email] or d@e.com", 2: "s: only"}


def test_copies_of_a_string_are_in_order_without_sorting(monkeypatch):
    """300 copies of one string and one that differs at its end: only suffixes that may differ are sorted, and the order is the plain one."""
    from tidemark.llm import suffixes

    draw = np.random.default_rng(8)
    one = bytes(draw.integers(97, 123, 120).tolist())
    text = np.frombuffer(b"\0".join([one] * 300 + [one[:-1] + b"~"]) + b"\0", np.uint8)
    at, sizes, plain = np.flatnonzero(text), [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sizes.append(len(keys[0])) or plain(keys))
    order = suffixes._sorted_directly(at, suffixes._eights(text), 100)
    raw = text.tobytes()
    assert order.tolist() == sorted(at.tolist(), key=lambda k: (raw[k : k + 104].split(b"\0")[0], k))
    assert sum(sizes) < 2 * len(at)
