"""How far the sources of a language differ in their words: row-wise sparse products through a term-major index."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import counted_ranges, pieces_of, slices, stored, utf8

#: A-Z in lower case; other ASCII bytes but letters part terms. Bytes of 128 and more belong to letters beyond ASCII.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PRECISION = 1_000_000_000
SMOOTHING = 5


def _count(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, source, term, n, docs) of a task's rows, handed on whenever `most` entries are held."""

    def rows(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> pa.RecordBatch:
        sizes = [len(n) for n, _ in held.values()]
        keys = [np.repeat(np.arange(len(held)), sizes)] * 2
        names = [pa.array([k[i] for k in held], pa.string()).take(pa.array(at)) for i, at in enumerate(keys)]
        return pa.RecordBatch.from_arrays([
            *names, pa.array([t for n, _ in held.values() for t in n], pa.binary()).cast(pa.string()),
            pa.array([c for n, _ in held.values() for c in n.values()], pa.int64()),
            pa.array([d[t] for n, d in held.values() for t in n], pa.int64())], ["lang", "source", "term", "n", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        entries = 0
        for batch in slices(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            raw, ends = data.tobytes(), offsets.tolist()
            for d, key in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())):
                terms = raw[ends[d] : ends[d + 1]].translate(_TERMS).split()
                n, docs = held.setdefault(key, (Counter(), Counter()))
                before = len(n)
                n.update(terms)
                docs.update(set(terms))
                entries += len(n) - before
                if entries >= most:
                    yield rows(held)
                    held, entries = {}, 0
        if held:
            yield rows(held)

    return count


def group_terms(docs: DataFrame, min_docs: int = 30, lang: str = "lang", source: str = "source", text: str = "text", held: int = 1 << 18) -> DataFrame:
    """(lang, source, term, n, lang_n) of the terms that `min_docs` documents of a language have; `lang_n` counts them all over it."""
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    parts = named.mapInArrow(_count(held), "lang string, source string, term string, n long, docs long")
    everywhere = Window.partitionBy("lang", "term")
    counts = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return counts.select("lang", "source", "term", "n", F.sum("n").over(everywhere).alias("lang_n"), F.sum("docs").over(everywhere).alias("docs")) \
        .where(F.col("docs") >= min_docs).drop("docs")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (count + 5) / (total + 5 * terms)), exactly."""
    wide = lambda c: c.cast("decimal(19,0)")
    above = (wide(count) + F.lit(SMOOTHING)) * F.lit(PRECISION)
    below = wide(total) + wide(terms) * F.lit(SMOOTHING)
    return F.lit(1) + F.call_function("div", above, below).cast("long")


def _accumulate(table: pa.Table, peers: pa.Table) -> pa.Table:
    """Per group the sum over this block's terms of its distances to every peer, by a dense accumulator.

    A group's terms are scattered through the index of the terms' groups. A group without a term has its zero share there:
    every pair starts from the distance of the two zero shares, is corrected for the terms that one side has, then for those
    that both have.
    """
    peers = peers.sort_by("place")
    zero = peers["zero"].to_numpy()
    n = len(zero)
    group, share_ = table["place"].to_numpy(), table["p"].to_numpy()
    terms = pa.chunked_array([*table["term"].chunks, pa.array([], pa.string())]).combine_chunks().dictionary_encode().indices.to_numpy()
    index = np.lexsort((group, terms))  # term-major
    heads = np.searchsorted(terms[index], np.arange(int(terms.max(initial=-1)) + 2))
    rows = np.lexsort((share_, group))  # group-major, shares ascending
    bounds = np.searchsorted(group[rows], np.arange(n + 1))
    sums = np.concatenate(([0], np.cumsum(share_[rows])))
    distinct = len(heads) - 1
    out = []

    def beyond(own: np.ndarray, level: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sum of |p - level| over the shares at rows a..b; `own` is how many of them are below the level."""
        return level * own - (sums[a + own] - sums[a]) + (sums[b] - sums[a + own]) - level * (b - a - own)

    keyed = group[rows] * (2 * PRECISION) + share_[rows]
    a, b = bounds[:-1], bounds[1:]
    for g in range(n):
        gap = np.abs(zero - zero[g])
        mine = share_[rows[a[g] : b[g]]]
        total = (distinct - (b - a) - (b[g] - a[g])) * gap  # corrected below where both have a term
        below = np.searchsorted(keyed, np.arange(n) * (2 * PRECISION) + zero[g]) - a
        total += beyond(below, zero[g], a, b)  # terms of the peers
        total += beyond(np.searchsorted(mine, zero), zero, a[g], b[g])  # terms of the group
        own = rows[a[g] : b[g]]
        size = heads[terms[own] + 1] - heads[terms[own]]
        at = index[counted_ranges(heads[terms[own]], size)]
        p, q, peer = np.repeat(share_[own], size), share_[at], group[at]
        np.add.at(total, peer, np.abs(p - q) - np.abs(p - zero[peer]) - np.abs(zero[g] - q) + gap[peer])
        out.append(total.astype(np.int64).tobytes())
    return pa.table({"lang": peers["lang"], "place": peers["place"], "sums": pa.array(out, pa.binary())})


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.int64) for x in table["sums"])
    n = len(total)
    return pa.table({"lang": pa.array([table["lang"][0].as_py()] * n, pa.string()), "place": pa.array([table["place"][0].as_py()] * n, pa.int64()),
                     "peer": pa.array(np.arange(n)), "value": pa.array(total)})


def source_divergence(docs: DataFrame, min_docs: int = 30, top_terms: int = 50, lang: str = "lang", source: str = "source", text: str = "text",
                      block_rows: int = 1 << 18, held: int = 1 << 18) -> DataFrame:
    """(lang, source, part, item, value, rank): distances between the sources of each language, and the terms that mark each source.

    Terms are runs of ASCII letters (A-Z lower-cased) and of letters beyond ASCII. A language keeps those that `min_docs` of
    its documents have. The share of a term in a group of c occurrences is 1 + floor(10^9 (c + 5) / (N + 5 V)) with N the
    group's occurrences of all V kept terms. Part `pair`: for each other source of the language the sum over all V terms of the
    absolute differences, largest first. Part `term`: the `top_terms` terms of the source whose shares exceed the language's
    most. Ties are ordered by the bytes of the item. All sums are of whole numbers.

    A task counts its rows' terms before the shuffle, `held` entries at a time; so a hot source or word sends one row a flush.
    The distances are sums over blocks of about `block_rows` counts: a block is an index from terms to groups; each group's
    terms are scattered through it into one dense accumulator over its peers. No pairs of counts are listed; a block hands on
    one vector a group, as many bytes as eight times its peers.

    Null text, language and source are empty texts; a group without terms has all zero shares; a language without kept terms has
    distances 0; repeated ids and rows count each; an empty table gives no rows; other columns are ignored. A group's own sizes
    are the number of sources of its language, which one task must hold.
    """
    kept = stored(group_terms(docs, min_docs, lang, source, text, held))
    occurring = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))]).distinct()
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    known = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    langs = Window.partitionBy("lang")
    groups = occurring.join(sizes, ["lang", "source"], "left").join(known, "lang", "left").na.fill(0, ["total", "terms"]).select(
        "lang", "source", "total", "terms", F.sum("total").over(langs).alias("lang_total"), (F.row_number().over(langs.orderBy("source")) - 1).cast("long").alias("place"))
    zero = F.when(F.col("terms") == 0, F.lit(0).cast("long")).otherwise(share(F.lit(0), F.col("total"), F.col("terms")))
    groups = stored(groups.withColumn("zero", zero))
    shares = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))

    blocks = pieces_of(kept.count(), block_rows)
    block = F.pmod(F.xxhash64("lang", "term"), F.lit(blocks)).cast("int").alias("block")
    peers = groups.select(*[F.col(c).alias(c) for c in ("lang", "place", "zero")], F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    sums = shares.select("lang", block, "term", "place", "p").groupBy("lang", "block").cogroup(peers.groupBy("lang", "block")).applyInArrow(
        _accumulate, "lang string, place long, sums binary")
    distances = sums.groupBy("lang", "place").applyInArrow(_add, "lang string, place long, peer long, value long").where("place <> peer")
    names = groups.select("lang", "place", "source")
    other = names.withColumnsRenamed({"place": "peer", "source": "item"})
    pairs = distances.join(names, ["lang", "place"]).join(other, ["lang", "peer"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    over = shares.withColumn("value", F.col("p") - share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))).where("n > 0 and value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    marks = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", rank).where(F.col("rank") <= top_terms)
    return pairs.withColumn("rank", rank).unionByName(marks)
