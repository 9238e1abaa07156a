"""Near-duplicate documents by min-max hashing: minimum and maximum of every permutation, banded, confirmed on full sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, lowered, mix, rolled, sieved, slices, span_hashes, stored, utf8, words
from .components import components, joined


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the word shingles of every text, one text after another, and the n + 1 offsets.

    Words are lower-cased (A-Z). A text with fewer words than `width` has its whole sequence as its one shingle; a text
    without words has none.
    """
    data = lowered(data)
    starts, ends, first = words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    rolls = rolled(hashes, width)
    sets = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            sets.append(np.unique(rolls[a : b - width + 1]))
        else:
            sets.append(mix(rolled(hashes[a:b], b - a) + U64(int(b - a))) if b > a else hashes[:0])
    return np.concatenate([hashes[:0], *sets]), np.concatenate(([0], np.cumsum([len(s) for s in sets], dtype=np.int64)))


def min_max(values: np.ndarray, first: np.ndarray, permutations: int, seed: int) -> np.ndarray:
    """(2 * permutations, sets) array: the least and the largest value of every non-empty set under each permutation."""
    keys = mix(np.arange(1, 2 * permutations + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))
    out = np.empty((2 * permutations, len(first)), U64)
    for p in range(permutations):
        hashed = (values ^ keys[2 * p]) * (keys[2 * p + 1] | U64(1))
        np.minimum.reduceat(hashed, first, out=out[2 * p])
        np.maximum.reduceat(hashed, first, out=out[2 * p + 1])
    return out


def _sign(width: int, bands: int, rows: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values, at = shingle_sets(*utf8(batch.column("text")), width)
            size = np.diff(at)
            full = np.flatnonzero(size)
            keys = np.zeros((len(full), bands), U64)
            set_a, set_b = np.zeros(len(size), U64), np.zeros(len(size), U64)
            if len(full):
                signature = min_max(values, at[full], (bands * rows + 1) // 2, seed)
                for band in range(bands):
                    key = np.full(len(full), U64(band + 1))
                    for value in signature[band * rows : (band + 1) * rows]:
                        key = mix(key ^ value) + U64(band)
                    keys[:, band] = key
                set_a[full] = np.add.reduceat(mix(values), at[full])
                set_b[full] = np.add.reduceat(mix(values ^ U64(0x5851F42D4C957F2D)), at[full])
            lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(np.where(size > 0, bands, 0)))).astype(np.int32), keys.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(set_a.view(np.int64)), pa.array(set_b.view(np.int64)), lists],
                                             ["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return sign


def _sets(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values, at = shingle_sets(*utf8(batch.column("text")), width)
            raw = [values[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "shingles"])

    return sets


def _confirm(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("shingles_a"), batch.column("shingles_b")):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int(np.count_nonzero(y[at] == x))
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return confirm


def _compare(percent: int) -> Callable[[pa.Table], pa.Table]:
    def compare(table: pa.Table) -> pa.Table:
        """Links between the documents of two blocks of a bucket (or within one) that lie in different components: a spanning forest of them."""
        mine = table["block"].to_numpy()
        p, q = table["p"][0].as_py(), table["q"][0].as_py()
        sides = []
        for block in (p, q):
            rows = np.flatnonzero(mine == block)
            raw = [np.frombuffer(table["shingles"][int(r)].as_buffer(), U64) for r in rows]
            sides.append((rows, np.repeat(np.arange(len(rows)), [len(x) for x in raw]), np.concatenate([np.zeros(0, U64), *raw])))
        (rows, row_of, left), (cols, col_of, right) = sides
        a, c, n = (table[k].to_numpy() for k in ("a", "c", "n"))
        shared = np.intersect1d(left, right)
        common = np.zeros((len(rows), len(cols)), np.float32)
        for at in range(0, len(shared), 2048):
            part = shared[at : at + 2048]
            grids = []
            for many, owner, values in ((len(rows), row_of, left), (len(cols), col_of, right)):
                place = np.minimum(np.searchsorted(part, values), len(part) - 1)
                here = part[place] == values
                grid = np.zeros((many, len(part)), np.float32)
                grid[owner[here], place[here]] = 1
                grids.append(grid)
            common += grids[0] @ grids[1].T
        linked = (100 * common >= percent * (n[rows][:, None] + n[cols][None, :] - common)) & (c[rows][:, None] != c[cols][None, :])
        root = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        links = []
        for i, j in zip(*np.nonzero(linked)):
            x, y = find(int(c[rows[i]])), find(int(c[cols[j]]))
            if x != y:
                root[max(x, y)] = min(x, y)
                links.append((int(a[rows[i]]), int(a[cols[j]])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return compare


def _open_links(met: DataFrame, found: DataFrame, sets: DataFrame, percent: int, block_sets: int = 512, block_shingles: int = 1 << 18) -> DataFrame:
    """Links between documents of a bucket that are not connected yet; buckets of two are settled by the star.

    Buckets of other bands with the same members say the same once. A bucket is cut into blocks by the hash of the id, and
    every two blocks meet in a task of bounded size, which counts common shingles and returns a forest of the links only.
    """
    placed = met.where("members > 2").join(found.withColumnRenamed("node", "a"), "a", "left").select("band", "a", "n", F.coalesce("component", "a").alias("c"))
    mixed = placed.groupBy("band").agg(
        F.count(F.lit(1)).alias("members"), F.sum("n").alias("volume"), F.min("c").alias("c_min"), F.max("c").alias("c_max"),
        F.sum(F.xxhash64("a").cast("decimal(20,0)")).alias("sum_a"), F.sum(F.xxhash64("a", "n").cast("decimal(20,0)")).alias("sum_b")).where("c_min <> c_max")
    once = mixed.groupBy("members", "volume", "sum_a", "sum_b").agg(F.min("band").alias("band"))
    cut = F.greatest(F.ceil(F.col("members") / block_sets), F.ceil(F.col("volume") / block_shingles)).cast("int")
    rows = placed.join(once.select("band", cut.alias("blocks")), "band").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    rows = rows.join(sets.withColumnRenamed("doc_id", "a"), "a").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("band", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "a", "n", "c", "shingles")
    return rows.groupBy("band", "p", "q").applyInArrow(_compare(percent), "a long, b long").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("shingles_a"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("shingles_b"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "shingles_a", "shingles_b")
    return both.mapInArrow(_confirm(percent), "a long, b long, linked boolean").where("linked").drop("linked")


def minhash_groups(docs: DataFrame, percent: int = 85, width: int = 5, bands: int = 26, rows: int = 5, seed: int = 1,
                   id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): groups of documents linked by 100 * intersection >= percent * union.

    A document's set holds its distinct `width`-word shingles (lower-cased A-Z; with fewer words the whole sequence as
    one). Each of bands * rows / 2 permutations gives two signature values, its minimum and its maximum, either of which
    agrees between two sets with the probability of their similarity. Documents with equal sets form a class; classes that
    share the values of a band meet in a bucket. Each class of a bucket is first compared with the bucket's smallest
    document; the links are confirmed on the full sets and joined to components. Then documents of a bucket that still lie
    in different components are compared block by block, so every pair of a bucket is either connected or compared,
    without listing the pairs of a group of copies. At a similarity of 0.85, 26 bands of 5 values miss a pair with probability 3e-7.

    component_id is the smallest doc_id reachable, kept marks that document. Null and empty texts and texts without words
    have n_shingles 0 and stand alone; rows with a null doc_id come back with null component_id and kept true; rows that
    repeat a doc_id come back each, the id being linked when any of its texts is; an empty table gives no rows; other
    columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = stored(texts.mapInArrow(_sign(width, bands, rows, seed), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"))
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("doc"))
    marks = usable.join(classes.withColumnRenamed("doc", "doc_id"), ["doc_id", "set_a", "set_b", "n_shingles"], "left_semi")
    marks = marks.dropDuplicates(["doc_id", "set_a", "set_b"]).select("doc_id", "n_shingles", F.explode("bands").alias("band"))
    hot = marks.groupBy("band").agg(F.count(F.lit(1)).alias("members"), F.min("doc_id").alias("least")).where("members > 1")
    met = stored(marks.join(hot, "band").select("band", "members", "least", F.col("doc_id").alias("a"), F.col("n_shingles").alias("n")))
    needed = met.select(F.col("a").alias("doc_id")).distinct()
    # An inner join: a semi join would be pushed below the sieve. The needed ids are distinct.
    sets = stored(sieved(texts, needed, "doc_id").join(needed, "doc_id").select("doc_id", "text").mapInArrow(_sets(width), "doc_id long, shingles binary").dropDuplicates(["doc_id", "shingles"]))
    star = met.where("a <> least").select("a", F.col("least").alias("b")).distinct()
    links = stored(_confirmed(star, sets, percent))
    found = components(links)
    more = stored(_open_links(met, found, sets, percent))
    if not more.isEmpty():
        found = joined(found, more)
    named = classes.join(found.withColumnRenamed("node", "doc"), "doc", "left").select("set_a", "set_b", "n_shingles", F.coalesce("component", "doc").alias("component_id"))
    out = signed.drop("bands").join(named, ["set_a", "set_b", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
