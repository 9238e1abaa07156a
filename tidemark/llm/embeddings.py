"""Near-duplicate vectors by a forest of random projection trees with overlapping splits."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces_of, stored
from .components import components

_TREE = 1 << 40  # a leaf's number is tree * _TREE + node


def _unit(lists: pa.Array) -> np.ndarray:
    """Rows of unit length in double precision, of lists of equal length."""
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _project(trees: int, levels: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                rows = batch.filter(pa.array(sizes == size))
                directions = np.random.default_rng([seed, int(size)]).normal(size=(int(size), trees * levels))
                at = (_unit(rows.column("v")) @ directions).reshape(rows.num_rows * trees, levels)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(rows.column("rep").to_numpy(), trees)), pa.array(np.repeat(rows.column("size").to_numpy(), trees)),
                     pa.array(np.tile(np.arange(trees, dtype=np.int32), rows.num_rows)),
                     pa.ListArray.from_arrays(np.arange(0, at.size + 1, levels, dtype=np.int32), at.ravel())], ["rep", "size", "tree", "at"])

    return project


def _merged(root: np.ndarray, rows: np.ndarray, cols: np.ndarray, near: np.ndarray) -> None:
    """Join in `root` (the least member of everyone's component) the rows and columns that `near` links."""
    at = root[cols]
    apart = (near & (at != root[rows][:, None])).any(axis=1)
    for i, linked in zip(rows[apart], near[apart]):
        met = np.unique(np.append(root[cols[linked]], root[i]))
        if len(met) > 1:
            root[np.isin(root, met[1:])] = met[0]


def _connect(cosine: float, block: int = 1000) -> Callable[[pa.Table], pa.Table]:
    def connect(table: pa.Table) -> pa.Table:
        """Links (a, b) that connect the vectors of one leaf as all its pairs of that cosine do: each vector with the first of its component."""
        n, rep, x = table.num_rows, table["rep"].to_numpy(), _unit(table["v"].combine_chunks())
        root = np.arange(n)
        for a in range(0, n, block):
            for b in range(a, n, block):
                near = x[a : a + block] @ x[b : b + block].T >= cosine
                rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
                _merged(root, rows + a, cols + b, near[np.ix_(rows, cols)])
        moved = np.flatnonzero(root != np.arange(n))
        return pa.table({"a": rep[moved], "b": rep[root[moved]]})

    return connect


def _counted(cosine: float, block: int = 1000) -> Callable[[pa.Table], pa.Table]:
    def counted(table: pa.Table) -> pa.Table:
        """(rep, links): for each vector the copies it links with on the other side of its tasks (component, p, q), or on its own where side is 2."""
        table = table.sort_by([("component", "ascending"), ("p", "ascending"), ("q", "ascending")])
        task = np.stack([table[k].to_numpy() for k in ("component", "p", "q")])
        cuts = np.concatenate(([0], np.flatnonzero((task[:, 1:] != task[:, :-1]).any(axis=0)) + 1, [table.num_rows]))
        side, copies, links, v = table["side"].to_numpy(), table["copies"].to_numpy(), np.zeros(table.num_rows, np.int64), table["v"].combine_chunks()
        for start, stop in zip(cuts, cuts[1:]):
            x, here = _unit(v.slice(start, stop - start)), side[start:stop]
            left, right, own = np.flatnonzero(here != 1), np.flatnonzero(here != 0), bool((here == 2).any())
            for a in range(0, len(left), block):
                for b in range(a if own else 0, len(right), block):
                    rows, cols = left[a : a + block], right[b : b + block]
                    near = x[rows] @ x[cols].T >= cosine
                    if own and a == b:
                        np.fill_diagonal(near, False)
                    links[start + rows] += near @ copies[start + cols]
                    if not own or a != b:
                        links[start + cols] += near.T @ copies[start + rows]
        return pa.table({"rep": table["rep"], "links": links})

    return counted


def _described(table: pa.Table) -> pa.Table:
    """One row for a part: its mean direction, the largest angle of a member to it, and its copies."""
    x = _unit(table["v"].combine_chunks())
    mean = x.mean(axis=0)
    length = np.sqrt(mean @ mean)
    mean = mean / length if length > 1e-9 else x[0]
    return pa.table([table["component"][:1], table["part"][:1], pa.array([mean.tolist()], pa.list_(pa.float64())),
                     pa.array([float(np.arccos(np.clip(x @ mean, -1, 1)).max())]), pa.array([int(table["copies"].to_numpy().sum())])],
                    ["component", "part", "mean", "radius", "copies"])


def _links(placed: DataFrame, cosine: float, part_rows: int, values: int = 1 << 21) -> DataFrame:
    """(rep, links) of the vectors of components of several: how many copies of other vectors of its component each links with.

    Components of up to `part_rows` vectors are compared whole. Larger ones are cut along a tree into parts, an eighth of the component
    unless that is more than eight times `part_rows` vectors or `values` numbers. Two parts that lie so near each other, or so far,
    that all or none of their pairs link are not compared; all others are, pair by pair of parts, and give sums.
    """
    counts = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size")).where("n > 1")
    most = F.greatest(F.lit(1), F.least(F.greatest(F.lit(part_rows), F.least(F.lit(8 * part_rows), F.ceil(F.col("n") / 8))), F.floor(F.lit(values) / F.col("size"))))
    counts = stored(counts.select("component", "n", most.cast("long").alias("most")))
    columns = ["rep", "component", "copies", "v"]
    schema = "rep long, links long"
    whole = placed.join(counts.where("n <= most"), "component").select(*columns, *[F.lit(0).alias(k) for k in ("p", "q")], F.lit(2).alias("side"), "n")
    groups = pieces_of(counts.where("n <= most").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], part_rows)
    dealt = whole.withColumn("dealt", F.pmod(F.xxhash64("component"), F.lit(groups))).drop("n")
    out = dealt.groupBy("dealt").applyInArrow(_counted(cosine), schema)
    large = counts.where("n > most")
    if large.isEmpty():
        return out
    members = stored(placed.join(large, "component").select(*columns, "place", "most"))
    along = Window.partitionBy("component").orderBy(F.bin("place"))
    before = members.groupBy("component", "place").agg(F.count(F.lit(1)).alias("here"))
    before = before.withColumn("before", F.sum("here").over(along) - F.col("here"))
    part = F.floor((F.col("before") + F.pmod(F.xxhash64("rep"), F.col("here"))) / F.col("most")).cast("int")
    members = stored(members.join(before, ["component", "place"]).select(*columns, part.alias("part")))
    parts = stored(members.groupBy("component", "part").applyInArrow(_described, "component long, part int, mean array<double>, radius double, copies long"))
    one, other = (parts.select("component", F.col("part").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("mean", "radius", "copies")]) for k in "pq")
    inner = F.expr("aggregate(zip_with(mean_p, mean_q, (x, y) -> x * y), 0D, (s, c) -> s + c)")
    apart, spread, limit = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), inner))), F.col("radius_p") + F.col("radius_q"), math.acos(cosine)
    pairs = one.join(other, "component").where("p <= q").withColumns({"far": F.when(F.col("p") == F.col("q"), 0.0).otherwise(apart), "spread": spread})
    sure = F.col("far") + F.col("spread") < limit - 1e-6
    pairs = stored(pairs.where(F.col("far") - F.col("spread") <= limit + 1e-6).select("component", "p", "q", "copies_p", "copies_q", sure.alias("sure")))
    ends = F.when(F.col("p") == F.col("q"), F.array(F.struct(F.col("p").alias("part"), F.lit(2).alias("side"), F.col("copies_p").alias("met")))).otherwise(
        F.array(F.struct(F.col("p").alias("part"), F.lit(0).alias("side"), F.col("copies_q").alias("met")), F.struct(F.col("q").alias("part"), F.lit(1).alias("side"), F.col("copies_p").alias("met"))))
    ended = pairs.select("component", "p", "q", "sure", F.inline(ends))
    all_of = ended.where("sure").groupBy("component", "part").agg(F.sum("met").alias("met"), F.count_if(F.col("side") == 2).alias("own"))
    known = members.join(all_of, ["component", "part"]).select("rep", (F.col("met") - F.col("own") * F.col("copies")).alias("links"))
    open_ = members.join(ended.where("not sure"), ["component", "part"]).select(*columns, "p", "q", "side")
    return out.unionByName(known).unionByName(open_.groupBy("component", "p", "q").applyInArrow(_counted(cosine), schema))


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.9, trees: int = 12, leaf_rows: int = 1000, spill: float = 0.05, seed: int = 3,
                           id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept): links of cosine >= `cosine` found by a random projection forest.

    Equal vectors are compared as one, with their number. Each tree splits every node of more than `leaf_rows` vectors at the
    median along a random direction; the `spill` share on either side of the median goes to both halves. Vectors of one leaf
    are compared in double precision, and those linked become components. Within a component every pair counts, whether a
    leaf brought it together or not: `_links` compares all of them, without listing pairs. So what the forest may miss is
    that two components are one.

    Null and zero vectors and those with null or non-finite components link with nothing, nor do vectors of different
    lengths with each other; repeated rows of one vec_id come back each; null ids come back with null component and kept
    true; an empty table gives no rows; other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    sound = F.coalesce((F.size("v") > 0) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("v", lambda c: c != 0), F.lit(False))
    sound = sound & F.col("vec_id").isNotNull()
    distinct = stored(rows.where(sound).groupBy("v").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
                      .select(F.monotonically_increasing_id().alias("rep"), "first_id", "v", "copies", F.size("v").alias("size")))
    total = distinct.count()
    levels = 3 + max(0, math.ceil(math.log(max(total, 1) / leaf_rows) / -math.log(0.5 + spill)))
    active = stored(distinct.select("rep", "size", "v").mapInArrow(_project(trees, levels, seed), "rep long, size int, tree int, at array<double>")
                    .withColumn("node", F.lit(1).cast("long")))
    leaves = None
    for level in range(levels + 1):
        x = F.col("at")[level if level < levels else 0]
        cuts = stored(active.groupBy("tree", "size", "node").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(x, [0.5 - spill, 0.5 + spill], 10_000).alias("cut")))
        last = level == levels
        done = active.join(cuts.where(F.lit(last) | (F.col("n") <= leaf_rows)).select("tree", "size", "node"), ["tree", "size", "node"])
        done = stored(done.select("rep", "size", (F.col("tree") * F.lit(_TREE) + F.col("node")).alias("leaf")))
        leaves = done if leaves is None else leaves.unionByName(done)
        if last or cuts.where(F.col("n") > leaf_rows).isEmpty():
            break
        split = active.join(cuts.where(F.col("n") > leaf_rows), ["tree", "size", "node"])
        sides = F.array_compact(F.array(F.when(x < F.col("cut")[1], F.lit(0)), F.when(x >= F.col("cut")[0], F.lit(1))))
        active = stored(split.withColumn("side", F.explode(sides)).select("rep", "size", "tree", "at", (F.col("node") * 2 + F.col("side")).alias("node")))
    met = distinct.join(leaves, ["rep", "size"]).select("rep", "size", "v", "leaf")
    placed = components(met.groupBy("size", "leaf").applyInArrow(_connect(cosine), "a long, b long")).withColumnRenamed("node", "rep")
    first_tree = leaves.where(F.col("leaf") < _TREE).groupBy("rep").agg(F.min("leaf").alias("place"))
    placed = stored(distinct.join(placed, "rep", "left").join(first_tree, "rep", "left").select(
        "rep", "first_id", "v", "size", "copies", "place", F.coalesce("component", "rep").alias("component")))
    least = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    counted = _links(placed, cosine, leaf_rows).groupBy("rep").agg(F.sum("links").alias("links"))
    named = placed.join(least, "component").join(counted, "rep", "left").select(
        "v", F.col("component_id").alias("_component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"))
    good = rows.where(sound).join(named, "v").select("vec_id", F.col("_links").alias("n_links"), F.col("_component").alias("component_id"))
    alone = rows.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
