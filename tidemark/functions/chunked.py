"""Windows over keys that may be very long.

A window partitioned by symbol alone puts all of one symbol's rows into one task. The two helpers
here split each key at a chunk column (a function of the order columns that never decreases, such as
the calendar year of a bar) and still give exactly the unsplit result:

* ``over_chunks``  - bounded row frames (lag, lead, trailing means): each chunk also receives copies of
  the last/first few rows of its neighbours.
* ``running``      - unbounded running sum/max/min/product/last known value: per-chunk running values plus the
  carry of all earlier chunks.

Only the chunk summaries, a handful of rows per key and chunk, are ever grouped by the bare key. Both helpers read
their input twice, so give them a stored table, a plain scan, or the result of ``lineage.written``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .lineage import written

CHUNK, OWN = "_chunk", "_own"

_RUNNING = {
    "sum": (F.sum, lambda own, carry: own + F.coalesce(carry, F.lit(0.0))),
    "count": (F.sum, lambda own, carry: own + F.coalesce(carry, F.lit(0))),
    "max": (F.max, lambda own, carry: F.greatest(own, carry)),
    "min": (F.min, lambda own, carry: F.least(own, carry)),
    "product": (F.product, lambda own, carry: own * F.coalesce(carry, F.lit(1.0))),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda own, carry: F.coalesce(own, carry)),
}


def _total(kind: str, column: str, order: list[str]) -> Column:
    """A chunk's own aggregate. A grouping has no order, so the last known value is picked by the order columns."""
    if kind == "last":
        return F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(*order)))
    return _RUNNING[kind][0](F.col(column))


def _rim(base: DataFrame, keys: list[str], order: list[str], n: int, leading: bool) -> DataFrame:
    """Copies of the n rows that precede (leading) or follow each chunk, tagged with that chunk."""
    if n == 1:
        return _rim_of_one(base, keys, order, leading)
    direction = [F.col(o).desc() if leading else F.col(o).asc() for o in order]
    edge = Window.partitionBy(*keys, CHUNK).orderBy(*direction)
    rest = [c for c in base.columns if c not in {*keys, CHUNK, *order}]
    rows = (
        base.withColumn("_n", F.row_number().over(edge))
        .filter(F.col("_n") <= n)  # becomes a window group limit: pruned before the shuffle
        .groupBy(*keys, CHUNK)
        .agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias("_edge"))
    )
    # Every chunk listed here holds at least one row, so n chunks away is always far enough.
    frame = (-n, -1) if leading else (1, n)
    neighbours = F.flatten(F.collect_list("_edge").over(Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(*frame)))
    rows = rows.select(*keys, CHUNK, neighbours.alias("_edge"))
    kept = F.slice("_edge", -n, n) if leading else F.slice("_edge", 1, n)
    kept = F.when(F.size("_edge") > n, kept).otherwise(F.col("_edge"))
    return rows.select(*keys, CHUNK, F.inline(kept))


def _rim_of_one(base: DataFrame, keys: list[str], order: list[str], leading: bool) -> DataFrame:
    """The single-row rim needs no sort: an aggregate picks each chunk's last or first row."""
    at = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    pick = F.max_by if leading else F.min_by
    rest = [c for c in base.columns if c not in {*keys, CHUNK}]
    rows = base.groupBy(*keys, CHUNK).agg(*[pick(c, at).alias(c) for c in rest])
    w = Window.partitionBy(*keys).orderBy(CHUNK)
    beside = (lambda c: F.lag(c).over(w)) if leading else (lambda c: F.lead(c).over(w))
    shifted = rows.select(*keys, CHUNK, *[beside(c).alias(c) for c in rest])
    return shifted.filter(F.col(order[0]).isNotNull())


def over_chunks(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column,
    compute: Callable[[DataFrame, WindowSpec], DataFrame],
    before: int = 0,
    after: int = 0,
    needs: list[str] | None = None,
) -> DataFrame:
    """Run `compute(frame, window)` with `before`/`after` rows of context around every chunk.

    `needs` lists the columns the frames read; the copied rows carry only those. The order columns must be
    unique within a key.
    """
    base = df.withColumn(CHUNK, chunk)
    framed = base.withColumn(OWN, F.lit(True))
    context = base.select(*dict.fromkeys([*keys, CHUNK, *order, *(needs or df.columns)]))
    for n, leading in ((before, True), (after, False)):
        if n:
            copies = _rim(context, keys, order, n, leading).withColumn(OWN, F.lit(False))
            framed = framed.unionByName(copies, allowMissingColumns=True)
    window = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    return compute(framed, window).filter(F.col(OWN)).drop(OWN, CHUNK)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column,
    measures: dict[str, tuple[str, str]],
) -> DataFrame:
    """Add running aggregates {name: (kind, column)}, inclusive of the current row."""
    base = df.withColumn(CHUNK, chunk)
    own = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    local = base.withColumns(
        {name: _RUNNING[kind][0](F.col(column)).over(own) for name, (kind, column) in measures.items()}
    )
    totals = base.groupBy(*keys, CHUNK).agg(
        *[_total(kind, column, order).alias(f"_t_{name}") for name, (kind, column) in measures.items()]
    )
    carry = totals.select(
        *keys, CHUNK,
        *[_RUNNING[kind][0](F.col(f"_t_{name}")).over(earlier).alias(f"_c_{name}") for name, (kind, _) in measures.items()],
    )
    out = local.join(carry, [*keys, CHUNK], "left")
    out = out.withColumns(
        {name: _RUNNING[kind][1](F.col(name), F.col(f"_c_{name}")) for name, (kind, _) in measures.items()}
    )
    return out.drop(CHUNK, *[f"_c_{name}" for name in measures])


def ordinal(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """0-based position of every row in the total order `order` (NULLs last), plus the row count as `n_rows`.

    Rows are dealt by sampled ranges of the order columns and stored with the number of their range, so the ranges stay
    as they fell; each range is numbered on its own and shifted by the size of all earlier ones (one row per range). Rows
    that agree in all order columns share a range and are numbered in any order.
    """
    by = [F.col(c).asc_nulls_last() for c in order]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(ranges, *by).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    total = sizes.agg(F.sum("_size")).scalar()
    inside = Window.partitionBy("_range").orderBy(*by)
    return (
        dealt.withColumn("_i", F.row_number().over(inside))
        .join(offsets, "_range")
        .withColumn(name, F.col("_offset") + F.col("_i") - 1)
        .withColumn("n_rows", total)
        .drop("_range", "_i", "_offset")
    )
