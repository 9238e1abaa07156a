"""Proportional stratified interleaving of rows into shards, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces_of, stored


def _counted_ranks(rows: DataFrame, within: list[str], bucket: Column, order: list, out: str) -> DataFrame:
    """Number rows 1, 2, ... within the `within` columns by `order`, of which `bucket` must be a monotone coarse form.

    Rows are numbered inside a bucket and shifted by the number of rows in the buckets before, so no task sorts a whole
    stratum however large it is.
    """
    rows = rows.withColumn("_bucket", bucket)
    counts = rows.groupBy(*within, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*within)
    shifts = counts.select(*[F.col(c).alias(f"_by_{c}") for c in within], F.col("_bucket").alias("_at"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"), F.sum("_n").over(whole).alias(f"{out}_of"))
    same = F.col("_bucket") == F.col("_at")
    for c in within:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    inside = Window.partitionBy(*within, "_bucket").orderBy(*order)
    ranked = rows.withColumn("_inside", F.row_number().over(inside)).join(shifts, same)
    return ranked.withColumn(out, F.col("_shift") + F.col("_inside")).drop("_bucket", "_at", "_inside", "_shift", *[f"_by_{c}" for c in within])


def interleave_shards(docs: DataFrame, shards: int = 8, seed: int = 42, stratum: str = "source", id_col: str = "doc_id",
                      text: str = "text", bucket_rows: int = 20_000) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): every shard holds the mixture of the strata.

    Rows of a stratum are shuffled by the md5 of seed and id and numbered; row r of n gets the fractional rank
    (2r - 1) / 2n. All rows are sorted by it (ties: stratum, shuffle key, text checksum, size) and cut into `shards`
    runs whose row counts differ by one at most (law `rows`), so each run takes its share of each stratum.

    Null text has size 1 and checksum 0; null ids shuffle as the empty text and null strata form a stratum of their own;
    repeated rows keep one place each; an empty table gives no rows; other columns are ignored.
    """
    text_of = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(stratum).alias("_stratum"),
        (F.octet_length(text_of) + 1).cast("long").alias("size"), F.crc32(text_of.cast("binary")).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")).alias("_key"))
    rows = stored(rows)
    total = rows.count()
    buckets = max(64, pieces_of(total, bucket_rows))
    ties = [F.col("_stratum").asc_nulls_first(), "_key", "text_crc32", "size"]
    # The first 8 hex digits of the key, scaled to the number of buckets: monotone in the key.
    coarse = F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * buckets / F.lit(16**8)).cast("int")
    ranked = _counted_ranks(rows, ["_stratum"], coarse, ["_key", "text_crc32", "size"], "_rank")
    ranked = stored(ranked.withColumn("_part", (2 * F.col("_rank") - 1).cast("double") / (2 * F.col("_rank_of")).cast("double")))
    placed = _counted_ranks(ranked.withColumn("_all", F.lit(0)), ["_all"], F.floor(F.col("_part") * buckets).cast("int"), ["_part", *ties], "_place")
    at = F.col("_place") - 1
    shard = F.expr(f"(_place - 1) * {shards} div {max(1, total)}")
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (at - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
