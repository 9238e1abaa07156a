"""Append-only research ledger: facts as JSON lines, partitioned by kind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.evaluation import ratio
from ..schemas import LEDGER, require

HIT_THRESHOLD = 0.10


def signal_facts(signals: DataFrame) -> DataFrame:
    return signals.withColumn("type", F.lit("signal"))


def outcome_facts(closed: DataFrame, hit_threshold: float = HIT_THRESHOLD) -> DataFrame:
    """Closing facts with the hit flag stamped when they are written."""
    return closed.withColumn("type", F.lit("signal_outcome")).withColumn(
        "hit", F.col("outcome_return") >= hit_threshold
    )


def experiment_facts(experiments: DataFrame) -> DataFrame:
    return experiments.withColumn("type", F.lit("experiment"))


def as_ledger(*facts: DataFrame) -> DataFrame:
    """Facts of several kinds in the superset schema."""
    shaped = [
        f.select(*[
            F.col(field.name).cast(field.dataType).alias(field.name) if field.name in f.columns
            else F.lit(None).cast(field.dataType).alias(field.name)
            for field in LEDGER.fields
        ])
        for f in facts
    ]
    out = shaped[0]
    for other in shaped[1:]:
        out = out.unionByName(other)
    return out


def append_ledger(facts: DataFrame, path: str) -> None:
    """Append facts; one folder per kind, so a reader of one kind skips the others."""
    facts.write.mode("append").partitionBy("type").json(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def append_batch(facts: DataFrame, path: str, batch_id: int) -> bool:
    """Append the facts of a numbered batch once: False if the batch has been committed before.

    A batch has a folder of its own and, when all its files are there, a commit record. A batch that failed half way has no
    record: nobody reads its files, and the next attempt overwrites them. So a replayed micro-batch adds nothing, whatever
    the facts it brings, and readers never see part of one.
    """
    spark, record = facts.sparkSession, f"{path}/_commits/batch={batch_id}"
    if _exists(spark, f"{record}/_SUCCESS"):
        return False
    facts.write.mode("overwrite").partitionBy("type").json(f"{path}/batch={batch_id}")
    spark.range(1).select(F.lit(batch_id).cast("long").alias("number"), F.current_timestamp().alias("committed_at")).write.mode("overwrite").json(record)
    return True


def ledger_writer(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for a stream of facts in the ledger's schema."""

    def write(batch: DataFrame, batch_id: int) -> None:
        append_batch(as_ledger(batch), path, batch_id)

    return write


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The facts of all committed batches, with their number as `batch`; folders without a commit record are not scanned."""
    if not _exists(spark, f"{path}/_commits"):
        return spark.createDataFrame([], T.StructType([*LEDGER.fields, T.StructField("batch", T.LongType())]))
    committed = spark.read.schema("number long").json(f"{path}/_commits")
    facts = spark.read.schema(T.StructType([*LEDGER.fields, T.StructField("batch", T.LongType())])).json(path)
    return facts.join(committed.select(F.col("number").alias("batch")).distinct(), "batch", "left_semi").select(*LEDGER.fieldNames(), "batch")


def append_rows(rows: DataFrame, path: str, schema: T.StructType) -> None:
    """Append equity snapshots or experiment feedback as JSON lines in their declared columns."""
    require(rows, schema.fieldNames(), "ledger rows")
    rows.select(*schema.fieldNames()).write.mode("append").json(path)


def read_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def ledger_summary(ledger: DataFrame) -> DataFrame:
    kind = F.col("type")
    return ledger.agg(
        F.count_if(kind == "experiment").alias("experiments"),
        F.count_if(kind == "signal").alias("signals"),
        F.count_if(kind == "signal_outcome").alias("outcomes"),
    )


def recent_feedback(feedback: DataFrame, order: list[Column], limit: int = 500) -> DataFrame:
    """The last `limit` feedback rows, latest first."""
    return feedback.orderBy(*order).limit(limit)


def feedback_summary(feedback: DataFrame, order: list[Column], limit: int = 500) -> DataFrame:
    """Means over the last `limit` experiments; zeros when there are none."""
    recent = recent_feedback(feedback, order, limit)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    n = F.count(F.lit(1))
    return recent.agg(
        n.cast("double").alias("experiments"),
        ratio(F.count_if("accepted"), n).alias("acceptance_rate"),
        zero(F.avg("top_k_precision")).alias("mean_precision"),
        zero(F.avg("net_pnl")).alias("mean_pnl"),
    )
