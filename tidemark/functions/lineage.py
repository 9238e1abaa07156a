"""Cutting long lineages through tables in the shared checkpoint folder, and removing those tables after use."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir

_owners: list[list[str]] = []


def written(df: DataFrame) -> DataFrame:
    """Write `df` once as parquet under the session's checkpoint folder and read it back.

    Unlike a cache it survives lost executors; unlike an RDD checkpoint later readers prune columns and push filters,
    and joins see its true size. Inside `released` the table goes when the block ends, else it stays.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    if _owners:
        _owners[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Delete all tables that `written` made inside the block; results must be read or stored before it ends."""
    _owners.append([])
    try:
        yield
    finally:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for path in _owners.pop():
            place = hadoop.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
