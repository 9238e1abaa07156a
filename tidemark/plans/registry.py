"""Registry of named queries: a Spark callable, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import rounded
from .domain_sql import with_tables

Build = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Build] = {}
SQL: dict[str, str] = {}


def comparable(df: DataFrame, digits: int = 6, per_column: dict[str, int] | None = None) -> DataFrame:
    """Engine-neutral output: fixed-digit doubles, 64-bit integers, ISO text for times, joined text for arrays."""
    shown = []
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.DoubleType):
            c = rounded(c, (per_column or {}).get(field.name, digits))
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(kind, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(kind, T.ArrayType):
            c = F.array_join(c, ",")
        shown.append(c.alias(field.name))
    return df.select(*shown)


def query(name: str, sql: str | None = None, tables: tuple[str, ...] = (), digits: int = 6,
          per_column: dict[str, int] | None = None, recursive: bool = False) -> Callable[[Build], Build]:
    """Register `build`; `tables` are the derived market tables the SQL reads; `recursive` SQL has a recursive table."""

    def add(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: comparable(build(spark, sf_dir), digits, per_column)
        if sql is not None:
            SQL[name] = with_tables(sql, tables, recursive)
        return build

    return add
