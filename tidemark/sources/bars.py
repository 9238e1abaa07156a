"""Bar readers and the normal form of OHLCV rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import known, number
from ..functions.strings import strip
from ..operators.quality import enforce
from ..schemas import BAR_COLUMNS, BARS, PRICE_COLUMNS, require

INGEST_ORDER = "ingest_order"


def read_bars(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str = "parquet",
    symbols: Sequence[str] | None = None,
    start: str | None = None,
    end: str | None = None,
    columns: Mapping[str, Column] | None = None,
    ingest_order: bool = False,
    **options: str,
) -> DataFrame:
    """OHLCV rows of `symbols` in [start, end] from csv, json, parquet or orc files.

    `columns` maps the bar columns to expressions when a file uses its own names. Filters on plain columns reach
    the scan of columnar formats. With `ingest_order` parquet rows also get the column of that name: their file's path and their
    number in it, by which later rows replace earlier ones where no column tells (see normalize_ohlcv). It is the same however
    files are split; files count in the order of their paths.
    """
    if ingest_order and fmt != "parquet":
        raise ValueError("only parquet files number their rows")
    if fmt not in {"csv", "json", "parquet", "orc"}:
        raise ValueError(f"unsupported bar format {fmt!r}")
    reader = spark.read.format(fmt).options(**options)
    if columns is None and fmt in {"csv", "json"}:
        reader = reader.schema(BARS)  # declared, never inferred
        if fmt == "csv":
            reader = reader.option("header", "true")
    frame = reader.load(path if isinstance(path, str) else list(path))
    place = [F.struct("_metadata.file_path", "_metadata.row_index").alias(INGEST_ORDER)] if ingest_order else []
    if columns is not None:
        frame = frame.select(*[columns[name].alias(name) for name in BAR_COLUMNS], *place)
    elif place:
        frame = frame.select("*", *place)
    require(frame, BAR_COLUMNS, "bars")
    if symbols is not None:
        frame = frame.filter(F.col("symbol").isin(list(symbols)))
    kind = frame.schema["timestamp"].dataType
    if start is not None:
        frame = frame.filter(F.col("timestamp") >= F.lit(start).cast(kind))
    if end is not None:
        frame = frame.filter(F.col("timestamp") <= F.lit(end).cast(kind))
    return frame


def keep_last(df: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """Last row per key in ingest order, as an aggregate that combines before the shuffle; `seq` must be unique."""
    order = F.col(seq[0]) if len(seq) == 1 else F.struct(*seq)
    rest = [c for c in df.columns if c not in {*keys, *seq}]
    if list(seq) == [INGEST_ORDER] and isinstance(df.schema[INGEST_ORDER].dataType, T.StructType):  # numbers alone decide inside a file, in fixed-width buffers; then a row a file is left
        numbered = df.select(*keys, *rest, F.col(f"{INGEST_ORDER}.file_path").alias("_file"), F.col(f"{INGEST_ORDER}.row_index").alias("_row"))
        df = numbered.groupBy(*keys, "_file").agg(*[F.max_by(c, "_row").alias(c) for c in rest])
        order = F.col("_file")
    return df.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in rest])


def normalize_ohlcv(rows: DataFrame, seq: Sequence[str] = (INGEST_ORDER,)) -> DataFrame:
    """Seven typed columns, upper-case symbols, no negatives, one row per (symbol, timestamp): the last ingested.

    `seq` are the columns that tell the order; by default that of the files, which `read_bars(ingest_order=True)` adds. Row order is not part of the result; operators order by timestamp themselves.
    """
    require(rows, [*BAR_COLUMNS, *seq], "bars")
    kind = rows.schema["timestamp"].dataType.typeName()
    stamp = F.col("timestamp") if kind in {"date", "timestamp", "timestamp_ntz"} else F.col("timestamp").cast("timestamp")
    typed = rows.select(
        strip(F.upper("symbol")).alias("symbol"),
        stamp.alias("timestamp"),
        *[known(F.col(c).cast("double")).alias(c) for c in PRICE_COLUMNS],
        *seq,
    )
    negative = F.coalesce(F.least(*PRICE_COLUMNS) < 0, F.lit(False))
    checked = enforce(typed, {"OHLCV values cannot be negative": negative}, "fail", "bar")
    return keep_last(checked, ["symbol", "timestamp"], list(seq)).select(*BAR_COLUMNS)


ALIASES = {"time": "timestamp", "datetime": "timestamp", "ticker": "symbol", "code": "symbol"}


def records_to_bars(records: DataFrame) -> DataFrame:
    """Rename common aliases, coerce numbers, and drop rows that lack any bar column."""
    named = records.withColumnsRenamed({k: v for k, v in ALIASES.items() if k in records.columns})
    require(named, BAR_COLUMNS, "market payload")
    kind = named.schema["timestamp"].dataType.typeName()
    stamp = F.col("timestamp").cast("timestamp") if kind == "string" else F.col("timestamp")
    typed = named.withColumn("timestamp", stamp).withColumns({c: number(c) for c in PRICE_COLUMNS})
    return typed.na.drop(subset=list(BAR_COLUMNS))


def collect_universe(bars: DataFrame, universe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bars of universe symbols, one-row coverage): symbols without rows are counted, and none at all is an error."""
    present = bars.join(universe.select("symbol").distinct(), "symbol", "left_semi")
    found = present.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))
    counted = universe.select("symbol").distinct().join(found, "symbol", "left")
    coverage = counted.agg(
        F.count(F.lit(1)).alias("universe"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.count_if(F.col("rows").isNull()).alias("failed_symbols"),
    )
    none = F.raise_error(F.lit("no market rows returned for any symbol")).cast("boolean")
    return present, coverage.filter(F.when(F.col("rows") == 0, none).otherwise(F.lit(True)))


def read_tolerant(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(bars, report) of a folder of parquet files by symbol (`symbol=A/...`), some of which may be broken.

    Files that cannot be read are skipped. The report has a row a symbol with a folder: files, failed_files (those that gave no row)
    and rows. It lists the folder without reading any content, and takes the rest from the files the rows came from. A file
    that breaks off gives the rows before the break and does not count as failed; one of no bytes is not a file here. No row at all is an error when the report is read.
    """
    file = F.col("_metadata.file_path").alias("_file")
    bars = spark.read.schema(BARS).option("ignoreCorruptFiles", "true").parquet(path)
    found = bars.select(file).groupBy("_file").agg(F.count(F.lit(1)).alias("_rows"))
    listed = spark.read.format("binaryFile").load(path).select(F.col("symbol").cast("string").alias("symbol"), file)
    report = listed.join(found, "_file", "left").groupBy("symbol").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("_rows").isNull()).alias("failed_files"),
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"),
    )
    none = F.raise_error(F.lit("no market rows returned for any symbol")).cast("boolean")
    some = report.agg(F.sum("rows") > 0).scalar()
    return bars, report.filter(F.when(some, F.lit(True)).otherwise(none))
