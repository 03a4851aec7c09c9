"""Reading uploaded and typed tables."""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.identity import strip
from ..functions.metadata import InputError

# The text of a CSV record that does not have the fields of the header.
RECORD = "_record"
# Position of a row in its source: file, byte offset of the block, then order inside the block.
ROW = "_row"


def _row_position():
    return F.struct(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    ).alias(ROW)


def spread(frame: DataFrame) -> DataFrame:
    """Rows dealt over all shuffle partitions by their position, for steps that sort or explode them.

    A small file may hold many rows, and one of them would else be the work of one task.
    """
    return frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), ROW)


def as_text(frame: DataFrame) -> DataFrame:
    """Every column as trimmed text, blank as NULL; column names trimmed."""
    if ROW in frame.columns:
        raise InputError(f"{ROW} is a reserved column name.")
    return frame.select(
        *[F.nullif(strip(F.col(f"`{c}`").cast("string")), F.lit("")).alias(c.strip()) for c in frame.columns], _row_position()
    )


def _surplus(record: Column, fields: int, sep: str) -> Column:
    """Whether a CSV record has more fields than the header: it is counted by separators outside quoted cells."""
    mark = re.escape(sep)
    bare = F.regexp_replace(record, rf'(^|{mark})\s*"[^"]*(?:""[^"]*)*"', "$1")
    return F.regexp_count(bare, F.lit(mark)) >= fields


def _header(spark: SparkSession, path: str, sep: str, encoding: str) -> list[str]:
    first = spark.read.option("encoding", encoding).text(path).limit(1).collect()
    if not first:
        raise InputError(f"{path} is empty.")
    header = [h.strip().lstrip("\ufeff") for h in next(csv.reader([first[0][0]], delimiter=sep))]
    named = [h for h in header if h]
    if len(set(named)) < len(named):
        raise InputError(f"{path} names a column twice.")
    if RECORD in named:
        raise InputError(f"{RECORD} is a reserved column name.")
    return [h or f"_unnamed_{i}" for i, h in enumerate(header)]


def read_table(
    spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", rows: int | None = None, line_breaks: bool = True
) -> DataFrame:
    """A CSV, Parquet or JSON table as text columns plus the row position, with the usual upload checks.

    A CSV cell in quotes may hold line breaks. To know where a row ends a file is then read from its start by one task;
    ``line_breaks=False`` is for large files without such cells and lets them be split. A row with more fields than the
    header is an error; missing fields at the end of a row are NULL.
    """
    checks = [F.count("*").alias("_n")]
    if path.rstrip("/").endswith(".parquet"):
        raw = spark.read.parquet(path)
    elif path.rstrip("/").endswith(".json"):
        raw = spark.read.json(path)
    else:
        names = _header(spark, path, sep, encoding)
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, RECORD]])
        raw = spark.read.csv(
            path, schema=schema, header=True, sep=sep, encoding=encoding, enforceSchema=True, multiLine=line_breaks,
            ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, escape='"', columnNameOfCorruptRecord=RECORD,
        )
        # Spark tells the fields of a record only where all columns are read.
        checks.append(F.max(F.xxhash64(*[F.col(f"`{n}`") for n in names])).alias("_all"))
        checks.append(F.min(F.when(_surplus(F.col(RECORD), len(names), sep), F.col(RECORD))).alias("_bad"))
    frame = as_text(raw)
    blank = [c for c in frame.columns if c.startswith("_unnamed_")]
    checked = frame.agg(*checks, *[F.count(F.col(c)).alias(c) for c in blank]).first()
    if not checked["_n"]:
        raise InputError(f"{path} has no rows.")
    if len(checks) > 1 and checked["_bad"] is not None:
        raise InputError(f"{path} has a row with more fields than the header: {checked['_bad'][:200]}")
    frame = frame.drop(RECORD, *[c for c in blank if not checked[c]])
    return frame if rows is None else frame.orderBy(ROW).limit(rows)


def restore_types(frame: DataFrame, numeric: list[str], missing: list[str]) -> DataFrame:
    """Numbers back from text and blank text back to NULL."""
    fixed = {c: F.col(c).try_cast("double") for c in numeric}
    return frame.withColumns({**fixed, **{c: F.nullif(F.col(c), F.lit("")) for c in missing}})


def read_typed(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """A typed CSV or Parquet table, pruned to ``columns``."""
    if path.rstrip("/").endswith(".parquet"):
        frame = spark.read.parquet(path)
        frame = frame.select(*[F.col(f.name).cast(f.dataType) for f in schema])
    else:
        frame = spark.read.schema(schema).csv(path, header=True)
    return frame.select(*columns) if columns else frame
