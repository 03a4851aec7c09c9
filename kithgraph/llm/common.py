"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import step_folder, tune

# Arrow batches stay small enough for very long documents.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}
# Bytes that separate words: white space.
SPACES = rb"\x20\x09-\x0D"
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that the operators are written for."""
    tune(spark)
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for tables of steps, under the shared folder of the cluster."""
    return f"{step_folder(spark)}/{name}-{uuid.uuid4().hex}"


def word_count(text: Column) -> Column:
    """Number of words between white space; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def lower_ascii(text: bytes) -> bytes:
    """A-Z lower-cased and nothing else (bytes.lower does not touch other letters)."""
    return text.lower()


# DuckDB has no CRC-32: its table of 256 remainders from the polynomial, and a fold over the UTF-8 bytes of a text.
CRC_TABLE = """crc_table as (select list(c order by i) as remainders from (
    select i, list_reduce([i::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
    from range(256) t(i)))"""


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text as DuckDB SQL; ``crc_table`` must be in scope."""
    bytes_ = f"list_transform(range(1, length(hex({text})), 2), lambda k: ('0x' || substr(hex({text}), k, 2))::bigint)"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {bytes_}), lambda c, b: xor(c >> 8, remainders[(xor(c, b) & 255) + 1])), 4294967295)::bigint"
