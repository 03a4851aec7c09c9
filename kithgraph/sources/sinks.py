"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .files import Files

SHEET_FORMULA = "^[=+@-]"


def write_result(frame: DataFrame, root: str, table: str, dataset_id: str, version: int) -> None:
    """Replace one dataset version of a result table and leave all others as they are.

    Rows are sorted by customer inside each file where there is one, so lookups prune by file statistics.
    """
    keyed = frame.withColumns({"dataset_id": F.lit(dataset_id), "version": F.lit(version)})
    if "customer_id" in frame.columns:
        keyed = keyed.sortWithinPartitions("customer_id")
    (
        keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("dataset_id", "version").parquet(f"{root}/{table}")
    )


def read_result(spark: SparkSession, root: str, table: str, dataset_id: str, version: int | None = None) -> DataFrame:
    """One dataset (version) of a result table, by partition pruning."""
    frame = spark.read.parquet(f"{root}/{table}").filter(F.col("dataset_id") == dataset_id)
    return frame if version is None else frame.filter(F.col("version") == version)


def partition_text(value: str) -> str:
    """A value as Spark writes it into the name of a partition folder."""
    hidden = set('"#%\'*/:=?\\\x7f{[]^')
    return "".join(f"%{ord(c):02X}" if c in hidden or ord(c) < 32 else c for c in value)


def without_dataset(frame: DataFrame, dataset_id: str) -> DataFrame:
    return frame.filter(~F.col("dataset_id").eqNullSafe(dataset_id))


def delete_dataset(spark: SparkSession, root: str, table: str, dataset_id: str) -> bool:
    """Drop the partitions of one dataset from one table; no data is read or rewritten."""
    return Files(spark).delete(f"{root}/{table}/dataset_id={partition_text(dataset_id)}")


def customer_export(customers: DataFrame) -> DataFrame:
    """Scored customers for people: nine columns in rank order, label words, no cell that a sheet would run."""
    analyst = F.when(F.col("analyst_label") == 1, "fraud").when(F.col("analyst_label") == 0, "legitimate").otherwise("")
    rows = customers.select(
        "customer_id", "name", F.bround(F.col("risk") * 100, 1).alias("risk_score"), "risk_level", "rank",
        F.coalesce("ring_id", F.lit("")).alias("ring_id"), F.col("degree").alias("linked_accounts"),
        analyst.alias("analyst_label"), F.col("summary").alias("explanation"),
    )
    text = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType)]
    safe = {c: F.when(F.col(c).rlike(SHEET_FORMULA), F.concat(F.lit("'"), c)).otherwise(F.col(c)) for c in text}
    return rows.withColumns(safe).orderBy("rank")


def write_csv(frame: DataFrame, path: str) -> None:
    """CSV with a header; nested columns become JSON text."""
    nested = [f.name for f in frame.schema.fields if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
    frame.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")


def from_json_columns(frame: DataFrame, schemas: dict[str, str]) -> DataFrame:
    """Nested columns back from JSON text."""
    return frame.withColumns({c: F.from_json(c, schema) for c, schema in schemas.items()})


def save_snapshot(root: str, customers: DataFrame, links: DataFrame, events: DataFrame | None) -> None:
    """Canonical tables kept for retraining."""
    customers.write.mode("overwrite").parquet(f"{root}/customers")
    links.write.mode("overwrite").parquet(f"{root}/links")
    if events is not None:
        events.write.mode("overwrite").parquet(f"{root}/events")
