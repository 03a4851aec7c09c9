"""Versions that become visible at once, the list of datasets, and their deletion.

A version's result tables are partitions under ``root/<table>/dataset_id=<id>/version=<n>``. Nobody reads them before the version
is published, which is the making of one small file, ``root/published/<id>/<n>.json``. A run that dies leaves partitions that
no reader sees; ``sweep`` removes them. Deleting begins with the published files, so a dataset is gone before its rows are.
"""

from __future__ import annotations

import json
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.metadata import InputError
from . import sinks
from .files import Files

PUBLISHED = "dataset_id string, version int, name string, source string, published_at timestamp, tables array<string>, summary string"
# Folders of a dataset other than its result tables.
KEPT_APART = ["snapshots", "published", "reviews"]


class Catalog:
    """Published versions under one root."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def _file(self, dataset_id: str, version: int | None = None) -> str:
        folder = f"{self.root}/published/{quote(dataset_id, safe='')}"
        return folder if version is None else f"{folder}/{version}.json"

    def publish(
        self, dataset_id: str, version: int, tables: list[str], name: str | None = None, source: str = "upload", summary: dict | None = None
    ) -> None:
        """Make a version visible with all its tables. A version is published once."""
        now = self.spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")).first()[0]
        about = {
            "dataset_id": dataset_id, "version": version, "name": name or dataset_id, "source": source, "published_at": now,
            "tables": sorted(tables), "summary": json.dumps(summary or {}),
        }
        if not self.files.create(self._file(dataset_id, version), json.dumps(about)):
            raise InputError(f"Version {version} of {dataset_id} is published already.")

    def versions(self, dataset_id: str) -> list[int]:
        """Visible versions of one dataset; it has few."""
        return sorted(int(name.removesuffix(".json")) for name in self.files.names(self._file(dataset_id)))

    def active_version(self, dataset_id: str) -> int:
        """The newest visible version, 0 if there is none."""
        return max(self.versions(dataset_id), default=0)

    def published(self) -> DataFrame:
        """One row per visible version of every dataset."""
        if not self.files.names(f"{self.root}/published"):
            return self.spark.createDataFrame([], PUBLISHED)
        return self.spark.read.schema(PUBLISHED).json(f"{self.root}/published/*")

    def datasets(self) -> DataFrame:
        """Every dataset with its newest version, what that version says of it, and when its first one was published."""
        mine = Window.partitionBy("dataset_id")
        newest = self.published().withColumn("created_at", F.min("published_at").over(mine)).withColumn("_last", F.max("version").over(mine))
        return newest.filter(F.col("version") == F.col("_last")).select(
            "dataset_id", "name", "source", "created_at", F.col("version").alias("active_version"), "summary"
        )

    def read(self, table: str, dataset_id: str, version: int | None = None) -> DataFrame:
        """A table of a visible version, the newest one if none is given."""
        wanted = version or self.active_version(dataset_id)
        if wanted not in self.versions(dataset_id):
            raise InputError(f"{dataset_id} has no version {wanted or 'yet'}.")
        return sinks.read_result(self.spark, self.root, table, dataset_id, wanted)

    def tables(self) -> list[str]:
        """Result tables under the root."""
        return [name for name in self.files.names(self.root) if name not in KEPT_APART]

    def delete(self, dataset_id: str) -> list[str]:
        """Drop a dataset from everywhere; the places it was in. No rows are read or rewritten."""
        places = [self._file(dataset_id), *[f"{self.root}/{kept}/{quote(dataset_id, safe='')}" for kept in KEPT_APART if kept != "published"]]
        places += [f"{self.root}/{table}/dataset_id={sinks.partition_text(dataset_id)}" for table in self.tables()]
        return [place for place in places if self.files.delete(place)]

    def sweep(self, dataset_id: str) -> list[str]:
        """Remove partitions of versions of a dataset that were never published; no run of it may be under way."""
        known, gone = self.versions(dataset_id), []
        for table in self.tables():
            folder = f"{self.root}/{table}/dataset_id={sinks.partition_text(dataset_id)}"
            for name in self.files.names(folder):
                if name.startswith("version=") and int(name.removeprefix("version=")) not in known:
                    self.files.delete(f"{folder}/{name}")
                    gone.append(f"{table}/{name}")
        return gone
