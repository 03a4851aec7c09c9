"""The review log of a dataset: batches of rows, each made part of the log by one commit file.

A writer stores its rows with their place in the batch, then tries to make the next commit file, which names the batch and the id
of its first row. If another writer was faster the file is there, and the attempt is repeated with the next number and the ids that
follow. So ids never clash, rows are written once however often a commit is tried, and rows without a commit are never read.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ordered import with_rank
from .files import Files

REVIEW = (
    "target_type string, target_id string, decision string, note string, members array<string>, included array<string>, "
    "created_at timestamp, model_version int"
)
_COMMIT = "batch string, first_id bigint, rows bigint"


class ReviewLog:
    """``id`` and the columns of ``REVIEW``, in the order in which batches were committed."""

    def __init__(self, spark: SparkSession, root: str, dataset_id: str) -> None:
        self.spark, self.files = spark, Files(spark)
        self.folder = f"{root.rstrip('/')}/reviews/{quote(dataset_id, safe='')}"

    def _next(self) -> tuple[int, int]:
        """Number of the next commit and the id of its first row, after the last commit that is there."""
        names = self.files.names(f"{self.folder}/commits")
        if not names:
            return 1, 1
        last = self.spark.read.schema(_COMMIT).json(f"{self.folder}/commits/{names[-1]}").first()
        return int(names[-1].removesuffix(".json")) + 1, last["first_id"] + last["rows"]

    def stage(self, new: DataFrame) -> tuple[str, int]:
        """Store rows, in order of time and target, that are not in the log yet; their batch and number."""
        batch = uuid.uuid4().hex
        order = [F.asc("created_at"), F.asc("target_type"), F.asc("target_id"), F.asc("decision"), F.asc("note")]
        columns = [name.split()[0] for name in REVIEW.split(", ")]
        with_rank(new.select(*columns), order, "place").write.parquet(f"{self.folder}/rows/batch={batch}")
        return batch, self.spark.read.parquet(f"{self.folder}/rows/batch={batch}").count()

    def commit(self, batch: str, rows: int) -> int:
        """Make staged rows part of the log; the id of the first one."""
        while True:
            number, first_id = self._next()
            if self.files.create(f"{self.folder}/commits/{number:012d}.json", json.dumps({"batch": batch, "first_id": first_id, "rows": rows})):
                return first_id

    def append(self, new: DataFrame) -> int:
        """Add reviews; the id of the first one."""
        return self.commit(*self.stage(new))

    def read(self) -> DataFrame:
        if not self.files.names(f"{self.folder}/commits"):
            return self.spark.createDataFrame([], f"id bigint, {REVIEW}")
        commits = self.spark.read.schema(_COMMIT).json(f"{self.folder}/commits")
        rows = self.spark.read.schema(f"{REVIEW}, place bigint, batch string").parquet(f"{self.folder}/rows")
        joined = rows.join(commits, "batch")
        return joined.select((F.col("first_id") + F.col("place") - 1).alias("id"), *[name.split()[0] for name in REVIEW.split(", ")])
