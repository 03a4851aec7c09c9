"""Whole small files through the file system of their path: made once, listed, deleted."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """File operations of the cluster's file system.

    ``create`` needs one that renames at once and refuses an existing target, as HDFS does.
    """

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _open(self, path: str):
        place = self._hadoop.Path(path)
        return place, place.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        place, system = self._open(path)
        return bool(system.exists(place))

    def create(self, path: str, text: str) -> bool:
        """Make ``path`` with this content, all at once; False if it is there already."""
        place, system = self._open(path)
        if system.exists(place):
            return False
        system.mkdirs(place.getParent())
        # Readers skip hidden files, so the content is complete before anyone sees it.
        draft = self._hadoop.Path(place.getParent(), f".{uuid.uuid4().hex}")
        out = system.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(place.toUri(), self._conf)
        try:
            context.rename(draft, system.makeQualified(place), self._spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0))
        except Exception:
            system.delete(draft, False)
            if system.exists(place):
                return False
            raise
        return True

    def names(self, folder: str) -> list[str]:
        """Names of the files and folders right under ``folder``, hidden ones left out; none where it is missing."""
        place, system = self._open(folder)
        if not system.exists(place):
            return []
        found = [entry.getPath().getName() for entry in system.listStatus(place)]
        return sorted(name for name in found if name[0] not in "._")

    def delete(self, path: str) -> bool:
        place, system = self._open(path)
        return bool(system.delete(place, True))
