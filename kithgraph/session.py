"""Session settings and durable intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators are written for. AQE sizes shuffle partitions and splits skewed
# join partitions; forcing skew handling lets it do so even where that costs one more exchange.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # First rows of a group are picked before the shuffle however many are asked for.
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000000",
}


def local_session(cores: str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and the bench; a cluster passes its own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("kithgraph")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in {**RUNTIME_CONF, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one is made only where none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or os.environ.get("KITHGRAPH_SHARED_DIR")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="kithgraph-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


# Folder of the run under way, if its steps are to be deleted together.
_run: ContextVar[str | None] = ContextVar("run", default=None)
# Folder of the last stage of a chain.
_left: ContextVar[str | None] = ContextVar("left", default=None)


@contextmanager
def steps(spark: SparkSession) -> Iterator[str]:
    """Keep the tables that ``durable`` writes meanwhile in a folder of their own, and delete it at the end.

    Nothing that was read from them may be used afterwards: results are written elsewhere inside the block.
    """
    folder = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    token = _run.set(folder)
    try:
        yield folder
    finally:
        _run.reset(token)
        _delete(spark, folder)


@contextmanager
def stage_steps(spark: SparkSession, first: bool = False) -> Iterator[str]:
    """Like ``steps`` for one stage of a chain: its tables stay until the next stage begins, since its result still reads them.

    Each stage but the ``first`` must get its input as a written table. The tables of a last stage stay.
    """
    last, folder = _left.get(), f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    if last and not first:
        _delete(spark, last)
    _left.set(folder)
    token = _run.set(folder)
    try:
        yield folder
    finally:
        _run.reset(token)


def step_folder(spark: SparkSession) -> str:
    """Where tables of steps go at present."""
    return _run.get() or shared_folder(spark)


def _delete(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


ROWS_A_FILE = 8192


def few_files(df: DataFrame, rows: int | None) -> DataFrame:
    """``df`` in the partitions that about ``rows`` rows need, two a core at least, if it has more; unchanged if they are not known.

    A small table in hundreds of files costs a task for each file that is read, and on local disks several processes that the
    executor begins for each file that is written (200 files: 1246 processes), each as large as the executor for a moment.
    """
    if rows is None:
        return df
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_FILE)))


def durable(df: DataFrame, name: str = "step", rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; in few files where about ``rows`` rows are known to be few.

    Cuts lineage like a checkpoint, survives lost executors, and unlike an RDD checkpoint keeps
    column pruning and gives the optimizer true sizes.
    """
    spark = df.sparkSession
    df = few_files(df, rows)
    path = f"{step_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, as the file system of the path tells."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(context._jsc.hadoopConfiguration()).exists(place))
