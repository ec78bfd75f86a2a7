"""Session construction and the folder for tables the jobs write."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

# Settings every job wants.  Cluster sizing (executors, memory, number of
# shuffle partitions) is left to the submitter; AQE coalesces and splits
# partitions from measured sizes, so a generous shuffle count is safe.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.parquet.compression.codec": "zstd",
    # Encoding keys, which do not compress, costs more than it saves.
    "spark.sql.inMemoryColumnarStorage.compressed": "false",
    # Noting the Python line of every column expression slows down building
    # plans, which a stream does for each micro-batch.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "eventtally", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in DEFAULTS.items():
        builder = builder.config(name, value)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


@contextlib.contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold inside the block only."""
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@functools.cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="eventtally-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return _local_folder()
    raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def _workspaces(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/eventtally/{spark.sparkContext.applicationId}"


def new_workspace(spark: SparkSession, label: str) -> str:
    """A fresh, not yet existing folder for one run's tables."""
    return f"{_workspaces(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def clear_workspaces(spark: SparkSession) -> None:
    """Remove what this application wrote on its way, once its results are
    stored elsewhere; DataFrames that read it are void then."""
    location = spark._jvm.org.apache.hadoop.fs.Path(_workspaces(spark))
    location.getFileSystem(spark._jsc.hadoopConfiguration()).delete(location, True)
