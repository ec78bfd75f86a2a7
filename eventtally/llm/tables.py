"""Tables that a job writes on its way: lineage ends there, so that a lost
executor costs the tasks since the last one only."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import eventtally
from eventtally.session import new_workspace
from eventtally.sources import folders


def stage(df: DataFrame, label: str) -> DataFrame:
    """`df` written once to the shared folder and read back."""
    path = new_workspace(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shared: set[str] = set()


def share_package(spark: SparkSession) -> None:
    """Give the executors this package, through the shared folder, once an application."""
    application = spark.sparkContext.applicationId
    if application in _shared:
        return
    root = Path(eventtally.__file__).parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, Path(root.name) / file.relative_to(root))
    path = f"{new_workspace(spark, 'package')}/{root.name}.zip"
    folders.write(spark, path, packed.getvalue())
    spark.sparkContext.addPyFile(path)
    _shared.add(application)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
