"""Folder operations through Hadoop's FileSystem, so that they work on any
storage Spark reads.  Only names pass through the driver, never rows."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError

from pyspark.sql import SparkSession


#: Storage whose renames overwrite, where a link is what fails if there is one.
LINKED = ("file",)


def _open(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    location = hadoop.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()), location


def exists(spark: SparkSession, path: str) -> bool:
    system, location = _open(spark, path)
    return system.exists(location)


def modified(spark: SparkSession, path: str) -> float | None:
    """When a file was last written, in epoch seconds; None if there is none."""
    system, location = _open(spark, path)
    return system.getFileStatus(location).getModificationTime() / 1000 if system.exists(location) else None


def child_folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Sorted names of the sub-folders that start with `prefix`."""
    system, location = _open(spark, path)
    if not system.exists(location):
        return []
    names = [s.getPath().getName() for s in system.listStatus(location) if s.isDirectory()]
    return sorted(name for name in names if name.startswith(prefix))


def child_files(spark: SparkSession, path: str) -> list[str]:
    """Sorted names of the files in a folder."""
    system, location = _open(spark, path)
    if not system.exists(location):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(location) if s.isFile())


def make(spark: SparkSession, path: str) -> None:
    system, location = _open(spark, path)
    system.mkdirs(location)


def write(spark: SparkSession, path: str, content: bytes, overwrite: bool = True) -> None:
    """Write a small file; without `overwrite` one that exists is an error, which storage
    with atomic creation (HDFS) makes a lock."""
    system, location = _open(spark, path)
    stream = system.create(location, overwrite)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, content: bytes) -> bool:
    """Create a file with all its content at once; False if there is one already.

    It is written beside and then given its name, by a rename that does not overwrite (HDFS has
    it) or, on this machine's disks, where renames overwrite, by a link.
    """
    system, location = _open(spark, path)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    write(spark, temporary, content)
    try:
        if system.getScheme() in LINKED:
            local = [spark._jvm.org.apache.hadoop.fs.Path(p).toUri().getPath() for p in (temporary, path)]
            try:
                os.link(*local)
            except FileExistsError:
                return False
            return True
        hadoop = spark._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(location.toUri(), spark._jsc.hadoopConfiguration())
        options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        try:
            context.rename(hadoop.Path(temporary), location, options)
        except Py4JJavaError:
            if not exists(spark, path):
                raise
            return False
        return True
    finally:
        remove(spark, temporary)


def content(spark: SparkSession, path: str) -> bytes | None:
    """All of a small file; None if there is none."""
    system, location = _open(spark, path)
    if not system.exists(location):
        return None
    stream = system.open(location)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def rename(spark: SparkSession, path: str, to: str) -> None:
    system, location = _open(spark, path)
    if not system.rename(location, spark._jvm.org.apache.hadoop.fs.Path(to)):
        raise RuntimeError(f"{path} could not become {to}")


def remove(spark: SparkSession, path: str) -> bool:
    system, location = _open(spark, path)
    return system.delete(location, True)
