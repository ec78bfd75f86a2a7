"""A table that is replaced as a whole while readers keep the old version."""

from __future__ import annotations

import json
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from eventtally.sources import folders

#: How long a version stays readable after a newer one took its place.
KEEP_HOURS = 24.0


class VersionedTable:
    """Parquet under `<root>/v=<number>`; the newest folder with a `_SUCCESS`
    file is current.  A failed write leaves no `_SUCCESS`, so the old version
    stays in force.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root, schema

    def _path(self, version: int) -> str:
        return f"{self.root}/v={version:09d}"

    def _numbers(self) -> list[int]:
        return [int(n[2:]) for n in folders.child_folders(self.spark, self.root, "v=")]

    def _written(self, version: int) -> float | None:
        """When the version was complete, in epoch seconds; None if it is not."""
        return folders.modified(self.spark, f"{self._path(version)}/_SUCCESS")

    def current_version(self) -> int | None:
        for number in reversed(self._numbers()):
            if self._written(number) is not None:
                return number
        return None

    def read(self) -> DataFrame:
        """The current version, or no rows when none was written yet."""
        version = self.current_version()
        if version is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._path(version))

    def note(self, version: int | None) -> dict | None:
        """What was noted with a version; None if nothing was."""
        found = None if version is None else folders.content(self.spark, self._note(version))
        return None if found is None else json.loads(found)

    def _note(self, version: int) -> str:
        return f"{self.root}/_notes/{version:09d}"

    def next_version(self) -> int:
        numbers = self._numbers()
        return (numbers[-1] if numbers else 0) + 1

    def replace(
        self, rows: DataFrame, partition_by: Sequence[str] = (), keep_hours: float = KEEP_HOURS, note: dict | None = None
    ) -> int:
        """Write a new version, with a note that goes when it goes.

        A version goes once a newer complete one has been there for
        `keep_hours`, however many there are: a reader that planned against it
        has that long.  Versions that failed go as soon as a newer one is
        complete; nobody reads them.
        """
        version = self.next_version()
        if note is not None:
            folders.write(self.spark, self._note(version), json.dumps(note).encode())
        rows.write.partitionBy(*partition_by).parquet(self._path(version))
        newer = None
        for number in reversed(self._numbers()):
            written = self._written(number)
            if number < version and (written is None or newer is not None and newer <= time.time() - keep_hours * 3600):
                folders.remove(self.spark, self._path(number))
                folders.remove(self.spark, self._note(number))
            newer = written if written is not None else newer
        return version
