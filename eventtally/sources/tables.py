"""Quarantine, counters, configuration and rollup tables."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventtally.operators import upsert
from eventtally.schema import (
    ANSWERS, CONFIG, COUNTERS, DEFAULT_RETENTION_DAYS, QUARANTINE, REPLAYS, RETENTION_KEY, ROLLUP,
)
from eventtally.sources import folders
from eventtally.sources.versioned import KEEP_HOURS, VersionedTable


class BatchTable:
    """Rows a batch leaves behind, in a folder of its own until parts are
    merged; replaying the batch replaces them."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root, schema
        self.names = StructType.fromDDL(schema).names

    def _path(self, part: str) -> str:
        return f"{self.root}/part={part}"

    def _merges(self) -> dict[str, set[str]]:
        """The merged parts in force, with the parts each replaces."""
        found = {}
        for name in folders.child_files(self.spark, f"{self.root}/_replaced"):
            if folders.exists(self.spark, self._path(name)):
                found[name] = set((folders.content(self.spark, f"{self.root}/_replaced/{name}") or b"").decode().split("\n"))
        return found

    def _parts(self) -> list[str]:
        """Parts in force: not those a merged part replaces."""
        merges = self._merges()
        gone = set().union(*merges.values()) if merges else set()
        return [n[5:] for n in folders.child_folders(self.spark, self.root, "part=") if n[5:] not in gone]

    def _read(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[self._path(part) for part in parts])

    def read(self) -> DataFrame:
        return self._read(self._parts())

    def of_batch(self, bid: str) -> DataFrame:
        """The rows of one batch: its own part, found by its name, or its rows in the merged ones."""
        merges = self._merges()
        gone = set().union(*merges.values()) if merges else set()
        if bid not in gone and folders.exists(self.spark, self._path(bid)):
            return self._read([bid])
        return self._read(sorted(set(merges) - gone)).filter(F.col("bid") == bid)

    def has_batches(self, prefix: str) -> bool:
        if folders.child_folders(self.spark, self.root, f"part={prefix}"):
            return True
        merged = self._read(sorted(self._merges()))
        return not merged.filter(F.startswith("bid", F.lit(prefix))).limit(1).isEmpty()

    def write(self, rows: DataFrame, bid: str) -> None:
        rows.withColumn("bid", F.lit(bid)).select(*self.names).write.mode("overwrite").parquet(self._path(bid))

    def merge(self, keep=None, keep_hours: float = KEEP_HOURS) -> int:
        """Gather all parts in one; returns how many there were.

        `keep` may filter the rows.  Batches that come meanwhile stay parts of
        their own.  The new part is put in force by the list of what it
        replaces, so readers never see a row twice or not at all.  Replaced
        folders stay for `keep_hours`, for readers that planned before, and go
        with the first merge after that.  One merge at a time.
        """
        old = self._parts()
        count = 0
        if len(old) >= (1 if keep else 2):
            name = f"merged-{time.time_ns()}"
            rows = self._read(old)
            staged = f"{self.root}/_staged/{name}"
            (keep(rows) if keep else rows).hint("rebalance").write.parquet(staged)
            folders.write(self.spark, f"{self.root}/_replaced/{name}", "\n".join(old).encode())
            folders.rename(self.spark, staged, self._path(name))
            count = len(old)
        self._clear(keep_hours)
        return count

    def _clear(self, keep_hours: float) -> None:
        merges = self._merges()
        gone = set().union(*merges.values()) if merges else set()
        for name, replaced in merges.items():
            since = folders.modified(self.spark, f"{self.root}/_replaced/{name}")
            if since is not None and since <= time.time() - keep_hours * 3600:
                for part in replaced:
                    folders.remove(self.spark, self._path(part))
                    # A merged part that is gone replaces nothing any more.
                    folders.remove(self.spark, f"{self.root}/_replaced/{part}")
                if name not in gone:
                    folders.write(self.spark, f"{self.root}/_replaced/{name}", b"")


def quarantine(spark: SparkSession, root: str) -> BatchTable:
    """Dead letters: the raw record, why it was refused, and its position."""
    return BatchTable(spark, root, QUARANTINE)


def counters(spark: SparkSession, root: str) -> BatchTable:
    """One row per batch, written last: it also marks the batch complete."""
    return BatchTable(spark, root, COUNTERS)


def answers(spark: SparkSession, root: str) -> BatchTable:
    """What each request of an admitted batch was answered."""
    return BatchTable(spark, root, ANSWERS)


def replays(spark: SparkSession, root: str) -> BatchTable:
    """One row per replay of dead letters: whose letters it takes."""
    return BatchTable(spark, root, REPLAYS)


def rollup(spark: SparkSession, root: str) -> VersionedTable:
    return VersionedTable(spark, root, ROLLUP)


class Config:
    """The key/value settings table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.table = VersionedTable(spark, root, CONFIG)

    def _rows(self, settings: dict[str, str]) -> DataFrame:
        return self.spark.createDataFrame(list(settings.items()), CONFIG)

    def _store(self, rows: DataFrame) -> None:
        self.table.replace(rows)

    def initialize(self, days: int = DEFAULT_RETENTION_DAYS) -> None:
        """Set the default unless a value is stored."""
        self._store(upsert.insert_missing(self.table.read(), self._rows({RETENTION_KEY: str(days)})))

    def set(self, settings: dict[str, str] | DataFrame) -> None:
        """Store settings, a dict or rows (key, value); they win over stored values."""
        rows = settings if isinstance(settings, DataFrame) else self._rows(settings)
        self._store(upsert.upsert(self.table.read(), rows))

    def read(self) -> DataFrame:
        return self.table.read()
