"""The keys of the ledger's large parts once more, in buckets by their hash.

A batch too large to broadcast meets the ledger by a join on keys.  Files that are laid out by the
hash of the key, as many buckets in every part, are joined where they lie: only the batch is shuffled, into
the same buckets.  Parts below `least_rows` have no buckets, as their files would be tiny; their keys
are shuffled, and merges gather them in large parts.

It is a bucketed table, which Spark knows by its catalog alone.  Any session enters it there by itself, and of its
partitions those it reads; the files are the table's content, so a catalog that forgets it loses nothing.
The buckets of a commit are written before it is in force, and never changed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from eventtally.sources import folders
from eventtally.sources.commits import Part

BUCKETS = 256
#: Some 8,000 keys a bucket and file.
LEAST_ROWS = 2_000_000

_COLUMNS = ("idempotency_key", "event_timestamp", "received_at")


class KeyBuckets:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, least_rows: int = LEAST_ROWS):
        self.spark, self.buckets, self.least_rows = spark, buckets, least_rows
        # Parts with another number of buckets are not joined with these.
        self.root = f"{root}/of={buckets}"
        self.table = f"eventtally_keys_{hashlib.sha256(self.root.encode()).hexdigest()[:20]}"

    def _enter(self) -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (idempotency_key STRING, event_timestamp BIGINT, received_at TIMESTAMP,"
            " commit STRING, event_date DATE) USING parquet PARTITIONED BY (commit, event_date)"
            f" CLUSTERED BY (idempotency_key) SORTED BY (event_timestamp) INTO {self.buckets} BUCKETS LOCATION '{self.root}'"
        )

    @staticmethod
    def _place(part: Part) -> tuple[str, str]:
        commit, day = part.folder.removeprefix("data/c=").split("/event_date=")
        return commit, day

    def add(self, rows: DataFrame, parts: Iterable[Part]) -> None:
        """Write the keys of the large ones among the parts of a commit; `rows` are all of its rows."""
        large = [part for part in parts if part.rows >= self.least_rows]
        if not large:
            return
        self._enter()
        commits = {self._place(part)[0] for part in large}
        days = [part.day for part in large]
        keys = rows.where(rows["event_date"].isin(days)).selectExpr(*_COLUMNS, f"'{commits.pop()}' AS commit", "event_date")
        # A task writes a bucket, so a part has a file a bucket; times are in order for the row groups.
        keys.repartition(self.buckets, "idempotency_key").write.insertInto(self.table)

    def holding(self, parts: Iterable[Part]) -> list[Part]:
        """The parts whose keys lie in buckets."""
        return [
            part for part in parts
            if part.rows >= self.least_rows and folders.exists(self.spark, self._path(*self._place(part)))
        ]

    def _path(self, commit: str, day: str) -> str:
        return f"{self.root}/commit={commit}/event_date={day}"

    def load(self, parts: Iterable[Part]) -> DataFrame:
        """(idempotency_key, event_timestamp, received_at, event_date) of parts that have buckets, dealt by the key's hash."""
        self._enter()
        days_of: dict[str, list[str]] = {}
        for part in parts:
            commit, day = self._place(part)
            days_of.setdefault(commit, []).append(day)
        named = [f"PARTITION (commit = '{c}', event_date = DATE'{d}')" for c, days in days_of.items() for d in days]
        self.spark.sql(f"ALTER TABLE {self.table} ADD IF NOT EXISTS {' '.join(named)}")
        chosen = " OR ".join(
            f"commit = '{c}' AND event_date IN ({', '.join(f"DATE'{d}'" for d in days)})" for c, days in days_of.items()
        )
        return self.spark.table(self.table).where(chosen).select(*_COLUMNS, "event_date")

    def vacuum(self, data: str) -> None:
        """Remove the keys of parts that are no longer among the ledger's data."""
        base = self.root.rsplit("/", 1)[0]
        for number in folders.child_folders(self.spark, base, "of="):
            for commit in folders.child_folders(self.spark, f"{base}/{number}", "commit="):
                place = f"{base}/{number}/{commit}"
                days = folders.child_folders(self.spark, place, "event_date=")
                gone = [d for d in days if not folders.exists(self.spark, f"{data}/{commit.replace('commit=', 'c=', 1)}/{d}")]
                for path in [place] if gone == days else [f"{place}/{day}" for day in gone]:
                    folders.remove(self.spark, path)
