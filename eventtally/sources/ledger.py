"""The event ledger: all accepted events, in parts by day and batch.

The ledger is also the record of seen keys, so one commit makes a batch's events and its keys
visible together, on all of its days at once.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventtally.operators import dedup
from eventtally.schema import LEDGER
from eventtally.sources import keybuckets, keyindex
from eventtally.sources.commits import APPEND, MERGE, CommitTable, Part, Snapshot, in_ranges

# Merged parts go by this and a name, which no batch's name has.
_MERGED = "merged/"

# First and last event second of each day.
Spans = Mapping[dt.date, tuple[int, int]]
_DAY_SECONDS = 86400

#: Parts are in time order, for the statistics `seen` relies on; the Bloom filters serve point lookups.
_ORDER = ("event_timestamp",)
_FORMAT = {"parquet.bloom.filter.enabled#idempotency_key": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


class Ledger(CommitTable):
    """A batch is one commit of a part a day.  Writers do not wait for each other: each looks its keys up
    in a snapshot, and when it commits, in what others have committed since."""

    def __init__(
        self, spark: SparkSession, root: str, buckets: int = keybuckets.BUCKETS, bucketed_rows: int = keybuckets.LEAST_ROWS
    ):
        super().__init__(spark, root, LEDGER, "event_timestamp")
        self.index = keyindex.KeyIndex(spark, f"{root}/keys")
        self.buckets = keybuckets.KeyBuckets(spark, f"{root}/keys-by-hash", buckets, bucketed_rows)

    def dates(self) -> list[dt.date]:
        """Days that hold events."""
        return self.snapshot().days()

    def seen(
        self, spans: Spans, with_separator: bool, parts: Iterable[Part], since: Column | None = None,
        keys: DataFrame | None = None, bucketed: Iterable[Part] = (),
    ) -> DataFrame:
        """(idempotency_key, event_date, everywhere): keys in `parts` that may refuse keys of a batch, on
        their date or on any.  The batch's days are left out of those `bucketed`, which `seen_in_buckets` looks up.

        `spans` has the batch's first and last event second per day.  Equal keys mean equal timestamps
        unless a field holds the separator.  So only parts of the batch's days whose times meet the
        batch's are opened, and of their files only the row groups that do: for a live stream the last
        minutes, not the whole day.

        For batches with separators in fields, such keys of all days are added, from the parts that
        the key index does not rule out for `keys`, the batch's keys with a separator.  `since` bounds how
        long a key is remembered across dates; on its own date it is never stored again, however old.
        """
        parts = list(parts)
        skipped = {part.folder for part in bucketed}
        near = [part for part in _near(parts, spans) if part.folder not in skipped]
        known = _seen_columns(_meeting(self.load(near), near, spans), since)
        if with_separator:
            likely = parts if keys is None else self.index.holding(parts, keys)
            known = known.unionByName(_seen_columns(self.load(likely).filter("key_has_separator"), since).filter("everywhere"))
        return known

    def bucketed(self, spans: Spans, parts: Iterable[Part]) -> list[Part]:
        """The parts near a batch whose keys lie in buckets."""
        return self.buckets.holding(_near(parts, spans))

    def seen_in_buckets(self, spans: Spans, parts: list[Part], since: Column | None = None) -> DataFrame:
        """The same as `seen` for `bucketed` parts, dealt by the hash of the key: a join on it does not shuffle them."""
        return _seen_columns(_meeting(self.buckets.load(parts), parts, spans), since)

    def seen_table(self) -> DataFrame:
        """The seen keys with their receive time, a projection of the ledger."""
        return self.read().select("idempotency_key", "event_date", "received_at")

    def exists(self, key: str) -> bool:
        """Point lookup of a key, in the parts that the key index does not rule out."""
        parts = self.index.holding(self.snapshot().parts.values(), keyindex.one(self.spark, key))
        hit = self.load(parts).filter(F.col("idempotency_key") == key).select("idempotency_key")
        return bool(parts) and not hit.limit(1).isEmpty()

    def _packed(self, rows: DataFrame) -> DataFrame:
        return dedup.packed(rows)

    def _unpacked(self, rows: DataFrame) -> DataFrame:
        return dedup.unpacked(rows).select(*self.columns)

    def stage_batch(self, rows: DataFrame, bid: str) -> list[Part]:
        """Write a batch's rows and their key index, not in force yet."""
        parts = self.stage(rows.withColumn("bid", F.lit(bid)), bid, _ORDER, _FORMAT)
        self._index(parts)
        return parts

    def try_out(self, rows: DataFrame, bid: str, path: str) -> bool:
        return super().try_out(rows.withColumn("bid", F.lit(bid)), path, _ORDER, _FORMAT)

    def _index(self, parts: list[Part]) -> None:
        rows = self.load(parts)
        self.index.add(rows, parts)
        self.buckets.add(rows, parts)

    def append(self, base: Snapshot, parts: list[Part], bid: str) -> Snapshot:
        """Put a batch in force; `Overtaken` if others committed since `base`."""
        return self.commit(base, APPEND, bid, parts)

    def stored_by(self, bid: str, dates: Iterable[dt.date]) -> int:
        """How many rows a batch stored on some days: those of its parts, or its rows in parts that were merged."""
        now = self.snapshot()
        own = now.of(dates, bid)
        merged = [part for part in now.of(dates) if part.by.startswith(_MERGED)]
        if own or not merged:
            return sum(part.rows for part in own)
        return self.load(merged).filter(F.col("bid") == bid).count()

    def merge_day(self, day: dt.date, by: str, least: int = 2) -> int:
        """Gather a day's parts in one, while readers and writers go on; returns how many there were."""
        def chosen(base: Snapshot) -> list[Part]:
            parts = base.of([day])
            return parts if len(parts) >= least else []

        def rewritten(old: list[Part]) -> list[Part]:
            new = self.stage(self.load(old), _MERGED + by, _ORDER, _FORMAT)
            self._index(new)
            return new

        return len(self.rearrange(MERGE, by, chosen, rewritten))

    def vacuum(self, *args, **options) -> int:
        gone = super().vacuum(*args, **options)
        self.index.vacuum({name for name in self._data()})
        self.buckets.vacuum(f"{self.root}/data")
        return gone


def _near(parts: Iterable[Part], spans: Spans) -> list[Part]:
    """Parts of a batch's days whose times meet the batch's."""
    return [p for p in parts if p.day in spans and p.low <= spans[p.day][1] and spans[p.day][0] <= p.high]


def _meeting(rows: DataFrame, near: list[Part], spans: Spans) -> DataFrame:
    return rows.filter(in_ranges(F.col("event_timestamp"), [spans[p.day] for p in near], _DAY_SECONDS))


def _seen_columns(rows: DataFrame, since: Column | None) -> DataFrame:
    remembered = F.lit(True) if since is None else F.col("received_at") >= since
    return rows.select("idempotency_key", "event_date", remembered.alias("everywhere"))
