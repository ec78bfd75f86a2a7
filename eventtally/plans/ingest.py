"""Ingest one batch of records: parse, quarantine, deduplicate, store, count."""

from __future__ import annotations

import datetime as dt
import logging
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventtally.operators import dedup, project, validate
from eventtally.schema import CORRUPT, RETRY_SECONDS, ROLLUP_USERS, SKETCHES
from eventtally.sources import folders, keybuckets, payloads, records as record_source, tables
from eventtally.sources.commits import APPEND, CommitTable, Overtaken, Part
from eventtally.sources.ledger import Ledger

log = logging.getLogger(__name__)

#: Above this many rows a batch's keys are not broadcast.  A key costs about
#: 150 bytes in a hash table, so this is some 75 MB per executor.  The results
#: are the same either way.
BROADCAST_KEYS = 500_000

#: Trial writes at a time when a batch cannot be stored, and into how many pieces one that fails is cut.
TRIALS, PIECES = 8, 4
#: A piece is asked whether it is a single key once it should have no more than so many.
FEW_KEYS = 4

OK, DEAD, SKIPPED = "ok", "dead", "skipped"


@dataclass(frozen=True)
class Stores:
    """The tables of one deployment, all under one root."""

    spark: SparkSession
    root: str
    #: How the keys of large parts of the ledger are laid out for the lookup of large batches.
    key_buckets: int = keybuckets.BUCKETS
    bucketed_rows: int = keybuckets.LEAST_ROWS

    @property
    def ledger(self) -> Ledger:
        return Ledger(self.spark, f"{self.root}/ledger", self.key_buckets, self.bucketed_rows)

    @property
    def quarantine(self) -> tables.BatchTable:
        return tables.quarantine(self.spark, f"{self.root}/quarantine")

    @property
    def counters(self) -> tables.BatchTable:
        return tables.counters(self.spark, f"{self.root}/counters")

    @property
    def answers(self) -> tables.BatchTable:
        return tables.answers(self.spark, f"{self.root}/answers")

    @property
    def replays(self) -> tables.BatchTable:
        return tables.replays(self.spark, f"{self.root}/replays")

    def letters(self) -> DataFrame:
        """The dead letters still to be mended: a replay that is complete has
        taken its letters over, and holds those it could not mend either."""
        done = self.replays.read().join(self.counters.read().select("bid"), "bid", "left_semi")
        consumed = done.select(F.explode("consumed").alias("bid")).distinct()
        return self.quarantine.read().join(consumed, "bid", "left_anti")

    @property
    def rollup(self):
        return tables.rollup(self.spark, f"{self.root}/rollup")

    @property
    def rollup_users(self) -> CommitTable:
        """Who is counted in the rollup: one row a user and rollup group."""
        return CommitTable(self.spark, f"{self.root}/rollup-users", ROLLUP_USERS, "date_hour")

    @property
    def sketches(self) -> CommitTable:
        """Users by the hour, event name and channel, as mergeable sketches; a group has one or more."""
        return CommitTable(self.spark, f"{self.root}/sketches", SKETCHES, "date_hour")

    @property
    def config(self) -> tables.Config:
        return tables.Config(self.spark, f"{self.root}/config")


def classify(
    records: DataFrame, coerce: bool = False, first_date: str | None = None, last_date: str | None = None
) -> DataFrame:
    """Parse records and tell events, dead letters and skipped records apart.

    Corruption is decided before any field is looked at, since a corrupt
    payload may still yield some fields.
    """
    parsed = payloads.parse_events(records, coerce=coerce)
    reason = F.when(F.col(CORRUPT).isNotNull(), F.lit(validate.MALFORMED)).otherwise(
        validate.storage_fault("timestamp", first_date, last_date)
    )
    absent = payloads.is_absent(F.col("value"))
    judged = parsed.withColumn("reason", F.when(~absent, reason)).withColumn(
        "status", F.when(absent, SKIPPED).when(F.col("reason").isNotNull(), DEAD).otherwise(OK)
    )
    return project.to_event(judged).drop(CORRUPT)


def dead_letters(classified: DataFrame) -> DataFrame:
    """The refused records with their raw text and place; an absent key becomes ''.

    Records of text files have no offset that tells them apart; their place is
    the file and the line's number in the batch.
    """
    source, line = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    if "place" in classified.columns:
        source, line = F.col("place.file_path"), F.col("line")
    elif {"source", "line"} <= set(classified.columns):
        source, line = F.col("source"), F.col("line")
    return classified.filter(F.col("status") == DEAD).select(
        F.coalesce("key", F.lit("")).alias("key"), "value", "partition", "offset",
        source.alias("source"), line.alias("line"), "reason",
    )


def new_events(
    events: DataFrame, ledger: Ledger, parts: list[Part], stats: dict, remember=None,
    order: tuple[str, ...] = ("offset", "partition"), broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """The events that `parts` of the ledger do not hold, one row per key."""
    small = stats["deserialized"] <= broadcast_keys
    bucketed = [] if small else ledger.bucketed(stats["spans"], parts)
    keys = events.filter("key_has_separator") if stats["with_separator"] else None
    seen = ledger.seen(stats["spans"], stats["with_separator"] > 0, parts, remember, keys, bucketed)
    if small:
        # The batch is known to be small: look its keys up where the ledger
        # lies, so that the ledger is never shuffled.  The hits are no more
        # than the batch's keys, as the ledger has one row per key and date.
        wanted = F.broadcast(events.select("idempotency_key").distinct())
        hits = seen.join(wanted, "idempotency_key", "left_semi").distinct()
        return dedup.last_in_batch(dedup.storable(events, F.broadcast(hits)), order)
    in_buckets = ledger.seen_in_buckets(stats["spans"], bucketed, remember) if bucketed else None
    if not stats["with_separator"]:
        # Equal keys have equal dates, so the batch may be reduced before the lookup.  It is shuffled once, a row a key
        # and task, with keys half as long, and meets the ledger's keys as it is dealt then; only buckets deal it anew.
        fresh = dedup.last_in_batch(dedup.packed(events), order)
        if bucketed:
            fresh = dedup.packed(dedup.storable(dedup.unpacked(fresh), in_buckets))
        return dedup.unpacked(dedup.storable(fresh, dedup.packed(seen)))
    # Only keys are shuffled to find the new ones; payloads of the others stay
    # where they are, if the new keys turn out to be few.
    keys = events.select("idempotency_key", "event_date").distinct()
    if bucketed:
        # The batch's keys go to where those of the ledger's large parts lie; what is left meets the small parts.
        keys = dedup.storable(keys, in_buckets)
    fresh = dedup.storable(keys, seen).select("idempotency_key", "event_date")
    return dedup.last_in_batch(events.join(fresh, ["idempotency_key", "event_date"], "left_semi"), order)


class BatchTaken(RuntimeError):
    """Another writer has stored a batch of the same name meanwhile."""


def _overlap(parts: list[Part], others: list[Part], with_separator: bool) -> list[Part]:
    """The other parts that may hold a key of `parts`: equal keys have equal times, but for separators."""
    return [
        o for o in others
        if with_separator or any(o.day == p.day and o.low <= p.high and p.low <= o.high for p in parts)
    ]


@dataclass(frozen=True)
class Storing:
    """How a batch is written: what is done to rows on their way, and with rows that cannot be.

    A write that fails is tried again after each of `waits` seconds.  Then pieces of the batch, by a hash of the keys,
    are written for trial until the keys that fail stand alone, and the rest is stored at once.  More than `most` of them, or as many as
    `outage` before any other could be stored, are no fault of single rows, and the batch fails.
    """

    prepare: Callable[[DataFrame], DataFrame] | None = None
    waits: tuple[float, ...] = RETRY_SECONDS
    most: int = 1_000
    outage: int = 20


def _tried(ledger: Ledger, rows: DataFrame, bid: str, storing: Storing) -> list[Part]:
    for wait in (*storing.waits, None):
        try:
            return ledger.stage_batch(storing.prepare(rows) if storing.prepare else rows, bid)
        except Exception as error:
            if wait is None:
                raise
            log.warning("batch %s could not be written (%s), again in %s s", bid, _cause(error), wait)
            time.sleep(wait)
    raise AssertionError


def _cause(error: Exception) -> str:
    """The first line of what an error says, as a reason."""
    return " ".join((str(error).strip() or type(error).__name__).split("\n")[0].split())[:200]


def _stage_what_can_be(ledger: Ledger, rows: DataFrame, bid: str, storing: Storing) -> tuple[list[Part], dict[str, str]]:
    """The parts written, and the keys that could not be, with the reason."""
    try:
        return _tried(ledger, rows, bid, storing), {}
    except Exception as error:
        log.warning("batch %s is written in pieces: %s", bid, _cause(error))
        first = error
    # The rows once more, without `prepare`, so that pieces do not look keys up again; a piece opens the slices it meets.
    place = f"{ledger.root}/_halved/{uuid.uuid4().hex}"
    hashed = rows.withColumn("_hash", F.xxhash64("idempotency_key")).withColumn("_slice", F.expr("_hash >> 56"))
    try:
        hashed.hint("rebalance", "_slice").sortWithinPartitions("_slice", "_hash").write.partitionBy("_slice").parquet(f"{place}/rows")
        staged = ledger.spark.read.parquet(f"{place}/rows")
        refused = _refused(ledger, staged, f"{place}/tried", bid, storing, first)
        names = ledger.spark.createDataFrame([(key,) for key in refused], "idempotency_key STRING")
        rest = staged.drop("_hash", "_slice").join(F.broadcast(names), "idempotency_key", "left_anti")
        return _tried(ledger, rest, bid, storing), refused
    finally:
        folders.remove(ledger.spark, place)


def _refused(
    ledger: Ledger, staged: DataFrame, place: str, bid: str, storing: Storing, first: Exception
) -> dict[str, str]:
    """The keys that cannot be stored, with the reason; `first` is raised if there are too many.

    Pieces of the hashes' range are written for trial, some at a time; one that fails is cut in PIECES, the newest first,
    so that single keys are soon told from an outage.  Trials shuffle nothing, and nobody reads what they leave.
    """
    once = replace(storing, waits=())
    rows = staged.count()

    def trial(some: DataFrame, how: Storing) -> tuple[bool, Exception | None]:
        """Whether there were rows, and why they could not be written."""
        for wait in (*how.waits, None):
            try:
                return ledger.try_out(how.prepare(some) if how.prepare else some, bid, f"{place}/{uuid.uuid4().hex}"), None
            except Exception as error:
                if wait is None:
                    return True, error
                time.sleep(wait)
        raise AssertionError

    def examined(bounds: tuple[int, int]) -> tuple[bool, dict[str, str] | None]:
        """Whether some rows could be written, and the keys refused; None if the piece is to be cut."""
        low, high = bounds
        within = F.col("_slice").between(low >> 56, (high - 1) >> 56) & F.col("_hash").between(low, high - 1)
        some = staged.filter(within).drop("_hash", "_slice")
        had, error = trial(some, once)
        if error is None:
            return had, {}
        if rows * (high - low) >> 64 > FEW_KEYS:
            return False, None
        keys = some.select("idempotency_key").distinct()
        few = [row["idempotency_key"] for row in (keys if high - low == 1 else keys.limit(2)).collect()]
        if len(few) > 1 and high - low > 1:
            return False, None
        had, error = trial(some, storing)
        return (had, {}) if error is None else (False, dict.fromkeys(few, _cause(error)))

    refused: dict[str, str] = {}
    stored = False
    open_ = [(-(1 << 63), 1 << 63)]
    with ThreadPoolExecutor(TRIALS) as pool:
        while open_:
            wave, open_ = open_[-TRIALS:], open_[:-TRIALS]
            for (low, high), (had, keys) in zip(wave, list(pool.map(examined, wave)), strict=True):
                stored = stored or had
                refused |= keys or {}
                if keys is None:
                    edges = sorted({low + (high - low) * i // PIECES for i in range(PIECES + 1)})
                    open_ += list(zip(edges, edges[1:], strict=False))
            if len(refused) > storing.most or not stored and len(refused) >= storing.outage:
                raise first
    return refused


def store_events(
    events: DataFrame, stores: Stores, bid: str, stats: dict, arrival, remember, order, broadcast_keys, storing: Storing
) -> dict[str, str]:
    """Put the batch's new events in the ledger, whoever else writes to it; returns the keys that could not be
    stored, with the reason.

    The keys are looked up in a snapshot.  If others have committed when the batch is ready to, their
    parts alone are looked up too, what they hold is left out, and the batch tries again; so of
    one key the first commit wins.  A batch whose parts meet no other's in time is not read again.
    """
    ledger = stores.ledger
    base = ledger.snapshot()
    # What this batch stored before it was cut off, all of a commit or nothing, is looked up like any other's.
    fresh = new_events(events, ledger, list(base.parts.values()), stats, remember, order, broadcast_keys)
    parts, refused = _stage_what_can_be(ledger, fresh.withColumn("received_at", arrival), bid, storing)
    while True:
        try:
            ledger.append(base, parts, bid)
            return refused
        except Overtaken as overtaken:
            base = overtaken.snapshot
            added = [part for commit in overtaken.commits if commit.kind == APPEND for part in commit.added]
        if any(part.by == bid for part in added):
            ledger.discard(parts)
            raise BatchTaken(f"'{bid}' was stored by another writer meanwhile")
        others = _overlap(parts, added, stats["with_separator"] > 0)
        if not others:
            continue
        left = {**stats, "deserialized": sum(part.rows for part in parts)}
        rest = new_events(ledger.load(parts), ledger, others, left, remember, ("received_at",), broadcast_keys)
        again = ledger.stage_batch(rest, bid)
        ledger.discard(parts)
        parts = again


def _letters_of(refused: dict[str, str], records: DataFrame, *rules) -> DataFrame:
    """Dead letters of all records with keys that could not be stored, from the batch's records."""
    reasons = records.sparkSession.createDataFrame(list(refused.items()), "refused STRING, why STRING")
    ok = classify(records, *rules).filter(F.col("status") == OK)
    named = ok.join(F.broadcast(reasons), F.col("idempotency_key") == F.col("refused"))
    return dead_letters(named.withColumns({
        "status": F.lit(DEAD), "reason": F.concat(F.lit(validate.NOT_STORABLE + ": "), "why"),
    }))


# The 32 bytes of the digest, half of what its hex text would shuffle.
_UNIQUE_KEYS = "count(DISTINCT unhex(idempotency_key))"
_COUNTS = {
    "received": "count(*)",
    "skipped": "count_if(status = 'skipped')",
    "dead": "count_if(status = 'dead')",
    "deserialized": "count_if(status = 'ok')",
    "with_separator": "count_if(status = 'ok' AND key_has_separator)",
}


def _statistics(classified: DataFrame) -> dict:
    """What the batch holds, and the time span of its events per day.

    A row a day comes back.  Distinct keys are counted apart, so that nothing but keys is shuffled for them.
    """
    days = classified.groupBy("event_date").agg(
        *[F.expr(text).alias(name) for name, text in _COUNTS.items()],
        F.expr("min(CASE WHEN status = 'ok' THEN event_timestamp END)").alias("low"),
        F.expr("max(CASE WHEN status = 'ok' THEN event_timestamp END)").alias("high"),
    ).collect()
    stats = {name: sum(day[name] for day in days) for name in _COUNTS}
    ok = classified.filter(F.col("status") == OK)
    stats["unique_keys"] = ok.agg(F.expr(_UNIQUE_KEYS)).first()[0] if stats["deserialized"] else 0
    stats["spans"] = {
        day["event_date"]: (day["low"], day["high"]) for day in days if day["deserialized"]
    }
    return stats


def ingest_batch(
    stores: Stores,
    records: DataFrame,
    bid: str,
    received_at: dt.datetime | None = None,
    coerce: bool = False,
    first_date: str | None = None,
    last_date: str | None = None,
    remember_days: int | None = None,
    broadcast_keys: int = BROADCAST_KEYS,
    storing: Storing = Storing(),
) -> dict:
    """Ingest one batch under the name `bid` and return its counters.

    A batch on record is not ingested again; its counters are returned.  One
    that was cut off may be run again with the same records: its events are in
    the ledger on all days or on none, and the other tables' output is keyed by
    `bid` and overwritten.  A bad record never fails its batch.

    A key is stored once a date, always.  `remember_days` limits how long a key
    is refused on other dates, which matters for fields that hold the
    separator.  `broadcast_keys` bounds the keys that are broadcast.  Batches
    may run at the same time; of a key that several hold, the first commit wins.
    Rows that cannot be stored become dead letters (`Storing`).
    """
    on_record = stores.counters.of_batch(bid).drop("days", "bid").first()
    if on_record:
        return on_record.asDict()
    arrival = F.lit(received_at or dt.datetime.now(dt.timezone.utc))
    remember = None
    if remember_days is not None:
        remember = arrival - F.make_dt_interval(F.lit(remember_days))
    records, order = record_source.in_order(records)
    classified = classify(records, coerce, first_date, last_date)
    # Parsed once for the jobs below and kept in the shared folder, where no
    # lost executor can take it along; without the raw text of good records.
    classified = classified.withColumns({c: F.when(F.col("status") == DEAD, F.col(c)) for c in ("key", "value")})
    staged = f"{stores.root}/_staged/{bid}-{uuid.uuid4().hex[:12]}"
    try:
        classified.write.parquet(staged, compression="zstd")
        classified = stores.spark.read.schema(classified.schema).parquet(staged)
        stats = _statistics(classified)
        inserted = 0
        letters = dead_letters(classified)
        if stats["deserialized"]:
            events = classified.filter(F.col("status") == OK).drop("status", "reason", "key", "value")
            refused = store_events(events, stores, bid, stats, arrival, remember, order, broadcast_keys, storing)
            inserted = stores.ledger.stored_by(bid, stats["spans"])
            if refused:
                more = _letters_of(refused, records, coerce, first_date, last_date)
                letters = letters.unionByName(more)
                count = more.count()
                stats["dead"] += count
                stats["deserialized"] -= count
                stats["unique_keys"] -= len(refused)
        if stats["dead"]:
            stores.quarantine.write(letters.withColumn("received_at", arrival), bid)
    finally:
        folders.remove(stores.spark, staged)
    counted = {
        "received": stats["received"],
        "skipped": stats["skipped"],
        "dead": stats["dead"],
        "deserialized": stats["deserialized"],
        "unique_keys": stats["unique_keys"],
        "inserted": inserted,
        "in_batch_duplicates": stats["deserialized"] - stats["unique_keys"],
        "cross_batch_duplicates": stats["unique_keys"] - inserted,
    }
    days = F.lit([day.isoformat() for day in sorted(stats["spans"])]).cast("array<date>")
    row = stores.spark.range(1).select(
        *[F.lit(n).cast("bigint").alias(k) for k, n in counted.items()], days.alias("days")
    )
    stores.counters.write(row, bid)
    return counted


def replay_dead_letters(stores: Stores, fix, bid: str, **options) -> dict:
    """Feed the open dead letters back through ingestion after `fix`, a
    function from DataFrame to DataFrame.

    The replay notes first whose letters it takes: those of complete batches
    that no other replay has taken.  Once it is complete they are no longer
    open, and what it could not mend is its own.  So replays do not add up, and
    the same one again changes nothing.
    """
    planned = stores.replays.of_batch(bid).first()
    if planned is None:
        complete = stores.counters.read().filter(F.col("bid") != bid).select("bid")
        taken = stores.replays.read().select(F.explode("consumed").alias("bid"))
        open_ = stores.quarantine.read().select("bid").distinct().join(complete, "bid", "left_semi").join(taken, "bid", "left_anti")
        row = open_.agg(F.array_sort(F.collect_list("bid")).alias("consumed"))
        stores.replays.write(row, bid)
        planned = stores.replays.of_batch(bid).first()
    names = stores.spark.createDataFrame([(name,) for name in planned["consumed"]], "bid STRING")
    letters = stores.quarantine.read().join(names, "bid", "left_semi")
    mended = fix(letters).select("key", "value", "partition", "offset", "source", "line")
    return ingest_batch(stores, mended, bid, **options)
