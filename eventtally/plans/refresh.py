"""Refresh of the stored rollup, and the retention jobs."""

from __future__ import annotations

import collections
import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventtally.functions import clock, text
from eventtally.operators import retention, rollup as rollups, uniques
from eventtally.plans.ingest import BROADCAST_KEYS, Stores
from eventtally.schema import DEFAULT_RETENTION_DAYS, INBOX_RETENTION_DAYS, RETENTION_KEY
from eventtally.sources.commits import APPEND, CommitTable, Overtaken, Part, Snapshot, in_ranges


#: Parts of a day of counted users, or of sketches, that a refresh gathers in one.
MERGE_PARTS = 24


def today() -> dt.date:
    return dt.datetime.now(dt.timezone.utc).date()


def configured_days(config: DataFrame) -> int:
    """The retention setting; the default when it is missing or blank."""
    row = config.filter(F.col("key") == RETENTION_KEY).select(
        text.retention_days(F.col("value")).alias("days")
    ).first()
    return DEFAULT_RETENTION_DAYS if row is None else row["days"]


def refresh(
    stores: Stores, as_of: dt.date | None = None, full_history: bool = False, anew: bool = False,
    broadcast_users: int = BROADCAST_KEYS,
) -> int:
    """Bring the rollup up to date for the window that ends with `as_of`;
    returns its version.

    Each version notes how far in the ledger's commits it has counted, and which days it has.
    So a refresh reads the parts that batches added since: their counts are added to the old version,
    and of their users those that the table of counted users does not have in the same group, of which
    only parts with the same days and hours are opened.  Only days that come into the window, and
    days whose new parts cannot be told apart any more, are counted from all their events.  Days
    that left the window, or the ledger, are dropped.

    The new version names the state of the counted users it belongs to; what a refresh that failed has
    added there is taken out again by the next one.  Nothing to do leaves the version as it is; `anew`
    recomputes everything.
    """
    start = dt.date.min
    if not full_history:
        start = (as_of or today()) - dt.timedelta(days=configured_days(stores.config.read()))
    version = stores.rollup.current_version()
    noted = stores.rollup.note(version) or {"ledger": 0, "users": 0, "sketches": 0, "days": []}
    ledger = stores.ledger.snapshot()
    window = {day for day in ledger.days() if day >= start}
    done = {dt.date.fromisoformat(day) for day in noted["days"]}
    changes = None if anew else stores.ledger.changes(noted["ledger"], ledger.version)
    added = [part for commit in changes or [] if commit.kind == APPEND for part in commit.added]
    # A part that was merged since is found in the merged one only, with the rest of its day.
    unclear = {part.day for part in added if part.folder not in ledger.parts}
    kept = set() if changes is None else (window & done) - unclear
    delta = [part for part in added if part.day in kept]
    if version is not None and not anew and kept == window == done and not delta:
        return version

    whole = rollups.by_user(rollups.hourly_rows(stores.ledger.load(ledger.of(window - kept))))
    found = whole.withColumn("is_new", F.col("user_id").isNotNull())
    users, sketches = stores.rollup_users, stores.sketches
    users_then, sketches_then = users.snapshot(noted["users"]), sketches.snapshot(noted["sketches"])
    if delta:
        hours = [(part.low - part.low % clock.HOUR, part.high) for part in delta]
        known = users.load(_meeting(users_then.of(kept), delta, hours)).filter(
            in_ranges(F.col("date_hour"), hours, clock.HOUR)
        )
        small = sum(part.rows for part in delta) <= broadcast_users
        added = rollups.by_user(rollups.hourly_rows(stores.ledger.load(delta)))
        found = found.unionByName(rollups.marked_new(added, known, small))
    # Written once: the counts and sketches below are of what is written.
    fresh = users.stage(found, "refresh", ("date_hour", "event_name"))
    sketched = sketches.stage(uniques.group_sketches(users.load(fresh)), "refresh", ("date_hour",))
    new = rollups.counted(users.load(fresh))
    if kept:
        new = new.unionByName(stores.rollup.read().filter(F.col("event_date").isin(sorted(kept))))
    # Sorted files let min/max statistics skip other event names.
    laid_out = rollups.summed(new).hint("rebalance", "event_date").sortWithinPartitions(
        "event_date", "event_name", "date_hour"
    )
    now_users = _carried_on(users, users_then, kept, fresh, rollups.users_summed)
    now_sketches = _carried_on(sketches, sketches_then, kept, sketched, uniques.united)
    note = {
        "ledger": ledger.version, "users": now_users, "sketches": now_sketches,
        "days": sorted(day.isoformat() for day in window),
    }
    return stores.rollup.replace(laid_out, partition_by=["event_date"], note=note)


def _meeting(parts: list[Part], others: list[Part], hours: list[tuple[int, int]]) -> list[Part]:
    """The parts with a day and hours in common with the others."""
    return [
        p for p in parts
        if any(p.day == o.day and p.low <= high and low <= p.high for o, (low, high) in zip(others, hours, strict=True))
    ]


def _carried_on(
    table: CommitTable, then: Snapshot, kept: set[dt.date], fresh: list[Part], summed: Callable[[DataFrame], DataFrame],
) -> int:
    """Commit what a refresh adds to a table: the parts of kept days in a former state, and the fresh ones; a day with
    many parts is summed up in one.  Returns the version."""
    parts = then.of(kept) + fresh
    by_day = collections.Counter(part.day for part in parts)
    many = {day for day, n in by_day.items() if n >= MERGE_PARTS}
    if many:
        merged = table.stage(summed(table.load(p for p in parts if p.day in many)), "refresh", ("date_hour",))
        parts = [p for p in parts if p.day not in many] + merged
    stay = {part.folder for part in parts}
    while True:
        now = table.snapshot()
        gone = [part for part in now.parts.values() if part.folder not in stay]
        try:
            return table.commit(now, APPEND, "refresh", [p for p in parts if p.folder not in now.parts], gone).version
        except Overtaken:
            continue


def expire_days(stores: Stores, before: dt.date) -> list[dt.date]:
    """Drop whole days of the ledger; the next refresh forgets them too."""
    return stores.ledger.drop_before(before)


def expire_letters(stores: Stores, now: dt.datetime | None = None, days: int = INBOX_RETENTION_DAYS) -> int:
    """Delete dead letters received more than `days` days ago; returns how many
    that were.  The rest is gathered in one part."""
    now = now or dt.datetime.now(dt.timezone.utc)
    aged = (F.unix_seconds("received_at"), F.lit(int(now.timestamp())).cast("bigint"), F.lit(days))
    deleted = retention.expired_count(stores.quarantine.read(), *aged).first()["deleted"]
    if deleted:
        stores.quarantine.merge(lambda rows: retention.survivors(rows, *aged))
    return deleted
