"""Upkeep of a deployment's tables: what runs beside the ingest, once a while."""

from __future__ import annotations

import datetime as dt

from eventtally.plans.ingest import Stores
from eventtally.plans.refresh import expire_letters
from eventtally.schema import INBOX_RETENTION_DAYS
from eventtally.sources.commits import KEEP_HOURS

#: A day of a table is merged once it has so many parts, and a table of batches once it has so many.
MERGE_PARTS = 24


def upkeep(
    stores: Stores, now: dt.datetime | None = None, merge_parts: int = MERGE_PARTS,
    letter_days: int = INBOX_RETENTION_DAYS, keep_hours: float = KEEP_HOURS,
) -> dict[str, int]:
    """Expire dead letters, merge what has come in many small parts, and remove what no reader needs any more;
    returns how much of each.

    Ingest, refreshes and readers go on meanwhile: merges are commits, or parts that replace others.  Each
    step is of use alone, and an upkeep that was cut off is made up for by the next one.
    """
    now = now or dt.datetime.now(dt.timezone.utc)
    name = f"upkeep-{int(now.timestamp())}"
    done = {"letters": expire_letters(stores, now, letter_days), "merged": 0, "removed": 0}
    ledger = stores.ledger
    for day in ledger.dates():
        done["merged"] += ledger.merge_day(day, name, merge_parts)
    # Counted users and sketches are merged by the refresh, whose versions name their state.
    for table in (stores.counters, stores.quarantine, stores.answers):
        done["merged"] += table.merge(keep_hours=keep_hours) if len(table._parts()) >= merge_parts else 0
    for table in (ledger, stores.rollup_users, stores.sketches):
        done["removed"] += table.vacuum(keep_hours)
    return done
