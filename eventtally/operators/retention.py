"""Retention: expiry by receive time, date windows, the partition calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_expired(received_at: Column, now: Column, days: Column) -> Column:
    """Strictly older than `days` days; both times in epoch seconds."""
    return received_at < now - days.cast("bigint") * F.lit(86400).cast("bigint")


def survivors(seen: DataFrame, received_at: Column, now: Column, days: Column) -> DataFrame:
    """What a time-to-live delete keeps."""
    return seen.filter(~F.coalesce(is_expired(received_at, now, days), F.lit(False)))


def expired_count(seen: DataFrame, received_at: Column, now: Column, days: Column) -> DataFrame:
    """How many rows a time-to-live delete removes."""
    return seen.agg(F.count_if(is_expired(received_at, now, days)).alias("deleted"))


def two_month_days(as_of: Column) -> Column:
    """The dates of the month of `as_of` and of the next, as an array."""
    first = F.trunc(as_of, "MM")
    return F.sequence(first, F.date_sub(F.add_months(first, 2), 1))


def partition_name(date: Column) -> Column:
    """Name of a day's partition, such as events_2026_02_15."""
    return F.concat(F.lit("events_"), F.replace(date.cast("string"), F.lit("-"), F.lit("_")))


def reaches_rollup(event_date: Column, refreshed_on: Column, days: Column) -> Column:
    """Whether a refresh counts an event.  There is no watermark: an event
    that comes late is counted as long as its date is inside the window of the
    refresh that follows it, and otherwise stays in the ledger only."""
    return event_date >= F.date_sub(refreshed_on, days)
