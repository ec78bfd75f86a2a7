"""Validation of requests and admission to storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventtally.functions import clock, text
from eventtally.schema import MAX_BULK_EVENTS, MAX_LENGTHS

# Fixed texts that must equal the reference's.
NAME_REQUIRED = "event_name is required"
USER_REQUIRED = "user_id is required"
TIMESTAMP_REQUIRED = "timestamp is required"
TIMESTAMP_POSITIVE = "timestamp must be a positive Unix epoch value"
EVENTS_REQUIRED = "events list must not be empty"
TOO_MANY_EVENTS = f"Maximum {MAX_BULK_EVENTS} events per bulk request"
QUERY_NAME_REQUIRED = "event_name is required for metrics queries"
FROM_REQUIRED = "from timestamp is required"
TO_REQUIRED = "to timestamp is required"

MALFORMED = "malformed JSON"
NOT_STORABLE = "cannot be stored"


def _violation(broken: Column, field: str, message: str) -> Column:
    return F.when(broken, F.struct(F.lit(field).alias("field"), F.lit(message).alias("message")))


def _only_present(candidates: list[Column]) -> Column:
    return F.array_compact(F.array(*candidates))


def event_violations(
    event_name: Column, user_id: Column, timestamp: Column
) -> Column:
    """ARRAY<STRUCT<field, message>> of the broken rules, by field name."""
    return _only_present([
        _violation(~text.not_blank(event_name), "event_name", NAME_REQUIRED),
        _violation(timestamp.isNull(), "timestamp", TIMESTAMP_REQUIRED),
        _violation(F.coalesce(timestamp <= 0, F.lit(False)), "timestamp", TIMESTAMP_POSITIVE),
        _violation(~text.not_blank(user_id), "user_id", USER_REQUIRED),
    ])


def is_valid_event(event_name: Column, user_id: Column, timestamp: Column) -> Column:
    """The four rules as one boolean, never NULL."""
    return (
        text.not_blank(event_name)
        & text.not_blank(user_id)
        & F.coalesce(timestamp > 0, F.lit(False))
    )


def with_violations(events: DataFrame, timestamp: str = "event_timestamp") -> DataFrame:
    return events.withColumn(
        "violations",
        event_violations(F.col("event_name"), F.col("user_id"), F.col(timestamp)),
    )


def bulk_size_violations(events: Column) -> Column:
    """Rules on the list of a bulk request."""
    size = F.coalesce(F.size(events), F.lit(0))
    return _only_present([
        _violation(events.isNull() | (size <= 0), "events", EVENTS_REQUIRED),
        _violation(size > MAX_BULK_EVENTS, "events", TOO_MANY_EVENTS),
    ])


def query_violations(event_name: Column, start: Column, end: Column) -> Column:
    """Rules on a metrics request.  A range that ends before it starts is
    allowed and simply matches nothing."""
    return _only_present([
        _violation(~text.not_blank(event_name), "event_name", QUERY_NAME_REQUIRED),
        _violation(start.isNull(), "from", FROM_REQUIRED),
        _violation(end.isNull(), "to", TO_REQUIRED),
    ])


def storage_fault(
    timestamp: str = "event_timestamp",
    first_date: str | None = None,
    last_date: str | None = None,
) -> Column:
    """Why storage would refuse a row, or NULL when it would take it.

    `first_date` and `last_date` (inclusive) limit the partitions that exist;
    without them a partition is created on write, and only a timestamp that
    has no date at all is refused.
    """
    reasons = [
        F.when(F.col(name).isNull(), F.lit(f"{name} is null"))
        for name in ("event_name", "user_id", timestamp)
    ]
    reasons += [
        F.when(F.char_length(F.col(name)) > limit, F.lit(f"{name} exceeds {limit} characters"))
        for name, limit in MAX_LENGTHS.items()
    ]
    at = F.col(timestamp)
    low, high = clock.FIRST_SECOND, clock.LAST_SECOND
    if first_date is not None:
        low = clock.midnight_of(first_date)
    if last_date is not None:
        high = clock.midnight_of(last_date) + clock.DAY - 1
    reasons.append(F.when(~at.between(F.lit(low), F.lit(high)), F.lit("event_date has no partition")))
    return F.coalesce(*reasons)
