"""Hourly rollup of event and distinct-user counts, whole or by what is new."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventtally.functions import clock


def window_start(as_of: Column, days: Column) -> Column:
    """First date of the retention window: N = 7 keeps eight dates, and any
    later ones."""
    return F.date_sub(as_of, days)


def hourly_rollup(ledger: DataFrame, since: Column | None = None) -> DataFrame:
    """Counts per event name, channel (NULL is its own group), hour and date.

    Without `since` the full history is rolled up.  Spark plans the distinct
    count as (group, user) first, shuffled on both, then the group; so neither
    a hot group nor a hot user ends up in one task.
    """
    rows = ledger if since is None else ledger.filter(F.col("event_date") >= since)
    return (
        hourly_rows(rows)
        .groupBy("event_name", "channel", "date_hour", "event_date")
        .agg(
            F.count("*").alias("total_count"),
            F.count_distinct("user_id").alias("unique_user_count"),
        )
    )


GROUP = ("event_name", "channel", "date_hour", "event_date")


def hourly_rows(ledger: DataFrame) -> DataFrame:
    """The rollup group and the user of each event."""
    return ledger.select(
        "event_name", "channel", clock.epoch_hour(F.col("event_timestamp")).alias("date_hour"), "event_date", "user_id"
    )


def by_user(rows: DataFrame) -> DataFrame:
    """How many events a user has in each group."""
    return rows.groupBy(*GROUP, "user_id").agg(F.count("*").alias("events"))


def marked_new(found: DataFrame, known: DataFrame, broadcast: bool) -> DataFrame:
    """`found`, rows of `by_user`, with is_new: whether `known` lacks the user in the group.

    With `broadcast`, for a `found` that is known to be small, `known` stays where it lies and only what
    both have is looked up.  An event without a user has no new one.
    """
    keys = (*GROUP, "user_id")

    def renamed(rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(c).alias(f"_{c}") for c in keys])

    def same(one: DataFrame, other: DataFrame) -> Column:
        # A channel that is NULL is a group of its own.
        return functools.reduce(lambda a, b: a & b, [one[c].eqNullSafe(other[f"_{c}"]) for c in keys])

    if broadcast:
        wanted = F.broadcast(renamed(found))
        hits = F.broadcast(renamed(known.join(wanted, same(known, wanted), "left_semi")).distinct())
    else:
        hits = renamed(known).distinct()
    hits = hits.withColumn("_known", F.lit(True))
    new = F.col("_known").isNull() & F.col("user_id").isNotNull()
    return found.join(hits, same(found, hits), "left").select(*found.columns, new.alias("is_new"))


def counted(user_rows: DataFrame) -> DataFrame:
    """What rows of `marked_new` add to the rollup."""
    return user_rows.groupBy(*GROUP).agg(
        F.sum("events").alias("total_count"), F.count_if("is_new").alias("unique_user_count")
    )


def users_summed(user_rows: DataFrame) -> DataFrame:
    """Rows of `marked_new` of several refreshes, one a user and group."""
    return user_rows.groupBy(*GROUP, "user_id").agg(F.sum("events").alias("events"), F.bool_or("is_new").alias("is_new"))


def summed(parts: DataFrame) -> DataFrame:
    """Rollup rows of equal groups, added up."""
    return parts.groupBy(*GROUP).agg(
        F.sum("total_count").alias("total_count"), F.sum("unique_user_count").alias("unique_user_count")
    )
