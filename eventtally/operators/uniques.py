"""True distinct users over a range, which sums of hourly counts overstate.

Not part of the metrics answers; ask for it explicitly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventtally.functions import clock


#: Three standard errors of a sketch of 4,096 buckets, as a share of the count.
ERROR_BOUND = 0.05


def exact_users(ledger: DataFrame, since: int, until: int, *by: str) -> DataFrame:
    """Exact distinct users per `by` group for hours starting in the range."""
    hour = clock.epoch_hour(F.col("event_timestamp"))
    return (
        ledger.filter(
            F.col("event_date").between(clock.date_of(since), clock.date_of(until))
            & (hour >= since) & (hour < until)
        )
        .groupBy(*by)
        .agg(F.count_distinct("user_id").alias("true_unique_users"))
    )


def hourly_sketches(ledger: DataFrame) -> DataFrame:
    """A mergeable HLL sketch per rollup group, small enough to store."""
    return group_sketches(ledger.withColumn("date_hour", clock.epoch_hour(F.col("event_timestamp"))))


def group_sketches(rows: DataFrame) -> DataFrame:
    """The same of rows that have their hour already."""
    return rows.groupBy("event_name", "channel", "event_date", "date_hour").agg(F.hll_sketch_agg("user_id").alias("users"))


def united(sketches: DataFrame) -> DataFrame:
    """Sketches of several refreshes, one a group."""
    return sketches.groupBy("event_name", "channel", "event_date", "date_hour").agg(F.hll_union_agg("users").alias("users"))


def sketched_users(sketches: DataFrame, since: int, until: int, *by: str) -> DataFrame:
    """Approximate distinct users over a range, from stored sketches."""
    return (
        sketches.filter(
            F.col("event_date").between(clock.date_of(since), clock.date_of(until))
            & (F.col("date_hour") >= since) & (F.col("date_hour") < until)
        )
        .groupBy(*by)
        .agg(F.hll_sketch_estimate(F.hll_union_agg("users")).alias("approx_unique_users"))
    )
