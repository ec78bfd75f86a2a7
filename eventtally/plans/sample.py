"""Events, deliveries and raw records derived from the given `events` table.

The table has no channel, campaign or duplicates, so those are derived by
fixed rules (FIXTURES.md); every row of the table takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventtally.functions import clock
from eventtally.operators import project

# Whole seconds since 1970 of a timestamp without zone, by its calendar parts:
# a difference of timestamps would shift with the session zone's summer time.
_SECONDS = (
    "unix_date(cast(t AS DATE)) * 86400L + hour(t) * 3600 + minute(t) * 60 + cast(floor(second(t)) AS INT)"
).replace("(t", "(cast(ts AS TIMESTAMP_NTZ)")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The table as canonical events, with a weekly batch and an offset."""
    source = spark.read.parquet(f"{folder}/events.parquet")
    named = source.select(
        "event_id",
        F.col("event_type").alias("event_name"),
        F.expr(
            "CASE event_id % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'mobile' WHEN 2 THEN 'email' END"
        ).alias("channel"),
        F.expr("CASE WHEN event_id % 5 <> 0 THEN concat('cmp_', event_id % 7) END").alias("campaign_id"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("user_id"),
        F.expr(_SECONDS).alias("event_timestamp"),
        F.expr(
            "CASE WHEN event_id % 3 <> 0 THEN array(event_type, concat('group_', user_id % 10)) END"
        ).alias("tags"),
        F.col("props").alias("metadata"),
    )
    return named.withColumns({
        "event_date": clock.epoch_date(F.col("event_timestamp")),
        "batch_id": F.floor(clock.epoch_day(F.col("event_timestamp")) / 7).cast("bigint"),
        "offset": F.col("event_id") * 2,
    })


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Events with redeliveries: `error` events arrive twice in their batch,
    `click` events again in the next one, with another channel each time."""
    original = project.with_key(events(spark, folder))
    again = original.filter(F.col("event_name").isin("error", "click")).withColumns({
        "channel": F.lit("redelivered"),
        "batch_id": F.col("batch_id") + F.when(F.col("event_name") == "click", 1).otherwise(0),
        "offset": F.col("offset") + 1,
    })
    return original.unionByName(again)


def damaged(spark: SparkSession, folder: str) -> DataFrame:
    """Events of which some break a validation rule; 20 make a request."""
    rows = events(spark, folder)
    return rows.withColumns({
        "request_id": F.floor(F.col("event_id") / 20).cast("bigint"),
        "event_name": F.expr(
            "CASE WHEN event_id % 997 = 0 THEN '' WHEN event_id % 1009 = 0 THEN char(9) ELSE event_name END"
        ),
        "user_id": F.expr("CASE WHEN event_id % 1013 <> 0 THEN user_id END"),
        "event_timestamp": F.expr(
            "CASE WHEN event_id % 1019 = 0 THEN NULL WHEN event_id % 1021 = 0 THEN 0L ELSE event_timestamp END"
        ),
    })


def raw_records(spark: SparkSession, folder: str, source=events) -> DataFrame:
    """Deliveries as JSON records, some of them unreadable or refused."""
    rows = source(spark, folder).withColumn(
        "channel", F.expr("CASE WHEN event_id % 1019 = 0 THEN repeat('x', 101) ELSE channel END")
    )
    value = F.expr(
        "CASE WHEN event_id % 997 = 0 THEN substr(value, 2) "
        "WHEN event_id % 1009 = 0 THEN NULL "
        "WHEN event_id % 1013 = 0 THEN '{}' "
        "WHEN event_id % 1021 = 0 THEN replace(value, '\"timestamp\":', '\"timestamp\":\"x\",\"ts\":') "
        "ELSE value END"
    )
    return project.to_message(rows).withColumn("value", value)


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """A metrics request per user and event name, over the time the user was
    active: a third for the user's last channel, half of them by day."""
    number = F.regexp_extract("user_id", r"(\d+)$", 1).cast("bigint")
    return (
        events(spark, folder)
        .groupBy("user_id", "event_name")
        .agg(
            F.min("event_timestamp").alias("from"),
            F.max("event_timestamp").alias("to"),
            F.max_by("channel", "event_id").alias("last_channel"),
        )
        .select(
            F.concat_ws("/", "user_id", "event_name").alias("request_id"),
            "event_name", "from", "to",
            F.when(number % 3 == 0, F.col("last_channel")).when(number % 3 == 1, F.lit(" ")).alias("channel"),
            F.when(number % 2 == 1, F.lit("Daily")).otherwise(F.lit("weekly")).alias("group_by"),
        )
    )
