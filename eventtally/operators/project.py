"""From a validated event to a ledger row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventtally.functions import clock, keys, text


def with_key(events: DataFrame, timestamp: str = "event_timestamp") -> DataFrame:
    """Attach the idempotency key and its separator flag."""
    name, user, campaign = F.col("event_name"), F.col("user_id"), F.col("campaign_id")
    return events.withColumns({
        "idempotency_key": keys.idempotency_key(name, user, F.col(timestamp), campaign),
        "key_has_separator": keys.key_has_separator(name, user, campaign),
    })


def to_event(events: DataFrame) -> DataFrame:
    """Rename the timestamp, derive the UTC date, attach the key."""
    renamed = events.withColumnRenamed("timestamp", "event_timestamp")
    return with_key(
        renamed.withColumn("event_date", clock.epoch_date(F.col("event_timestamp")))
    )


def to_message(events: DataFrame, timestamp: str = "event_timestamp") -> DataFrame:
    """Add `key` (the user) and `value` (the event as JSON, absent members
    omitted) as they are published to the stream."""
    names = ("event_name", "channel", "campaign_id", "user_id")
    plain = F.to_json(F.struct(*names, F.col(timestamp).alias("timestamp"), "tags"))
    # Metadata already is JSON text, so it is spliced in instead of quoted.
    spliced = F.concat(
        F.substr(plain, F.lit(1), F.length(plain) - 1), F.lit(',"metadata":'), F.col("metadata"), F.lit("}")
    )
    return events.withColumns({"key": F.col("user_id"), "value": F.coalesce(spliced, plain)})


def stored_form(events: DataFrame) -> DataFrame:
    """The row as the relational store sees it: tags as JSON text too."""
    return events.withColumn("tags", text.json_text(F.col("tags")))
