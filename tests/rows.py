"""Events and records that tests are made of."""

import json

from eventtally.schema import RECORD

# 2026-02-15 12:00 UTC, on the hour.
T0 = 1771156800


def events_frame(spark, rows):
    """(event_name, user_id, timestamp, campaign_id, channel) tuples."""
    return spark.createDataFrame(
        rows, "event_name STRING, user_id STRING, event_timestamp BIGINT, campaign_id STRING, channel STRING"
    )


def records_frame(spark, values, first_offset=0):
    """JSON texts as records of one partition, in order."""
    rows = [(None, value, 0, first_offset + i) for i, value in enumerate(values)]
    return spark.createDataFrame(rows, RECORD)


def event_json(name="product_view", user="user_123", ts=T0, campaign="cmp_987", **more):
    event = {"event_name": name, "user_id": user, "timestamp": ts, "campaign_id": campaign, **more}
    return json.dumps({k: v for k, v in event.items() if v is not None})
