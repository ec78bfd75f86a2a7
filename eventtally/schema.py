"""Schemas and the fixed limits of the data model."""

from __future__ import annotations

# One event as it arrives in JSON.  `metadata` stays JSON text: it is stored
# and handed back, never queried.
EVENT_FIELDS = (
    "event_name STRING, channel STRING, campaign_id STRING, user_id STRING, "
    "timestamp BIGINT, tags ARRAY<STRING>, metadata STRING"
)
CORRUPT = "_corrupt"
EVENT_JSON = f"{EVENT_FIELDS}, {CORRUPT} STRING"
BULK_JSON = f"events ARRAY<STRUCT<{EVENT_FIELDS.replace(' ', ': ').replace(',: ', ', ')}>>, {CORRUPT} STRING"

# A record of the ingestion stream, in the shape of Spark's Kafka source.
RECORD = "key STRING, value STRING, partition INT, offset BIGINT"

# Ledger rows; event_date and bid are the partition columns.
LEDGER_COLUMNS = (
    "event_name", "channel", "campaign_id", "user_id", "event_timestamp",
    "tags", "metadata", "idempotency_key", "key_has_separator", "received_at",
    "event_date", "bid",
)
LEDGER = (
    "event_name STRING, channel STRING, campaign_id STRING, user_id STRING, "
    "event_timestamp BIGINT, tags ARRAY<STRING>, metadata STRING, "
    "idempotency_key STRING, key_has_separator BOOLEAN, received_at TIMESTAMP, "
    "event_date DATE, bid STRING"
)

QUARANTINE = (
    "key STRING, value STRING, partition INT, offset BIGINT, source STRING, line BIGINT, "
    "reason STRING, received_at TIMESTAMP, bid STRING"
)

COUNTERS = (
    "received BIGINT, skipped BIGINT, dead BIGINT, deserialized BIGINT, "
    "unique_keys BIGINT, inserted BIGINT, in_batch_duplicates BIGINT, "
    "cross_batch_duplicates BIGINT, days ARRAY<DATE>, bid STRING"
)

ANSWERS = (
    "request_id STRING, kind STRING, status STRING, accepted_count BIGINT, message STRING, "
    "violations ARRAY<STRUCT<field: STRING; message: STRING>>, bid STRING"
).replace(";", ",")

# Which batches' dead letters a replay takes.
REPLAYS = "consumed ARRAY<STRING>, bid STRING"

ROLLUP = (
    "event_name STRING, channel STRING, date_hour BIGINT, total_count BIGINT, "
    "unique_user_count BIGINT, event_date DATE"
)

# What each refresh of the rollup has counted, by user; is_new where no refresh before had the user in the group.
ROLLUP_USERS = (
    "event_name STRING, channel STRING, date_hour BIGINT, user_id STRING, events BIGINT, is_new BOOLEAN, event_date DATE"
)

SKETCHES = "event_name STRING, channel STRING, event_date DATE, date_hour BIGINT, users BINARY"

CONFIG = "key STRING, value STRING"

# Fixed values that must equal the reference's.
MAX_BULK_EVENTS = 1000
MAX_LENGTHS = {"event_name": 255, "channel": 100, "campaign_id": 100, "user_id": 255}
KEY_SEPARATOR = "|"
TOPIC = "events-ingestion"
TOPIC_PARTITIONS = 6
DEAD_LETTER_SUFFIX = ".DLT"
MAX_RECORDS_PER_POLL = 1000
RETENTION_KEY = "mv_retention_days"
DEFAULT_RETENTION_DAYS = 7
INBOX_RETENTION_DAYS = 7
REFRESH_SECONDS = 60
RETRY_SECONDS = (1.0, 2.0)
UPKEEP_SECONDS = 3600
