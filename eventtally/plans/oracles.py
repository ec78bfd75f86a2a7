"""The registered queries as plain SQL over the same tables, for DuckDB."""

from __future__ import annotations

FROM, TO = 1704412800, 1705708800
FROM_MID, TO_MID = FROM + 1800, TO - 2400
ABSENT_KEY = "b1a84c038bc6a3cf10d06e74d0ff2466c18b98fa34938b1c5cf3b9a5dfbf90de"

_EVENTS = """
events_c AS (
  SELECT event_id, event_type AS event_name,
         CASE event_id % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'mobile' WHEN 2 THEN 'email' END AS channel,
         CASE WHEN event_id % 5 <> 0 THEN 'cmp_' || (event_id % 7) END AS campaign_id,
         'user_' || user_id AS user_id, user_id AS user_number,
         epoch_us(ts) // 1000000 AS event_timestamp,
         CASE WHEN event_id % 3 <> 0
              THEN '["' || event_type || '","group_' || (user_id % 10) || '"]' END AS tags,
         props AS metadata,
         CAST(ts AS DATE) AS event_date,
         (epoch_us(ts) // 1000000) // 604800 AS batch_id,
         event_id * 2 AS "offset"
  FROM events
),
keyed AS (
  SELECT *, sha256(event_name || '|' || user_id || '|' || event_timestamp || '|'
                   || coalesce(campaign_id, '')) AS idempotency_key
  FROM events_c
)"""

_ARRIVALS = _EVENTS + """,
arrivals AS (
  SELECT * FROM keyed
  UNION ALL
  SELECT * REPLACE ('redelivered' AS channel, "offset" + 1 AS "offset",
                    batch_id + CASE WHEN event_name = 'click' THEN 1 ELSE 0 END AS batch_id)
  FROM keyed WHERE event_name IN ('error', 'click')
)"""

_LEDGER = _ARRIVALS + """,
ledger AS (
  SELECT * FROM arrivals
  QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY batch_id, "offset" DESC) = 1
)"""

_DAMAGED = _EVENTS + """,
damaged AS (
  SELECT event_id, event_id // 20 AS request_id,
         CASE WHEN event_id % 997 = 0 THEN '' WHEN event_id % 1009 = 0 THEN chr(9)
              ELSE event_name END AS event_name,
         CASE WHEN event_id % 1013 <> 0 THEN user_id END AS user_id,
         CASE WHEN event_id % 1019 = 0 THEN NULL WHEN event_id % 1021 = 0 THEN 0
              ELSE event_timestamp END AS event_timestamp,
         campaign_id
  FROM events_c
),
judged AS (
  SELECT *, coalesce(trim(event_name, ' ' || chr(9)) <> '', false) AS has_name,
         coalesce(trim(user_id, ' ' || chr(9)) <> '', false) AS has_user
  FROM damaged
),
verdicts AS (
  SELECT *, has_name AND has_user AND coalesce(event_timestamp > 0, false) AS valid FROM judged
),
requests AS (
  SELECT request_id, count(*) AS event_count, count(*) FILTER (NOT valid) AS invalid_count,
         count(*) FILTER (NOT valid) = 0 AND count(*) <= 1000 AS accepted
  FROM verdicts GROUP BY request_id
)"""

# One member of the JSON text after another; absent ones are omitted.
_MESSAGE = """'{"event_name":"' || event_name || '"'
  || coalesce(',"channel":"' || channel || '"', '')
  || coalesce(',"campaign_id":"' || campaign_id || '"', '')
  || ',"user_id":"' || user_id || '","timestamp":' || event_timestamp
  || coalesce(',"tags":' || tags, '')
  || coalesce(',"metadata":' || metadata, '') || '}'"""


def _raw(source: str, name: str = "raw") -> str:
    """Raw records and their fate, from events or arrivals."""
    return f""",
{name}_long AS (
  SELECT * REPLACE (CASE WHEN event_id % 1019 = 0 THEN repeat('x', 101) ELSE channel END AS channel)
  FROM {source}
),
{name}_text AS (SELECT *, {_MESSAGE} AS message FROM {name}_long),
{name} AS (
  SELECT *, CASE WHEN event_id % 997 = 0 THEN message[2:]
                 WHEN event_id % 1009 = 0 THEN NULL
                 WHEN event_id % 1013 = 0 THEN '{{}}'
                 WHEN event_id % 1021 = 0
                   THEN replace(message, '"timestamp":', '"timestamp":"x","ts":')
                 ELSE message END AS value,
         CASE WHEN event_id % 997 = 0 THEN 'malformed JSON'
              WHEN event_id % 1009 = 0 THEN NULL
              WHEN event_id % 1013 = 0 THEN 'event_name is null'
              WHEN event_id % 1021 = 0 THEN 'malformed JSON'
              WHEN event_id % 1019 = 0 THEN 'channel exceeds 100 characters' END AS reason,
         event_id % 997 <> 0 AND event_id % 1009 = 0 AS skipped
  FROM {name}_text
)"""


_RAW_EVENTS = _EVENTS + _raw("keyed")
_RAW_ARRIVALS = _ARRIVALS + _raw("arrivals")
_STORED = _RAW_ARRIVALS + """,
stored AS (
  SELECT * FROM raw WHERE reason IS NULL AND NOT skipped
  QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY batch_id, "offset" DESC) = 1
)"""


def _rollup(source: str, where: str = "true", name: str = "rollup") -> str:
    return f""",
{name} AS (
  SELECT event_name, channel, event_timestamp // 3600 * 3600 AS date_hour, event_date,
         count(*) AS total_count, count(DISTINCT user_id) AS unique_user_count
  FROM {source} WHERE {where}
  GROUP BY ALL
)"""


_FULL = _EVENTS + _rollup("events_c")
_ROLLUP_OUT = """
SELECT event_name, channel, date_hour, CAST(event_date AS VARCHAR) AS event_date,
       total_count, unique_user_count FROM rollup"""


def _window(days: str) -> str:
    return f"event_date >= (SELECT max(event_date) FROM events_c) - CAST({days} AS INTEGER)"


def _where(name: str, low: int, high: int, channel: str | None = None) -> str:
    text = f"event_name = '{name}' AND date_hour >= {low} AND date_hour < {high}"
    return text + (f" AND channel = '{channel}'" if channel else "")


def _totals(prefix: str, *where) -> str:
    return f"""WITH {prefix}
SELECT CAST(coalesce(sum(total_count), 0) AS BIGINT) AS total_count,
       CAST(coalesce(sum(unique_user_count), 0) AS BIGINT) AS unique_user_count
FROM rollup WHERE {_where(*where)}"""


def _label(seconds: str) -> str:
    return f"strftime(make_timestamp(({seconds}) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"


def _breakdown(prefix: str, daily: bool, *where) -> str:
    bucket = "date_hour // 86400 * 86400" if daily else "date_hour"
    return f"""WITH {prefix}
SELECT {_label(bucket)} AS bucket, CAST(sum(total_count) AS BIGINT) AS total_count,
       CAST(sum(unique_user_count) AS BIGINT) AS unique_user_count
FROM rollup WHERE {_where(*where)} GROUP BY 1 ORDER BY 1"""


_PARTS = """'{"bucket":"' || bucket || '","total_count":' || total_count
  || ',"unique_user_count":' || unique_user_count || '}'"""

_ASKED = _FULL + f""",
asked AS (
  SELECT user_id || '/' || event_name AS request_id, event_name,
         min(event_timestamp) AS low, max(event_timestamp) AS high,
         CASE user_number % 3 WHEN 0 THEN arg_max_null(channel, event_id) WHEN 1 THEN ' ' END AS channel,
         user_number % 2 = 1 AS daily
  FROM events_c GROUP BY user_id, user_number, event_name
),
found AS (
  SELECT request_id, CASE WHEN daily THEN date_hour // 86400 * 86400 ELSE date_hour END AS start,
         sum(total_count) AS total_count, sum(unique_user_count) AS unique_user_count
  FROM asked a JOIN rollup r
    ON r.event_name = a.event_name AND r.date_hour >= a.low AND r.date_hour < a.high
   AND (a.channel IS NULL OR a.channel = ' ' OR r.channel = a.channel)
  GROUP BY 1, 2
),
labelled AS (
  SELECT request_id, {_label('start')} AS bucket, total_count, unique_user_count FROM found
),
answers AS (
  SELECT a.request_id, any_value(a.event_name) AS event_name, any_value(low) AS low,
         any_value(high) AS high, any_value(a.channel) AS channel,
         CAST(coalesce(sum(total_count), 0) AS BIGINT) AS total_count,
         CAST(coalesce(sum(unique_user_count), 0) AS BIGINT) AS unique_user_count,
         count(bucket) AS buckets,
         coalesce(string_agg({_PARTS}, ',' ORDER BY bucket), '') AS parts
  FROM asked a LEFT JOIN labelled l ON l.request_id = a.request_id GROUP BY a.request_id
)"""

_RESPONSE = """'{"status":"' || CASE WHEN ACC THEN 'accepted' ELSE 'rejected' END
  || '","acceptedCount":' || CASE WHEN ACC THEN N ELSE 0 END || ',"message":"'
  || CASE WHEN ACC THEN 'MSG' ELSE 'Validation failed' END || '"}'"""


def _response(accepted: str, count: str, message: str) -> str:
    return _RESPONSE.replace("ACC", accepted).replace(" N ", f" {count} ").replace("MSG", message)


_MESSAGES = [
    ("NOT has_name", "event_name", "event_name is required"),
    ("event_timestamp IS NULL", "timestamp", "timestamp is required"),
    ("event_timestamp <= 0", "timestamp", "timestamp must be a positive Unix epoch value"),
    ("NOT has_user", "user_id", "user_id is required"),
]
_VIOLATIONS = "concat_ws('; ', " + ", ".join(
    f"CASE WHEN {rule} THEN '{field}: {message}' END" for rule, field, message in _MESSAGES
) + ")"
_VIOLATION_COUNT = " + ".join(
    f"CASE WHEN {rule} THEN 1 ELSE 0 END" for rule, _, _ in _MESSAGES
)
_POSITIONED = "concat_ws(', ', " + ", ".join(
    f"CASE WHEN {rule} THEN 'events[' || (event_id % 20) || '].{field}' END"
    for rule, field, _ in _MESSAGES
) + ")"

_NEWEST = "(SELECT max(batch_id) FROM events_c)"
_SPLIT = _ARRIVALS + f""",
newest AS (SELECT * FROM arrivals WHERE batch_id = {_NEWEST}),
before AS (
  SELECT * FROM arrivals WHERE batch_id < {_NEWEST}
  QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY batch_id, "offset" DESC) = 1
),
reduced AS (
  SELECT * FROM newest
  QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY "offset" DESC) = 1
),
fresh AS (SELECT * FROM reduced r WHERE NOT EXISTS (
  SELECT 1 FROM before b WHERE b.idempotency_key = r.idempotency_key))"""

_COUNTED = """,
per_key AS (
  SELECT idempotency_key, batch_id, count(*) AS copies,
         min(batch_id) OVER (PARTITION BY idempotency_key) AS first_batch
  FROM {source} GROUP BY idempotency_key, batch_id
),
counted AS (
  SELECT batch_id, CAST(sum(copies) AS BIGINT) AS deserialized, count(*) AS unique_keys,
         count(*) FILTER (first_batch = batch_id) AS inserted
  FROM per_key GROUP BY batch_id
)"""

_STORED_COUNTERS = "WITH " + _RAW_ARRIVALS + """,
good AS (SELECT * FROM raw WHERE reason IS NULL AND NOT skipped)""" + _COUNTED.format(source="good") + """,
received AS (
  SELECT batch_id, count(*) AS received, count(*) FILTER (skipped) AS skipped,
         count(reason) AS dead
  FROM raw GROUP BY batch_id
)
SELECT received, skipped, dead, deserialized, unique_keys, inserted,
       deserialized - unique_keys AS in_batch_duplicates,
       unique_keys - inserted AS cross_batch_duplicates
FROM received r JOIN counted c ON c.batch_id = r.batch_id"""

_STORED_LEDGER = "WITH " + _STORED + """
SELECT idempotency_key, event_name, channel, campaign_id, user_id, event_timestamp,
       CAST(event_date AS VARCHAR) AS event_date, CAST(json(metadata) AS VARCHAR) AS metadata, tags
FROM stored"""

_STORED_DEAD = "WITH " + _RAW_ARRIVALS + """
SELECT user_id AS key, value, "offset", reason FROM raw WHERE reason IS NOT NULL"""

_TEN_DAYS = _STORED + _rollup("stored", _window("10"))


def _settings(where: str) -> str:
    return f"""SELECT user_id AS key, arg_max(coalesce(campaign_id, 'none'), event_id) AS value
  FROM events_c WHERE {where} GROUP BY user_id"""


def _merged(winner: str, loser: str) -> str:
    return f"""WITH {_EVENTS},
winner AS ({_settings(winner)}),
loser AS ({_settings(loser)})
SELECT key, value FROM winner
UNION ALL
SELECT key, value FROM loser l WHERE NOT EXISTS (SELECT 1 FROM winner w WHERE w.key = l.key)"""


_RECEIVED = _EVENTS + """,
seen AS (SELECT idempotency_key, event_timestamp + 3600 AS received_at FROM keyed)"""
_EXPIRED = "received_at < (SELECT max(received_at) FROM seen) - 7 * 86400"

ORACLES: dict[str, str] = {
    "idempotency_key": f"""WITH {_ARRIVALS}
SELECT event_id, "offset", idempotency_key FROM arrivals""",
    "canonical_events": f"""WITH {_EVENTS}
SELECT event_id, event_name, channel, campaign_id, user_id, event_timestamp,
       CAST(event_date AS VARCHAR) AS event_date, tags, metadata, idempotency_key FROM keyed""",
    "clock_parts": f"""WITH {_EVENTS}
SELECT event_id, CAST(event_date AS VARCHAR) AS event_date,
       event_timestamp // 3600 * 3600 AS hour_start, event_timestamp // 86400 * 86400 AS day_start,
       {_label('event_timestamp')} AS instant FROM events_c""",
    "publish_messages": f"""WITH {_EVENTS}
SELECT event_id, user_id AS key, {_MESSAGE} AS value FROM events_c""",
    "published_keys": f"""WITH {_EVENTS}
SELECT user_id AS key, count(*) AS sent, min("offset") AS first_offset, max("offset") AS last_offset
FROM events_c GROUP BY user_id""",
    "parse_records": f"""WITH {_RAW_EVENTS},
told AS (SELECT *, reason IS NULL AND NOT skipped AS ok FROM raw)
SELECT event_id, CASE WHEN skipped THEN 'skipped' WHEN ok THEN 'ok' ELSE 'dead' END AS status,
       CASE WHEN ok THEN event_name END AS event_name, CASE WHEN ok THEN channel END AS channel,
       CASE WHEN ok THEN campaign_id END AS campaign_id, CASE WHEN ok THEN user_id END AS user_id,
       CASE WHEN ok THEN CAST(event_date AS VARCHAR) END AS event_date,
       CASE WHEN ok THEN CAST(json(metadata) AS VARCHAR) END AS metadata,
       CASE WHEN ok THEN idempotency_key END AS idempotency_key, CASE WHEN ok THEN tags END AS tags
FROM told""",
    "quarantine_rows": f"""WITH {_RAW_EVENTS}
SELECT user_id AS key, value, "offset", reason FROM raw WHERE reason IS NOT NULL""",
    "partition_admission": f"""WITH {_EVENTS}
SELECT CASE WHEN event_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' THEN 'stored'
            ELSE 'event_date has no partition' END AS outcome, count(*) AS events
FROM events_c GROUP BY 1""",
    "validate_events": f"""WITH {_DAMAGED}
SELECT event_id, CAST({_VIOLATION_COUNT} AS BIGINT) AS violation_count, {_VIOLATIONS} AS violations
FROM verdicts""",
    "single_responses": f"""WITH {_DAMAGED}
SELECT event_id, {_response('valid', '1', 'Event queued for processing')} AS response FROM verdicts""",
    "bulk_admission": f"""WITH {_DAMAGED}
SELECT request_id, event_count, invalid_count,
       CASE WHEN accepted THEN 'accepted' ELSE 'rejected' END AS status,
       CASE WHEN accepted THEN event_count ELSE 0 END AS accepted_count,
       CASE WHEN accepted THEN 'Events queued for processing' ELSE 'Validation failed' END AS message
FROM requests""",
    "bulk_admitted_rows": f"""WITH {_DAMAGED}
SELECT v.request_id, event_id, event_name FROM verdicts v JOIN requests r
  ON r.request_id = v.request_id WHERE r.accepted""",
    "bulk_payloads": f"""WITH {_DAMAGED},
broken AS (
  SELECT request_id, string_agg({_POSITIONED}, ', ' ORDER BY event_id) AS fields
  FROM verdicts WHERE NOT valid GROUP BY request_id
)
SELECT r.request_id, {_response('accepted', 'event_count', 'Events queued for processing')} AS response,
       coalesce(fields, '') AS fields
FROM requests r LEFT JOIN broken b ON b.request_id = r.request_id""",
    "bulk_explode": f"""WITH {_DAMAGED}
SELECT v.request_id, event_id % 20 AS position,
       sha256(event_name || '|' || user_id || '|' || event_timestamp || '|'
              || coalesce(campaign_id, '')) AS idempotency_key
FROM verdicts v JOIN requests r ON r.request_id = v.request_id WHERE r.accepted""",
    "seen_keys": f"""WITH {_SPLIT}
SELECT DISTINCT n.idempotency_key FROM newest n JOIN before b ON b.idempotency_key = n.idempotency_key""",
    "unseen_keys": f"""WITH {_SPLIT}
SELECT idempotency_key, event_name, channel, "offset" FROM fresh""",
    "insert_ignore": f"""WITH {_SPLIT}
SELECT idempotency_key, CAST(event_date AS VARCHAR) AS event_date, channel, batch_id FROM before
UNION ALL
SELECT idempotency_key, CAST(event_date AS VARCHAR) AS event_date, channel, batch_id FROM fresh""",
    "key_exists": f"""WITH {_STORED}
SELECT count(DISTINCT idempotency_key) FILTER (idempotency_key = (SELECT min(idempotency_key) FROM stored)) AS present,
       count(DISTINCT idempotency_key) FILTER (idempotency_key = '{ABSENT_KEY}') AS absent
FROM stored""",
    "dedup_in_batch": f"""WITH {_ARRIVALS}
SELECT batch_id, idempotency_key, channel, "offset",
       min("offset") OVER (PARTITION BY batch_id, idempotency_key) AS first_offset
FROM arrivals
QUALIFY row_number() OVER (PARTITION BY batch_id, idempotency_key ORDER BY "offset" DESC) = 1""",
    "dedup_ledger": f"""WITH {_LEDGER}
SELECT idempotency_key, event_name, channel, campaign_id, user_id, event_timestamp,
       CAST(event_date AS VARCHAR) AS event_date, batch_id, "offset" FROM ledger""",
    "batch_counters": f"""WITH {_ARRIVALS}{_COUNTED.format(source='arrivals')}
SELECT batch_id, deserialized, unique_keys, inserted,
       deserialized - unique_keys AS in_batch_duplicates,
       unique_keys - inserted AS cross_batch_duplicates FROM counted""",
    "hourly_rollup": f"WITH {_EVENTS}{_rollup('events_c', _window('7'))}{_ROLLUP_OUT}",
    "rollup_full_history": f"WITH {_FULL}{_ROLLUP_OUT}",
    "totals": _totals(_FULL, "click", FROM, TO),
    "totals_empty": _totals(_FULL, "nope", FROM, TO),
    "totals_reversed": _totals(_FULL, "click", TO, FROM),
    "totals_channel": _totals(_FULL, "click", FROM, TO, "web"),
    "totals_blank_channel": _totals(_FULL, "click", FROM, TO),
    "breakdown_hourly": _breakdown(_FULL, False, "click", FROM, TO),
    "breakdown_daily": _breakdown(_FULL, True, "click", FROM, TO),
    "breakdown_daily_channel": _breakdown(_FULL, True, "view", FROM, TO, "mobile"),
    "breakdown_midhour": _breakdown(_FULL, False, "click", FROM_MID, TO_MID),
    "metrics_document": f"""WITH {_FULL},
labelled AS (
  SELECT {_label('date_hour // 86400 * 86400')} AS bucket, sum(total_count) AS total_count,
         sum(unique_user_count) AS unique_user_count
  FROM rollup WHERE {_where('click', FROM_MID, TO_MID, 'web')} GROUP BY 1
)
SELECT '{{"event_name":"click","total_count":' || coalesce(sum(total_count), 0)
  || ',"unique_user_count":' || coalesce(sum(unique_user_count), 0)
  || ',"time_range":{{"from":{FROM_MID},"to":{TO_MID}}},"channel":"web","breakdowns":['
  || coalesce(string_agg({_PARTS}, ',' ORDER BY bucket), '') || ']}}' AS document
FROM labelled""",
    "metrics_requests": f"""WITH {_ASKED}
SELECT request_id, total_count, unique_user_count, buckets FROM answers""",
    "metrics_documents": f"""WITH {_ASKED}
SELECT request_id, '{{"event_name":"' || event_name || '","total_count":' || total_count
  || ',"unique_user_count":' || unique_user_count || ',"time_range":{{"from":' || low
  || ',"to":' || high || '}}' || coalesce(',"channel":"' || channel || '"', '')
  || ',"breakdowns":[' || parts || ']}}' AS document
FROM answers""",
    "metrics_request_checks": f"""WITH {_ASKED}
SELECT request_id, CASE event_name WHEN 'view' THEN 'event_name is required for metrics queries'
                                   WHEN 'error' THEN 'to timestamp is required' ELSE '' END AS violations
FROM asked""",
    "unique_exact": f"""WITH {_EVENTS}
SELECT event_name, count(DISTINCT user_id) AS true_unique_users FROM events_c
WHERE event_timestamp // 3600 * 3600 >= {FROM} AND event_timestamp // 3600 * 3600 < {TO}
GROUP BY event_name""",
    "unique_sketch": f"""WITH {_EVENTS}
SELECT event_name, channel, count(DISTINCT user_id) AS true_unique_users, CAST(0 AS BIGINT) AS bounds_off FROM events_c
WHERE event_timestamp // 3600 * 3600 >= {FROM} AND event_timestamp // 3600 * 3600 < {TO}
GROUP BY event_name, channel""",
    "config_upsert": _merged("event_name = 'purchase'", "event_name <> 'purchase'"),
    "config_insert_missing": _merged("event_name = 'purchase'", "event_name <> 'purchase'"),
    "retention_from_config": f"""WITH {_EVENTS}{_rollup(
        'events_c', _window('(SELECT count(DISTINCT event_name) FROM events_c)'))}
SELECT CAST(event_date AS VARCHAR) AS event_date, CAST(sum(total_count) AS BIGINT) AS total_count,
       CAST(sum(unique_user_count) AS BIGINT) AS unique_user_count
FROM rollup GROUP BY 1""",
    "ttl_survivors": f"""WITH {_RECEIVED}
SELECT idempotency_key, received_at FROM seen WHERE NOT ({_EXPIRED})""",
    "ttl_deleted": f"WITH {_RECEIVED} SELECT count(*) AS deleted FROM seen WHERE {_EXPIRED}",
    "late_events": f"""WITH {_EVENTS}
SELECT CAST(event_date AS VARCHAR) AS event_date, event_name, count(DISTINCT idempotency_key) AS in_ledger,
       count(DISTINCT idempotency_key) FILTER (event_date >= (SELECT max(event_date) FROM events_c)) AS counted
FROM keyed GROUP BY event_date, event_name""",
    "partition_calendar": f"""WITH {_EVENTS},
edge AS (SELECT date_trunc('month', max(event_date)) AS first_day FROM events_c),
days AS (
  SELECT CAST(unnest(generate_series(CAST(first_day AS TIMESTAMP),
    CAST(first_day AS TIMESTAMP) + INTERVAL 2 MONTH - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS d
  FROM edge
)
SELECT 'events_' || strftime(d, '%Y_%m_%d') AS partition_name, count(event_id) AS events
FROM days LEFT JOIN events_c ON event_date = d GROUP BY d""",
    "stored_ledger": _STORED_LEDGER,
    "stored_counters": _STORED_COUNTERS,
    "stored_quarantine": _STORED_DEAD,
    "stored_rollup": f"WITH {_TEN_DAYS}{_ROLLUP_OUT}",
    "stored_totals": _totals(_TEN_DAYS, "click", FROM, TO + 10 * 86400, "web"),
    "stored_breakdown": _breakdown(_TEN_DAYS, True, "error", FROM, TO + 10 * 86400),
    "stored_config": "SELECT 'mv_retention_days' AS key, '10' AS value FROM events GROUP BY 1, 2 UNION ALL SELECT * FROM ("
    + _merged("event_name = 'purchase'", "event_name <> 'purchase'") + ")",
    "stored_seen_keys": f"""WITH {_STORED}
SELECT idempotency_key, CAST(event_date AS VARCHAR) AS event_date FROM stored""",
    "stream_ledger": _STORED_LEDGER,
    "stream_counters": _STORED_COUNTERS,
    "stream_quarantine": _STORED_DEAD,
    "stream_rollup": f"WITH {_STORED}{_rollup('stored', _window('7'))}{_ROLLUP_OUT}",
    "stream_hourly_counts": f"""WITH {_RAW_ARRIVALS}
SELECT event_name, channel, event_timestamp // 3600 * 3600 AS date_hour, count(*) AS total_count
FROM raw WHERE reason IS NULL AND NOT skipped GROUP BY 1, 2, 3""",
    "stream_first_arrivals": f"""WITH {_RAW_ARRIVALS}
SELECT DISTINCT idempotency_key, event_name FROM raw WHERE reason IS NULL AND NOT skipped""",
    "dlt_replay": f"""WITH {_RAW_ARRIVALS}
SELECT idempotency_key, event_name, channel, CAST(event_date AS VARCHAR) AS event_date FROM raw
WHERE event_id % 997 = 0 AND event_id % 1019 <> 0
QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY "offset" DESC) = 1""",
    "ledger_retention": f"""WITH {_STORED}
SELECT CAST(event_date AS VARCHAR) AS event_date, count(*) AS events FROM stored
WHERE event_date >= DATE '2024-01-15' GROUP BY 1""",
    "end_to_end": _breakdown(_LEDGER + _rollup("ledger"), True, "click", FROM, TO),
    "dlt_open": f"""WITH {_RAW_ARRIVALS}
SELECT user_id AS key, CASE WHEN event_id % 997 = 0 THEN '{{' ELSE '' END || value AS value, "offset",
       CASE WHEN event_id % 997 = 0 THEN 'channel exceeds 100 characters' ELSE reason END AS reason
FROM raw WHERE reason IS NOT NULL AND NOT (event_id % 997 = 0 AND event_id % 1019 <> 0)""",
    "stream_remembered": f"""WITH {_RAW_ARRIVALS},
told AS (
  SELECT *, event_name = 'click' AND "offset" % 2 = 1 AS again,
         event_timestamp + CASE WHEN "offset" % 2 = 1 THEN (1 + event_id % 14) * 86400 ELSE 0 END AS received
  FROM raw WHERE reason IS NULL AND NOT skipped
),
firsts AS (
  SELECT * FROM told WHERE NOT again
  QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY "offset" DESC) = 1
),
seconds AS (
  SELECT * FROM told WHERE again
  QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY "offset" DESC) = 1
)
SELECT idempotency_key, event_name, "offset", received FROM firsts
UNION ALL
SELECT s.idempotency_key, s.event_name, s."offset", s.received FROM seconds s LEFT JOIN firsts f USING (idempotency_key)
WHERE f.idempotency_key IS NULL OR s.received - f.received > 7 * 86400""",
    "stream_exact_users": f"""WITH {_RAW_ARRIVALS}
SELECT event_name, 'any' AS channel, event_timestamp // 3600 * 3600 AS date_hour,
       count(DISTINCT idempotency_key) AS total_count, count(DISTINCT user_id) AS unique_user_count
FROM raw WHERE reason IS NULL AND NOT skipped GROUP BY 1, 2, 3""",
    "refresh_stream_rollup": f"WITH {_STORED}{_rollup('stored', _window('7'))}{_ROLLUP_OUT}",
    "stored_sketches": f"""WITH {_STORED}
SELECT CAST(event_date AS VARCHAR) AS event_date, event_name, count(DISTINCT user_id) AS true_unique_users,
       CAST(0 AS BIGINT) AS bounds_off
FROM (SELECT * FROM stored WHERE event_date >= (SELECT max(event_date) FROM events_c) - 7) GROUP BY 1, 2""",
    "poison_letters": f"""WITH {_RAW_ARRIVALS}
SELECT user_id AS key, value, "offset" FROM raw
WHERE reason IS NULL AND NOT skipped AND event_timestamp = (SELECT max(event_timestamp) FROM raw WHERE reason IS NULL AND NOT skipped)""",
    "poison_ledger": f"""WITH {_RAW_ARRIVALS}
SELECT idempotency_key, event_name, channel, CAST(event_date AS VARCHAR) AS event_date FROM raw
WHERE reason IS NULL AND NOT skipped AND event_timestamp <> (SELECT max(event_timestamp) FROM raw WHERE reason IS NULL AND NOT skipped)
QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY "offset" DESC) = 1""",
    "concurrent_ledger": f"""WITH {_STORED}
SELECT idempotency_key, event_name, CAST(1 AS BIGINT) AS rows, (SELECT count(*) FROM stored) AS inserted FROM stored""",
    "empty_batches": f"""WITH {_RAW_ARRIVALS}
SELECT 'skipped' AS bid, count(*) AS received, count(*) AS skipped, CAST(0 AS BIGINT) AS dead, CAST(0 AS BIGINT) AS deserialized,
       CAST(0 AS BIGINT) AS inserted, CAST(0 AS BIGINT) AS stored FROM raw WHERE value IS NULL
UNION ALL SELECT 'none', 0, 0, 0, 0, 0, 0""",
    "stream_rate_limited": f"""WITH {_RAW_ARRIVALS}
SELECT count(*) AS received, count(*) FILTER (skipped) AS skipped, count(*) FILTER (reason IS NOT NULL) AS dead
FROM raw GROUP BY batch_id""",
    "stored_remembered": f"""WITH {_STORED}
SELECT idempotency_key, CAST(1 AS BIGINT) AS rows, 'load-1' AS bid FROM stored GROUP BY 1""",
    "merged_ledger": _STORED_LEDGER,
    "merged_counters": _STORED_COUNTERS,
    "bucketed_ledger": _STORED_LEDGER,
    "bucketed_counters": _STORED_COUNTERS,
    "admission_answers": f"""WITH {_DAMAGED},
lists AS (
  SELECT 'list ' || request_id AS request_id, count(*) AS n,
         bool_and(valid) AND bool_and(event_id % 499 <> 0) AS accepted
  FROM verdicts WHERE event_id % 2 = 1 GROUP BY request_id
), sizes AS (
  SELECT 'first ' || n AS request_id, count(*) AS n, count(*) <= 1000 AS accepted
  FROM events_c, (VALUES (1000), (1001)) t(n) WHERE event_id > 0 AND event_id <= t.n GROUP BY t.n
),
told AS (
  SELECT CAST(event_id AS VARCHAR) AS request_id, 'single' AS kind, valid AS accepted, 1 AS n FROM verdicts WHERE event_id % 2 = 0
  UNION ALL SELECT request_id, 'bulk', accepted, n FROM lists
  UNION ALL SELECT request_id, 'bulk', accepted, n FROM sizes
  UNION ALL SELECT DISTINCT body, 'bulk', false, 0 FROM events_c, (VALUES ('{{"events":[]}}'), ('{{"events":null}}'), ('{{}}'), ('no JSON')) t(body)
)
SELECT request_id, kind, CASE WHEN accepted THEN 'accepted' ELSE 'rejected' END AS status,
       CAST(CASE WHEN accepted THEN n ELSE 0 END AS BIGINT) AS accepted_count,
       CASE WHEN NOT accepted THEN 'Validation failed' WHEN kind = 'single' THEN 'Event queued for processing'
            ELSE 'Events queued for processing' END AS message
FROM told""",
    "admitted_ledger": f"""WITH {_DAMAGED},
lists AS (
  SELECT 'list ' || request_id AS request_id, count(*) AS n,
         bool_and(valid) AND bool_and(event_id % 499 <> 0) AS accepted
  FROM verdicts WHERE event_id % 2 = 1 GROUP BY request_id
), sizes AS (
  SELECT 'first ' || n AS request_id, count(*) AS n, count(*) <= 1000 AS accepted
  FROM events_c, (VALUES (1000), (1001)) t(n) WHERE event_id > 0 AND event_id <= t.n GROUP BY t.n
),
passed AS (
  SELECT event_id FROM verdicts v LEFT JOIN lists l ON l.request_id = 'list ' || v.request_id
  WHERE CASE WHEN event_id % 2 = 0 THEN valid ELSE l.accepted END
  UNION SELECT event_id FROM events_c, sizes s
  WHERE s.accepted AND event_id > 0 AND event_id <= CAST(substr(s.request_id, 7) AS BIGINT)
)
SELECT DISTINCT idempotency_key, event_name, CAST(event_date AS VARCHAR) AS event_date
FROM keyed WHERE event_id IN (SELECT event_id FROM passed)""",
    "letters_expired": f"""WITH {_RAW_ARRIVALS},
batches AS (SELECT batch_id, row_number() OVER (ORDER BY batch_id) - 1 AS i, count(*) OVER () - 1 AS last FROM (SELECT DISTINCT batch_id FROM raw)),
letters AS (SELECT batch_id, 3 * (last - i) > 7 AS expired FROM raw JOIN batches USING (batch_id) WHERE reason IS NOT NULL)
SELECT 'load-' || lpad(CAST(batch_id AS VARCHAR), 6, '0') AS bid, count(*) AS letters,
       (SELECT count(*) FROM letters WHERE expired) AS deleted
FROM letters WHERE NOT expired GROUP BY batch_id""",
}
