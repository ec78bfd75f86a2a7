"""Bulk requests: one bad event rejects the whole request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventtally.operators import validate
from eventtally.schema import CORRUPT, MAX_BULK_EVENTS

# Fixed texts that must equal the reference's.
ACCEPTED = "accepted"
QUEUED_ONE = "Event queued for processing"
QUEUED_MANY = "Events queued for processing"
VALIDATION_FAILED = "Validation failed"


def _valid_element(event: Column) -> Column:
    return event.isNotNull() & validate.is_valid_event(
        event["event_name"], event["user_id"], event["timestamp"]
    )


def judge_payloads(parsed: DataFrame) -> DataFrame:
    """Judge parsed bulk payloads (one row per request, array `events`).

    Everything is decided inside the row, so there is no shuffle.  Adds
    `accepted`, and `violations` with positions such as events[1].user_id.
    """
    def positioned(event: Column, position: Column) -> Column:
        prefix = F.concat(F.lit("events["), position.cast("string"), F.lit("]"))
        broken = validate.event_violations(event["event_name"], event["user_id"], event["timestamp"])
        return F.transform(
            broken,
            lambda v: F.struct(
                F.concat(prefix, F.lit("."), v["field"]).alias("field"), v["message"].alias("message")
            ),
        )

    size_faults = validate.bulk_size_violations(F.col("events"))
    element_faults = F.flatten(F.transform("events", positioned))
    intact = F.col(CORRUPT).isNull() if CORRUPT in parsed.columns else F.lit(True)
    accepted = (
        intact & (F.size(size_faults) == 0) & F.coalesce(F.forall("events", _valid_element), F.lit(False))
    )
    no_faults = F.array().cast("array<struct<field:string,message:string>>")
    return parsed.withColumns({
        "accepted": accepted,
        "violations": F.concat(size_faults, F.coalesce(element_faults, no_faults)),
    })


def explode_accepted(judged: DataFrame, *keep: str) -> DataFrame:
    """The events of accepted requests with their position in the list."""
    return (
        judged.filter("accepted")
        .select(*keep, F.posexplode("events").alias("position", "event"))
        .select(*keep, "position", "event.*")
    )


def judge_rows(events: DataFrame, request: str, timestamp: str = "event_timestamp") -> DataFrame:
    """The same verdict for events that already are rows with a request id:
    one row per request with its size and `accepted`.

    Partial aggregation shrinks a hot request to one row per map task.
    """
    valid = validate.is_valid_event(F.col("event_name"), F.col("user_id"), F.col(timestamp))
    return events.groupBy(request).agg(
        F.count("*").alias("event_count"),
        F.count_if(~valid).alias("invalid_count"),
    ).withColumn(
        "accepted", (F.col("invalid_count") == 0) & (F.col("event_count") <= MAX_BULK_EVENTS)
    )


def admit_rows(events: DataFrame, request: str, timestamp: str = "event_timestamp") -> DataFrame:
    """Rows of the accepted requests.

    The verdicts are about as many as the requests, so the join side is left
    to AQE; no accepted request holds more than the bulk limit, so only rows
    that are dropped can be skewed, and AQE splits those.
    """
    verdicts = judge_rows(events, request, timestamp)
    return events.join(verdicts.filter("accepted").select(request), request, "left_semi")


def responses(judged: DataFrame) -> DataFrame:
    """Answer per bulk request: status, accepted count, message."""
    return judged.withColumns({
        "status": F.when(F.col("accepted"), F.lit(ACCEPTED)).otherwise(F.lit("rejected")),
        "accepted_count": F.when(F.col("accepted"), F.col("event_count")).otherwise(F.lit(0)).cast("bigint"),
        "message": F.when(F.col("accepted"), F.lit(QUEUED_MANY)).otherwise(F.lit(VALIDATION_FAILED)),
    })


def single_responses(events: DataFrame, timestamp: str = "event_timestamp") -> DataFrame:
    """Answer per single-event request."""
    valid = validate.is_valid_event(F.col("event_name"), F.col("user_id"), F.col(timestamp))
    return events.withColumns({
        "status": F.when(valid, F.lit(ACCEPTED)).otherwise(F.lit("rejected")),
        "accepted_count": F.when(valid, F.lit(1)).otherwise(F.lit(0)).cast("bigint"),
        "message": F.when(valid, F.lit(QUEUED_ONE)).otherwise(F.lit(VALIDATION_FAILED)),
    })


def response_document(answers: DataFrame) -> Column:
    """The acceptance summary as a JSON text, names as clients know them."""
    return F.to_json(F.struct(
        F.col("status"), F.col("accepted_count").alias("acceptedCount"), F.col("message")
    ))
