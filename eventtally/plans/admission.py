"""Admission of raw requests: judge, answer, and pass the accepted on.

A request carries one event, or a list of events of which a bad one rejects all.
Records read straight from the stream are not judged by these rules; requests are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventtally.operators import bulk, project, validate
from eventtally.plans.ingest import Stores, ingest_batch
from eventtally.schema import CORRUPT, EVENT_FIELDS, MAX_BULK_EVENTS
from eventtally.sources import folders, payloads, records

SINGLE, BULK = "single", "bulk"
_EVENT = [field.strip().split(" ")[0] for field in EVENT_FIELDS.split(",")]
_VIOLATIONS = "array<struct<field:string,message:string>>"


def judge(requests: DataFrame) -> DataFrame:
    """Requests (request_id, kind, value, offset) with `accepted`, `violations`
    and their `events`, a list of one for a single.

    An unreadable body is rejected with the one violation that says so.
    """
    no_body = payloads.is_absent(F.col("value"))
    unreadable = F.array(F.struct(F.lit("body").alias("field"), F.lit(validate.MALFORMED).alias("message")))

    singles = payloads.parse_events(requests.filter(F.col("kind") == SINGLE))
    faults = validate.event_violations(F.col("event_name"), F.col("user_id"), F.col("timestamp"))
    broken = F.col(CORRUPT).isNotNull() | no_body
    one = singles.select(
        "request_id", "kind", "offset",
        F.when(broken, unreadable).otherwise(faults).cast(_VIOLATIONS).alias("violations"),
        F.array(F.struct(*_EVENT)).alias("events"),
    )
    judged = bulk.judge_payloads(payloads.parse_bulk(requests.filter(F.col("kind") == BULK)))
    many = judged.select(
        "request_id", "kind", "offset",
        F.when(F.col(CORRUPT).isNotNull(), unreadable).otherwise(F.col("violations")).cast(_VIOLATIONS).alias("violations"),
        F.when(F.col("accepted"), F.transform("events", lambda event: F.struct(*[event[name].alias(name) for name in _EVENT]))).alias("events"),
    )
    return one.unionByName(many).withColumn("accepted", F.size("violations") == 0)


def answers(judged: DataFrame) -> DataFrame:
    """Status, accepted count and message of each request, with its violations."""
    queued = F.when(F.col("kind") == SINGLE, bulk.QUEUED_ONE).otherwise(bulk.QUEUED_MANY)
    return judged.select(
        "request_id", "kind",
        F.when(F.col("accepted"), bulk.ACCEPTED).otherwise("rejected").alias("status"),
        F.when(F.col("accepted"), F.size("events")).otherwise(0).cast("bigint").alias("accepted_count"),
        F.when(F.col("accepted"), queued).otherwise(bulk.VALIDATION_FAILED).alias("message"),
        "violations",
    )


def published(judged: DataFrame) -> DataFrame:
    """The accepted events as records, in the order of requests and lists."""
    events = judged.filter("accepted").select("offset", F.posexplode("events").alias("position", "event"))
    placed = events.select((F.col("offset") * MAX_BULK_EVENTS + F.col("position")).alias("offset"), "event.*")
    return records.to_records(project.to_message(placed, "timestamp"), "offset")


def admit_batch(stores: Stores, requests: DataFrame, bid: str, **options) -> dict:
    """Judge a batch of requests, store the answers and ingest what was
    accepted; returns the batch's counters.

    The verdicts are written once, and both the answers and the events are of
    what is written, so they agree whatever the source gives when it is read again.
    """
    place = f"{stores.root}/_judged/{bid}-{uuid.uuid4().hex[:12]}"
    judged = judge(requests)
    try:
        judged.write.parquet(place)
        judged = stores.spark.read.schema(judged.schema).parquet(place)
        stores.answers.write(answers(judged), bid)
        return ingest_batch(stores, published(judged), bid, **options)
    finally:
        folders.remove(stores.spark, place)
