"""The registered queries, one or more per operator.

Each takes a session and the folder of the given tables, reads whole tables
and returns a DataFrame whose columns carry explicit names.
"""

from __future__ import annotations

import datetime as dt
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventtally.functions import clock, text
from eventtally.operators import (
    bulk, dedup, metrics, project, retention, rollup, uniques, upsert, validate,
)
from eventtally.plans import sample
from eventtally.plans.admission import admit_batch
from eventtally.plans.ingest import Storing, Stores, classify, dead_letters, ingest_batch, replay_dead_letters
from eventtally.plans.refresh import expire_days, expire_letters, refresh
from eventtally.session import new_workspace
from eventtally.sources import folders, payloads, records
from eventtally.streaming import windows
from eventtally.streaming.ingest import start_ingest
from eventtally.streaming.refresh import start_refresh

KEY = "idempotency_key"
# 2024-01-05 and 2024-01-20, UTC; the second pair lies inside an hour.
FROM, TO = 1704412800, 1705708800
FROM_MID, TO_MID = FROM + 1800, TO - 2400
ABSENT_KEY = "b1a84c038bc6a3cf10d06e74d0ff2466c18b98fa34938b1c5cf3b9a5dfbf90de"


def _date_text(df: DataFrame) -> DataFrame:
    return df.withColumn("event_date", F.col("event_date").cast("string"))


# --- scalar functions and projections -------------------------------------

def idempotency_key(spark, folder):
    return sample.arrivals(spark, folder).select("event_id", "offset", KEY)


def canonical_events(spark, folder):
    """The stored event row: renamed, dated, keyed, tags and metadata as JSON."""
    rows = sample.events(spark, folder).drop("event_date").withColumnRenamed("event_timestamp", "timestamp")
    return _date_text(project.stored_form(project.to_event(rows))).select(
        "event_id", "event_name", "channel", "campaign_id", "user_id", "event_timestamp",
        "event_date", "tags", "metadata", KEY,
    )


def clock_parts(spark, folder):
    at = F.col("event_timestamp")
    return sample.events(spark, folder).select(
        "event_id",
        clock.epoch_date(at).cast("string").alias("event_date"),
        clock.epoch_hour(at).alias("hour_start"),
        clock.epoch_midnight(at).alias("day_start"),
        clock.iso_label(at).alias("instant"),
    )


def publish_messages(spark, folder):
    rows = sample.events(spark, folder)
    return project.to_message(rows).select("event_id", "key", "value")


def published_keys(spark, folder):
    """Records published as keyed messages and read back as the stream does: how many
    a key has, and its first and last offset."""
    place = new_workspace(spark, "published")
    sent = records.to_records(project.to_message(sample.events(spark, folder)), "offset")
    records.publish_files(sent, place)
    return records.read_files(spark, place).groupBy("key").agg(
        F.count("*").alias("sent"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset")
    )


# --- parsing, validation, admission ---------------------------------------

def parse_records(spark, folder):
    """Raw JSON records to events, dead letters and skipped ones."""
    sent = sample.raw_records(spark, folder).select("event_id", "key", "value")
    return _date_text(classify(sent)).select(
        "event_id", "status",
        *[F.when(F.col("status") == "ok", F.col(c)).alias(c) for c in
          ("event_name", "channel", "campaign_id", "user_id", "event_date", "metadata", KEY)],
        F.when(F.col("status") == "ok", text.json_text(F.col("tags"))).alias("tags"),
    )


def quarantine_rows(spark, folder):
    sent = records.to_records(sample.raw_records(spark, folder), "offset")
    return dead_letters(classify(sent)).select("key", "value", "offset", "reason")


def partition_admission(spark, folder):
    """Rows a store refuses whose day partitions span only January 10 to 20."""
    rows = sample.events(spark, folder).withColumn(
        "reason", validate.storage_fault("event_timestamp", "2024-01-10", "2024-01-20")
    )
    return rows.groupBy(F.coalesce("reason", F.lit("stored")).alias("outcome")).agg(
        F.count("*").alias("events")
    )


def validate_events(spark, folder):
    judged = validate.with_violations(sample.damaged(spark, folder))
    return judged.select(
        "event_id",
        F.size("violations").cast("bigint").alias("violation_count"),
        F.array_join(
            F.transform("violations", lambda v: F.concat(v["field"], F.lit(": "), v["message"])), "; "
        ).alias("violations"),
    )


def single_responses(spark, folder):
    answers = bulk.single_responses(sample.damaged(spark, folder))
    return answers.select("event_id", bulk.response_document(answers).alias("response"))


def bulk_admission(spark, folder):
    """Events that are rows with a request id: verdict per request."""
    judged = bulk.judge_rows(sample.damaged(spark, folder), "request_id")
    return bulk.responses(judged).select(
        "request_id", "event_count", "invalid_count", "status", "accepted_count", "message"
    )


def bulk_admitted_rows(spark, folder):
    return bulk.admit_rows(sample.damaged(spark, folder), "request_id").select(
        "request_id", "event_id", "event_name"
    )


def _bulk_payloads(spark, folder) -> DataFrame:
    event = F.struct(
        "event_id", "event_name", "channel", "campaign_id", "user_id",
        F.col("event_timestamp").alias("timestamp"), "tags",
    )
    # Twenty events a request, so the list is bounded.
    return (
        sample.damaged(spark, folder)
        .groupBy("request_id")
        .agg(F.array_sort(F.collect_list(event)).alias("events"))
        .select("request_id", F.to_json(F.struct("events")).alias("value"))
    )


def bulk_payloads(spark, folder):
    """Bulk requests as JSON, judged inside the row."""
    judged = bulk.judge_payloads(payloads.parse_bulk(_bulk_payloads(spark, folder)))
    counted = judged.withColumn("event_count", F.size("events"))
    answered = bulk.responses(counted)
    return answered.select(
        "request_id", bulk.response_document(answered).alias("response"),
        F.array_join(F.transform("violations", lambda v: v["field"]), ", ").alias("fields"),
    )


def bulk_explode(spark, folder):
    judged = bulk.judge_payloads(payloads.parse_bulk(_bulk_payloads(spark, folder)))
    events = project.to_event(bulk.explode_accepted(judged, "request_id"))
    return events.select(
        "request_id", F.col("position").cast("bigint").alias("position"), KEY
    )


# --- deduplication ---------------------------------------------------------

def _last_batch(arrivals: DataFrame):
    """The batch of the newest event, late copies included, and the ledger
    before it."""
    newest = arrivals.agg(F.max_by("batch_id", F.struct("event_timestamp", -F.col("batch_id")))).scalar()
    batch = arrivals.filter(F.col("batch_id") == newest)
    before = dedup.first_batch_last_arrival(arrivals.filter(F.col("batch_id") < newest))
    return batch, before


def seen_keys(spark, folder):
    batch, before = _last_batch(sample.arrivals(spark, folder))
    return dedup.seen_keys(batch, before)


def unseen_keys(spark, folder):
    batch, before = _last_batch(sample.arrivals(spark, folder))
    return dedup.unseen(dedup.last_in_batch(batch), before).select(KEY, "event_name", "channel", "offset")


def insert_ignore(spark, folder):
    """The ledger after inserting the newest batch, conflicts ignored."""
    batch, before = _last_batch(sample.arrivals(spark, folder))
    added = dedup.insert_ignore(dedup.last_in_batch(batch), before, (KEY, "event_date"))
    columns = [KEY, "event_date", "channel", "batch_id"]
    return _date_text(before.select(*columns).unionByName(added.select(*columns)))


def dedup_in_batch(spark, folder):
    reduced = dedup.last_with_first_position(
        sample.arrivals(spark, folder), keys=("batch_id", KEY)
    )
    return reduced.select("batch_id", KEY, "channel", "offset", "first_offset")


def dedup_ledger(spark, folder):
    rows = dedup.first_batch_last_arrival(sample.arrivals(spark, folder))
    return _date_text(rows).select(
        KEY, "event_name", "channel", "campaign_id", "user_id", "event_timestamp", "event_date",
        "batch_id", "offset",
    )


def batch_counters(spark, folder):
    return dedup.batch_counters(sample.arrivals(spark, folder))


# --- rollup and metrics ----------------------------------------------------

def _full_rollup(spark, folder) -> DataFrame:
    return rollup.hourly_rollup(sample.events(spark, folder))


def _windowed_rollup(spark, folder, days) -> DataFrame:
    rows = sample.events(spark, folder)
    newest = rows.agg(F.max("event_date")).scalar()
    return rollup.hourly_rollup(rows, rollup.window_start(newest, days))


def hourly_rollup(spark, folder):
    return _date_text(_windowed_rollup(spark, folder, F.lit(7)))


def rollup_full_history(spark, folder):
    return _date_text(_full_rollup(spark, folder))


def totals(spark, folder):
    return metrics.totals(_full_rollup(spark, folder), "click", FROM, TO)


def totals_empty(spark, folder):
    return metrics.totals(_full_rollup(spark, folder), "nope", FROM, TO)


def totals_reversed(spark, folder):
    return metrics.totals(_full_rollup(spark, folder), "click", TO, FROM)


def totals_channel(spark, folder):
    return metrics.totals(_full_rollup(spark, folder), "click", FROM, TO, "web")


def totals_blank_channel(spark, folder):
    return metrics.totals(_full_rollup(spark, folder), "click", FROM, TO, "  ")


def breakdown_hourly(spark, folder):
    return metrics.breakdown(_full_rollup(spark, folder), "click", FROM, TO)


def breakdown_daily(spark, folder):
    return metrics.breakdown(_full_rollup(spark, folder), "click", FROM, TO, None, "DAILY")


def breakdown_daily_channel(spark, folder):
    return metrics.breakdown(_full_rollup(spark, folder), "view", FROM, TO, "mobile", "daily")


def breakdown_midhour(spark, folder):
    return metrics.breakdown(_full_rollup(spark, folder), "click", FROM_MID, TO_MID, None, "WEEKLY")


def metrics_document(spark, folder):
    return metrics.metrics_document(_full_rollup(spark, folder), "click", FROM_MID, TO_MID, "web", "daily")


def metrics_requests(spark, folder):
    answers = metrics.total_requests(_full_rollup(spark, folder), sample.requests(spark, folder))
    return answers.select("request_id", "total_count", "unique_user_count", "buckets")


def metrics_documents(spark, folder):
    answers = metrics.answer_requests(_full_rollup(spark, folder), sample.requests(spark, folder))
    return answers.select("request_id", metrics.document().alias("document"))


def metrics_request_checks(spark, folder):
    """Requests of which some lack a name or an end of their range."""
    asked = sample.requests(spark, folder).withColumns({
        "event_name": F.when(F.col("event_name") != "view", F.col("event_name")),
        "to": F.when(F.col("event_name") != "error", F.col("to")),
    })
    return metrics.check_requests(asked).select(
        "request_id", F.array_join(F.transform("violations", lambda v: v["message"]), "; ").alias("violations")
    )


def unique_exact(spark, folder):
    return uniques.exact_users(sample.events(spark, folder), FROM, TO, "event_name")


# --- configuration and retention -------------------------------------------

def _settings(rows: DataFrame) -> DataFrame:
    """A key/value table: each user's campaign at their last event."""
    return rows.groupBy(F.col("user_id").alias("key")).agg(
        F.max_by(F.coalesce("campaign_id", F.lit("none")), "event_id").alias("value")
    )


def config_upsert(spark, folder):
    rows = sample.events(spark, folder)
    stored = _settings(rows.filter("event_name <> 'purchase'"))
    return upsert.upsert(stored, _settings(rows.filter("event_name = 'purchase'")))


def config_insert_missing(spark, folder):
    rows = sample.events(spark, folder)
    stored = _settings(rows.filter("event_name = 'purchase'"))
    return upsert.insert_missing(stored, _settings(rows.filter("event_name <> 'purchase'")))


def retention_from_config(spark, folder):
    """The rollup window's length comes from a stored setting, here the number
    of event names plus a blank of the kind users leave around it."""
    rows = sample.events(spark, folder)
    config = rows.agg(F.concat(F.lit(" "), F.count_distinct("event_name").cast("string")).alias("value"))
    days = config.select(text.retention_days(F.col("value"))).scalar()
    return _date_text(_windowed_rollup(spark, folder, days)).groupBy("event_date").agg(
        F.sum("total_count").alias("total_count"), F.sum("unique_user_count").alias("unique_user_count")
    )


def _received(spark, folder):
    """Seen keys, each received an hour after its event."""
    rows = project.with_key(sample.events(spark, folder))
    return rows.select(KEY, (F.col("event_timestamp") + 3600).alias("received_at"))


def ttl_survivors(spark, folder):
    seen = _received(spark, folder)
    now = seen.agg(F.max("received_at")).scalar()
    return retention.survivors(seen, F.col("received_at"), now, F.lit(7))


def ttl_deleted(spark, folder):
    seen = _received(spark, folder)
    now = seen.agg(F.max("received_at")).scalar()
    return retention.expired_count(seen, F.col("received_at"), now, F.lit(7))


def partition_calendar(spark, folder):
    """Day partitions of two months from the newest event's month, and how
    many events each would hold."""
    rows = sample.events(spark, folder).select("event_date")
    days = rows.agg(F.max("event_date").alias("newest")).select(
        F.explode(retention.two_month_days(F.col("newest"))).alias("event_date")
    )
    counts = rows.groupBy("event_date").agg(F.count("*").alias("events"))
    return days.join(counts, "event_date", "left").select(
        retention.partition_name(F.col("event_date")).alias("partition_name"),
        F.coalesce("events", F.lit(0).cast("bigint")).alias("events"),
    )


# --- stored tables and streams ---------------------------------------------

_RUNS: dict[tuple[str, str, str], Stores] = {}


def _deliveries(spark, folder) -> DataFrame:
    """All arrivals as raw records, with the batch that delivers them."""
    sent = sample.raw_records(spark, folder, sample.arrivals)
    return sent.select(
        "key", "value", records.topic_partition(F.col("key")).alias("partition"), "offset", "batch_id"
    )


def _staged(spark, folder, stores: Stores):
    """The deliveries written once, then batch by batch in order; a batch is a
    week of the data, so there are a handful."""
    stage = f"{stores.root}/deliveries"
    records.stage_batches(_deliveries(spark, folder), "batch_id", stage)
    for name in folders.child_folders(spark, stage, "batch_id="):
        number = int(name.removeprefix("batch_id="))
        yield number, records.read_files(spark, f"{stage}/{name}")


def _newest(spark, folder) -> dt.date:
    return sample.events(spark, folder).agg(F.max("event_date").alias("newest")).first()["newest"]


def _once(spark, folder, kind, run) -> Stores:
    """The tables of one whole run; queries of a session read the same run."""
    name = (spark.sparkContext.applicationId, folder, kind)
    if name not in _RUNS:
        stores = Stores(spark, new_workspace(spark, kind))
        run(stores)
        _RUNS[name] = stores
    return _RUNS[name]


def _batch_run(spark, folder) -> Stores:
    """Ingest batch by batch; refresh after each with the dates it touched."""
    def run(stores: Stores) -> None:
        newest = _newest(spark, folder)
        stores.config.initialize()
        stores.config.set({"mv_retention_days": "10"})
        rows = sample.events(spark, folder)
        stores.config.set(_settings(rows.filter("event_name <> 'purchase'")))
        stores.config.set(_settings(rows.filter("event_name = 'purchase'")))
        for number, batch in _staged(spark, folder, stores):
            bid = f"load-{number:06d}"
            ingest_batch(stores, batch, bid)
            refresh(stores, newest)

    return _once(spark, folder, "batch", run)


def _stream_run(spark, folder) -> Stores:
    """Publish each batch's records as files and run the stream on them; after
    each, the refresh picks up the batches its last version does not count."""
    def run(stores: Stores) -> None:
        newest = _newest(spark, folder)
        inbox = f"{stores.root}/records"
        for _, batch in _staged(spark, folder, stores):
            records.publish_files(batch, inbox)
            start_ingest(
                stores, records.stream_files(spark, inbox), f"{stores.root}/checkpoints/ingest"
            ).awaitTermination()
            refresh(stores, newest)

    return _once(spark, folder, "stream", run)


def _ledger_view(stores: Stores) -> DataFrame:
    return _date_text(stores.ledger.read()).select(
        KEY, "event_name", "channel", "campaign_id", "user_id", "event_timestamp", "event_date",
        "metadata", F.to_json("tags").alias("tags"),
    )


def _counter_view(stores: Stores) -> DataFrame:
    return stores.counters.read().drop("days", "bid")


def stored_ledger(spark, folder):
    return _ledger_view(_batch_run(spark, folder))


def stored_counters(spark, folder):
    return _counter_view(_batch_run(spark, folder))


def stored_quarantine(spark, folder):
    return _batch_run(spark, folder).quarantine.read().select("key", "value", "offset", "reason")


def stored_rollup(spark, folder):
    """The rollup after incremental refreshes, window length from the config."""
    return _date_text(_batch_run(spark, folder).rollup.read())


def stored_totals(spark, folder):
    return metrics.totals(_batch_run(spark, folder).rollup.read(), "click", FROM, TO + 10 * 86400, "web")


def stored_breakdown(spark, folder):
    rows = _batch_run(spark, folder).rollup.read()
    return metrics.breakdown(rows, "error", FROM, TO + 10 * 86400, None, "daily")


def stored_config(spark, folder):
    return _batch_run(spark, folder).config.read()


def key_exists(spark, folder):
    """Point lookups in the stored ledger, of its smallest key and of one it lacks."""
    ledger = _batch_run(spark, folder).ledger
    smallest = ledger.read().agg(F.min(KEY)).first()[0]
    found = [F.lit(int(ledger.exists(key))).cast("bigint") for key in (smallest, ABSENT_KEY)]
    return spark.range(1).select(found[0].alias("present"), found[1].alias("absent"))


def stored_seen_keys(spark, folder):
    return _date_text(_batch_run(spark, folder).ledger.seen_table()).select(KEY, "event_date")


def stream_ledger(spark, folder):
    return _ledger_view(_stream_run(spark, folder))


def stream_counters(spark, folder):
    return _counter_view(_stream_run(spark, folder))


def stream_quarantine(spark, folder):
    return _stream_run(spark, folder).quarantine.read().select("key", "value", "offset", "reason")


def stream_rollup(spark, folder):
    """The rollup kept by the refresh stream, default window."""
    return _date_text(_stream_run(spark, folder).rollup.read())


def _drain(spark, folder, label: str, build, mode: str) -> DataFrame:
    """Run a stream over the published records once; its last output."""
    stores = _stream_run(spark, folder)
    place = new_workspace(spark, label)
    events = classify(
        records.stream_files(spark, f"{stores.root}/records")
    ).filter("status = 'ok'")
    query = (
        build(events)
        .writeStream.outputMode(mode)
        .option("checkpointLocation", f"{place}/checkpoint")
        .trigger(availableNow=True)
    )
    if mode == "append":
        query.format("parquet").option("path", f"{place}/out").start().awaitTermination()
    else:
        query.foreachBatch(
            lambda df, _: df.write.mode("overwrite").parquet(f"{place}/out")
        ).start().awaitTermination()
    return spark.read.parquet(f"{place}/out")


def stream_hourly_counts(spark, folder):
    """Tumbling windows kept in stream state, duplicates included."""
    counted = _drain(spark, folder, "windows", windows.hourly_counts, "complete")
    return counted.select("event_name", "channel", "date_hour", "total_count")


def stream_first_arrivals(spark, folder):
    """Keyed state with a time to live instead of the ledger lookup."""
    def build(events):
        timed = events.withColumn("at", clock.hour_as_timestamp(F.col("event_timestamp")))
        return windows.first_arrivals(timed, "at", days=60).select(KEY, "event_name")

    return _drain(spark, folder, "arrivals", build, "append")


def _drained(query, place: str, spark) -> DataFrame:
    query.option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).format("parquet").option(
        "path", f"{place}/out"
    ).outputMode("append").start().awaitTermination()
    return spark.read.parquet(f"{place}/out")


def stream_remembered(spark, folder):
    """Keys remembered for seven days by the stream's own state.  Redeliveries come one to fourteen days late by the
    clock of the records; those of another micro-batch pass again if it is more than seven."""
    place = new_workspace(spark, "remembered")
    sent = sample.raw_records(spark, folder, sample.arrivals).withColumn("partition", records.topic_partition(F.col("key")))
    is_again = (F.col("offset") % 2 == 1) & (F.col("event_name") == "click")
    first, again = sent.filter(~is_again), sent.filter(is_again)
    id_ = F.floor(F.col("offset") / 2)
    late = F.when(F.col("offset") % 2 == 1, (1 + id_ % 14) * clock.DAY).otherwise(0)
    with windows.keyed_state(spark):
        for part in (first, again):
            records.publish_files(part, f"{place}/in")
            events = classify(records.stream_files(spark, f"{place}/in")).filter("status = 'ok'")
            timed = events.select(KEY, "event_name", "offset", (F.col("event_timestamp") + late).alias("received"))
            out = _drained(windows.remembered(timed, "received").writeStream, place, spark)
    return out.select(KEY, "event_name", "offset", "received")


def stream_exact_users(spark, folder):
    """Events and distinct users by the hour, kept exactly by the stream; a closing record a year later lets
    it give out its last hours."""
    stores = _stream_run(spark, folder)
    place = new_workspace(spark, "exact")
    late = F.to_json(F.struct(
        F.lit("closing").alias("event_name"), F.lit("user").alias("user_id"), (F.max("event_timestamp") + 366 * clock.DAY).alias("timestamp")
    ))
    closing = sample.events(spark, folder).agg(late.alias("value")).select(
        F.lit("user").alias("key"), "value", F.lit(0).alias("partition"), F.lit(10**15).alias("offset")
    )
    inbox = f"{place}/in"
    for some in (records.read_files(spark, f"{stores.root}/records"), closing):
        records.publish_files(some, inbox)
    found = {}
    for name, build in (("users", windows.exact_users), ("totals", windows.exact_totals)):
        events = classify(records.stream_files(spark, inbox)).filter("status = 'ok'")
        # Copies of an event differ in their channel, and which of them counts is not fixed.
        some = build(events.withColumn("channel", F.lit("any")), "60 days").writeStream
        found[name] = _drained(some, f"{place}/{name}", spark).filter("event_name <> 'closing'")
    return found["totals"].join(found["users"], ["event_name", "channel", "date_hour"])


def _refresh_stream_run(spark, folder) -> Stores:
    """The refresh stream itself, with batches that come while it runs."""
    def run(stores: Stores) -> None:
        newest = _newest(spark, folder)
        query = start_refresh(stores, f"{stores.root}/checkpoints/refresh", lambda: newest, seconds=0.5)
        try:
            for number, batch in _staged(spark, folder, stores):
                ingest_batch(stores, batch, f"load-{number:06d}")
            until = time.time() + 300
            while time.time() < until and query.isActive:
                noted = stores.rollup.note(stores.rollup.current_version())
                if noted and noted["ledger"] == stores.ledger.snapshot().version:
                    return
                time.sleep(0.5)
            raise RuntimeError(f"the refresh stream did not come to the end: {query.exception()}")
        finally:
            query.stop()

    return _once(spark, folder, "refreshing", run)


def refresh_stream_rollup(spark, folder):
    """The rollup that the refresh stream keeps, default window."""
    return _date_text(_refresh_stream_run(spark, folder).rollup.read())


def stored_sketches(spark, folder):
    """The sketches that refreshes keep up, against the exact users of the ledger's days in the window: how many bounds
    of error they are off."""
    stores = _refresh_stream_run(spark, folder)
    exact = stores.ledger.read(stores.sketches.snapshot().days()).groupBy("event_date", "event_name").agg(
        F.count_distinct("user_id").alias("true_unique_users")
    )
    approx = stores.sketches.read().groupBy("event_date", "event_name").agg(
        F.hll_sketch_estimate(F.hll_union_agg("users")).alias("approx_unique_users")
    )
    error = F.abs(F.col("approx_unique_users") - F.col("true_unique_users"))
    return _date_text(exact.join(approx, ["event_date", "event_name"])).select(
        "event_date", "event_name", "true_unique_users",
        F.floor(error / (F.col("true_unique_users") * uniques.ERROR_BOUND)).cast("bigint").alias("bounds_off"),
    )


def _poison_run(spark, folder) -> Stores:
    """A stream whose storage refuses the events of the last second."""
    newest = classify(_deliveries(spark, folder)).filter("status = 'ok'").agg(F.max("event_timestamp")).first()[0]

    def refuse(rows: DataFrame) -> DataFrame:
        bad = F.col("event_timestamp") == newest
        return rows.withColumn("channel", F.when(bad, F.raise_error(F.lit("refused by the storage"))).otherwise(F.col("channel")))

    def run(stores: Stores) -> None:
        inbox = f"{stores.root}/records"
        for _, batch in _staged(spark, folder, stores):
            records.publish_files(batch, inbox)
        start_ingest(
            stores, records.stream_files(spark, inbox), f"{stores.root}/checkpoints/ingest", storing=Storing(refuse, waits=(0.1,))
        ).awaitTermination()

    return _once(spark, folder, "poison", run)


def poison_letters(spark, folder):
    """Events that could not be stored, as dead letters."""
    return _poison_run(spark, folder).quarantine.read().filter("reason LIKE 'cannot%'").select("key", "value", "offset")


def poison_ledger(spark, folder):
    return _date_text(_poison_run(spark, folder).ledger.read()).select(KEY, "event_name", "channel", "event_date")


def concurrent_ledger(spark, folder):
    """Three writers at once, each with the deliveries of two days of three: a key that two of them have is stored
    once, all of a batch's days show together, and counters add up."""
    def run(stores: Stores) -> None:
        sent = new_workspace(spark, "concurrent")
        day = F.floor(F.expr("try_cast(get_json_object(value, '$.timestamp') AS BIGINT)") / clock.DAY)
        _deliveries(spark, folder).withColumn("third", F.coalesce(F.pmod(day, F.lit(3)), F.lit(0)).cast("int")).write.parquet(sent)

        def write(number: int) -> None:
            batch = spark.read.parquet(sent).filter(F.col("third") != number).drop("third", "batch_id")
            ingest_batch(stores, batch, f"writer-{number}")

        with ThreadPoolExecutor(3) as pool:
            list(pool.map(write, range(3)))

    stores = _once(spark, folder, "concurrent", run)
    batches = stores.ledger.read().groupBy(KEY).agg(F.count("*").alias("rows"), F.first("event_name").alias("event_name"))
    inserted = stores.counters.read().agg(F.sum("inserted").alias("inserted")).scalar()
    return batches.select(KEY, "event_name", "rows", inserted.alias("inserted"))


def empty_batches(spark, folder):
    """A batch without records, and one of records without a body: counted, nothing stored."""
    stores = Stores(spark, new_workspace(spark, "empty"))
    sent = _deliveries(spark, folder).drop("batch_id")
    ingest_batch(stores, sent.filter("false"), "none")
    ingest_batch(stores, sent.filter("value IS NULL"), "skipped")
    return stores.counters.read().select("bid", "received", "skipped", "dead", "deserialized", "inserted").withColumn(
        "stored", F.lit(len(stores.ledger.dates())).cast("bigint")
    )


def stream_rate_limited(spark, folder):
    """One file a micro-batch: as many batches as files, each with its file's records."""
    stores = Stores(spark, new_workspace(spark, "limited"))
    inbox = f"{stores.root}/records"
    for _, batch in _staged(spark, folder, stores):
        records.publish_files(batch.coalesce(1), inbox)
    start_ingest(stores, records.stream_files(spark, inbox, 1), f"{stores.root}/checkpoint").awaitTermination()
    return stores.counters.read().select("received", "skipped", "dead")


def _mended(letters: DataFrame) -> DataFrame:
    cut = F.startswith("value", F.lit('"'))
    return letters.withColumn("value", F.when(cut, F.concat(F.lit("{"), "value")).otherwise(F.col("value")))


def _replay_run(spark, folder) -> Stores:
    """Dead letters that lost their opening brace are mended, and replayed
    twice under one name and once under another."""
    def run(stores: Stores) -> None:
        ingest_batch(stores, _deliveries(spark, folder).drop("batch_id"), "load-1")
        for bid in ("replay-1", "replay-1", "replay-2"):
            replay_dead_letters(stores, _mended, bid)

    return _once(spark, folder, "replay", run)


def dlt_replay(spark, folder):
    stores = _replay_run(spark, folder)
    return _date_text(stores.ledger.read().filter("bid <> 'load-1'")).select(
        KEY, "event_name", "channel", "event_date"
    )


def dlt_open(spark, folder):
    """The letters no replay could mend, once each."""
    return _replay_run(spark, folder).letters().select("key", "value", "offset", "reason")


def letters_expired(spark, folder):
    """Dead letters received a day apart by batch; those older than a week at
    the last batch are deleted, and counted."""
    def run(stores: Stores) -> None:
        at = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)
        sent = list(_staged(spark, folder, stores))
        for i, (number, batch) in enumerate(sent):
            ingest_batch(stores, batch, f"load-{number:06d}", received_at=at + dt.timedelta(days=3 * i))
        stores.config.set({"deleted": str(expire_letters(stores, at + dt.timedelta(days=3 * len(sent) - 3)))})

    stores = _once(spark, folder, "expired", run)
    deleted = stores.config.read().filter("key = 'deleted'").first()["value"]
    return stores.quarantine.read().groupBy("bid").agg(
        F.count("*").alias("letters"), F.lit(int(deleted)).cast("bigint").alias("deleted")
    )


def stored_remembered(spark, folder):
    """All deliveries, and all again ten days later with keys remembered for
    seven: still one row per key."""
    def run(stores: Stores) -> None:
        at = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)
        sent = _deliveries(spark, folder).drop("batch_id")
        ingest_batch(stores, sent, "load-1", received_at=at)
        ingest_batch(stores, sent, "load-2", received_at=at + dt.timedelta(days=10), remember_days=7)

    stores = _once(spark, folder, "remembered", run)
    return stores.ledger.read().groupBy(KEY).agg(F.count("*").alias("rows"), F.min("bid").alias("bid"))


def _merged_run(spark, folder) -> Stores:
    """Upkeep between the batches: days, counters and dead letters are merged,
    and the first batch is delivered once more after that."""
    def run(stores: Stores) -> None:
        staged = list(_staged(spark, folder, stores))
        for number, batch in staged:
            ingest_batch(stores, batch, f"load-{number:06d}")
            for day in stores.ledger.dates()[-3:]:
                stores.ledger.merge_day(day, f"merged-{number:06d}")
            stores.counters.merge()
            stores.quarantine.merge()
        number, batch = staged[0]
        ingest_batch(stores, batch, f"load-{number:06d}")

    return _once(spark, folder, "merged", run)


def merged_ledger(spark, folder):
    return _ledger_view(_merged_run(spark, folder))


def merged_counters(spark, folder):
    return _counter_view(_merged_run(spark, folder))


def _bucketed_run(spark, folder) -> Stores:
    """Every batch is looked up like a large one: without a shuffle of the ledger in days whose keys lie in buckets, by a
    shuffled join in the others."""
    def run(stores: Stores) -> None:
        stores = replace(stores, key_buckets=8, bucketed_rows=20)
        for number, batch in _staged(spark, folder, stores):
            ingest_batch(stores, batch, f"load-{number:06d}", broadcast_keys=0)

    return _once(spark, folder, "bucketed", run)


def bucketed_ledger(spark, folder):
    return _ledger_view(_bucketed_run(spark, folder))


def bucketed_counters(spark, folder):
    return _counter_view(_bucketed_run(spark, folder))


def late_events(spark, folder):
    """Errors reach the ledger three days after the other events, purchases ten;
    the rollup of a ten-day window after the refresh that follows each."""
    def run(stores: Stores) -> None:
        newest = _newest(spark, folder)
        stores.config.set({"mv_retention_days": "10"})
        sent = records.to_records(project.to_message(sample.events(spark, folder)).withColumn(
            "late", F.expr("CASE event_name WHEN 'purchase' THEN 10 WHEN 'error' THEN 3 ELSE 0 END")
        ).withColumn("offset", F.col("late") * 10**12 + F.col("offset")), "offset")
        for late in (0, 3, 10):
            ingest_batch(stores, sent.filter(F.floor(F.col("offset") / 10**12) == late), f"late-{late}")
            refresh(stores, newest + dt.timedelta(days=late))

    stores = _once(spark, folder, "late", run)
    in_ledger = stores.ledger.read().groupBy("event_date", "event_name").agg(F.count("*").alias("in_ledger"))
    counted = stores.rollup.read().groupBy("event_date", "event_name").agg(F.sum("total_count").alias("counted"))
    both = in_ledger.join(counted, ["event_date", "event_name"], "left")
    return _date_text(both.withColumn("counted", F.coalesce("counted", F.lit(0)).cast("bigint")))


def _requests(spark, folder) -> DataFrame:
    """Raw requests: even events alone, odd ones twenty to a list (each list
    with a mistyped element where an id is divisible by 499), and lists of
    1,000, 1,001 and no events."""
    rows = project.to_message(sample.damaged(spark, folder))
    singles = rows.filter("event_id % 2 = 0").select(
        F.col("event_id").cast("string").alias("request_id"), F.lit("single").alias("kind"), "value", "offset"
    )

    def lists(rows, name):
        element = F.struct("event_id", F.expr(
            "CASE WHEN event_id % 499 = 0 THEN regexp_replace(value, '\"user_id\":\"[^\"]*\"', '\"user_id\":{\"a\":1}') ELSE value END"
        ).alias("value"))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(element)), lambda e: e["value"]), ",")
        return rows.groupBy(name.alias("request_id")).agg(
            F.lit("bulk").alias("kind"), F.concat(F.lit('{"events":['), joined, F.lit("]}")).alias("value"),
            F.max("offset").alias("offset"),
        )

    whole = project.to_message(sample.events(spark, folder)).filter("event_id > 0")
    found = singles.unionByName(lists(rows.filter("event_id % 2 = 1"), F.concat(F.lit("list "), F.col("request_id").cast("string"))))
    limit = whole.select("event_id", "value", "offset")
    for n in (1000, 1001):
        chosen = limit.filter(F.col("event_id") <= n)
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda e: e["value"]), ",")
        found = found.unionByName(chosen.agg(
            F.lit(f"first {n}").alias("request_id"), F.lit("bulk").alias("kind"),
            F.concat(F.lit('{"events":['), joined, F.lit("]}")).alias("value"), F.max("offset").alias("offset"),
        ))
    for body in ('{"events":[]}', '{"events":null}', "{}", "no JSON"):
        found = found.unionByName(limit.agg(
            F.lit(body).alias("request_id"), F.lit("bulk").alias("kind"), F.lit(body).alias("value"), F.max("offset").alias("offset")
        ))
    return found


def _admission_run(spark, folder) -> Stores:
    return _once(spark, folder, "admission", lambda stores: admit_batch(stores, _requests(spark, folder), "requests-1"))


def admission_answers(spark, folder):
    return _admission_run(spark, folder).answers.read().select("request_id", "kind", "status", "accepted_count", "message")


def admitted_ledger(spark, folder):
    return _date_text(_admission_run(spark, folder).ledger.read()).select(KEY, "event_name", "event_date")


def unique_sketch(spark, folder):
    """Sketches by the hour, stored, and merged over the range: how far from the
    exact number of users, by event name and channel, in units of the bound."""
    def run(stores: Stores) -> None:
        table = stores.sketches
        parts = table.stage(uniques.hourly_sketches(sample.events(spark, folder)), "load")
        table.commit(table.snapshot(), "append", "load", parts)

    stored = _once(spark, folder, "sketches", run).sketches.read()
    exact = uniques.exact_users(sample.events(spark, folder), FROM, TO, "event_name", "channel")
    approx = uniques.sketched_users(stored, FROM, TO, "event_name", "channel")
    same = exact["channel"].eqNullSafe(approx["channel"]) & (exact["event_name"] == approx["event_name"])
    error = F.abs(F.col("approx_unique_users") - F.col("true_unique_users"))
    return exact.join(approx, same).select(
        exact["event_name"], exact["channel"], "true_unique_users",
        F.floor(error / (F.col("true_unique_users") * uniques.ERROR_BOUND)).cast("bigint").alias("bounds_off"),
    )


def ledger_retention(spark, folder):
    """Days before January 15 are dropped from the ledger."""
    stores = Stores(spark, new_workspace(spark, "retention"))
    ingest_batch(stores, _deliveries(spark, folder).drop("batch_id"), "load-1")
    expire_days(stores, dt.date(2024, 1, 15))
    return _date_text(stores.ledger.read()).groupBy("event_date").agg(F.count("*").alias("events"))


def end_to_end(spark, folder):
    """Flagship: deliveries, deduplicated, rolled up, and answered by day."""
    ledger = dedup.first_batch_last_arrival(sample.arrivals(spark, folder))
    return metrics.breakdown(rollup.hourly_rollup(ledger), "click", FROM, TO, None, "daily")


QUERIES = (
    idempotency_key, canonical_events, clock_parts, publish_messages, published_keys,
    parse_records, quarantine_rows, partition_admission, validate_events, single_responses,
    bulk_admission, bulk_admitted_rows, bulk_payloads, bulk_explode,
    seen_keys, unseen_keys, insert_ignore, dedup_in_batch, dedup_ledger, batch_counters,
    hourly_rollup, rollup_full_history, totals, totals_empty, totals_reversed, totals_channel,
    totals_blank_channel, breakdown_hourly, breakdown_daily, breakdown_daily_channel,
    breakdown_midhour, metrics_document, metrics_requests, metrics_documents,
    metrics_request_checks, unique_exact, unique_sketch,
    config_upsert, config_insert_missing, retention_from_config, ttl_survivors, ttl_deleted,
    partition_calendar,
    stored_ledger, stored_counters, stored_quarantine, stored_rollup, stored_totals,
    stored_breakdown, stored_config, stored_seen_keys,
    stream_ledger, stream_counters, stream_quarantine, stream_rollup, stream_hourly_counts,
    stream_first_arrivals, dlt_replay, dlt_open, ledger_retention, key_exists, late_events,
    letters_expired, stored_remembered, merged_ledger, merged_counters, admission_answers, admitted_ledger, end_to_end,
    stream_remembered, stream_exact_users, refresh_stream_rollup, stored_sketches, poison_letters, poison_ledger,
    concurrent_ledger, empty_batches, stream_rate_limited, bucketed_ledger, bucketed_counters,
)
