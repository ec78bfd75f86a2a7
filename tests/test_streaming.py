import datetime as dt
import time

import pyarrow.parquet as pq
import pytest
from rows import T0, event_json, records_frame

from eventtally.functions import clock
from eventtally.plans.ingest import Storing, Stores, classify, ingest_batch
from eventtally.plans.upkeep import upkeep
from eventtally.session import new_workspace, shared_folder
from eventtally.sources import folders, records
from eventtally.streaming import windows
from eventtally.streaming.ingest import start_ingest
from eventtally.streaming import refresh as refresh_stream
from pyspark.sql import functions as F


def deliver(spark, path, values, first_offset):
    records.publish_files(records_frame(spark, values, first_offset), path)


def run(stores, inbox, checkpoint, **more):
    start_ingest(stores, records.stream_files(stores.spark, inbox), checkpoint, **more).awaitTermination()


BATCHES = [
    [event_json(ts=T0 + i, channel="first") for i in range(5)] + ["broken", None],
    [event_json(ts=T0 + i, channel="late") for i in range(3, 8)] + [event_json(ts=T0 + 7, channel="last")],
    [event_json(ts=T0 - 86400)],
]


def contents(stores):
    rows = stores.ledger.read().select("idempotency_key", "channel", "event_date").collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_stream_equals_batches_and_survives_a_crash(spark, stores, tmp_path):
    inbox, checkpoint = str(tmp_path / "inbox"), str(tmp_path / "checkpoint")
    other = Stores(spark, str(tmp_path / "other"))
    for n, values in enumerate(BATCHES):
        deliver(spark, inbox, values, 100 * n)
        run(stores, inbox, checkpoint)
        ingest_batch(other, records_frame(spark, values, 100 * n), f"b-{n}")
    assert contents(stores) == contents(other)
    columns = ["received", "skipped", "dead", "inserted", "in_batch_duplicates", "cross_batch_duplicates"]

    def counted(s):
        return sorted(tuple(r) for r in s.counters.read().select(*columns).collect())

    assert counted(stores) == counted(other) == sorted(
        [(7, 1, 1, 5, 0, 0), (6, 0, 0, 3, 1, 2), (1, 0, 0, 1, 0, 0)])
    before = contents(stores)
    # The crash: the last micro-batch wrote its tables but was not committed.
    commit = tmp_path / "checkpoint" / "commits" / "2"
    commit.unlink()
    (commit.parent / ".2.crc").unlink(missing_ok=True)
    run(stores, inbox, checkpoint)
    assert contents(stores) == before and stores.counters.read().count() == 3


def test_lost_checkpoint_is_refused(spark, stores, tmp_path):
    inbox = str(tmp_path / "inbox")
    deliver(spark, inbox, BATCHES[0], 0)
    run(stores, inbox, str(tmp_path / "one"))
    with pytest.raises(RuntimeError, match="another name"):
        run(stores, inbox, str(tmp_path / "two"))
    run(stores, inbox, str(tmp_path / "two"), name="second")
    assert stores.ledger.read().count() == 5


def test_refresh_stream_needs_no_events(spark, stores, tmp_path, monkeypatch):
    today = [dt.date(2026, 2, 16)]
    failures = [1]
    real = refresh_stream.refresh

    def flaky(*args):
        if failures:
            raise RuntimeError(failures.pop())
        return real(*args)

    monkeypatch.setattr(refresh_stream, "refresh", flaky)

    def until(expected):
        for _ in range(60):
            rows = stores.rollup.read().groupBy("event_date").agg(F.sum("total_count")).collect()
            if {r[0].day: r[1] for r in rows} == expected:
                return
            time.sleep(0.5)
        raise AssertionError(rows)

    ingest_batch(stores, records_frame(spark, BATCHES[0]), "b-1")
    query = refresh_stream.start_refresh(stores, str(tmp_path / "refresh"), lambda: today[0], seconds=0.5)
    try:
        until({15: 5})  # after a failure, without a new event
        ingest_batch(stores, records_frame(spark, BATCHES[1] + BATCHES[2]), "b-2")
        until({14: 1, 15: 8})
        today[0] = dt.date(2026, 2, 22)
        until({15: 8})  # the window moves, again without one
    finally:
        query.stop()


def test_windowed_counts_and_keyed_state(spark, tmp_path):
    inbox = str(tmp_path / "inbox")
    deliver(spark, inbox, BATCHES[0] + BATCHES[1] + BATCHES[2], 0)

    def drain(build, mode, name):
        events = classify(records.stream_files(spark, inbox)).filter("status = 'ok'")
        query = build(events).writeStream.outputMode(mode).format("memory").queryName(name).trigger(
            availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        query.awaitTermination()
        return spark.table(name)

    counts = drain(windows.hourly_counts, "complete", "hourly")
    assert {(r["channel"], r["date_hour"]): r["total_count"] for r in counts.collect()} == {
        ("first", T0): 5, ("late", T0): 5, ("last", T0): 1, (None, T0 - 86400): 1,
    }

    def keyed(events):
        timed = events.withColumn("at", clock.hour_as_timestamp(F.col("event_timestamp")))
        return windows.first_arrivals(timed, "at").select("idempotency_key")

    assert drain(keyed, "append", "keyed").count() == 9


def test_users_share_a_partition(spark):
    users = spark.range(1000).select((F.col("id") % 50).cast("string").alias("key"))
    got = users.select("key", records.topic_partition(F.col("key")).alias("p")).distinct()
    assert got.count() == 50
    assert got.agg(F.min("p"), F.max("p")).first() == (0, 5)


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    # Digests do not compress: some 13 MB in one file.
    sent = spark.range(200_000).select(
        F.lit("k").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("value"), F.lit(0).alias("partition"), F.col("id").alias("offset")
    )
    records.publish_files(sent.coalesce(1), str(tmp_path))
    read = records.read_files(spark, str(tmp_path))
    assert len(read.inputFiles()) == 1 and read.count() == 200_000
    assert read.select(F.spark_partition_id().alias("task")).distinct().count() > 1


def test_batches_are_staged_in_files_that_many_tasks_read(spark, tmp_path):
    # Digests do not compress: some 13 MB in two batches, of a single task.
    rows = spark.range(200_000, numPartitions=1).select(
        F.lit(None).cast("string").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("value"),
        F.lit(0).alias("partition"), F.col("id").alias("offset"), (F.col("id") % 2).alias("batch_id"),
    )
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    place = str(tmp_path / "staged")
    records.stage_batches(rows, "batch_id", place)
    assert spark.conf.get(name) == before
    for batch in (0, 1):
        files = sorted((tmp_path / "staged" / f"batch_id={batch}").glob("*.parquet"))
        groups = [pq.ParquetFile(file).metadata for file in files]
        assert sum(m.num_rows for m in groups) == 100_000
        assert max(m.row_group(i).total_byte_size for m in groups for i in range(m.num_row_groups)) < 2 * records.ROW_GROUP
        got = records.read_files(spark, f"{place}/batch_id={batch}")
        assert got.agg(F.count_distinct("offset"), F.sum("offset")).first() == (100_000, sum(range(batch, 200_000, 2)))


def test_raw_lines_are_a_source(spark, stores, tmp_path):
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.json").write_text("\n".join([event_json(channel="x"), event_json(channel="y"), "bad"]))
    lines = records.stream_json_lines(spark, str(tmp_path / "lines"), 1)
    start_ingest(stores, lines, str(tmp_path / "cp")).awaitTermination()
    assert [r["channel"] for r in stores.ledger.read().collect()] == ["y"]
    (letter,) = stores.quarantine.read().collect()
    assert letter["source"].endswith("a.json") and letter["line"] == 2


def test_kafka_needs_its_package(spark):
    options = records.kafka_options("broker:9092")
    assert options == {"kafka.bootstrap.servers": "broker:9092", "subscribe": "events-ingestion"}
    with pytest.raises(Exception, match="kafka"):
        records.stream_kafka(spark, "broker:9092", records_per_trigger=10)
    assert records.stream_options("broker:9092", records_per_trigger=10)["maxOffsetsPerTrigger"] == "10"


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_folder(spark) == configured.rstrip("/")
    assert not folders.exists(spark, shared_folder(spark) + "/no-such-folder")


def test_workspaces_of_an_application_lie_together(spark):
    first, second = (new_workspace(spark, "some") for _ in range(2))
    assert first != second and f"/{spark.sparkContext.applicationId}/some-" in first


def drained(spark, build, tmp_path, name, inbox, **conf):
    events = classify(records.stream_files(spark, inbox)).filter("status = 'ok'")
    query = build(events).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / name / "out"))
    query.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name / "cp")).start().awaitTermination()
    return spark.read.parquet(str(tmp_path / name / "out"))


def test_key_returns_after_its_time_and_not_before(spark, tmp_path):
    inbox = str(tmp_path / "in")
    day = 86400
    # The second at which each arrives is in its channel; days 0, 7, 7 and a second, 8, 14.
    arrivals = [[0, 5], [7 * day + 5, 9], [7 * day + 6], [8 * day], [14 * day + 6], [14 * day + 7]]

    def build(events):
        return windows.remembered(events.withColumn("received", F.col("channel").cast("bigint")), "received")

    with windows.keyed_state(spark):
        for n, seconds in enumerate(arrivals):
            deliver(spark, inbox, [event_json(channel=str(s)) for s in seconds], 10 * n)
            got = drained(spark, build, tmp_path, "keyed", inbox)
    # Of the first micro-batch the last arrival, at 5; at 7 days and 6 it is more than 7 days ago, and again at 14 and 7.
    assert sorted(int(r["channel"]) for r in got.collect()) == [5, 7 * day + 6, 14 * day + 7]
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"


def test_keys_of_a_group_are_remembered_apart(spark, tmp_path):
    """Python is entered once a group, not once a key; each key decides for itself all the same."""
    inbox, day, users = str(tmp_path / "in"), 86400, 120

    def build(events):
        return windows.remembered(events.withColumn("received", F.col("channel").cast("bigint")), "received", groups=3)

    passed, want = {}, []
    with windows.keyed_state(spark):
        for n in range(3):
            # User i arrives twice, on day 4n + i % 5 and a second later, in every micro-batch but one.
            coming = [i for i in range(users) if i % 3 != n]
            times = [(i, (4 * n + i % 5) * day + late) for late in (0, 1) for i in coming]
            deliver(spark, inbox, [event_json(user=f"u{i}", channel=str(at)) for i, at in times], 1000 * n)
            got = drained(spark, build, tmp_path, "grouped", inbox)
            for i, at in times[len(coming):]:
                if i not in passed or at - passed[i] > 7 * day:
                    passed[i] = at
                    want.append((f"u{i}", str(at)))
    assert sorted((r["user_id"], r["channel"]) for r in got.collect()) == sorted(want) and users < len(want) < 2 * users


def test_exact_users_of_an_hour_come_once_it_is_over(spark, tmp_path):
    inbox = str(tmp_path / "in")
    users = [event_json(user=f"u{i % 3}", ts=T0 + i, channel=None) for i in range(30)]
    deliver(spark, inbox, users + [event_json(user="u0", ts=T0 + 3600)], 0)
    got = drained(spark, lambda e: windows.exact_users(e, "1 hour"), tmp_path, "users", inbox)
    assert got.count() == 0
    deliver(spark, inbox, [event_json(user="u9", ts=T0 + 20, channel=None), event_json(user="u1", ts=T0 + 3 * 3600)], 100)
    got = drained(spark, lambda e: windows.exact_users(e, "1 hour"), tmp_path, "users", inbox)
    assert [(r["channel"], r["date_hour"], r["unique_user_count"]) for r in got.filter(f"date_hour = {T0}").collect()] == [(None, T0, 4)]
    # Too late by then.
    deliver(spark, inbox, [event_json(user="u8", ts=T0 + 30, channel=None), event_json(user="u1", ts=T0 + 9 * 3600)], 200)
    got = drained(spark, lambda e: windows.exact_users(e, "1 hour"), tmp_path, "users", inbox)
    assert got.filter(f"date_hour = {T0}").agg(F.sum("unique_user_count")).first()[0] == 4
    totals = drained(spark, lambda e: windows.exact_totals(e, "1 hour"), tmp_path, "totals", inbox)
    assert {r["date_hour"]: r["n"] for r in totals.groupBy("date_hour").agg(F.sum("total_count").alias("n")).collect()}[T0] == 32


def test_streams_keep_keys_as_bytes(spark, tmp_path):
    inbox = str(tmp_path / "in")
    deliver(spark, inbox, [event_json(user=f"u{i % 9}", ts=T0 + i % 9) for i in range(30)], 0)

    def arrivals(events):
        return windows.first_arrivals(events.withColumn("at", clock.hour_as_timestamp(F.col("event_timestamp"))), "at")

    got = drained(spark, arrivals, tmp_path, "arrivals", inbox)
    sent = classify(records.read_files(spark, inbox)).select("idempotency_key").distinct()
    assert sorted(got.select("idempotency_key").collect()) == sorted(sent.collect())
    drained(spark, lambda e: windows.exact_totals(e, "1 hour"), tmp_path, "totals", inbox)
    for name, operator in (("arrivals", 0), ("totals", 1)):
        # Operators are numbered from the end of the plan.
        state = spark.read.format("statestore").option("operatorId", operator).load(str(tmp_path / name / "cp"))
        lengths = state.select(F.octet_length("key.idempotency_key").alias("n")).groupBy("n").count().collect()
        assert [tuple(row) for row in lengths] == [(32, 9)]


def refusing(user, raising="refused"):
    def prepare(rows):
        return rows.withColumn("channel", F.when(F.col("user_id").startswith(user), F.raise_error(F.lit(raising))).otherwise(F.col("channel")))
    return prepare


def test_one_poison_row_costs_one_letter(spark, stores, tmp_path):
    inbox = str(tmp_path / "in")
    values = [event_json(user=f"user_{i}", ts=T0 + i) for i in range(999)] + [event_json(user="poison", campaign="bad")]
    deliver(spark, inbox, values, 0)
    run(stores, inbox, str(tmp_path / "cp"), storing=Storing(refusing("poison"), waits=(0.05, 0.1)))
    (letter,) = stores.quarantine.read().collect()
    assert '"bad"' in letter["value"] and letter["offset"] == 999 and letter["reason"].startswith("cannot be stored: ") and "refused" in letter["reason"]
    counted = stores.counters.read().first()
    assert (counted["received"], counted["dead"], counted["inserted"], counted["unique_keys"], counted["cross_batch_duplicates"]) == (1000, 1, 999, 999, 0)
    assert len(folders.child_folders(spark, f"{stores.ledger.root}/data", "c=")) == len({p.folder.split("/")[1] for p in stores.ledger.snapshot().of()})
    # The stream goes on.
    deliver(spark, inbox, [event_json(user="next")], 2000)
    run(stores, inbox, str(tmp_path / "cp"))
    assert stores.ledger.read().count() == 1000
    # A rerun after a cut between the commit and the counters finds the letter again.
    assert folders.remove(spark, f"{stores.root}/counters/part=stream-000000000000")
    ingest_batch(stores, records_frame(spark, values), "stream-000000000000", storing=Storing(refusing("poison"), waits=()))
    assert stores.quarantine.read().count() == 1 and stores.counters.of_batch("stream-000000000000").first()["inserted"] == 999


def test_many_poison_rows_leave_one_commit_of_the_rest(spark, stores):
    """What can be stored is staged once, not in as many pieces as the search for the others takes."""
    staged = []

    def prepare(rows):
        staged.append("halved" if "_halved" in str(rows.inputFiles()) else "whole")
        return refusing("poison")(rows)

    values = [event_json(user=f"{'poison' if i % 40 == 7 else 'user'}_{i}", ts=T0 + i) for i in range(400)]
    counted = ingest_batch(stores, records_frame(spark, values), "b-1", storing=Storing(prepare, waits=()))
    assert (counted["dead"], counted["inserted"], counted["unique_keys"]) == (10, 390, 390)
    assert stores.quarantine.read().filter("value LIKE '%poison%'").count() == stores.quarantine.read().count() == 10
    (part,) = stores.ledger.snapshot().of()
    assert part.rows == 390 and staged[0] == "whole" and set(staged[1:]) == {"halved"}
    assert folders.child_folders(spark, f"{stores.ledger.root}/_halved", "") == []


def test_outage_is_no_poison(spark, stores):
    values = [event_json(user=f"user_{i}", ts=T0 + i) for i in range(30)]
    with pytest.raises(Exception, match="disk full"):
        ingest_batch(stores, records_frame(spark, values), "b-1", storing=Storing(refusing("user", "disk full"), waits=(0.01,), outage=4))
    assert stores.quarantine.read().count() == stores.ledger.read().count() == stores.counters.read().count() == 0
    tries = []
    failing = [True, True]

    def recovers(rows):
        tries.append(1)
        return rows.withColumn("channel", F.raise_error(F.lit("busy"))) if failing and failing.pop() else rows

    assert ingest_batch(stores, records_frame(spark, values), "b-1", storing=Storing(recovers, waits=(0.01, 0.01)))["inserted"] == 30
    assert len(tries) == 3


def test_upkeep_merges_expires_and_clears(spark, stores, tmp_path):
    at = dt.datetime(2026, 2, 16, tzinfo=dt.timezone.utc)
    for n in range(4):
        ingest_batch(stores, records_frame(spark, [event_json(ts=T0 + n), f"bad {n}"]), f"b-{n}", received_at=at + dt.timedelta(days=n))
    refresh_stream.refresh(stores, dt.date(2026, 2, 16))
    planned = stores.ledger.read(), stores.counters.read()
    done = upkeep(stores, at + dt.timedelta(days=9), merge_parts=3)
    assert done["letters"] == 2 and done["merged"] >= 8 and done["removed"] == 0
    assert len(stores.ledger.snapshot().parts) == 1 and stores.ledger.read().count() == 4
    assert [df.count() for df in planned] == [4, 4]
    assert stores.counters.read().count() == 4 and stores.quarantine.read().count() == 2
    for keep in (-1, -1):
        upkeep(stores, at + dt.timedelta(days=9), merge_parts=1, keep_hours=keep)
    assert stores.ledger.read().count() == 4 and stores.counters.read().count() == 4
    assert len(folders.child_folders(spark, f"{stores.ledger.root}/data", "c=")) == 1
    assert stores.counters.of_batch("b-2").first()["inserted"] == 1 and stores.counters.has_batches("b-")
    query = refresh_stream.start_upkeep(stores, str(tmp_path / "upkeep"), seconds=0.5, now=at + dt.timedelta(days=30))
    try:
        for _ in range(60):
            if stores.quarantine.read().count() == 0:
                break
            time.sleep(0.5)
        assert stores.quarantine.read().count() == 0
    finally:
        query.stop()
