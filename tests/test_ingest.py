import datetime as dt
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from rows import T0, event_json, records_frame

from eventtally.operators import dedup, retention, upsert
from eventtally.plans import ingest
from eventtally.plans.ingest import ingest_batch, replay_dead_letters
from eventtally.sources import commits, folders, keyindex
from eventtally.sources.ledger import Ledger
from pyspark.sql import functions as F

OTHER = dict(name="wish", user="w-17", ts=T0 + 77, campaign=None)


def contents(stores):
    rows = stores.ledger.read().select("idempotency_key", "channel", "event_date", "bid").collect()
    return sorted(tuple(r) for r in rows)


def test_new_event_is_inserted(spark, stores):
    got = ingest_batch(stores, records_frame(spark, [event_json()]), "b-1")
    assert got["inserted"] == 1
    assert stores.ledger.exists("b1a84c038bc6a3cf10d06e74d0ff2466c18b98fa34938b1c5cf3b9a5dfbf90de")
    assert not stores.ledger.exists("0" * 64)


def test_seen_event_is_skipped(spark, stores):
    ingest_batch(stores, records_frame(spark, [event_json()]), "b-1")
    before = contents(stores)
    got = ingest_batch(stores, records_frame(spark, [event_json(channel="again")]), "b-2")
    assert (got["inserted"], got["cross_batch_duplicates"]) == (0, 1)
    assert contents(stores) == before


def test_new_and_seen_event(spark, stores):
    ingest_batch(stores, records_frame(spark, [event_json(**OTHER)]), "b-1")
    got = ingest_batch(stores, records_frame(spark, [event_json(), event_json(**OTHER)]), "b-2")
    assert got["inserted"] == 1


def test_empty_batch_writes_no_events(spark, stores):
    got = ingest_batch(stores, records_frame(spark, []), "b-1")
    assert set(got.values()) == {0}
    assert stores.ledger.dates() == [] and stores.quarantine.read().count() == 0


def test_last_arrival_wins_inside_a_batch(spark, stores):
    values = [event_json(channel="first"), event_json(**OTHER), event_json(channel=None)]
    got = ingest_batch(stores, records_frame(spark, values), "b-1")
    assert (got["inserted"], got["in_batch_duplicates"]) == (2, 1)
    row = stores.ledger.read().filter("event_name = 'product_view'").first()
    assert row["channel"] is None  # the winner's NULL stays


def test_replay_changes_nothing_and_repairs(spark, stores):
    one = records_frame(spark, [event_json(), event_json(**OTHER), "bad", event_json(ts=T0 - 86400)])
    two = records_frame(spark, [event_json(channel="late"), event_json(ts=T0 + 86400)], 10)
    ingest_batch(stores, one, "b-1")
    ingest_batch(stores, two, "b-2")
    before = contents(stores)
    for records, bid in ((two, "b-2"), (one, "b-1"), (two, "b-2")):
        ingest_batch(stores, records, bid)
        assert contents(stores) == before
    # A crash after the commit leaves the batch in the ledger, not counted; with its part, and merged since.
    for merged in (False, True):
        if merged:
            for day in stores.ledger.dates():
                stores.ledger.merge_day(day, "m", least=1)
        counted = stores.counters.of_batch("b-2").first()
        assert folders.remove(spark, f"{stores.root}/counters/part=b-2")
        assert ingest_batch(stores, two, "b-2")["inserted"] == counted["inserted"] == 1
        assert contents(stores) == before
    assert stores.quarantine.read().count() == 1
    assert stores.counters.read().count() == 2


def test_order_of_rows_does_not_matter(spark, stores, tmp_path):
    values = [event_json(channel=f"c{i % 7}", ts=T0 + i % 5) for i in range(40)]
    records = records_frame(spark, values)
    ingest_batch(stores, records, "b-1")
    other = ingest.Stores(spark, str(tmp_path / "other"))
    ingest_batch(other, records.orderBy(F.rand(1)).repartition(5), "b-1")
    assert contents(stores) == contents(other)


def test_shuffled_lookup_equals_broadcast_lookup(spark, stores, tmp_path):
    first = records_frame(spark, [event_json(ts=T0 + i) for i in range(50)])
    second = records_frame(spark, [event_json(ts=T0 + i // 2, channel=f"c{i}") for i in range(30, 200)])
    other = ingest.Stores(spark, str(tmp_path / "other"))
    for target, limit in ((stores, 500_000), (other, 0)):
        ingest_batch(target, first, "b-1", broadcast_keys=limit)
        ingest_batch(target, second, "b-2", broadcast_keys=limit)
    assert contents(stores) == contents(other)


def test_large_batches_leave_bucketed_keys_where_they_are(spark, tmp_path):
    """Batches that meet bucketed parts, parts without buckets, and both: as with the broadcast lookup."""
    plain, laid_out = (ingest.Stores(spark, str(tmp_path / name), 4, rows) for name, rows in (("plain", 10**9), ("laid-out", 40)))
    def batch(first, last, day, offset):
        return [event_json(user=f"u{i}", ts=T0 + day * 86400 + i, channel=f"{offset}") for i in range(first, last)]
    batches = [
        batch(0, 60, 0, 0) + batch(0, 10, 1, 0), batch(30, 80, 0, 1) + batch(5, 70, 1, 1),
        batch(0, 90, 0, 2) + batch(0, 90, 1, 2) + [event_json(user="a|b", ts=T0 + 5), event_json(name="product_view|a", user="b", ts=T0 + 5)],
    ]
    for n, values in enumerate(batches):
        records = records_frame(spark, values)
        want = ingest_batch(plain, records, f"b-{n}")
        assert ingest_batch(laid_out, records, f"b-{n}", broadcast_keys=0) == want
    assert contents(laid_out) == contents(plain)
    ledger = laid_out.ledger
    parts = list(ledger.snapshot().parts.values())
    spans = {part.day: (T0 - 10**6, T0 + 10**6) for part in parts}
    large = ledger.bucketed(spans, parts)
    assert {part.folder for part in large} == {part.folder for part in parts if part.rows >= 40} and 0 < len(large) < len(parts)
    # Another session's catalog does not know the table; the files are enough.
    spark.sql(f"DROP TABLE {ledger.buckets.table}")
    events = ledger.read().drop("received_at", "bid").withColumns({"offset": F.lit(0), "partition": F.lit(0)})
    stats = {"spans": spans, "with_separator": 0, "deserialized": 10**9}
    assert ingest.new_events(events, ledger, parts, stats).count() == 0
    # The scan of the buckets goes into its join without an exchange, the batch's keys into as many partitions.
    keys = events.select("idempotency_key", "event_date").distinct()
    seen = ledger.seen_in_buckets(spans, large)
    with_threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = dedup.storable(keys, seen)
        text = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_threshold)
    side = text[text.index("LeftAnti"):].split("+- Sort")
    scans = [part for part in side if ledger.buckets.table in part]
    assert len(scans) == 1 and "Bucketed: true" in scans[0] and "Exchange" not in scans[0], text
    assert "hashpartitioning(idempotency_key" in text and ", 4)" in text


def test_a_large_batch_is_shuffled_once(spark, stores):
    """A batch that is not broadcast meets the ledger as its reduction to a row a key has dealt it, keys as bytes."""
    ingest_batch(stores, records_frame(spark, [event_json(ts=T0 + i) for i in range(50)]), "b-1")
    ledger = stores.ledger
    parts = list(ledger.snapshot().parts.values())
    events = ledger.read().drop("received_at", "bid").withColumns({"offset": F.lit(0), "partition": F.lit(0)})
    events = events.unionByName(events.withColumns({"user_id": F.lit("new"), "idempotency_key": F.sha2("idempotency_key", 256)}))
    stats = {"spans": {part.day: (0, 2 * T0) for part in parts}, "with_separator": 0, "deserialized": 10**9}
    with_threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = ingest.new_events(events, ledger, parts, stats)
        text = fresh._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_threshold)
    assert text.count("Exchange hashpartitioning") == 2, text
    want = {r[0] for r in ledger.read().select(F.sha2("idempotency_key", 256)).collect()}
    assert sorted(r["idempotency_key"] for r in fresh.collect()) == sorted(want)


def test_merges_lay_keys_out_and_vacuum_clears_them(spark, tmp_path):
    stores = ingest.Stores(spark, str(tmp_path / "deployment"), 2, 3)
    for n in range(3):
        ingest_batch(stores, records_frame(spark, [event_json(user=f"u{n}{i}", ts=T0 + n) for i in range(2)]), f"b-{n}")
    ledger = stores.ledger
    spans = {day: (0, 2 * T0) for day in ledger.dates()}
    assert ledger.bucketed(spans, ledger.snapshot().parts.values()) == []
    ledger.merge_day(ledger.dates()[0], "upkeep")
    parts = list(ledger.snapshot().parts.values())
    assert ledger.bucketed(spans, parts) == parts and ledger.buckets.load(parts).count() == 6
    for n in (3, 4):
        ingest_batch(stores, records_frame(spark, [event_json(user=f"u{n}{i}", ts=T0 + n) for i in range(4)]), f"b-{n}", broadcast_keys=0)
    ledger.merge_day(ledger.dates()[0], "upkeep-2")
    assert len(folders.child_folders(spark, ledger.buckets.root, "commit=")) == 4
    ledger.vacuum(keep_hours=0)
    assert len(folders.child_folders(spark, ledger.buckets.root, "commit=")) == 1
    got = ingest_batch(stores, records_frame(spark, [event_json(user="u00", ts=T0), event_json(user="new", ts=T0)]), "b-5", broadcast_keys=0)
    assert (got["inserted"], got["cross_batch_duplicates"]) == (1, 1)


def test_separator_collision_across_dates(spark, stores):
    # Three splits of a|b|5|7|x, then two of a|b|864000|7|x on different dates.
    a = event_json(name="a", user="b", ts=5, campaign="7|x")
    b = event_json(name="a", user="b|5", ts=7, campaign="x")
    far = event_json(name="a|b", user="5", ts=7, campaign="x")
    assert ingest_batch(stores, records_frame(spark, [a]), "b-1")["inserted"] == 1
    assert ingest_batch(stores, records_frame(spark, [far]), "b-2")["inserted"] == 0
    days = 864000
    c = event_json(name="a", user="b", ts=days, campaign="7|x")
    d = event_json(name="a|b", user=str(days), ts=7, campaign="x")
    assert ingest_batch(stores, records_frame(spark, [c]), "b-3")["inserted"] == 1
    assert ingest_batch(stores, records_frame(spark, [d]), "b-4")["inserted"] == 0
    assert ingest_batch(stores, records_frame(spark, [b]), "b-5")["inserted"] == 0


def test_remembering_for_a_limited_time(spark, stores):
    records = records_frame(spark, [event_json()])
    at = dt.datetime(2026, 2, 15, tzinfo=dt.timezone.utc)
    ingest_batch(stores, records, "b-1", received_at=at)
    late = at + dt.timedelta(days=8)
    assert ingest_batch(stores, records, "b-2", received_at=late)["inserted"] == 0
    # Forgotten, but its row is still there: one row per key and date, always.
    assert ingest_batch(stores, records, "b-3", received_at=late, remember_days=7)["inserted"] == 0
    a = event_json(name="a", user="b", ts=864000, campaign="7|x")
    b = event_json(name="a|b", user="864000", ts=7, campaign="x")
    ingest_batch(stores, records_frame(spark, [a]), "b-4", received_at=at)
    assert ingest_batch(stores, records_frame(spark, [b]), "b-5", received_at=late)["inserted"] == 0
    # The same key on another date, which only separators make possible.
    assert ingest_batch(stores, records_frame(spark, [b]), "b-6", received_at=late, remember_days=7)["inserted"] == 1
    assert stores.ledger.read().groupBy("idempotency_key", "event_date").count().filter("count > 1").isEmpty()


def test_writers_at_the_same_time(spark, stores):
    # Five events of their own each, ten that all have, over three days.
    def batch(n):
        own = [event_json(user=f"u{n}", ts=T0 + 86400 * (i % 3) + i) for i in range(5)]
        return records_frame(spark, own + [event_json(user="all", ts=T0 + 86400 * (i % 3) + i, channel=f"c{n}") for i in range(10)])

    names = [f"b-{n}" for n in range(3)]
    with ThreadPoolExecutor(3) as pool:
        counted = list(pool.map(lambda n: ingest_batch(stores, batch(n), names[n]), range(3)))
    rows = stores.ledger.read()
    assert rows.count() == rows.select("idempotency_key", "event_date").distinct().count() == 25
    assert sorted(c["inserted"] for c in counted) == [5, 5, 15]
    # All copies of the first to commit stay, on all days.
    assert rows.filter("user_id = 'all'").select("bid").distinct().count() == 1
    assert stores.ledger.snapshot().version == 3
    for n in range(3):
        assert ingest_batch(stores, batch(n), f"again-{n}")["inserted"] == 0


def test_overtaken_batch_leaves_out_what_came_in_between(spark, stores, monkeypatch):
    first = records_frame(spark, [event_json(ts=T0 + i) for i in range(4)])
    second = records_frame(spark, [event_json(ts=T0 + i, channel="second") for i in range(2, 8)])
    far = records_frame(spark, [event_json(ts=T0 + 40_000)])
    real = Ledger.append
    read = []

    def between(self, base, parts, bid):
        if bid == "b-2" and not read:
            read.append(len(parts))
            ingest_batch(stores, first, "b-1")
            ingest_batch(stores, far, "b-3")
        return real(self, base, parts, bid)

    monkeypatch.setattr(Ledger, "append", between)
    looked = []
    real_seen = Ledger.seen
    monkeypatch.setattr(Ledger, "seen", lambda self, spans, sep, parts, *more: looked.append([p.by for p in parts]) or real_seen(self, spans, sep, parts, *more))
    assert ingest_batch(stores, second, "b-2")["inserted"] == 4
    assert sorted(r["event_timestamp"] - T0 for r in stores.ledger.read().filter("channel = 'second'").collect()) == [4, 5, 6, 7]
    # The far batch shares no second with it, so only the other was looked into.
    assert looked[-1] == ["b-1"]
    assert len(folders.child_folders(spark, f"{stores.ledger.root}/data", "c=")) == 3


def test_one_name_for_two_writers_is_refused(spark, stores, monkeypatch):
    real = Ledger.append

    def between(self, base, parts, bid):
        monkeypatch.setattr(Ledger, "append", real)
        ingest_batch(stores, records_frame(spark, [event_json(channel="other")]), "b-1")
        return real(self, base, parts, bid)

    monkeypatch.setattr(Ledger, "append", between)
    with pytest.raises(ingest.BatchTaken):
        ingest_batch(stores, records_frame(spark, [event_json(channel="mine")]), "b-1")
    assert [r["channel"] for r in stores.ledger.read().collect()] == ["other"]


def test_a_write_that_cannot_be_is_an_error_at_once(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    broken = ingest.Stores(spark, str(tmp_path / "file" / "below"))
    began = time.time()
    with pytest.raises(Exception, match="(?i)not a directory|file|mkdirs"):
        ingest_batch(broken, records_frame(spark, [event_json()]), "b-1")
    with pytest.raises(Exception, match="(?i)not a directory|file|mkdirs"):
        folders.publish(spark, str(tmp_path / "file" / "below" / "x.json"), b"{}")
    assert time.time() - began < 30


def test_cut_off_before_the_commit_shows_nothing(spark, stores, monkeypatch):
    ingest_batch(stores, records_frame(spark, [event_json()]), "b-1")
    before = contents(stores)

    def killed(*_):
        raise KeyboardInterrupt

    batch = records_frame(spark, [event_json(ts=T0 + 86400 * d + 9) for d in range(4)])
    with monkeypatch.context() as patch:
        patch.setattr(Ledger, "append", killed)
        with pytest.raises(KeyboardInterrupt):
            ingest_batch(stores, batch, "b-2")
    assert contents(stores) == before and stores.ledger.dates() == [dt.date(2026, 2, 15)]
    assert ingest_batch(stores, batch, "b-2")["inserted"] == 4
    assert stores.ledger.vacuum() == 0 and stores.ledger.vacuum(keep_hours=-1) == 1
    assert len(contents(stores)) == 5


def test_publish_keeps_the_first(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log" / "1.json")
    assert folders.publish(spark, path, b"one") and not folders.publish(spark, path, b"two")
    assert folders.content(spark, path) == b"one" and folders.child_files(spark, str(tmp_path / "log")) == ["1.json"]
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: folders.publish(spark, str(tmp_path / "log" / "2.json"), str(i).encode()), range(16)))
    assert sum(won) == 1 and folders.content(spark, str(tmp_path / "log" / "2.json")) == str(won.index(True)).encode()
    # The way of other storage, which renames without overwriting.
    monkeypatch.setattr(folders, "LINKED", ())
    assert folders.publish(spark, str(tmp_path / "log" / "3.json"), b"x") and not folders.publish(spark, path, b"y")
    assert folders.content(spark, path) == b"one"


def test_snapshots_outlive_merges_and_full_lists(spark, stores, monkeypatch):
    monkeypatch.setattr(commits, "FULL_EVERY", 3)
    for n in range(7):
        ingest_batch(stores, records_frame(spark, [event_json(ts=T0 + n), event_json(ts=T0 + 86400 + n)]), f"b-{n}")
    ledger = stores.ledger
    planned, before = ledger.read(), contents(stores)
    assert [ledger.read(version=v).count() for v in range(8)] == [2 * v for v in range(8)]
    day = dt.date(2026, 2, 15)
    assert ledger.merge_day(day, "m") == 7 and len(ledger.snapshot().of([day])) == 1
    ledger.drop_before(dt.date(2026, 2, 16))
    assert planned.count() == 14 and sorted(tuple(r) for r in planned.select("idempotency_key", "channel", "event_date", "bid").collect()) == before
    assert ledger.read().count() == 7 and ledger.read(version=8).count() == 14
    assert ledger.vacuum() == 0 and planned.count() == 14
    # The merged day goes as a whole, of the batches the parts of that day.
    assert ledger.vacuum(keep_hours=-1) == 1 and ledger.read().count() == 7
    assert ledger.changes(0, 9) is None and ledger.changes(8, 9) is not None
    with pytest.raises(Exception):
        planned.count()


def test_merge_goes_on_when_batches_come_in_between(spark, stores, monkeypatch):
    for n in range(2):
        ingest_batch(stores, records_frame(spark, [event_json(ts=T0 + n)]), f"b-{n}")
    real, calls = Ledger.commit, []

    def between(self, base, kind, by, *parts):
        if kind == "merge" and not calls:
            calls.append(1)
            ingest_batch(stores, records_frame(spark, [event_json(ts=T0 + 5)]), "b-5")
            Ledger(spark, stores.ledger.root).merge_day(dt.date(2026, 2, 15), "other")
        return real(self, base, kind, by, *parts)

    monkeypatch.setattr(Ledger, "commit", between)
    stores.ledger.merge_day(dt.date(2026, 2, 15), "m")
    assert stores.ledger.read().count() == 3 and len(stores.ledger.snapshot().parts) == 1


def test_key_index_spares_data_files(spark, stores, monkeypatch):
    for n in range(6):
        ingest_batch(stores, records_frame(spark, [event_json(user=f"u{n}-{i}", ts=T0 + 86400 * n + i) for i in range(500)]), f"b-{n}")
    ledger = stores.ledger
    parts = list(ledger.snapshot().parts.values())
    assert len(parts) == 6
    keys = ledger.read().select("idempotency_key", "bid").orderBy("idempotency_key").limit(40).collect()
    for key, bid in keys[:4]:
        held = ledger.index.holding(parts, keyindex.one(spark, key))
        assert bid in [p.by for p in held] and len(held) <= 2 and ledger.exists(key)
    opened = []
    real = Ledger.load
    with monkeypatch.context() as patch:
        patch.setattr(Ledger, "load", lambda self, some: opened.append(list(some)) or real(self, some))
        assert not ledger.exists("0" * 64)
    assert opened == [[]]
    # A share of absent keys that pass for some part, of 6 x 2,000 trials: about 1 % by design.
    absent = spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).alias("idempotency_key"))
    asked = absent.select("idempotency_key", F.explode(keyindex.positions(F.col("idempotency_key"))).alias("p"))
    bit = F.pmod("p", F.lit(keyindex.BUCKET_BITS))
    met = ledger.index.read(parts).join(asked, F.floor(bit / keyindex.BUCKET_BITS) == F.col("bucket"))
    passing = met.groupBy("part", "idempotency_key").agg(F.bool_and(keyindex._is_set(F.col("bits"), bit)).alias("all")).filter("all").count()
    assert passing <= 0.02 * 12_000
    assert keyindex.buckets_for(0) == keyindex.buckets_for(3_000) == 1 and keyindex.buckets_for(172_000_000) == 65_536
    # Filters of several buckets.
    wide = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("idempotency_key"), F.lit(1).alias("g"))
    made = keyindex.filters(wide, ["g"], F.lit(8)).collect()
    assert len(made) == 8 and sum(bin(int.from_bytes(r["bits"], "little")).count("1") for r in made) > 100_000


def test_filters_are_bitmaps_built_without_a_sort(spark):
    """Dense, sparse and single-key filters equal those of `bitmap_construct_agg`; no row a key and bit is sorted."""
    rows = spark.range(6_000).select(
        F.sha2(F.col("id").cast("string"), 256).alias("idempotency_key"),
        F.expr("CASE WHEN id < 5000 THEN 0 WHEN id < 5999 THEN 1 END").alias("g"), F.expr("if(id < 5000, 2, 64)").alias("size"),
    )
    got = keyindex.filters(rows, ["g"], F.col("size"))
    bit = F.pmod("position", F.col("size").cast("bigint") * keyindex.BUCKET_BITS)
    set_ = rows.withColumn("position", F.explode(keyindex.positions(F.col("idempotency_key")))).withColumn("bit", bit)
    want = set_.groupBy("g", "size", F.floor(F.col("bit") / keyindex.BUCKET_BITS).alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("bit") % keyindex.BUCKET_BITS).alias("bits")
    )
    assert got.dtypes == [("g", "int"), ("buckets", "int"), ("bucket", "bigint"), ("bits", "binary")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert "Sort" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("days", [41, 400])
def test_lookup_reads_no_more_for_many_days(spark, stores, days):
    ingest_batch(stores, records_frame(spark, [event_json(ts=T0 + 86400 * d + h) for d in range(3) for h in (0, 40000)]), "b-1")
    late = dt.date(2026, 2, 17)
    spans = {dt.date(2020, 1, 1) + dt.timedelta(n): (1577836800 + 86400 * n, 1577836810 + 86400 * n) for n in range(days)}
    spans[late] = (T0 + 2 * 86400, T0 + 2 * 86400 + 10)
    assert stores.ledger.seen(spans, False, stores.ledger.snapshot().of()).count() == 1


def test_merged_counters_and_letters(spark, stores):
    for n in range(3):
        ingest_batch(stores, records_frame(spark, [event_json(ts=T0 + n), f"bad {n}"]), f"b-{n}")
    before = sorted(stores.counters.read().collect()), sorted(stores.quarantine.read().collect())
    assert stores.counters.merge() == stores.quarantine.merge() == 3
    assert (sorted(stores.counters.read().collect()), sorted(stores.quarantine.read().collect())) == before
    assert stores.counters.merge() == 0 and stores.counters.has_batches("b-1") and not stores.counters.has_batches("c")
    again = ingest_batch(stores, records_frame(spark, [event_json(ts=T0 + 1), "bad 1"]), "b-1")
    assert again["inserted"] == 1 and stores.quarantine.read().count() == 3


def test_hot_key_is_reduced_before_the_shuffle(spark, stores):
    # A third of the rows are copies of one event, another third one user's.
    n = 90_000
    kind = F.col("id") % 3
    user = F.when(kind == 0, F.lit("hot")).when(kind == 1, F.lit("busy")).otherwise(
        F.concat(F.lit("u"), F.col("id").cast("string"))
    )
    ts = F.when(kind == 0, F.lit(T0)).otherwise(F.lit(T0) + F.col("id") % 86400)
    value = F.to_json(F.struct(F.lit("click").alias("event_name"), user.alias("user_id"), ts.alias("timestamp")))
    records = spark.range(0, n, 1, 8).select(
        F.lit(None).cast("string").alias("key"), value.alias("value"), F.lit(0).alias("partition"),
        F.col("id").alias("offset"),
    )
    got = ingest_batch(stores, records, "b-1")
    assert got["deserialized"] == n
    expected = 1 + n // 3 + len({i % 86400 for i in range(1, n, 3)})
    assert got["inserted"] == expected
    reduced = dedup.last_in_batch(ingest.classify(records).drop("value"))
    plan = reduced._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_lookup_reads_only_the_days_and_times_of_the_batch(spark, stores):
    values = [event_json(ts=T0 + 86400 * d + s) for d in range(6) for s in (0, 5, 10)]
    ingest_batch(stores, records_frame(spark, values), "b-1")
    day = dt.date(2026, 2, 16)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    parts = stores.ledger.snapshot().of()
    seen = stores.ledger.seen({day: (T0 + 86400 + 3, T0 + 86400 + 10)}, False, parts)
    assert len(seen.inputFiles()) == 1 and seen.count() == 2
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert f"GreaterThanOrEqual(event_timestamp,{T0 + 86400 + 3})" in plan
    assert "ReadSchema: struct<event_timestamp:bigint,idempotency_key:string>" in plan  # no payload
    many = {day + dt.timedelta(n): (T0, T0 + 10**6) for n in range(100)}
    assert stores.ledger.seen(many, False, parts).count() == 15
    assert stores.ledger.seen({}, False, parts).count() == 0


def test_dead_letter_replay(spark, stores):
    ingest_batch(stores, records_frame(spark, [event_json()[1:], "hopeless"]), "b-1")
    assert stores.quarantine.read().count() == 2

    def mend(letters):
        return letters.withColumn("value", F.concat(F.lit("{"), "value"))

    for bid in ("replay-1", "replay-1", "replay-2", "replay-3"):
        replay_dead_letters(stores, mend, bid)
        assert stores.ledger.read().count() == 1
        assert [r["offset"] for r in stores.letters().collect()] == [1]
    ingest_batch(stores, records_frame(spark, ["another"], 7), "b-2")
    replay_dead_letters(stores, mend, "replay-4")
    assert sorted(r["offset"] for r in stores.letters().collect()) == [1, 7]


def test_expired_days_are_dropped(spark, stores):
    values = [event_json(ts=T0 + 86400 * d) for d in range(4)]
    ingest_batch(stores, records_frame(spark, values), "b-1")
    gone = stores.ledger.drop_before(dt.date(2026, 2, 17))
    assert gone == [dt.date(2026, 2, 15), dt.date(2026, 2, 16)]
    assert stores.ledger.read().count() == 2


def test_merging_a_day_keeps_its_rows(spark, stores):
    day = dt.date(2026, 2, 15)
    for n in range(3):
        values = [event_json(ts=T0 + n, channel=f"c{n}"), event_json(ts=T0 + 86400 + n)]
        ingest_batch(stores, records_frame(spark, values), f"b-{n}")

    def rows():
        return sorted(stores.ledger.read([day]).collect(), key=lambda r: r["event_timestamp"])

    before = rows()
    assert stores.ledger.merge_day(day, "merged-1") == 3
    assert rows() == before and len(stores.ledger.snapshot().of([day])) == 1
    assert stores.ledger.merge_day(day, "merged-2") == 0
    # A batch replayed after it was merged adds nothing and keeps its counters.
    values = [event_json(ts=T0, channel="c0"), event_json(ts=T0 + 86400)]
    assert ingest_batch(stores, records_frame(spark, values), "b-0")["inserted"] == 2
    assert rows() == before and stores.ledger.read().count() == 6


def test_time_to_live_is_strict(spark):
    now = 10 * 86400
    seen = spark.createDataFrame([(3 * 86400 - 1,), (3 * 86400,), (now,)], "received_at BIGINT")
    args = (F.col("received_at"), F.lit(now).cast("bigint"), F.lit(7))
    assert retention.survivors(seen, *args).count() == 2
    assert retention.expired_count(seen, *args).first()["deleted"] == 1


def test_two_month_calendar(spark):
    days = spark.range(1).select(
        retention.two_month_days(F.lit("2026-02-20").cast("date")).alias("d")
    ).first()["d"]
    assert (len(days), days[0], days[-1]) == (59, dt.date(2026, 2, 1), dt.date(2026, 3, 31))


@pytest.mark.parametrize("merge, value", [(upsert.upsert, "14"), (upsert.insert_missing, "7")])
def test_conflict_rules(spark, merge, value):
    stored = spark.createDataFrame([("days", "7"), ("kept", "x")], "key STRING, value STRING")
    incoming = spark.createDataFrame([("days", "14"), ("new", "y")], "key STRING, value STRING")
    assert dict(merge(stored, incoming).collect()) == {"days": value, "kept": "x", "new": "y"}


def test_insert_ignore_on_two_columns(spark):
    table = spark.createDataFrame([("k", "2026-01-01")], "idempotency_key STRING, event_date STRING")
    rows = spark.createDataFrame(
        [("k", "2026-01-01"), ("k", "2026-01-02"), ("m", "2026-01-01")], table.schema
    )
    added = dedup.insert_ignore(rows, table, ("idempotency_key", "event_date"))
    assert sorted(map(tuple, added.collect())) == [("k", "2026-01-02"), ("m", "2026-01-01")]
