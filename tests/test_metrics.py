import datetime as dt
import json
import random

import pytest
from rows import T0, event_json, events_frame, records_frame

from eventtally.functions import clock
from eventtally.operators import metrics, rollup, uniques
from eventtally.plans.ingest import ingest_batch
from eventtally.plans.refresh import expire_days, refresh
from eventtally.plans import refresh as refresh_job
from eventtally.schema import ROLLUP
from eventtally.sources.commits import CommitTable
from eventtally.sources.versioned import VersionedTable
from eventtally.sources import folders
from pyspark.sql import functions as F

ROLLUP_COLUMNS = ("event_name", "channel", "date_hour", "total_count", "unique_user_count", "event_date")
H = 3600
ROWS = [  # event_name click: user, channel, epoch
    ("u1", "web", 1771157100), ("u1", "web", 1771159200), ("u1", "mobile", 1771159800),
    ("u2", "web", 1771161000), ("u1", None, 1771163999), ("u3", "web", 1771164000),
    ("u1", "web", 1771200000),
]


@pytest.fixture(scope="module")
def clicks(spark):
    events = events_frame(spark, [("click", u, t, None, c) for u, c, t in ROWS])
    dated = events.withColumn("event_date", clock.epoch_date(F.col("event_timestamp")))
    return rollup.hourly_rollup(dated).cache(), dated


def ask(table, start, end, channel=None, group_by="hourly", name="click"):
    total = metrics.totals(table, name, start, end, channel).collect()
    assert len(total) == 1
    buckets = metrics.breakdown(table, name, start, end, channel, group_by).collect()
    assert [b["bucket"] for b in buckets] == sorted(b["bucket"] for b in buckets)
    return tuple(total[0]), [tuple(b) for b in buckets]


@pytest.mark.parametrize("args, expected", [
    ((T0, 1771164000), ((5, 4), [("2026-02-15T12:00:00Z", 3, 2), ("2026-02-15T13:00:00Z", 2, 2)])),
    ((T0, 1771164000, "web"), ((3, 2), [("2026-02-15T12:00:00Z", 2, 1), ("2026-02-15T13:00:00Z", 1, 1)])),
    ((T0, 1771164000, " "), ((5, 4), [("2026-02-15T12:00:00Z", 3, 2), ("2026-02-15T13:00:00Z", 2, 2)])),
    ((1771158600, 1771162200), ((2, 2), [("2026-02-15T13:00:00Z", 2, 2)])),
    ((T0, 1771203600, None, "daily"),
     ((7, 6), [("2026-02-15T00:00:00Z", 6, 5), ("2026-02-16T00:00:00Z", 1, 1)])),
    ((T0, 1771203600, None, "DAILY"),
     ((7, 6), [("2026-02-15T00:00:00Z", 6, 5), ("2026-02-16T00:00:00Z", 1, 1)])),
    ((T0, 1771164000, None, "WEEKLY"),
     ((5, 4), [("2026-02-15T12:00:00Z", 3, 2), ("2026-02-15T13:00:00Z", 2, 2)])),
    ((1771164000, T0), ((0, 0), [])),
    ((T0, 1771164000, None, "hourly", "nope"), ((0, 0), [])),
    ((T0, 1771164000, None, "hourly", "Click"), ((0, 0), [])),
    ((-(2**62), 2**62, "mobile"), ((1, 1), [("2026-02-15T12:00:00Z", 1, 1)])),
])
def test_queries(clicks, args, expected):
    assert ask(clicks[0], *args) == expected


def test_document_omits_absent_channel(clicks):
    def text(*args):
        return metrics.metrics_document(clicks[0], *args).first()["document"]

    assert text("click", T0, 1771164000) == (
        '{"event_name":"click","total_count":5,"unique_user_count":4,'
        f'"time_range":{{"from":{T0},"to":1771164000}},"breakdowns":['
        '{"bucket":"2026-02-15T12:00:00Z","total_count":3,"unique_user_count":2},'
        '{"bucket":"2026-02-15T13:00:00Z","total_count":2,"unique_user_count":2}]}'
    )
    assert json.loads(text("click", T0, 1771164000, "web"))["channel"] == "web"
    assert json.loads(text("nope", T0, T0))["breakdowns"] == []


@pytest.mark.parametrize("args", [(None, 1, 2), (" ", 1, 2), ("x", None, 2), ("x", 1, None)])
def test_document_needs_its_parameters(clicks, args):
    with pytest.raises(ValueError):
        metrics.metrics_document(clicks[0], *args)


def test_a_table_of_requests_equals_single_requests(spark):
    rng = random.Random(7)
    events = [
        (rng.choice("ab"), f"u{rng.randrange(9)}", T0 + rng.randrange(5 * 86400), None,
         rng.choice(["web", "mobile", None]))
        for _ in range(400)
    ]
    dated = events_frame(spark, events).withColumn("event_date", clock.epoch_date(F.col("event_timestamp")))
    table = rollup.hourly_rollup(dated).cache()
    asked = []
    for i in range(14):
        start = T0 + rng.randrange(-2 * 86400, 5 * 86400)
        asked.append((f"r{i}", rng.choice("abc"), start, start + rng.randrange(-3600, 4 * 86400),
                      rng.choice([None, "", "web", "mobile", "tv"]), rng.choice(["daily", "x", None])))
    asked += [("wide", "a", -(2**63), 2**63 - 1, None, "Daily"), ("blank", " ", 1, 2, None, None),
              ("open", "a", None, 2, None, None)]
    schema = "request_id STRING, event_name STRING, from BIGINT, to BIGINT, channel STRING, group_by STRING"
    requests = spark.createDataFrame(asked, schema)
    answers = metrics.answer_requests(table, requests)
    got = {
        r["request_id"]: ((r["total_count"], r["unique_user_count"]), [tuple(b) for b in r["breakdowns"]])
        for r in answers.collect()
    }
    assert set(got) == {r[0] for r in asked} - {"blank", "open"}
    hours = [r.asDict() for r in table.collect()]
    for rid, name, start, end, channel, group_by in asked:
        if rid not in got:
            continue
        want: dict[str, list[int]] = {}
        for h in hours:
            if h["event_name"] == name and start <= h["date_hour"] < end and (
                not (channel or "").strip() or h["channel"] == channel
            ):
                at = h["date_hour"] // 86400 * 86400 if (group_by or "").lower() == "daily" else h["date_hour"]
                label = dt.datetime.fromtimestamp(at, dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
                sums = want.setdefault(label, [0, 0])
                sums[0] += h["total_count"]
                sums[1] += h["unique_user_count"]
        buckets = [(label, *sums) for label, sums in sorted(want.items())]
        total = (sum(b[1] for b in buckets), sum(b[2] for b in buckets))
        assert got[rid] == (total, buckets), rid
    checks = {r["request_id"]: [v["message"] for v in r["violations"]]
              for r in metrics.check_requests(requests).collect()}
    assert checks["blank"] == ["event_name is required for metrics queries"]
    assert checks["open"] == ["from timestamp is required"]
    assert checks["r0"] == []


def test_true_distinct_users(clicks):
    _, dated = clicks
    assert uniques.exact_users(dated, T0, 1771164000).first()[0] == 2
    sketches = uniques.hourly_sketches(dated)
    assert uniques.sketched_users(sketches, T0, 1771164000).first()[0] == 2


def test_rollup_sums_to_the_ledger(clicks):
    table, dated = clicks
    assert table.agg(F.sum("total_count")).first()[0] == dated.count()
    keys = table.select("event_name", "channel", "date_hour", "event_date")
    assert keys.distinct().count() == keys.count()


def fill(stores, spark, days, bid):
    values = [event_json(ts=T0 + 86400 * d, user=f"{bid}{d}") for d in days]
    ingest_batch(stores, records_frame(spark, values), bid)


def rolled(stores):
    rows = stores.rollup.read().groupBy("event_date").agg(F.sum("total_count")).collect()
    return {r[0].isoformat(): r[1] for r in rows}


def test_window_moves_and_late_events_count_inside_it(spark, stores):
    fill(stores, spark, range(0, 12), "a")  # 2026-02-15 … 26
    as_of = dt.date(2026, 2, 24)
    refresh(stores, as_of)
    assert rolled(stores) == {f"2026-02-{d}": 1 for d in range(17, 27)}  # no upper bound
    fill(stores, spark, [0, 4], "b")  # late: one before the window, one inside
    refresh(stores, as_of)
    assert rolled(stores) == {f"2026-02-{d}": 1 + (d == 19) for d in range(17, 27)}
    refresh(stores, dt.date(2026, 2, 27))
    assert rolled(stores) == {f"2026-02-{d}": 1 for d in range(20, 27)}
    stores.config.initialize()
    stores.config.set({"mv_retention_days": "10"})
    stores.config.initialize()
    version = refresh(stores, dt.date(2026, 2, 27))
    assert rolled(stores) == {f"2026-02-{d}": 1 + (d == 19) for d in range(17, 27)}
    assert refresh(stores, dt.date(2026, 2, 27)) == version  # nothing to do
    expire_days(stores, dt.date(2026, 2, 20))
    refresh(stores, dt.date(2026, 2, 27))
    assert rolled(stores) == {f"2026-02-{d}": 1 for d in range(20, 27)}
    refresh(stores, full_history=True, anew=True)
    assert rolled(stores) == {f"2026-02-{d}": 1 for d in range(20, 27)}


def test_readers_keep_their_version(spark, stores):
    fill(stores, spark, [0], "a")
    refresh(stores, dt.date(2026, 2, 15))
    planned = stores.rollup.read()
    fill(stores, spark, [0], "b")
    for _ in range(10):
        refresh(stores, dt.date(2026, 2, 15), anew=True)
    assert planned.agg(F.sum("total_count")).first()[0] == 1
    assert rolled(stores) == {"2026-02-15": 2}
    stores.rollup.replace(stores.rollup.read(), ["event_date"], keep_hours=0)
    stores.rollup.replace(stores.rollup.read(), ["event_date"], keep_hours=0)
    assert len(folders.child_folders(spark, stores.rollup.root, "v=")) == 1


def test_failed_refresh_leaves_the_old_version(spark, stores):
    fill(stores, spark, [0], "a")
    refresh(stores, dt.date(2026, 2, 15))
    broken = stores.rollup.read().withColumn("total_count", F.raise_error(F.lit("no")).cast("bigint"))
    with pytest.raises(Exception, match="no"):
        stores.rollup.replace(broken, ["event_date"])
    assert rolled(stores) == {"2026-02-15": 1}
    # The batches of a refresh that failed are still open to the next one.
    fill(stores, spark, [0], "b")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(stores.rollup.__class__, "replace", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            refresh(stores, dt.date(2026, 2, 15))
    assert rolled(stores) == {"2026-02-15": 1}
    assert refresh(stores, dt.date(2026, 2, 15)) == 3 and rolled(stores) == {"2026-02-15": 2}
    assert folders.child_folders(spark, stores.rollup.root, "v=") == ["v=000000001", "v=000000003"]


def test_metrics_scan_is_pruned_and_pushed_down(spark, stores):
    fill(stores, spark, range(3), "a")
    refresh(stores, dt.date(2026, 2, 17))
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    df = metrics.totals(stores.rollup.read(), "product_view", T0, T0 + H, "web")
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    partition = scan[scan.index("PartitionFilters"):scan.index("PushedFilters")]
    assert "event_date" in partition and ">=" in partition and "<=" in partition
    pushed = scan[scan.index("PushedFilters"):]
    for text in ("EqualTo(event_name,product_view)", "EqualTo(channel,web)", "GreaterThanOrEqual(date_hour",
                 "LessThan(date_hour"):
        assert text in pushed


def test_distinct_count_spreads_a_hot_group(spark):
    rows = events_frame(spark, [("a", "u", T0, None, None)]).withColumn(
        "event_date", clock.epoch_date(F.col("event_timestamp")))
    plan = rollup.hourly_rollup(rows)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 2 and "user_id" in exchanges[1] and "user_id" not in exchanges[0]


@pytest.mark.parametrize("channel, filters", [
    (None, False), ("", False), (" \t", False), ("\u2003", False), ("\u3000\x1f", False), ("\x01", True), ("\u00a0", True), (" web", True),
])
def test_a_channel_of_white_space_is_no_filter(spark, clicks, channel, filters):
    table, _ = clicks
    asked = spark.createDataFrame([("r", "click", T0, T0 + 10 * 86400, channel, None)], "request_id STRING, event_name STRING, from BIGINT, to BIGINT, channel STRING, group_by STRING")
    answer = metrics.answer_requests(table, asked).first()["total_count"]
    assert metrics.totals(table, "click", T0, T0 + 10 * 86400, channel).first()["total_count"] == answer == (0 if filters else 7)


@pytest.mark.parametrize("name, start, end", [(" ", 1, 2), (None, 1, 2), ("click", None, 2), ("click", 1, None)])
def test_totals_and_breakdowns_check_their_request(clicks, name, start, end):
    for ask in (metrics.totals, metrics.breakdown, metrics.metrics_document):
        with pytest.raises(ValueError, match="required"):
            ask(clicks[0], name, start, end)


def test_requests_find_first_and_last_day_together(spark, clicks):
    table, _ = clicks
    asked = spark.createDataFrame([("r", "click", T0, T0 + 86400, None, None)], "request_id STRING, event_name STRING, from BIGINT, to BIGINT, channel STRING, group_by STRING")
    plan = metrics.answer_requests(table, asked)._jdf.queryExecution().optimizedPlan().toString()
    days = [line for line in plan.splitlines() if "min(" in line or "max(" in line]
    assert days and all("min(" in line and "max(" in line for line in days)


def test_totals_by_running_sums_equal_whole_answers(spark):
    rng = random.Random(4)
    days = [0, 1, 2, 5, 6, 9]
    rows = [
        (name, channel, T0 + 86400 * d + 3600 * h - 43200, rng.randint(1, 9), rng.randint(1, 4), dt.date(2026, 2, 15) + dt.timedelta(d))
        for name in ("a", "b") for channel in ("web", None, "app") for d in days for h in range(24)
        if rng.random() < (0.3 if name == "a" else 0.02)
    ]
    rollup = spark.createDataFrame(rows, ROLLUP)
    asked = []
    for i in range(400):
        low = T0 - 2 * 86400 + rng.randint(0, 13 * 86400)
        high = low + rng.choice([-5, 0, 1, 1800, 3600, 7200, 86400, 200_000, 10**6])
        if i % 3 == 0:
            low, high = low - low % 3600, high - high % 3600
        asked.append((i, rng.choice(["a", "b", "c"]), low, high, rng.choice([None, " ", "web", "app", "x"]), rng.choice(["daily", "hourly", None, "DAILY"])))
    asked += [(900, None, 1, 2, None, None), (901, "a", None, 2, None, None), (902, "a", -(10**14), 10**14, None, "daily"), (903, "a", T0, 10**14, None, "x")]
    requests = spark.createDataFrame(asked, "request_id INT, event_name STRING, `from` BIGINT, `to` BIGINT, channel STRING, group_by STRING")
    columns = ("request_id", "total_count", "unique_user_count")
    whole = metrics.answer_requests(rollup, requests).select(*columns, F.size("breakdowns").cast("bigint").alias("buckets"))
    running = metrics.total_requests(rollup, requests).select(*columns, "buckets")
    assert sorted(running.collect()) == sorted(whole.collect())
    assert metrics.total_requests(rollup.limit(0), requests).agg(F.sum("total_count")).first()[0] == 0
    # Two equality joins, nothing laid out over days on the requests' side.
    plan = running._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2 and "explode_outer" not in plan


def test_refresh_reads_what_is_new(spark, stores, monkeypatch):
    as_of = dt.date(2026, 2, 16)
    day = [event_json(user=f"u{i % 40}", ts=T0 - 40_000 + 300 * i, channel=[None, "web"][i % 2]) for i in range(250)]
    ingest_batch(stores, records_frame(spark, day), "b-0")
    refresh(stores, as_of)
    opened = []
    real = CommitTable.load

    def load(self, parts):
        parts = list(parts)
        opened.append((self.root.rsplit("/", 1)[1], sorted(p.rows for p in parts), [p.by for p in parts]))
        return real(self, parts)

    monkeypatch.setattr(refresh_job, "MERGE_PARTS", 4)
    for n in range(1, 7):
        # A user known in the hour, one new in it, one in a new hour.
        batch = [event_json(user="u0", ts=T0 - 40_000 + n), event_json(user=f"new{n}", ts=T0 - 40_000 + n), event_json(user="u1", ts=T0 + 43_000 + n)]
        ingest_batch(stores, records_frame(spark, batch), f"b-{n}")
        if n == 3:
            stores.ledger.merge_day(dt.date(2026, 2, 15), "m")
        with monkeypatch.context() as patch:
            patch.setattr(CommitTable, "load", load)
            opened.clear()
            refresh(stores, as_of, broadcast_users=[0, 1000][n % 2])
        from_ledger = [rows for table, rows, _ in opened if table == "ledger" and rows]
        # Once the batch's three rows; when they were merged with the day's, the day.
        assert from_ledger == ([[253 + 3 * 2]] if n == 3 else [[3]]), (n, opened)
        want = sorted(map(tuple, rollup.hourly_rollup(stores.ledger.read()).select(*ROLLUP_COLUMNS).collect()), key=str)
        assert sorted(map(tuple, stores.rollup.read().select(*ROLLUP_COLUMNS).collect()), key=str) == want
        exact = {(r[0], r[1]): r[2] for r in stores.ledger.read().groupBy("event_name", "channel").agg(F.count_distinct("user_id")).collect()}
        sketched = {(r[0], r[1]): r[2] for r in uniques.sketched_users(stores.sketches.read(), 0, 2**33, "event_name", "channel").collect()}
        assert sketched == exact  # so few that sketches are exact
    assert len(stores.rollup_users.snapshot().parts) < 8 and len(stores.sketches.snapshot().parts) < 8
    before = stores.rollup.current_version()
    assert refresh(stores, as_of) == before


def test_failed_refresh_leaves_nothing_counted_twice(spark, stores, monkeypatch):
    as_of = dt.date(2026, 2, 16)
    ingest_batch(stores, records_frame(spark, [event_json(user="a"), event_json(user="b", ts=T0 + 86400)]), "b-1")
    refresh(stores, as_of)
    ingest_batch(stores, records_frame(spark, [event_json(user="c"), event_json(user="a", ts=T0 + 1)]), "b-2")
    with monkeypatch.context() as patch:
        patch.setattr(VersionedTable, "replace", lambda *_, **__: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            refresh(stores, as_of)
    refresh(stores, as_of)
    assert sorted((r["date_hour"], r["total_count"], r["unique_user_count"]) for r in stores.rollup.read().collect()) == [(T0, 3, 2), (T0 + 86400, 1, 1)]
    # The window moves on: its days' users go too, and come back when it moves back.
    refresh(stores, dt.date(2026, 2, 23))
    assert [p.day.day for p in stores.rollup_users.snapshot().parts.values()] == [16]
    refresh(stores, as_of)
    assert stores.rollup.read().agg(F.sum("total_count")).first()[0] == 4
    assert not folders.exists(spark, f"{stores.root}/rollup-covered")
