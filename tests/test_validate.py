import json

import pytest
from rows import T0, event_json, records_frame

from eventtally.operators import bulk, validate
from eventtally.plans.ingest import classify, dead_letters
from eventtally.plans import admission
from eventtally.sources import payloads
from pyspark.sql import functions as F

FULL = dict(
    event_name="product_view", user_id="user_123", timestamp=T0, channel="web", campaign_id="cmp_987",
    tags=["spring", "banner", "b"], metadata={"shelf": 12, "seen_before": False},
)


def single(spark, payload):
    parsed = payloads.parse_events(spark.createDataFrame([(payload,)], "value STRING"))
    row = bulk.single_responses(
        validate.with_violations(parsed, "timestamp"), "timestamp"
    ).first()
    return row["status"], row["accepted_count"], [(v["field"], v["message"]) for v in row["violations"]]


def without(name):
    return json.dumps({k: v for k, v in FULL.items() if k != name})


def test_full_event_is_accepted(spark):
    assert single(spark, json.dumps(FULL)) == ("accepted", 1, [])


@pytest.mark.parametrize("payload, faults", [
    (without("event_name"), [("event_name", "event_name is required")]),
    (without("user_id"), [("user_id", "user_id is required")]),
    (without("timestamp"), [("timestamp", "timestamp is required")]),
    (json.dumps(FULL | {"timestamp": -1}),
     [("timestamp", "timestamp must be a positive Unix epoch value")]),
    (json.dumps(FULL | {"timestamp": 0}),
     [("timestamp", "timestamp must be a positive Unix epoch value")]),
    (json.dumps(FULL | {"event_name": " \t"}), [("event_name", "event_name is required")]),
    ("{}", [("event_name", "event_name is required"), ("timestamp", "timestamp is required"),
            ("user_id", "user_id is required")]),
])
def test_rejected_events(spark, payload, faults):
    assert single(spark, payload) == ("rejected", 0, faults)


def bulk_verdict(spark, payload):
    judged = bulk.judge_payloads(payloads.parse_bulk(spark.createDataFrame([(payload,)], "value STRING")))
    row = bulk.responses(judged.withColumn("event_count", F.size("events"))).first()
    events = bulk.explode_accepted(judged).count()
    return row["status"], row["accepted_count"], events, [v["field"] for v in row["violations"]]


def bulk_of(*events):
    return json.dumps({"events": list(events)})


def test_bulk_of_two(spark):
    second = dict(event_name="add_to_cart", user_id="user_456", timestamp=T0 + 10, channel="mobile")
    assert bulk_verdict(spark, bulk_of(FULL, second)) == ("accepted", 2, 2, [])


@pytest.mark.parametrize("payload", ['{"events":[]}', '{"events":null}', "{}"])
def test_empty_bulk(spark, payload):
    assert bulk_verdict(spark, payload) == ("rejected", 0, 0, ["events"])


def test_one_bad_event_rejects_the_bulk(spark):
    bad = {k: v for k, v in FULL.items() if k != "event_name"}
    assert bulk_verdict(spark, bulk_of(FULL, bad)) == ("rejected", 0, 0, ["events[1].event_name"])


def test_bulk_with_null_or_mistyped_element(spark):
    assert bulk_verdict(spark, bulk_of(FULL, None))[:3] == ("rejected", 0, 0)
    assert bulk_verdict(spark, bulk_of(FULL, FULL | {"timestamp": "x"}))[:3] == ("rejected", 0, 0)
    assert bulk_verdict(spark, "not json")[:3] == ("rejected", 0, 0)


def test_bulk_limit(spark):
    assert bulk_verdict(spark, bulk_of(*[FULL] * 1000))[:3] == ("accepted", 1000, 1000)
    assert bulk_verdict(spark, bulk_of(*[FULL] * 1001)) == ("rejected", 0, 0, ["events"])


def test_row_form_applies_the_limit(spark):
    rows = spark.range(1501).select(
        F.when(F.col("id") < 500, "small").otherwise("big").alias("request_id"),
        F.lit("n").alias("event_name"), F.lit("u").alias("user_id"), F.lit(5).cast("bigint").alias("event_timestamp"),
    )
    got = {r["request_id"]: r["accepted"] for r in bulk.judge_rows(rows, "request_id").collect()}
    assert got == {"small": True, "big": False}
    assert bulk.admit_rows(rows, "request_id").count() == 500


def fate(spark, value, **options):
    return classify(records_frame(spark, [value]), **options).select("status", "reason").first()


FATES = [
    (event_json(), "ok", None),
    (event_json(extra=1), "ok", None),
    (event_json(name=12), "ok", None),
    (event_json(name="[x]", user="{y"), "ok", None),
    (event_json(metadata={"metadata": "x", "channel": {}}), "ok", None),
    (event_json(name=""), "ok", None),  # the stream does not repeat the request rules
    ("not json", "dead", "malformed JSON"),
    ("", "dead", "malformed JSON"),
    ("[]", "dead", "malformed JSON"),
    (event_json(ts="1771156800"), "dead", "malformed JSON"),
    (event_json(ts=1.5), "dead", "malformed JSON"),
    (event_json(user={"a": 1}), "dead", "malformed JSON"),
    (event_json(channel=["a"]), "dead", "malformed JSON"),
    (event_json(metadata="text"), "dead", "malformed JSON"),
    (event_json(metadata='{"a":1}'), "dead", "malformed JSON"),
    (event_json(tags="x"), "dead", "malformed JSON"),
    ("{}", "dead", "event_name is null"),
    (event_json(user=None), "dead", "user_id is null"),
    (event_json(ts=None), "dead", "timestamp is null"),
    (event_json(name="é" * 255), "ok", None),
    (event_json(name="é" * 256), "dead", "event_name exceeds 255 characters"),
    (event_json(channel="c" * 101), "dead", "channel exceeds 100 characters"),
    (event_json(ts=10**18), "dead", "event_date has no partition"),
    (None, "skipped", None),
    (" null ", "skipped", None),
]


def test_fate_of_each_record(spark):
    told = classify(records_frame(spark, [value for value, _, _ in FATES]))
    got = {r["offset"]: (r["status"], r["reason"]) for r in told.collect()}
    for i, (value, status, reason) in enumerate(FATES):
        assert got[i] == (status, reason), value


def test_coerced_timestamps(spark):
    given = {"17": 17, " 18 ": 18, 1.9: 1, 1e3: 1000}
    records = records_frame(spark, [event_json(ts=text) for text in given])
    got = classify(records, coerce=True).orderBy("offset").collect()
    assert [(r["status"], r["event_timestamp"]) for r in got] == [("ok", s) for s in given.values()]


def test_timestamps_beyond_coercion(spark):
    records = records_frame(spark, [event_json(ts=given) for given in ("x", True, [1], 10**19)])
    assert {r["status"] for r in classify(records, coerce=True).collect()} == {"dead"}


def test_partition_range(spark):
    options = dict(first_date="2026-02-01", last_date="2026-02-15")
    assert fate(spark, event_json(ts=T0), **options)["status"] == "ok"
    assert fate(spark, event_json(ts=T0 + 86400), **options)["reason"] == "event_date has no partition"
    assert fate(spark, event_json(ts=1), **options)["reason"] == "event_date has no partition"


def test_dead_letter_keeps_raw_text(spark):
    row = dead_letters(classify(records_frame(spark, ["not json"]))).first()
    assert (row["key"], row["value"], row["offset"]) == ("", "not json", 0)


def test_text_is_parsed_once(spark):
    df = dead_letters(classify(records_frame(spark, ["x"])))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 1


@pytest.mark.parametrize("member", [
    '"event_name":{"a":1}', '"user_id":["u"]', '"channel":{"c":1}', '"campaign_id":[1]', '"metadata":"txt"', '"metadata":[1]',
])
def test_mistyped_member_is_refused_alone_and_in_a_list(spark, member):
    good = json.dumps(FULL)
    bad = good[:-1] + "," + member + "}"
    bad = json.dumps({k: v for k, v in FULL.items() if f'"{k}"' not in member})[:-1] + "," + member + "}"
    rows = spark.createDataFrame([(1, bad, '{"events":[%s,%s]}' % (good, bad)), (2, good, '{"events":[%s,%s]}' % (good, good))], "id int, one STRING, many STRING")
    one = payloads.parse_events(rows, "one").select("id", "_corrupt").collect()
    many = payloads.parse_bulk(rows, "many").select("id", "_corrupt").collect()
    for found in (one, many):
        assert {r["id"]: r["_corrupt"] is None for r in found} == {1: False, 2: True}


def test_storage_admission_of_all_lengths(spark):
    limits = {"event_name": 255, "channel": 100, "campaign_id": 100, "user_id": 255}
    rows = []
    for name, limit in limits.items():
        for extra in (0, 1):
            row = {"event_name": "e", "channel": "c", "campaign_id": "p", "user_id": "u", name: "x" * (limit + extra)}
            rows.append((f"{name}{extra}", *row.values(), T0))
    df = spark.createDataFrame(rows, "id STRING, event_name STRING, channel STRING, campaign_id STRING, user_id STRING, event_timestamp BIGINT")
    found = {r["id"]: r["fault"] for r in df.select("id", validate.storage_fault().alias("fault")).collect()}
    assert found == {f"{n}{e}": f"{n} exceeds {m} characters" if e else None for n, m in limits.items() for e in (0, 1)}


def test_admitted_requests_are_answered_and_ingested(spark, stores):
    def event(**changes):
        return {k: v for k, v in {**FULL, **changes}.items() if v is not None}

    def listed(*events):
        return json.dumps({"events": list(events)})

    bodies = [
        ("single", json.dumps(event()), 1), ("single", json.dumps(event(event_name=" ")), 0), ("single", json.dumps(event(user_id=None)), 0),
        ("single", json.dumps(event(timestamp=None)), 0), ("single", json.dumps(event(timestamp=0)), 0), ("single", "no JSON", 0),
        ("single", None, 0), ("single", "null", 0), ("bulk", listed(), 0), ("bulk", '{"events":null}', 0), ("bulk", None, 0),
        ("bulk", listed(*[event(timestamp=T0 + i) for i in range(1000)]), 1000), ("bulk", listed(*[event(timestamp=T0 + i) for i in range(1001)]), 0),
        ("bulk", listed(event(user_id="new"), event(event_name={"a": 1})), 0), ("bulk", listed(event(user_id="new"), event(timestamp=-5)), 0),
        ("bulk", listed(event(user_id="other"), event(user_id="other", channel="last")), 2), ("bulk", '{"events":[null]}', 0),
    ]
    requests = spark.createDataFrame([(str(i), kind, body, i) for i, (kind, body, _) in enumerate(bodies)], "request_id STRING, kind STRING, value STRING, offset BIGINT")
    counted = admission.admit_batch(stores, requests, "r-1")
    got = {int(r["request_id"]): r["accepted_count"] for r in stores.answers.read().collect()}
    assert got == {i: n for i, (_, _, n) in enumerate(bodies)}
    assert (counted["received"], counted["inserted"], counted["dead"]) == (1003, 1001, 0)
    assert [r["channel"] for r in stores.ledger.read().filter("user_id = 'other'").collect()] == ["last"]
    empty = admission.admit_batch(stores, requests.limit(0), "r-2")
    assert empty["received"] == empty["inserted"] == 0
