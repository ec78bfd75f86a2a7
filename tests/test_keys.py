import hashlib

import pytest
from rows import T0, events_frame

from eventtally.functions import clock, keys, text
from eventtally.operators.project import to_message, with_key
from pyspark.sql import functions as F

BASE = ("product_view", "user_123", T0, "cmp_987", "web")


def key_of(spark, *rows):
    return [r["idempotency_key"] for r in with_key(events_frame(spark, list(rows))).collect()]


def test_golden_keys(spark):
    with_campaign, without = key_of(spark, BASE, BASE[:3] + (None, "web"))
    assert with_campaign == "b1a84c038bc6a3cf10d06e74d0ff2466c18b98fa34938b1c5cf3b9a5dfbf90de"
    assert without == "65aea38a65d924901a75dfbb644f08b85fca27425429cd13daa9f855bfbc24db"
    assert len(without) == 64


def test_same_fields_same_key(spark):
    assert len(set(key_of(spark, BASE, BASE, BASE))) == 1


@pytest.mark.parametrize("position, value", [
    (0, "add_to_cart"), (1, "user_456"), (2, T0 + 1), (3, "cmp_000"),
])
def test_each_field_changes_the_key(spark, position, value):
    other = list(BASE)
    other[position] = value
    assert len(set(key_of(spark, BASE, tuple(other)))) == 2


def test_channel_is_not_part_of_the_key(spark):
    assert len(set(key_of(spark, BASE, BASE[:4] + ("mobile",)))) == 1


def test_empty_and_missing_campaign_collide(spark):
    assert len(set(key_of(spark, BASE[:3] + ("", "web"), BASE[:3] + (None, "web")))) == 1


def test_separator_collides_and_is_flagged(spark):
    rows = [("a|b", "c", T0, None, None), ("a", "b|c", T0, None, None), BASE]
    got = with_key(events_frame(spark, rows)).collect()
    assert got[0]["idempotency_key"] == got[1]["idempotency_key"]
    assert [r["key_has_separator"] for r in got] == [True, True, False]


def test_utf8(spark):
    (key,) = key_of(spark, ("görüntüleme", "kullanıcı", 5, "ş", None))
    assert key == hashlib.sha256("görüntüleme|kullanıcı|5|ş".encode()).hexdigest()


def test_clock_at_the_edges(spark):
    seconds = [0, 1, 86399, 86400, T0 + 59 * 60 + 59, -1, clock.LAST_SECOND, clock.LAST_SECOND + 1,
               clock.FIRST_SECOND, clock.FIRST_SECOND - 1, 1771156800000, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(s,) for s in seconds], "s BIGINT")
    got = df.select(
        clock.epoch_date(F.col("s")).cast("string").alias("d"), clock.epoch_day(F.col("s")).alias("n")
    ).collect()
    assert [r["d"] for r in got] == [
        "1970-01-01", "1970-01-01", "1970-01-01", "1970-01-02", "2026-02-15", "1969-12-31",
        "9999-12-31", None, "0001-01-01", None, None, None, None,
    ]
    assert got[-1]["n"] == clock.FIRST_DAY and got[-2]["n"] == clock.LAST_DAY


def test_summer_time_does_not_shift_hours(spark):
    # 2024-03-10 07:30 UTC is inside New York's gap day.
    at = 1710055800
    row = spark.createDataFrame([(at,)], "s BIGINT").select(
        clock.iso_label(clock.epoch_hour(F.col("s"))).alias("h"),
        clock.iso_label(clock.epoch_midnight(F.col("s"))).alias("d"),
    ).first()
    assert (row["h"], row["d"]) == ("2024-03-10T07:00:00Z", "2024-03-10T00:00:00Z")


@pytest.mark.parametrize("value, days", [("14", 14), (" 3 ", 3), ("", 7), ("  ", 7), (None, 7)])
def test_retention_days(spark, value, days):
    df = spark.createDataFrame([(value,)], "v STRING")
    assert df.select(text.retention_days(F.col("v"))).first()[0] == days


def test_retention_days_refuses_words(spark):
    df = spark.createDataFrame([("abc",)], "v STRING")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(text.retention_days(F.col("v"))).collect()


def test_json_text_of_null_is_null(spark):
    df = spark.createDataFrame([(["a", None],), (None,)], "t ARRAY<STRING>")
    assert [r[0] for r in df.select(text.json_text(F.col("t"))).collect()] == ['["a",null]', None]


def test_message_omits_absent_members_and_splices_metadata(spark):
    df = spark.createDataFrame(
        [("a", None, None, "u", 5, None, '{"p":1}'), ("a", "w", "c", 'q"', 5, ["x"], None)],
        "event_name STRING, channel STRING, campaign_id STRING, user_id STRING, event_timestamp BIGINT, "
        "tags ARRAY<STRING>, metadata STRING",
    )
    assert [r["value"] for r in to_message(df).collect()] == [
        '{"event_name":"a","user_id":"u","timestamp":5,"metadata":{"p":1}}',
        '{"event_name":"a","channel":"w","campaign_id":"c","user_id":"q\\"","timestamp":5,"tags":["x"]}',
    ]


def test_key_text_is_plain(spark):
    df = events_frame(spark, [BASE])
    got = df.select(keys.key_text(*[F.col(c) for c in ("event_name", "user_id", "event_timestamp", "campaign_id")]))
    assert got.first()[0] == f"product_view|user_123|{T0}|cmp_987"
