"""Variants that keep their state in the stream instead of in the ledger."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues

from eventtally.functions import clock
from eventtally.operators import dedup
from eventtally.schema import INBOX_RETENTION_DAYS
from eventtally.session import settings


def hourly_counts(events: DataFrame) -> DataFrame:
    """Tumbling one-hour counts straight from a stream of events.  Distinct
    users are approximate here, since a stream keeps no exact distinct state;
    the rollup of the ledger is the exact form.  Without a watermark late
    events always count: use update or complete output."""
    at = clock.hour_as_timestamp(F.col("event_timestamp"))
    return (
        events.withColumn("at", at)
        .groupBy("event_name", "channel", F.window("at", "1 hour"))
        .agg(
            F.count("*").alias("total_count"),
            F.approx_count_distinct("user_id").alias("approx_user_count"),
        )
        .select(
            "event_name", "channel",
            F.unix_seconds("window.start").alias("date_hour"),
            "total_count", "approx_user_count",
        )
    )


def first_arrivals(events: DataFrame, received_at: str, days: int = INBOX_RETENTION_DAYS) -> DataFrame:
    """Keyed state that forgets a key `days` after its receive time.  A key's
    first arrival wins here, also inside a micro-batch.  The state has keys as bytes."""
    return dedup.unpacked(dedup.packed(events).withWatermark(received_at, f"{days} days").dropDuplicatesWithinWatermark(
        ["idempotency_key"]
    ))


def exact_users(events: DataFrame, late_by: str) -> DataFrame:
    """Exact distinct users by hour, event name and channel (event_name, channel, date_hour, unique_user_count).

    Two stateful operators: the first lets a user pass once an hour and group, the second counts
    who passes.  An hour is given out once no event of it may come any more, `late_by` after its last
    one; the state of both is dropped then.  Needs append output.
    """
    once = _in_hours(events.filter("user_id IS NOT NULL"), late_by).dropDuplicates(["event_name", "channel", "window", "user_id"])
    return once.groupBy("event_name", "channel", "window").agg(F.count("*").alias("unique_user_count")).select(*_hour(), "unique_user_count")


def exact_totals(events: DataFrame, late_by: str) -> DataFrame:
    """The same for events, each key counting once (event_name, channel, date_hour, total_count).

    The state has keys as bytes."""
    once = _in_hours(dedup.packed(events), late_by).dropDuplicates(["idempotency_key", "window"])
    return once.groupBy("event_name", "channel", "window").agg(F.count("*").alias("total_count")).select(*_hour(), "total_count")


def _hour() -> tuple:
    return "event_name", "channel", F.unix_seconds("window.start").alias("date_hour")


def _in_hours(events: DataFrame, late_by: str) -> DataFrame:
    timed = events.withColumn("at", clock.hour_as_timestamp(F.col("event_timestamp"))).withWatermark("at", late_by)
    return timed.withColumn("window", F.window("at", "1 hour"))


#: Groups that the state's keys are dealt to by their hash.  Python is entered once a group and micro-batch, not once a key.
KEY_GROUPS = 4096


class _Remembered(StatefulProcessor):
    """Lets a key's last row of a micro-batch pass, unless the key passed less than `seconds` ago; for all keys of a group."""

    def __init__(self, key: str, received: str, order: list[str], seconds: int, columns: list[str]):
        self.key, self.received, self.order, self.seconds, self.columns = key, received, order, seconds, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        # The state cleans itself up by processing time; twice the span, so that a stream that falls
        # behind the clock of its records forgets none too early.
        self.passed = handle.getMapState("passed", "key STRING", "at BIGINT", ttlDurationMs=2000 * self.seconds)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last = _last_rows(pd.concat([_last_rows(some, self.order, self.key) for some in rows]), self.order, self.key)
        times = [int(at) for at in last[self.received]]
        # Only the keys of the micro-batch are looked up, however many the group has.
        known = self.passed.exists()
        passes = []
        for name, at in zip(last[self.key], times, strict=True):
            before = self.passed.getValue((name,)) if known else None
            passes.append(before is None or at - before[0] > self.seconds)
            if passes[-1]:
                self.passed.updateValue((name,), (at,))
        if any(passes):
            yield last.loc[passes, self.columns]

    def close(self) -> None:
        pass


_GROUP = "_group"


def _last_rows(rows: pd.DataFrame, order: list[str], by: str) -> pd.DataFrame:
    return rows.sort_values(order, kind="stable").drop_duplicates(by, keep="last")


def remembered(
    events: DataFrame, received: str, days: float = INBOX_RETENTION_DAYS, key: str = "idempotency_key",
    order: Sequence[str] = ("offset",), groups: int = KEY_GROUPS,
) -> DataFrame:
    """Keyed state in place of the ledger lookup: of a key the last arrival of a micro-batch passes, and then
    none for `days`.

    The clock is the column `received`, epoch seconds, so a replayed stream decides as the first one did.  A key
    passes again if it comes more than `days` after it passed last; arrivals in between do not
    prolong that.  Tasks send one row a key and Arrow batch to the state, so a hot key costs little.  The state is
    a map from key to time, dealt to `groups` by the key's hash; a checkpoint is bound to their number.
    Start it within `keyed_state`.
    """
    columns, sort = events.schema, list(order)

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield _last_rows(rows, sort, key)

    state = _Remembered(key, received, sort, int(days * clock.DAY), columns.names)
    dealt = events.mapInPandas(reduced, columns).withColumn(_GROUP, F.pmod(F.xxhash64(key), F.lit(groups)).cast("int"))
    return dealt.groupBy(_GROUP).transformWithStateInPandas(
        state, columns, outputMode="Append", timeMode="ProcessingTime"
    )


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The settings a stream with such state is started with: a store with expiry, on disk rather than in memory, and
    no micro-batches without data, of which state that expires by itself would ask for ever more."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    with settings(spark, wanted):
        yield
