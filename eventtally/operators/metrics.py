"""Metrics over the rollup: totals, breakdowns and whole documents.

Unique users are sums of the hourly per-channel distinct counts, as the
reference defines them; `uniques` has the true distinct counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventtally.functions import clock, text
from eventtally.operators import validate


def is_daily(group_by: str | None) -> bool:
    """Only `daily`, in any case, means days; everything else means hours."""
    return group_by is not None and group_by.lower() == "daily"


def _check(event_name: str | None, start: int | None, end: int | None) -> None:
    """The rules of `check_requests` for one request."""
    if not text.has_text(event_name):
        raise ValueError(validate.QUERY_NAME_REQUIRED)
    if start is None or end is None:
        raise ValueError(validate.FROM_REQUIRED if start is None else validate.TO_REQUIRED)


def matching_hours(
    rollup: DataFrame, event_name: str, start: int, end: int, channel: str | None = None
) -> DataFrame:
    """Rollup rows whose hour starts in [start, end).

    The range on `date_hour` implies one on `event_date`; stating it prunes
    partitions, which Spark cannot infer.  A channel that is NULL in the
    rollup matches no channel filter.
    """
    _check(event_name, start, end)
    rows = rollup.filter(
        (F.col("event_date") >= clock.date_of(start))
        & (F.col("event_date") <= clock.date_of(end))
        & (F.col("event_name") == event_name)
        & (F.col("date_hour") >= start)
        & (F.col("date_hour") < end)
    )
    return rows.filter(F.col("channel") == channel) if text.has_visible(channel) else rows


def _sums() -> list[Column]:
    return [
        F.sum("total_count").alias("total_count"),
        F.sum("unique_user_count").alias("unique_user_count"),
    ]


def totals(rollup: DataFrame, event_name: str, start: int, end: int, channel: str | None = None) -> DataFrame:
    """Exactly one row, zeros when nothing matches."""
    zero = F.lit(0).cast("bigint")
    return matching_hours(rollup, event_name, start, end, channel).agg(
        F.coalesce(F.sum("total_count"), zero).alias("total_count"),
        F.coalesce(F.sum("unique_user_count"), zero).alias("unique_user_count"),
    )


def _labelled_buckets(
    rollup: DataFrame, event_name: str, start: int, end: int, channel: str | None, group_by: str | None
) -> DataFrame:
    hour = F.col("date_hour")
    bucket = clock.epoch_midnight(hour) if is_daily(group_by) else hour
    return (
        matching_hours(rollup, event_name, start, end, channel)
        .groupBy(bucket.alias("bucket_start"))
        .agg(*_sums())
        .select(clock.iso_label(F.col("bucket_start")).alias("bucket"), "total_count", "unique_user_count")
    )


def breakdown(
    rollup: DataFrame, event_name: str, start: int, end: int,
    channel: str | None = None, group_by: str | None = "hourly",
) -> DataFrame:
    """Ordered buckets; hours or days without events are absent."""
    # ISO labels of the years a DATE can express sort like the instants.
    return _labelled_buckets(rollup, event_name, start, end, channel, group_by).orderBy("bucket")


def check_requests(requests: DataFrame) -> DataFrame:
    """Add `violations` to a table of metrics requests."""
    return requests.withColumn(
        "violations", validate.query_violations(F.col("event_name"), F.col("from"), F.col("to"))
    )


def _array_sum(items: Column, member: str) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.aggregate(items, zero, lambda total, item: total + item[member])


_SLOT = ("event_name", "all_channels", "slot_channel")


def _hour_slots(rollup: DataFrame) -> DataFrame:
    """One row per event name, channel (or all of them) and hour, with its day."""
    both = F.array(
        F.struct(F.lit(True).alias("all"), F.lit("").alias("channel")),
        F.struct(F.lit(False).alias("all"), F.col("channel").alias("channel")),
    )
    return (
        rollup.withColumn("slot", F.explode(both))
        .filter("slot.channel is not null")
        .groupBy(
            F.col("event_name"), F.col("slot.all").alias("all_channels"),
            F.col("slot.channel").alias("slot_channel"),
            F.unix_date("event_date").cast("bigint").alias("slot_day"), F.col("date_hour"),
        )
        .agg(*_sums())
    )


def _day_slots(rollup: DataFrame) -> DataFrame:
    """One row per event name, channel (or all of them) and day, with the
    day's hours, at most 24, as an array."""
    return (
        _hour_slots(rollup)
        .withColumn("bucket", clock.iso_label(F.col("date_hour")))
        .groupBy(*_SLOT, "slot_day")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("date_hour", "bucket", "total_count", "unique_user_count"))
            ).alias("hours")
        )
    )


def running_days(rollup: DataFrame) -> DataFrame:
    """What has come up before each day and in its hours, per event name and channel (or all of them).

    A row for every day from the first with events to the rollup's last; on a day without events, `hours`
    are those of the last day that has some, and what came before is what came before that one.  So the
    sums up to any second are in the one row of its day.
    """
    days = _hour_slots(rollup).groupBy(*_SLOT, "slot_day").agg(
        F.collect_list(F.struct("date_hour", "total_count", "unique_user_count")).alias("hours"), *_sums()
    )
    in_order = Window.partitionBy(*_SLOT).orderBy("slot_day")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    last = rollup.agg(F.max(F.unix_date("event_date")).cast("bigint")).scalar()
    reach = F.coalesce(F.lead("slot_day").over(in_order) - 1, last)
    return days.select(
        *_SLOT, "hours", "slot_day", reach.alias("reach"),
        F.coalesce(F.sum("total_count").over(before), zero).alias("before_total"),
        F.coalesce(F.sum("unique_user_count").over(before), zero).alias("before_unique"),
        F.coalesce(F.sum(F.size("hours")).over(before), zero).alias("before_hours"),
        F.count("*").over(before).alias("before_days"),
    ).withColumn("slot_day", F.explode(F.sequence("slot_day", "reach"))).drop("reach")


def _up_to(edge: str, second: Column) -> dict[str, Column]:
    """Sums over the hours that start before a second, from the row of its day."""
    row = F.col(edge)
    early = F.filter(row["hours"], lambda h: h["date_hour"] < second)
    zero = F.lit(0).cast("bigint")
    sums = {
        "total": row["before_total"] + _array_sum(early, "total_count"),
        "unique": row["before_unique"] + _array_sum(early, "unique_user_count"),
        "hours": row["before_hours"] + F.size(early),
        "days": row["before_days"] + F.when(F.size(early) > 0, 1).otherwise(0),
    }
    return {name: F.when(row.isNotNull(), value).otherwise(zero) for name, value in sums.items()}


def total_requests(rollup: DataFrame, requests: DataFrame) -> DataFrame:
    """Totals of a table of metrics requests, and how many buckets their breakdowns have.

    A range is what came before its end less what came before its start, so a request meets two
    rows of `running_days`, by equality, however long its range is.  Requests that break a rule
    of `check_requests` are left out; one that matches nothing gets zeros.
    """
    valid = check_requests(requests).filter(F.size("violations") == 0)
    wants_channel = text.visible(F.col("channel"))
    last = rollup.agg(F.max(F.unix_date("event_date")).cast("bigint")).scalar()
    asked = valid.select(
        "request_id", "event_name", "from", "to", "channel", "group_by", (~wants_channel).alias("all_channels"),
        F.when(wants_channel, F.col("channel")).otherwise(F.lit("")).alias("slot_channel"),
        F.least(clock.epoch_day(F.col("from")), last).alias("from_day"), F.least(clock.epoch_day(F.col("to")), last).alias("to_day"),
    )
    days = running_days(rollup)
    packed = F.struct("hours", "before_total", "before_unique", "before_hours", "before_days")
    for edge in ("from", "to"):
        rows = days.select(*_SLOT, F.col("slot_day").alias(f"{edge}_day"), packed.alias(f"at_{edge}"))
        asked = asked.join(rows, [*_SLOT, f"{edge}_day"], "left")
    low, high = _up_to("at_from", F.col("from")), _up_to("at_to", F.col("to"))
    # A day that begins before the range and goes on in it is one bucket more.
    hours = F.col("at_from")["hours"]
    cut = F.exists(hours, lambda h: h["date_hour"] < F.col("from")) & F.exists(
        hours, lambda h: (h["date_hour"] >= F.col("from")) & (h["date_hour"] < F.col("to"))
    )
    by_day = high["days"] - low["days"] + F.when(cut, 1).otherwise(0)
    daily = F.lower(F.coalesce(F.col("group_by"), F.lit(""))) == "daily"
    some = F.col("to") > F.col("from")

    def over(value: Column) -> Column:
        return F.when(some, value).otherwise(0).cast("bigint")

    return asked.select(
        "request_id", "event_name", "from", "to", "channel", "group_by",
        over(high["total"] - low["total"]).alias("total_count"), over(high["unique"] - low["unique"]).alias("unique_user_count"),
        over(F.when(daily, by_day).otherwise(high["hours"] - low["hours"])).alias("buckets"),
    )


def _laid_out(rollup: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests with a row per date they can match, at least one each."""
    day = F.unix_date("event_date").cast("bigint")
    # One subquery, one scan: first and last day together.
    days = rollup.agg(F.struct(F.min(day).alias("first"), F.max(day).alias("last"))).scalar()
    wants_channel = text.visible(F.col("channel"))
    low = F.greatest(clock.epoch_day(F.col("from")), days["first"])
    high = F.least(clock.epoch_day(F.col("to")), days["last"])
    return requests.withColumns({
        "all_channels": ~wants_channel,
        "slot_channel": F.when(wants_channel, F.col("channel")).otherwise(F.lit("")),
        # sequence() would count downwards when the range is empty.
        "slot_day": F.explode_outer(F.when(low <= high, F.sequence(low, high))),
    })


def answer_requests(rollup: DataFrame, requests: DataFrame) -> DataFrame:
    """Answer a table of metrics requests in one job.

    `requests` has a unique request_id, event_name, from, to, channel and
    group_by; those that break a rule of `check_requests` are left out.  Adds
    total_count, unique_user_count and the ordered array of breakdowns, all
    from the same rollup version; a request that matches nothing gets zeros.

    Instead of a range join of requests with hours, each request is laid out
    over its dates and meets at most one row per date, by equality on (event
    name, channel or all, date).  Either side may grow, so none is broadcast
    by hand: Spark broadcasts a side it knows or measures to be small, and AQE
    splits hot event names otherwise.
    """
    asked = ("request_id", "event_name", "from", "to", "channel", "group_by")
    valid = check_requests(requests).filter(F.size("violations") == 0).select(*asked)
    # Spread the requests before they are laid out over days and widened by the
    # join: both keep the partitioning, so the final grouping needs no shuffle
    # of what they add.
    met = _laid_out(rollup, valid.repartition("request_id")).join(
        _day_slots(rollup), ["event_name", "all_channels", "slot_channel", "slot_day"], "left"
    )
    zero = F.lit(0).cast("bigint")
    daily = F.lower(F.coalesce(F.col("group_by"), F.lit(""))) == "daily"
    in_range = F.filter(
        "hours", lambda h: (h["date_hour"] >= F.col("from")) & (h["date_hour"] < F.col("to"))
    )
    summed = met.withColumn("hours", in_range).withColumns({
        name: _array_sum(F.col("hours"), name) for name in ("total_count", "unique_user_count")
    })
    midnight = F.col("slot_day") * F.lit(clock.DAY)
    whole_day = F.array(
        F.struct(clock.iso_label(midnight).alias("bucket"), "total_count", "unique_user_count")
    )
    each_hour = F.transform("hours", lambda h: F.struct(
        h["bucket"].alias("bucket"), h["total_count"].alias("total_count"),
        h["unique_user_count"].alias("unique_user_count"),
    ))
    part = F.struct("slot_day", F.when(daily, whole_day).otherwise(each_hour).alias("buckets"))
    # collect_list drops NULLs, so a date without matches leaves nothing; a
    # list holds no more than its own answer does.
    return (
        summed.groupBy(*asked)
        .agg(
            F.coalesce(F.sum("total_count"), zero).alias("total_count"),
            F.coalesce(F.sum("unique_user_count"), zero).alias("unique_user_count"),
            F.array_sort(F.collect_list(F.when(F.size("hours") > 0, part))).alias("parts"),
        )
        .withColumn("breakdowns", F.flatten(F.transform("parts", lambda p: p["buckets"])))
        .drop("parts")
    )


def document() -> Column:
    """The response document of an answered request, NULL members omitted."""
    return F.to_json(F.struct(
        F.col("event_name"), F.col("total_count"), F.col("unique_user_count"),
        F.struct(F.col("from"), F.col("to")).alias("time_range"),
        F.col("channel"), F.col("breakdowns"),
    ))


def metrics_document(
    rollup: DataFrame, event_name: str, start: int, end: int,
    channel: str | None = None, group_by: str | None = "hourly",
) -> DataFrame:
    """One request, one document, one read of the rollup."""
    buckets = _labelled_buckets(rollup, event_name, start, end, channel, group_by)
    zero = F.lit(0).cast("bigint")
    return buckets.agg(
        F.lit(event_name).alias("event_name"),
        F.coalesce(F.sum("total_count"), zero).alias("total_count"),
        F.coalesce(F.sum("unique_user_count"), zero).alias("unique_user_count"),
        F.lit(start).cast("bigint").alias("from"),
        F.lit(end).cast("bigint").alias("to"),
        F.lit(channel).cast("string").alias("channel"),
        F.array_sort(
            F.collect_list(F.struct("bucket", "total_count", "unique_user_count"))
        ).alias("breakdowns"),
    ).select(document().alias("document"))
