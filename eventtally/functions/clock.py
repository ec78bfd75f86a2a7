"""UTC clock arithmetic on epoch seconds (BIGINT).

TIMESTAMP is avoided on purpose: casting to DATE or truncating follows the
session zone, while event dates are UTC days whatever the session says.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3600
DAY = 86400
# 0001-01-01 and 9999-12-31 as days since 1970, the range of a DATE.
FIRST_DAY = -719162
LAST_DAY = 2932896


def epoch_hour(seconds: Column) -> Column:
    """Start of the UTC hour."""
    return seconds - F.pmod(seconds, F.lit(HOUR).cast("bigint"))


def epoch_midnight(seconds: Column) -> Column:
    """Start of the UTC day."""
    return seconds - F.pmod(seconds, F.lit(DAY).cast("bigint"))


# The seconds a DATE can express.
FIRST_SECOND = FIRST_DAY * DAY
LAST_SECOND = LAST_DAY * DAY + DAY - 1


def has_date(seconds: Column) -> Column:
    return seconds.between(F.lit(FIRST_SECOND), F.lit(LAST_SECOND))


def epoch_day(seconds: Column) -> Column:
    """Days since 1970 (BIGINT), limited to the range of a DATE."""
    day = F.floor(seconds / F.lit(DAY)).cast("bigint")
    return F.when(seconds.isNotNull(), F.least(F.greatest(day, F.lit(FIRST_DAY).cast("bigint")),
                                               F.lit(LAST_DAY).cast("bigint")))


def epoch_date(seconds: Column) -> Column:
    """UTC date; NULL for a second no DATE can express (so that one absurd
    timestamp cannot fail a job under ANSI mode)."""
    day = F.floor(seconds / F.lit(DAY)).cast("int")
    return F.when(has_date(seconds), F.date_from_unix_date(day))


def iso_label(seconds: Column) -> Column:
    """ISO-8601 instant, such as 2026-02-15T12:00:00Z, in any session zone."""
    day = F.date_from_unix_date(epoch_day(seconds).cast("int")).cast("string")
    rest = F.pmod(seconds, F.lit(DAY).cast("bigint")).cast("int")
    two = [
        F.lpad((rest / F.lit(HOUR)).cast("int").cast("string"), 2, "0"),
        F.lpad((F.pmod(rest, F.lit(HOUR)) / F.lit(60)).cast("int").cast("string"), 2, "0"),
        F.lpad(F.pmod(rest, F.lit(60)).cast("string"), 2, "0"),
    ]
    return F.concat(day, F.lit("T"), two[0], F.lit(":"), two[1], F.lit(":"), two[2], F.lit("Z"))


def date_of(seconds: int) -> Column:
    """UTC date of a Python integer as a literal, limited to the range of a
    DATE."""
    day = min(max(seconds // DAY, FIRST_DAY), LAST_DAY)
    date = dt.date(1970, 1, 1) + dt.timedelta(days=day)
    return F.lit(date.isoformat()).cast("date")


def midnight_of(date: str) -> int:
    """Epoch second at which an ISO date starts."""
    return (dt.date.fromisoformat(date) - dt.date(1970, 1, 1)).days * DAY


def hour_as_timestamp(seconds: Column) -> Column:
    """The instant as TIMESTAMP, for event-time windows."""
    return F.timestamp_seconds(seconds)
