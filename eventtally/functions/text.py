"""Text rules: blankness, JSON text, configuration values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventtally.schema import DEFAULT_RETENTION_DAYS


def not_blank(column: Column) -> Column:
    """At least one character above U+0020; NULL counts as blank.
    SQL trim would only strip spaces, and let a tab through."""
    return F.coalesce(column.rlike(r"[^\x00-\x20]"), F.lit(False))


def has_text(value: str | None) -> bool:
    """The same rule for a Python argument."""
    return value is not None and any(ch > " " for ch in value)


# The characters that Java counts as white space.
_JAVA_WHITE = [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x1680, *range(0x2000, 0x2007), *range(0x2008, 0x200B),
    0x2028, 0x2029, 0x205F, 0x3000,
]


def visible(column: Column) -> Column:
    """At least one character that is not white space; NULL has none.  The rule
    for a channel, which differs from `not_blank` outside of ASCII and for
    control characters."""
    inside = "".join(f"\\x{{{point:x}}}" for point in _JAVA_WHITE)
    return F.coalesce(column.rlike(f"[^{inside}]"), F.lit(False))


def has_visible(value: str | None) -> bool:
    """The same rule for a Python argument."""
    return value is not None and any(ord(ch) not in _JAVA_WHITE for ch in value)


def json_text(column: Column) -> Column:
    """An array, map or struct as JSON text; NULL stays NULL."""
    return F.when(column.isNotNull(), F.to_json(column))


def retention_days(value: Column) -> Column:
    """Days from a configuration text; blank or missing means the default.
    Text that is no integer fails the query, as it does in the reference."""
    return F.coalesce(
        F.nullif(F.trim(value), F.lit("")).cast("int"), F.lit(DEFAULT_RETENTION_DAYS)
    )
