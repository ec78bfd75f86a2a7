"""The idempotency key of an event."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventtally.schema import KEY_SEPARATOR


def key_text(event_name: Column, user_id: Column, timestamp: Column, campaign_id: Column) -> Column:
    """The text that is hashed.  The separator is not escaped, and a missing
    campaign equals an empty one; both are part of the key's definition."""
    bar = F.lit(KEY_SEPARATOR)
    # concat_ws would drop the last separator of a NULL campaign.
    return F.concat(
        event_name, bar, user_id, bar, timestamp.cast("string"), bar, F.coalesce(campaign_id, F.lit(""))
    )


def idempotency_key(event_name: Column, user_id: Column, timestamp: Column, campaign_id: Column) -> Column:
    """Lowercase hex SHA-256, 64 characters."""
    return F.sha2(key_text(event_name, user_id, timestamp, campaign_id), 256)


def key_has_separator(event_name: Column, user_id: Column, campaign_id: Column) -> Column:
    """True when a field itself holds the separator.

    Without one, the key text splits back into its four fields in only one
    way, so equal keys have equal timestamps and therefore one event date.
    With one, different events may share a key across dates, and a lookup must
    not be limited to the dates of the batch.
    """
    def holds(column: Column) -> Column:
        return F.coalesce(F.contains(column, F.lit(KEY_SEPARATOR)), F.lit(False))

    return holds(event_name) | holds(user_id) | holds(campaign_id)
