"""Typed reading of JSON event and bulk payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventtally.schema import BULK_JSON, CORRUPT, EVENT_FIELDS, EVENT_JSON

_PERMISSIVE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
_LONG_RANGE = (-(2**63), 2**63 - 1)


def _opens_like(text: Column, *brackets: str) -> Column:
    return F.coalesce(F.substr(text, F.lit(1), F.lit(1)).isin(*brackets), F.lit(False))


_TEXTS = ("event_name", "channel", "campaign_id", "user_id")
_BARE_METADATA = r'"metadata"\s*:\s*[^{\s]'


def _suspect(event: Column, value: Column) -> Column:
    """Whether an event may hold a member of a JSON type its field does not take.

    Spark hands an object over as text where a string is declared, and a
    string where the metadata object is.  Only payloads that may have that
    problem, by a text that opens with a bracket or a quoted metadata member,
    are looked at again for the members' types.
    """
    suspect = event["metadata"].isNotNull() & value.rlike(_BARE_METADATA)
    for name in _TEXTS:
        suspect = suspect | _opens_like(event[name], "{", "[")
    return suspect


def _mistyped(value: Column, prefix: Column) -> Column:
    """Whether a member of the event at a path of the JSON text has a wrong type."""
    def differs(member: Column) -> Column:
        path = F.concat(prefix, F.lit("."), member["name"])
        kind = F.schema_of_variant(F.variant_get(F.try_parse_json(value), path, "variant"))
        return F.coalesce(F.rlike(kind, member["refused"]), F.lit(False))

    members = [(name, "^(OBJECT|ARRAY)") for name in _TEXTS] + [("metadata", "^(?!OBJECT|VOID)")]
    table = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(refused).alias("refused")) for name, refused in members
    ])
    return F.exists(table, differs)


def _wrong_kind(value: Column, event: Column) -> Column:
    return F.when(_suspect(event, value), _mistyped(value, F.lit("$"))).otherwise(F.lit(False))


def _wrong_element(value: Column, events: Column) -> Column:
    """The same for the elements of a bulk payload's list."""
    places = F.transform(events, lambda event, i: F.when(_suspect(event, value), F.concat(F.lit("$.events["), i.cast("string"), F.lit("]"))))
    wrong = F.exists(F.array_compact(places), lambda place: _mistyped(value, place))
    return F.coalesce(wrong, F.lit(False))


def _coerced_long(text: Column) -> Column:
    """A number or a quoted number as BIGINT, fractions cut off."""
    number = F.trim(text).try_cast("decimal(38,9)")
    whole = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number))
    return F.when(whole.between(*[F.lit(str(b)).cast("decimal(38,0)") for b in _LONG_RANGE]),
                  whole.cast("bigint"))


def _parsed_once(rows: DataFrame, name: str, document: Column) -> DataFrame:
    """Add a parsed document as the one element of a generator.  A later filter
    is not pushed through a generator, as it would be through a projection,
    where each mention of a field would parse the text once more."""
    return rows.select("*", F.explode(F.array(document)).alias(name))


def parse_events(records: DataFrame, value: str = "value", coerce: bool = False) -> DataFrame:
    """Add the event's fields and `_corrupt` (the raw text when it is not an
    event) to each record.  A NULL or literal `null` value is neither an event
    nor corrupt.  Unknown members are ignored, numbers become text where text
    is declared.

    The timestamp must be a JSON integer; with `coerce`, quoted numbers and
    fractions are taken too.
    """
    raw = F.col(value)
    schema = EVENT_JSON if not coerce else EVENT_JSON.replace("timestamp BIGINT", "timestamp STRING")
    parsed = _parsed_once(records, "_event", F.from_json(raw, schema, _PERMISSIVE))
    event = F.col("_event")
    timestamp = event["timestamp"]
    broken = event.isNull() | event[CORRUPT].isNotNull() | _wrong_kind(raw, event)
    if coerce:
        timestamp = _coerced_long(timestamp)
        broken = broken | (event["timestamp"].isNotNull() & timestamp.isNull())
    absent = is_absent(raw)
    names = [field.strip().split(" ")[0] for field in EVENT_FIELDS.split(",")]
    fields = {name: event[name] for name in names if name != "timestamp"}
    fields["timestamp"] = timestamp
    fields[CORRUPT] = F.when(~absent & broken, raw)
    return parsed.withColumns(fields).drop("_event")


def is_absent(value: Column) -> Column:
    """No value at all: skipped, neither an event nor a dead letter."""
    return value.isNull() | (F.trim(value) == "null")


def parse_bulk(requests: DataFrame, value: str = "value") -> DataFrame:
    """Add the `events` array and `_corrupt` of each bulk payload.  One
    mistyped element marks the whole payload corrupt."""
    raw = F.col(value)
    parsed = _parsed_once(requests, "_bulk", F.from_json(raw, BULK_JSON, _PERMISSIVE))
    bulk = F.col("_bulk")
    broken = bulk.isNull() | bulk[CORRUPT].isNotNull() | _wrong_element(raw, bulk["events"])
    return parsed.withColumns({
        "events": bulk["events"], CORRUPT: F.when(broken, F.coalesce(raw, F.lit(""))),
    }).drop("_bulk")
