"""Deduplication by idempotency key.

Inside a batch the last arrival's payload wins, across batches the first
batch wins.  Copies of one key may be a third of all rows, so every operator
here reduces map-side before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "idempotency_key"


def packed(rows: DataFrame) -> DataFrame:
    """Keys as the 32 bytes of their digest, half of what their text takes in a shuffle."""
    return rows.withColumn(KEY, F.unhex(KEY))


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.withColumn(KEY, F.lower(F.hex(KEY)))


def _first_row(events: DataFrame, keys: tuple[str, ...], order: list[Column]) -> DataFrame:
    # For a rank compared with 1 Spark limits each group already before the
    # shuffle, so a task sends one row per key, whatever the number of copies.
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return events.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def last_in_batch(
    events: DataFrame, order: tuple[str, ...] = ("offset",), keys: tuple[str, ...] = (KEY,)
) -> DataFrame:
    """One row per key, the last arrival's.  With the batch among `keys`, many
    batches are reduced at once."""
    return _first_row(events, keys, [F.desc(name) for name in order])


def last_with_first_position(
    events: DataFrame, offset: str = "offset", keys: tuple[str, ...] = (KEY,)
) -> DataFrame:
    """The same, with `first_offset`, where the key arrived first: the order
    in which a batch emits its keys.

    Two reductions, each partial on the map side: the rank keeps a row a key
    and task, the offsets alone are summed up.
    """
    first = events.groupBy(*keys).agg(F.min(offset).alias("first_offset"))
    return last_in_batch(events, (offset,), keys).join(first, list(keys))


def first_stored(rows: DataFrame) -> DataFrame:
    """One row per key and date, the one that was stored first."""
    return _first_row(rows, (KEY, "event_date"), [F.asc("received_at"), F.asc("bid")])


def first_batch_last_arrival(
    arrivals: DataFrame, batch: str = "batch_id", offset: str = "offset", key: str = KEY
) -> DataFrame:
    """Both rules over many batches at once: the ledger after all of them."""
    return _first_row(arrivals, (key,), [F.asc(batch), F.desc(offset)])


def seen_keys(batch: DataFrame, ledger: DataFrame, key: str = KEY) -> DataFrame:
    """Which keys of the batch the ledger already holds, one row each."""
    return batch.select(key).join(ledger.select(key), key, "left_semi").distinct()


def unseen(batch: DataFrame, ledger: DataFrame, key: str = KEY) -> DataFrame:
    """Rows of the batch whose key the ledger does not hold."""
    return batch.join(ledger.select(key), key, "left_anti")


def storable(batch: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows of the batch that no row of `seen` refuses: by key and date, and by
    the key alone where `everywhere` says so."""
    known = seen.select(F.col(KEY).alias("_key"), F.col("event_date").alias("_date"), "everywhere")
    refused = (F.col(KEY) == F.col("_key")) & (F.col("everywhere") | (F.col("event_date") == F.col("_date")))
    return batch.join(known, refused, "left_anti")


def insert_ignore(rows: DataFrame, table: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """Rows an insert that ignores conflicts on `on` would add."""
    return rows.join(table.select(*on), list(on), "left_anti")


def batch_counters(arrivals: DataFrame, batch: str = "batch_id", offset: str = "offset",
                   key: str = KEY) -> DataFrame:
    """Per batch: deserialized, unique keys, inserted, and both kinds of
    duplicates, for many batches at once.

    The first step counts copies per (key, batch), which is partial on the map
    side; after it a key has one row per batch that delivered it.
    """
    per_key = arrivals.groupBy(key, batch).agg(F.count("*").alias("copies"))
    first_batch = F.min(batch).over(Window.partitionBy(key))
    return (
        per_key.withColumn("first_batch", first_batch)
        .groupBy(batch)
        .agg(
            F.sum("copies").alias("deserialized"),
            F.count("*").alias("unique_keys"),
            F.count_if(F.col("first_batch") == F.col(batch)).alias("inserted"),
        )
        .withColumns({
            "in_batch_duplicates": F.col("deserialized") - F.col("unique_keys"),
            "cross_batch_duplicates": F.col("unique_keys") - F.col("inserted"),
        })
    )
