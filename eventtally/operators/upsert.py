"""Key/value upserts on tables without MERGE."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _merge(stored: DataFrame, incoming: DataFrame, key: str, incoming_wins: bool) -> DataFrame:
    stored_rank, incoming_rank = (0, 1) if incoming_wins else (1, 0)
    columns = stored.columns
    both = stored.withColumn("rank", F.lit(stored_rank)).unionByName(
        incoming.select(*columns).withColumn("rank", F.lit(incoming_rank))
    )
    payload = [name for name in columns if name != key]
    return (
        both.groupBy(key)
        .agg(F.max_by(F.struct(*payload), "rank").alias("winner"))
        .select(key, "winner.*")
        .select(*columns)
    )


def upsert(stored: DataFrame, incoming: DataFrame, key: str = "key") -> DataFrame:
    """Insert, or overwrite the stored value.  One shuffle, no full join."""
    return _merge(stored, incoming, key, incoming_wins=True)


def insert_missing(stored: DataFrame, incoming: DataFrame, key: str = "key") -> DataFrame:
    """Insert, but keep the stored value on conflict."""
    return _merge(stored, incoming, key, incoming_wins=False)
