"""The ingest loop as a streaming query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from eventtally.plans.ingest import Stores, ingest_batch
from eventtally.sources import folders


def start_ingest(
    stores: Stores,
    records: DataFrame,
    checkpoint: str,
    name: str = "stream",
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Ingest a stream of records, each micro-batch as one batch.

    The checkpoint fixes which records form micro-batch n, and the batch's
    tables are keyed by (name, n); so a micro-batch that is replayed after a
    crash rewrites what it wrote, and delivery is effectively once.  Losing
    the checkpoint would start again at n = 0 and overwrite old batches, so
    `name` is refused when batches of it are on record but no checkpoint.
    """
    if stores.counters.has_batches(f"{name}-") and not folders.exists(stores.spark, checkpoint):
        raise RuntimeError(
            f"batches of '{name}' are on record but {checkpoint} does not exist; "
            "start the stream under another name"
        )

    def handle(batch: DataFrame, number: int) -> None:
        ingest_batch(stores, batch, f"{name}-{number:012d}", **options)

    return (
        records.writeStream.queryName(name)
        .foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
