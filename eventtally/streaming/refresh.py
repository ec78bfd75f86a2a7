"""The periodic jobs: rollup refresh and upkeep."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from eventtally.plans.ingest import Stores
from eventtally.plans.refresh import refresh, today
from eventtally.plans.upkeep import upkeep
from eventtally.schema import REFRESH_SECONDS, UPKEEP_SECONDS

log = logging.getLogger(__name__)


def start_refresh(
    stores: Stores,
    checkpoint: str,
    as_of: Callable[[], dt.date] = today,
    seconds: float = REFRESH_SECONDS,
) -> StreamingQuery:
    """Refresh the rollup at once and then every `seconds`, events or not.

    The stream is only a clock.  What a refresh has to do follows from the
    tables: which batches the current version does not count, and where the
    window lies now.  So a new day or a changed setting takes effect without a
    new event, late events count while their date is in the window, and a
    failed refresh, which is logged and leaves the old version in force, is
    made up for by the next one.  For one refresh that raises, call `refresh`.
    """
    return _every(stores, "rollup refresh", lambda: refresh(stores, as_of()), checkpoint, seconds)


def start_upkeep(stores: Stores, checkpoint: str, seconds: float = UPKEEP_SECONDS, **options) -> StreamingQuery:
    """`upkeep` at once and then every `seconds`."""
    return _every(stores, "upkeep", lambda: upkeep(stores, **options), checkpoint, seconds)


def _every(stores: Stores, what: str, work: Callable[[], object], checkpoint: str, seconds: float) -> StreamingQuery:
    def handle(_: DataFrame, number: int) -> None:
        try:
            work()
        except Exception:
            log.exception("%s %d failed and is made up for by the next one", what, number)

    ticks = stores.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (
        ticks.writeStream.queryName(what.replace(" ", "-"))
        .foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=f"{seconds} seconds")
        .start()
    )
