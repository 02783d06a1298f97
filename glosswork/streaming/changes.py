"""Incremental listings: every micro-batch is one complete listing of the sources it names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glosswork.operators.versions import KEY, snapshot_diff


def follow(listings: DataFrame, index: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Diff each micro-batch of listings against the index as it then is and hand the outcome to `sink`.

    Files that arrive since the last run are taken once (the checkpoint holds what was read), so running it again queues
    nothing. Only sources in the batch are compared, so MISSING is never told of a source that wasn't listed.
    """

    def batch(rows: DataFrame, number: int) -> None:
        listed = rows.select("source_id").distinct()
        sink(snapshot_diff(rows, index().join(listed, "source_id", "left_semi")), number)

    return listings.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(events: DataFrame, key: list[str] | None = None, order: str = "id") -> DataFrame:
    """The newest row of each key; ties go to the row that is last by all columns' hash."""
    keys = key or KEY
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), F.xxhash64(*events.columns)))
    return events.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def stalled(events: DataFrame, status: str, since: str, hours: int, now: Column | None = None, column: str = "status") -> DataFrame:
    """Rows in a status for longer than `hours` (at least one) before `now`, by default the time of the batch. A null time is
    no age. On a stream this is a filter without state."""
    cutoff = (now if now is not None else F.current_timestamp()) - F.make_dt_interval(F.lit(0), F.lit(max(hours, 1)))
    return events.filter((F.col(column) == status) & (F.col(since) < cutoff))
