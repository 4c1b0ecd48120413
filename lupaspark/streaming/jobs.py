"""Incremental jobs over event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_mentions(stream: DataFrame, entity: str, at: str, delay: str = "14 days") -> DataFrame:
    """Weekly mentions by event time; a week's rows that come later than the delay are dropped with its state. Also for batches."""
    weeks = stream.withWatermark(at, delay).groupBy(F.window(at, "7 days", startTime="4 days").alias("w"), F.col(entity).alias("entity")).agg(F.count("*").alias("n"))
    return weeks.select(F.col("w.start").cast("date").alias("week"), "entity", "n")


def stream_daily(stream: DataFrame, kind: str, at: str, value: str, delay: str = "3 days") -> DataFrame:
    """Daily totals by event time."""
    days = stream.withWatermark(at, delay).groupBy(F.window(at, "1 day").alias("w"), F.col(kind).alias("kind")).agg(F.sum(value).alias("value"))
    return days.select(F.col("w.start").cast("date").alias("day"), "kind", "value")


def year_to_date(days: DataFrame, as_of) -> DataFrame:
    """The running year's total of each kind up to a day, from daily totals."""
    day = F.lit(as_of).cast("date")
    return days.where((F.year("day") == F.year(day)) & (F.col("day") <= day)).groupBy("kind").agg(F.sum("value").alias("value"))


def stream_once(stream: DataFrame, id_col: str, at: str, delay: str = "30 days") -> DataFrame:
    """Each id once within the delay; state does not outgrow it."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([id_col])


def snapshots(stream: DataFrame, path: str, checkpoint: str, step: Callable[[DataFrame, int], DataFrame]) -> StreamingQuery:
    """Each micro-batch is a snapshot; what `step` makes of it is written under its batch id, so that a repeated batch overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        step(batch, batch_id).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
