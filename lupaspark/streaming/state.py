"""State of keys that expires by event time (I5, I6): timers of the stream, not of the wall clock, so that a replay gives the same rows."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000
# The worker that sets a stateful processor up on the driver gets no files of the application, so the classes travel whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _ms(at) -> int:
    return pd.Timestamp(at).value // 1_000_000


class Expiring(StatefulProcessor):
    """One value for each key and the time at which it was seen, forgotten `days` after by a timer."""

    schema = "at_ms bigint, value double"

    def __init__(self, days: int) -> None:
        self.keep = days * DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.schema)

    def known(self) -> tuple[int, float] | None:
        return tuple(self.last.get()) if self.last.exists() else None

    def remember(self, at: int, value: float, was: tuple[int, float] | None) -> None:
        if was:
            self.handle.deleteTimer(was[0] + self.keep)
        self.last.update((at, value))
        self.handle.registerTimer(at + self.keep)

    def in_order(self, rows: Iterator[pd.DataFrame]) -> list[tuple[int, float]]:
        """A key's rows of one micro-batch, by time."""
        return sorted((_ms(at), v) for df in rows for at, v in zip(df["at"], df["value"]))

    def close(self) -> None:
        pass


class AskAgain(Expiring):
    """Lets a key through if it was not let through within the days before."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the base class's names
        asked, was = [], self.known()
        for at, _ in self.in_order(rows):
            if was is None or at - was[0] > self.keep:
                self.remember(at, 0.0, was)
                was = (at, 0.0)
                asked.append(at)
        yield pd.DataFrame({"key": [key[0]] * len(asked), "at": pd.to_datetime(asked, unit="ms")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        yield pd.DataFrame({"key": pd.Series([], dtype="int64"), "at": pd.Series([], dtype="datetime64[ns]")})


class CarryForward(Expiring):
    """Gives each reading its value or, where it has none, the last one within the days before; tells when a value is given up."""

    def told(self, rows: list[tuple]) -> pd.DataFrame:
        key, at, value, seen, origin = zip(*rows) if rows else ((),) * 5
        times = lambda x: pd.to_datetime(pd.Series(x, dtype="int64"), unit="ms")
        return pd.DataFrame({"key": pd.Series(key, dtype="int64"), "at": times(at), "value": pd.Series(value, dtype="float64"), "seen": times(seen), "origin": pd.Series(origin, dtype="object")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out, was = [], self.known()
        for at, v in self.in_order(rows):
            if not pd.isna(v):
                self.remember(at, float(v), was)
                was = (at, float(v))
                out.append((key[0], at, float(v), at, "current"))
            elif was and at - was[0] <= self.keep:
                out.append((key[0], at, was[1], was[0], "carried"))
        yield self.told(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, value = self.known()
        self.last.clear()
        yield self.told([(key[0], expiredTimerInfo.getExpiryTimeInMs(), value, at, "expired")])


def _keyed(stream: DataFrame, key: str, at: str, value, delay: str):
    """Rows by key; times in UTC and milliseconds."""
    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(at).cast("timestamp").alias("at"), value.cast("double").alias("value"))
    return rows.where("key is not null and at is not null").withWatermark("at", delay).groupBy("key")


def ask_again(stream: DataFrame, key: str, at: str, days: int, delay: str = "1 day") -> DataFrame:
    """I5 on a stream: (key, at) of the requests to let through: no other was let through for the key within `days`. Negative answers are forgotten by a timer; rows with a null key or time are left out."""
    return _keyed(stream, key, at, F.lit(None), delay).transformWithStateInPandas(AskAgain(days), "key long, at timestamp", "append", "eventTime")


def carry_on(stream: DataFrame, key: str, at: str, value: str, days: int, delay: str = "1 day") -> DataFrame:
    """I6 on a stream: (key, at, value, seen, origin) of each reading: 'current' with its own value, 'carried' with the last one of at most `days` before; an older or no value gives no row. 'expired' rows tell the value that was given up and when."""
    return _keyed(stream, key, at, F.col(value), delay).transformWithStateInPandas(CarryForward(days), "key long, at timestamp, value double, seen timestamp, origin string", "append", "eventTime")


def run_now(out: DataFrame, path: str) -> DataFrame:
    """What the stream gives for all that its source holds now, as a table; state is kept in RocksDB and checkpointed beside it, so that the next call goes on from there."""
    spark, name = out.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = out.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    return spark.read.schema(out.schema).parquet(f"{path}/rows")
