"""Complete hourly series and their moving average on a stream of trips that come late and in any order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from kerbside.functions.time import as_instant, from_instant

HOUR_MS = 3_600_000
KEYS = ["VendorID", "PULocationID"]
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class HourlyAverage(StatefulProcessor):
    """Counts a series' trips by hour and closes an hour when the watermark has passed its end.

    State: the counts of open hours, the last closed hour, and the newest closed demands. A timer stands at the end of every
    open hour. When one is due, the hours that have ended are closed in order: silent hours between get a demand of zero, and each
    hour the mean of the ``back`` hours before it. Silent hours after a series' last trip are closed by its next trip.
    """

    def __init__(self, back: int = 5):
        self.back = back

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "hour long", "trips long")
        self.last = handle.getValueState("last", "hour long")
        self.recent = handle.getValueState("recent", "demands array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        closed = self.last.get()[0] if self.last.exists() else None
        for frame in rows:
            for hour, trips in frame.groupby("ms").size().items():
                hour = int(hour)
                if closed is not None and hour <= closed:
                    continue  # too late: the hour is out
                before = self.open.getValue((hour,))[0] if self.open.containsKey((hour,)) else 0
                self.open.updateValue((hour,), (before + int(trips),))
                self.handle.registerTimer(hour + HOUR_MS)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = timerValues.getCurrentWatermarkInMs() - HOUR_MS  # one timer closes all hours that are due
        ready = sorted((k[0], v[0]) for k, v in self.open.iterator() if k[0] <= due)
        if not ready:
            return
        recent = list(self.recent.get()[0]) if self.recent.exists() else []
        last = self.last.get()[0] if self.last.exists() else ready[0][0] - HOUR_MS
        out = []
        for hour, trips in ready:
            for at in range(last + HOUR_MS, hour + HOUR_MS, HOUR_MS):
                demand = trips if at == hour else 0
                out.append((*key, at, demand, sum(recent) / len(recent) if recent else None))
                recent = [*recent, demand][-self.back :]
            last = hour
            self.open.removeKey((hour,))
        self.last.update((last,))
        self.recent.update((recent,))
        yield pd.DataFrame(out, columns=[*KEYS, "ms", "demand", "prediction"])

    def close(self) -> None:
        pass


def moving_average_stream(trips: DataFrame, delay: str = "1 hour", back: int = 5) -> DataFrame:
    """(VendorID, PULocationID, timestamp, demand, prediction) of every closed hour of each series, silent ones included.

    Equals ``series.moving_average(hourly series, complete=True)`` up to the watermark, in whatever order trips come, as long as
    they come within ``delay``; later ones are dropped. Times pass through UTC, as watermarks need instants. State lives in RocksDB, which timers need: call use_rocksdb first.
    """
    timed = trips.withColumn("instant", as_instant("pickup_datetime")).withWatermark("instant", delay)
    hourly = timed.select(*[F.col(k).cast("long") for k in KEYS], "instant", (F.floor(F.unix_millis("instant") / HOUR_MS) * HOUR_MS).alias("ms"))
    schema = StructType.fromDDL("VendorID long, PULocationID long, ms long, demand long, prediction double")
    found = hourly.groupBy(*KEYS).transformWithStateInPandas(HourlyAverage(back), schema, "Append", "EventTime")
    kinds = dict(trips.dtypes)
    return found.select(
        *[F.col(k).cast(kinds[k]) for k in KEYS], from_instant(F.timestamp_millis("ms")).alias("timestamp"), F.col("demand").cast("int"), "prediction"
    )


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(STORE, ROCKS)
