"""The stateful series on a stream against the batch operator."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from kerbside.functions.time import trunc_grain
from kerbside.operators.series import moving_average
from kerbside.streaming.forecast import moving_average_stream, use_rocksdb

DAY = dt.datetime(2024, 3, 9)  # the night in which New York's clocks go forward
SCHEMA = "VendorID int, PULocationID int, pickup_datetime timestamp_ntz"


def run(spark, tmp_path, files, delay):
    """Hours that the stream closes over the files, in this order."""
    source = tmp_path / "in"
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        [new] = source.glob("part-*.parquet")
        new.rename(source / f"{i:04d}.parquet")
        os.utime(source / f"{i:04d}.parquet", (1_000_000 + i, 1_000_000 + i))
    use_rocksdb(spark)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = (
        moving_average_stream(stream, delay).writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return {(r.VendorID, r.PULocationID, r.timestamp): (r.demand, r.prediction) for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def batch(spark, rows):
    trips = spark.createDataFrame(rows, SCHEMA)
    hours = trips.groupBy("VendorID", "PULocationID", trunc_grain("pickup_datetime", "hour").alias("timestamp")).agg(F.count("*").cast("int").alias("demand"))
    return {(r.VendorID, r.PULocationID, r.timestamp): (r.demand, r.prediction) for r in moving_average(hours, complete=True).collect()}


def trips(n, seed):
    rng = random.Random(seed)
    return [(rng.randrange(2), rng.choice([1, 1, 7]), DAY + dt.timedelta(minutes=rng.randrange(60 * 60))) for _ in range(n)]


FLUSH = [(9, 9, DAY + dt.timedelta(days=30))]


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_input_gives_the_batch(spark, tmp_path, seed):
    """A few trips in 60 hours, so that many hours are silent; all come within the delay."""
    rows = trips(120, seed)
    random.Random(seed).shuffle(rows)
    found = run(spark, tmp_path, [rows[:50], rows[50:90], rows[90:], FLUSH, FLUSH], "4 days")
    wanted = batch(spark, rows)
    assert found == wanted and sum(d == 0 for d, _ in found.values()) > 5


def test_hours_close_in_order_and_late_trips_are_dropped(spark, tmp_path):
    rows = sorted(trips(200, 3), key=lambda r: r[2])
    files = [rows[i : i + 40] for i in range(0, 200, 40)]
    late = [(0, 1, DAY + dt.timedelta(minutes=5))] * 3
    found = run(spark, tmp_path, [*files[:4], late, files[4], FLUSH, FLUSH], "1 hour")
    assert found == batch(spark, rows)


def test_an_hour_stays_open_until_the_watermark_passes(spark, tmp_path):
    rows = [(0, 1, DAY), (0, 1, DAY + dt.timedelta(hours=3)), (0, 1, DAY + dt.timedelta(hours=9))]
    found = run(spark, tmp_path, [rows, rows[:1]], "2 hours")
    assert set(found) == {(0, 1, DAY + dt.timedelta(hours=h)) for h in range(4)}  # the watermark is at hour 7
    assert found[0, 1, DAY + dt.timedelta(hours=3)] == (1, 2 / 3)  # the second file came before its hour was closed
