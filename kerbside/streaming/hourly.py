"""The hourly roll-up on a stream of trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from kerbside.functions.time import as_instant, from_instant
from kerbside.operators.rollup import hourly_series


def hourly_series_stream(trips: DataFrame, delay: str = "1 hour") -> DataFrame:
    """hourly_series of a stream; hours are final once the watermark has passed them.

    Watermarks need instants, so the wall-clock times pass through UTC.
    """
    timed = trips.withColumn("pickup_datetime", as_instant("pickup_datetime")).withWatermark("pickup_datetime", delay)
    return hourly_series(timed).withColumn("timestamp", from_instant("timestamp"))


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished hours to parquet files, exactly once, until the input is used up."""
    return (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def write_updates(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write every hour that a batch changed, also those still open, until the input is used up.

    Each batch has a folder of its own, so a repeated batch replaces its own rows.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        df.writeStream.foreachBatch(keep)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_hours(spark: SparkSession, path: str) -> DataFrame:
    """The newest state of every hour that write_updates has written: the roll-up of all input but late rows."""
    keys = ["VendorID", "PULocationID", "timestamp"]
    rows = spark.read.option("basePath", path).parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return newest.select(*keys, "_v.*")
