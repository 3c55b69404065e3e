"""Writing tables. Every writer replaces what is at the path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from kerbside.functions.text import series_key


def write_parquet(df: DataFrame, path: str, codec: str = "snappy", level: int | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", codec)
    if level is not None:
        writer = writer.option(f"parquet.compression.codec.{codec}.level", str(level))
    writer.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def with_series_id(df: DataFrame) -> DataFrame:
    return df.withColumn("Series_ID", series_key("VendorID", "PULocationID"))


def write_series(df: DataFrame, path: str) -> None:
    """One folder per series with one file each; incomplete rows are dropped.

    Meant for hourly series, whose folders hold at most one row per hour.
    """
    complete = with_series_id(df.dropna(subset=["demand", "PULocationID", "VendorID", "timestamp"]))
    complete.repartition("Series_ID").write.mode("overwrite").partitionBy("Series_ID").parquet(path)


def write_sorted(df: DataFrame, path: str, by: Sequence[str], codec: str = "zstd") -> None:
    """Files that each cover one range of the sort key, sorted inside."""
    df.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").option("compression", codec).parquet(path)


def write_features(df: DataFrame, path: str, lon: str, lat: str, properties: Sequence[str]) -> None:
    """Point features, one GeoJSON feature per line."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(*properties).alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"),
    )
    df.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)


def save_router(segments: DataFrame, path: str) -> None:
    """Series -> segment table for forecasting."""
    segments.select("Series_ID", "segment").write.mode("overwrite").parquet(path)


def load_router(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("Series_ID STRING, segment STRING").parquet(path)
