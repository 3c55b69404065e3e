"""Reading tables and payloads."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from kerbside.functions.time import ntz
from kerbside.operators.geo import polygon_column
from kerbside.schemas import FEATURE, ZONE_FEATURES, conform


def read_parquet(spark: SparkSession, paths: str | Iterable[str], schema: T.StructType | None = None) -> DataFrame:
    """One path or any collection of paths, in one scan."""
    files = [paths] if isinstance(paths, str) else sorted(paths)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*files)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, header: bool = True) -> DataFrame:
    """CSV with a header; without a schema the types are inferred (an extra pass)."""
    reader = spark.read.option("header", header)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def read_features(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """GeoJSON zones: locationid, zone, borough, polygons.

    A FeatureCollection is one document and so one task; lines=True reads one
    feature per line, which splits.
    """
    if lines:
        rows = spark.read.schema(FEATURE).json(path)
    else:
        rows = spark.read.schema(ZONE_FEATURES).option("multiLine", True).json(path).select(F.inline("features"))
    return rows.select(
        F.col("properties.locationid").cast("int").alias("locationid"),
        F.col("properties.zone").alias("zone"),
        F.col("properties.borough").alias("borough"),
        polygon_column(F.col("geometry.type"), F.col("geometry.coordinates")).alias("polygons"),
    )


def columns_to_rows(df: DataFrame, arrays: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Parallel array columns -> one row per position."""
    return df.select(*keep, F.inline(F.arrays_zip(*arrays)))


def read_merged(spark: SparkSession, paths: Iterable[str], schema: T.StructType | None = None) -> DataFrame:
    """Many files as one table.

    Without a schema the footers are merged; with one each file is read on its own
    types and cast, which also covers columns whose type differs between files.
    """
    files = sorted(paths)
    if schema is None:
        return spark.read.option("mergeSchema", True).parquet(*files)
    tables = [conform(spark.read.parquet(f), schema) for f in files]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def expected_months_vendors(spark: SparkSession, start, end, vendors: Sequence[str]) -> DataFrame:
    """One row per month from start to end and vendor; start and end may be scalar sub-queries."""
    first = F.trunc((start if isinstance(start, Column) else ntz(start)).cast("date"), "month")
    last = F.trunc((end if isinstance(end, Column) else ntz(end)).cast("date"), "month")
    months = spark.range(1).select(F.explode(F.sequence(first, last, F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return months.select("month", F.explode(F.array(*[F.lit(v) for v in vendors])).alias("vendor"))


def missing_partitions(expected: DataFrame, existing: DataFrame) -> DataFrame:
    """Expected (month, vendor) rows without data."""
    return expected.join(existing.select("month", "vendor").distinct(), ["month", "vendor"], "left_anti")


def stored_partitions(df: DataFrame) -> DataFrame:
    """(month, vendor) of a table's files, from the last '<vendor>_<YYYY-MM>' in their paths.

    Files may be named so, or lie in folders that are.
    """
    path = F.input_file_name()
    named = r"([a-z]+)_(\d{4}-\d{2})(?!.*[a-z]_\d{4}-\d{2})"
    return df.select(
        F.try_to_date(F.concat(F.regexp_extract(path, named, 2), F.lit("-01")), "yyyy-MM-dd").alias("month"),
        F.regexp_extract(path, named, 1).alias("vendor"),
    ).distinct()


def extract_links(pages: DataFrame) -> DataFrame:
    """Anchor targets of each page in document order."""
    return pages.select(
        "page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("position", "href")
    )


def preview(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """The first n rows in a given order."""
    return df.orderBy(*order).limit(n)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"))
