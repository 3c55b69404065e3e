"""Text parsing and key expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from kerbside.functions.time import as_col

# Fixed value: decimal coordinates such as "40.71°N 74.01°W" after a slash.
COORDINATES = "/\\s*﻿?(\\d+\\.\\d+)°N\\s+(\\d+\\.\\d+)°W"


def parse_count(text: Column | str) -> Column:
    """'12,345' -> 12345; anything else that is no integer -> NULL."""
    return F.replace(as_col(text), F.lit(","), F.lit("")).try_cast("bigint")


def parse_decimal_comma(text: Column | str) -> Column:
    """'40,75' -> 40.75."""
    return F.replace(as_col(text), F.lit(","), F.lit(".")).try_cast("double")


def extract_latlon(text: Column | str) -> tuple[Column, Column]:
    """Latitude and longitude (west is negative), NULL when absent."""
    text = as_col(text)
    lat = F.regexp_extract(text, COORDINATES, 1).try_cast("double")
    lon = F.regexp_extract(text, COORDINATES, 2).try_cast("double")
    return lat, -lon


def series_key(vendor: Column | str, zone: Column | str) -> Column:
    return F.concat_ws("_", as_col(vendor).cast("string"), as_col(zone).cast("string"))


def split_series_key(key: Column | str) -> tuple[Column, Column]:
    parts = F.split(as_col(key), "_")
    return F.get(parts, F.lit(0)).cast("int"), F.get(parts, F.lit(1)).cast("int")


def route_label(pickup: Column | str, dropoff: Column | str) -> Column:
    return F.concat(
        F.lit("PU: "), as_col(pickup).cast("string"), F.lit(" -> DO: "), as_col(dropoff).cast("string")
    )
