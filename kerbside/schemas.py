"""The hub schema, zone features and code sets (fixed values of the data model)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T


TYPES = {
    "TINYINT": T.ByteType(),
    "SMALLINT": T.ShortType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "FLOAT": T.FloatType(),
    "DOUBLE": T.DoubleType(),
    "STRING": T.StringType(),
    "DATE": T.DateType(),
    "TIMESTAMP_NTZ": T.TimestampNTZType(),
}


def struct(columns: str) -> T.StructType:
    """'name TYPE, ...' as a schema; needs no session, so schemas can be module constants."""
    fields = [c.strip().rsplit(" ", 1) for c in columns.split(",")]
    return T.StructType([T.StructField(name.strip("`"), TYPES[kind]) for name, kind in fields])


# Vendor codes, licence codes, payment codes, zones outside the city.
VENDOR_YELLOW, VENDOR_GREEN, VENDOR_APP_A, VENDOR_APP_B, VENDOR_OTHER = 0, 1, 2, 3, 4
LICENCE_TO_VENDOR = {"HV0003": VENDOR_APP_A, "HV0005": VENDOR_APP_B}
PAYMENT_APP = 7
PAYMENT_UNKNOWN = 5
UNKNOWN_ZONES = (264, 265)
FIRST_ZONE, LAST_ZONE = 1, 263

UNIFIED_TRIPS = struct(
    "VendorID TINYINT, pickup_datetime TIMESTAMP_NTZ, dropoff_datetime TIMESTAMP_NTZ, "
    "trip_distance FLOAT, PULocationID SMALLINT, DOLocationID SMALLINT, payment_type TINYINT, "
    "tip_amount BIGINT, tolls_amount BIGINT, fare_amount BIGINT, total_amount BIGINT"
)
FEATURE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("properties", struct("locationid STRING, zone STRING, borough STRING")),
        # coordinates stay text here: their nesting depends on the geometry type
        T.StructField("geometry", struct("type STRING, coordinates STRING")),
    ]
)
ZONE_FEATURES = T.StructType(
    [T.StructField("type", T.StringType()), T.StructField("features", T.ArrayType(FEATURE))]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project onto a declared schema; absent columns become typed NULLs."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )
