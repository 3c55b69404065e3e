"""Joins with dimensions.

All of them are equi-joins without hints: Spark broadcasts a dimension whose size
it knows to lie below ``spark.sql.autoBroadcastJoinThreshold`` (from file sizes,
or from shuffle sizes at run time) and otherwise shuffles both sides, where
adaptive execution splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from kerbside.functions import maths
from kerbside.functions.time import trunc_time
from kerbside.operators.prep import daylight_flag


def with_centroids(df: DataFrame, centroids: DataFrame, how: str = "left") -> DataFrame:
    """Pickup zone coordinates."""
    dim = centroids.select(F.col("locationid").alias("PULocationID"), "Latitude", "Longitude")
    return df.join(dim, "PULocationID", how)


def with_od_centroids(df: DataFrame, centroids: DataFrame) -> DataFrame:
    """Coordinates of both ends; trips without a known end are dropped."""
    for key, end in (("PULocationID", "pickup"), ("DOLocationID", "dropoff")):
        dim = centroids.select(
            F.col("locationid").alias(key),
            F.col("Latitude").alias(f"{end}_latitude"),
            F.col("Longitude").alias(f"{end}_longitude"),
        )
        df = df.join(dim, key)
    return df


def with_hourly_climate(df: DataFrame, climate: DataFrame, ts: str = "pickup_datetime") -> DataFrame:
    return df.withColumn("hour_key", trunc_time(ts, "1h")).join(climate, "hour_key").drop("hour_key")


def with_daily_sun(df: DataFrame, sun: DataFrame, ts: str = "pickup_datetime") -> DataFrame:
    keyed = df.withColumn("date_key", F.to_date(ts)).join(sun, "date_key")
    return daylight_flag(keyed, ts).drop("date_key", "sunrise", "sunset")


def with_station_weather(
    df: DataFrame, weather: DataFrame, ts: str = "pickup_datetime", rain_above: float = 0.41
) -> DataFrame:
    """Rain and snow flags of the day; NULL for days without a reading."""
    days = weather.select(
        F.to_date("DATE").alias("_day"),
        (F.col("PRCP") > rain_above).alias("rain"),
        (F.col("SNOW") > 0).alias("snow"),
    )
    return df.withColumn("_day", F.to_date(ts)).join(days, "_day", "left").drop("_day")


def with_zone_names(df: DataFrame, lookup: DataFrame, key: str = "PULocationID", name: str = "zone") -> DataFrame:
    dim = lookup.select(F.col("LocationID").alias(key), F.col("Zone").alias("_zone"))
    return df.join(dim, key, "left").withColumn(name, F.coalesce("_zone", F.lit("Unknown"))).drop("_zone")


def with_od_boroughs(df: DataFrame, lookup: DataFrame) -> DataFrame:
    for key, name in (("PULocationID", "PUborough"), ("DOLocationID", "DOborough")):
        dim = lookup.select(F.col("LocationID").alias(key), F.col("Borough").alias("_b"))
        df = df.join(dim, key, "left").withColumn(name, F.coalesce("_b", F.lit("Unknown"))).drop("_b")
    return df


def combine_monthly(*reports: DataFrame, on: Sequence[str] = ("month", "type")) -> DataFrame:
    """Inner join of monthly reports."""
    out = reports[0]
    for r in reports[1:]:
        out = out.join(r, list(on))
    return out


def monthly_earnings(hours: DataFrame, trips: DataFrame, fares: DataFrame) -> DataFrame:
    """Hourly earnings per driver from (m_hours), (m_trips_per_driver), (monthly_avg) reports."""
    return combine_monthly(hours, trips, fares).withColumn(
        "hourly_earnings", maths.hourly_earnings("m_trips_per_driver", "monthly_avg", "m_hours")
    )


def monthly_idle(hours: DataFrame, trips: DataFrame, durations: DataFrame) -> DataFrame:
    return combine_monthly(hours, trips, durations).withColumn(
        "free_hours", maths.idle_hours("m_hours", "m_trips_per_driver", "avg_trip_duration_h")
    )


def restrict_to_routes(df: DataFrame, routes: DataFrame, with_count: bool = True) -> DataFrame:
    keys = ["PULocationID", "DOLocationID"]
    return df.join(routes, keys) if with_count else df.join(routes, keys, "left_semi")


def pair_actual_pred(actual: DataFrame, pred: DataFrame) -> DataFrame:
    return actual.join(pred, ["VendorID", "PULocationID", "timestamp"])


def merge_forecasts(*forecasts: DataFrame) -> DataFrame:
    """Full outer join of per-target forecasts."""
    out = forecasts[0]
    for f in forecasts[1:]:
        out = out.join(f, ["PULocationID", "VendorID", "timestamp"], "full")
    return out


def with_fallback(
    df: DataFrame,
    specific: DataFrame,
    general: DataFrame,
    specific_on: Sequence[str],
    general_on: Sequence[str],
    value: str,
    fallback: str,
) -> DataFrame:
    """Specific value, else the general one."""
    return (
        df.join(specific, list(specific_on), "left")
        .join(general, list(general_on), "left")
        .withColumn(value, F.coalesce(value, fallback))
    )


def route_to_segment(df: DataFrame, router: DataFrame, default: str = "BASELINE") -> DataFrame:
    return df.join(router, "Series_ID", "left").withColumn("segment", F.coalesce("segment", F.lit(default)))


def map_areas(values: DataFrame, zones: DataFrame, mapping: DataFrame) -> DataFrame:
    """Area values to every zone of the area; mapping is (Zone, areaName)."""
    return (
        values.join(mapping.select("Zone", "areaName").distinct(), "areaName")
        .join(zones.select("LocationID", "Zone"), "Zone")
        .drop("Zone", "areaName")
    )


def industry_report(report: DataFrame, classes: Sequence[str] = ("Yellow", "Green", "FHV - High Volume")) -> DataFrame:
    """Monthly industry report: typed month and counts for the listed licence classes."""
    from kerbside.functions.text import parse_count
    from kerbside.functions.time import month_to_date

    trips = parse_count(F.col("`Trips Per Day`"))
    drivers = parse_count(F.col("`Unique Drivers`"))
    return report.where(F.col("`License Class`").isin(*classes)).select(
        month_to_date(F.col("`Month/Year`")).alias("month"),
        F.col("`License Class`").alias("type"),
        trips.alias("num_trips"),
        parse_count(F.col("`Unique Vehicles`")).alias("unique_vehicles"),
        drivers.alias("unique_drivers"),
        F.col("`Avg Hours Per Day Per Driver`").alias("m_hours"),
        maths.trips_per_driver(trips, drivers).alias("m_trips_per_driver"),
    )
