"""Group-by reports. All aggregates are partial, so a hot zone or vendor is
reduced before any shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kerbside.functions.time import (
    GROUPING_INTERVAL, duration_hours, duration_minutes, elapsed_seconds, iso_weekday, ntz, trunc_grain, trunc_time,
)
from kerbside.operators.grid import all_zones, observed_grid
from kerbside.operators.lookup import with_od_boroughs, with_station_weather, with_zone_names
from kerbside.operators.prep import in_period, optional_in, positive_duration, valid_zones

ROLLUP_SUMS = ["trip_distance", "fare_amount", "tip_amount", "duration", "tolls_amount", "total_amount"]


def hourly_series(trips: DataFrame, every: str = "1 hour") -> DataFrame:
    """Demand, mean distance and mean amount by vendor, zone and hour.

    Works on batch and streaming input alike.
    """
    return (
        valid_zones(trips)
        .groupBy("VendorID", "PULocationID", F.window("pickup_datetime", every).alias("_w"))
        .agg(
            F.count("*").cast("int").alias("demand"),
            F.avg("trip_distance").cast("float").alias("avg_distance"),
            F.avg("total_amount").cast("float").alias("avg_amount"),
        )
        .select("VendorID", "PULocationID", F.col("_w.start").alias("timestamp"), "demand", "avg_distance", "avg_amount")
    )


def half_hour_series(trips: DataFrame) -> DataFrame:
    return (
        trips.groupBy("VendorID", "PULocationID", trunc_time("pickup_datetime", "30m").alias("pickup_interval"))
        .agg(
            F.count("*").alias("demand"),
            F.avg("total_amount").alias("mean_amount"),
            F.stddev_samp("total_amount").alias("std_amount"),
            F.avg("trip_distance").alias("mean_distance"),
        )
    )


def dashboard_rollup(trips: DataFrame, start=None, end=None) -> DataFrame:
    """Hourly sums by vendor and zone for trips that take time."""
    if start is not None:
        trips = in_period(trips, start, end)
    timed = positive_duration(trips.withColumn("duration", duration_minutes("pickup_datetime", "dropoff_datetime")))
    return timed.groupBy(
        trunc_time("pickup_datetime", "1h").alias("pickup_datetime"),
        "VendorID",
        F.col("PULocationID").cast("smallint").alias("PULocationID"),
    ).agg(F.count("*").alias("count"), *[F.sum(c).alias(c) for c in ROLLUP_SUMS])


def _ratio(numerator: str, denominator: str) -> Column:
    return F.try_divide(F.sum(numerator).cast("double"), F.sum(denominator).cast("double"))




def measures() -> dict[str, Column]:
    """Named dashboard measures over the hourly rollup."""
    return {
        "total_trips": F.sum("count"),
        "total_price": F.sum("fare_amount"),
        "mean_price": _ratio("fare_amount", "count"),
        "total_tip": F.sum("tip_amount"),
        "mean_tip": _ratio("tip_amount", "count"),
        "mean_distance": _ratio("trip_distance", "count"),
        "mean_duration": _ratio("duration", "count"),
        "mean_tip_time": _ratio("tip_amount", "duration"),
        "mean_tip_dis": _ratio("tip_amount", "trip_distance"),
        "mean_price_time": _ratio("fare_amount", "duration"),
        "mean_price_dis": _ratio("fare_amount", "trip_distance"),
    }


def _selected(variables: Sequence[str]) -> list[Column]:
    known = measures()
    chosen = [known[v].alias(v) for v in variables if v in known]
    if not chosen:
        raise ValueError("no known variable")
    return chosen


def _filtered(rollup, start, end, vendors, zones):
    return optional_in(optional_in(in_period(rollup, start, end), "VendorID", vendors), "PULocationID", zones)


def zone_measures(rollup, ids, variables, start, end, vendors=None, zones=None) -> DataFrame:
    """Measures per zone for a period; zones without trips get zeros."""
    agg = _filtered(rollup, start, end, vendors, zones).groupBy("PULocationID").agg(*_selected(variables))
    return all_zones(optional_in(ids, "PULocationID", zones), agg)


def zone_measures_over_time(rollup, ids, variables, start, end, grouping="day", vendors=None, zones=None) -> DataFrame:
    """Measures per zone and bucket, zero-filled over the buckets that occur."""
    interval = GROUPING_INTERVAL[grouping]
    agg = (
        _filtered(rollup, start, end, vendors, zones)
        .groupBy("PULocationID", trunc_time("pickup_datetime", interval).alias("time_bucket"))
        .agg(*_selected(variables))
    )
    first, last = trunc_time(ntz(start), interval), trunc_time(ntz(end), interval)
    return observed_grid(optional_in(ids, "PULocationID", zones), agg, first, last, interval)


def zone_popularity(rollup: DataFrame) -> DataFrame:
    """Total trips by zone, most popular first."""
    return rollup.groupBy("PULocationID").agg(F.sum("count").alias("total_trips")).orderBy(F.desc("total_trips"), "PULocationID")


def dedupe_points(points: DataFrame, keys: Sequence[str] = ("x", "y", "DBA")) -> DataFrame:
    """Mean score by place; NULL names form their own group."""
    return points.groupBy(*keys).agg(F.avg("SCORE").alias("SCORE"))


def mean_by_zone_hour(rollup: DataFrame, days: Sequence[int] | None = None) -> DataFrame:
    """Mean rollup count by zone and hour of day, one vote per rollup row."""
    rows = optional_in(rollup.withColumn("_day", iso_weekday("pickup_datetime")), "_day", days)
    return rows.groupBy("PULocationID", F.hour("pickup_datetime").alias("hour")).agg(F.avg("count").alias("count"))


def monthly_mean_of_daily_means(trips: DataFrame, value: str = "total_amount") -> DataFrame:
    """Mean over the days of a month of the daily mean, by type."""
    daily = trips.groupBy("type", F.to_date("pickup_datetime").alias("day")).agg(F.avg(value).alias("daily_avg"))
    return daily.groupBy("type", F.trunc("day", "month").alias("month")).agg(F.avg("daily_avg").alias("monthly_avg"))


def monthly_mean_duration(trips: DataFrame) -> DataFrame:
    return trips.groupBy(F.trunc(F.to_date("pickup_datetime"), "month").alias("month"), "type").agg(
        F.avg(duration_hours("pickup_datetime", "dropoff_datetime")).alias("avg_trip_duration_h")
    )


def od_matrix(trips: DataFrame, lookup: DataFrame) -> DataFrame:
    """Trips by year, borough pair and type.

    Zones are counted first, so names are joined to at most zones x zones rows.
    """
    counted = trips.groupBy(
        trunc_grain("pickup_datetime", "year").alias("bucket"), "PULocationID", "DOLocationID", "type"
    ).agg(F.count("*").alias("_n"))
    return with_od_boroughs(counted, lookup).groupBy("bucket", "PUborough", "DOborough", "type").agg(F.sum("_n").alias("trips"))


def zone_trips_by(trips: DataFrame, lookup: DataFrame, grain: str) -> DataFrame:
    """Trips by bucket, zone name and type; counted by zone id before the name join."""
    counted = trips.groupBy(trunc_grain("pickup_datetime", grain).alias("bucket"), "PULocationID", "type").agg(
        F.count("*").alias("_n")
    )
    return with_zone_names(counted, lookup).groupBy("bucket", "zone", "type").agg(F.sum("_n").alias("trips"))


def weather_hour_profile(trips: DataFrame, lookup: DataFrame, weather: DataFrame, flag: str) -> DataFrame:
    """Mean hourly trips by hour of day, zone and weather flag ('rain' or 'snow')."""
    hourly = trips.groupBy(trunc_time("pickup_datetime", "1h").alias("bucket"), "PULocationID").agg(F.count("*").alias("_n"))
    named = with_zone_names(with_station_weather(hourly, weather, "bucket"), lookup)
    counts = named.groupBy("bucket", "zone", flag).agg(F.sum("_n").alias("trips"))
    return counts.groupBy(F.hour("bucket").alias("hour"), "zone", flag).agg(F.avg("trips").alias("avg_trips"))


def zones_per_borough(lookup: DataFrame) -> DataFrame:
    """Number and sorted names of the zones of a borough."""
    return lookup.groupBy("Borough").agg(F.sort_array(F.collect_set("Zone")).alias("zones"))


def time_bounds(df: DataFrame, ts: str) -> DataFrame:
    return df.agg(F.min(ts).alias("first"), F.max(ts).alias("last"))


def latest_per_zone(rent: DataFrame, ids: DataFrame, start, end) -> DataFrame:
    """Rent of the newest month within the period, zero for zones without one."""
    newest = (
        rent.where(F.col("Date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
        .groupBy(F.col("LocationID").alias("PULocationID"))
        .agg(F.max_by("AskingRent", "Date").alias("asking_rent"))
    )
    return all_zones(ids, newest)


def series_features(series: DataFrame, key: str = "Series_ID", ts: str = "timestamp") -> DataFrame:
    """Volume, variability and rhythm of each series."""
    eps = 1e-4
    span = elapsed_seconds(series.agg(F.min(ts)).scalar(), series.agg(F.max(ts)).scalar())
    hours = F.greatest(F.lit(1.0), F.bround(span / 3600.0, 0))
    h, demand = F.hour(ts), F.col("demand")

    def total_if(cond: Column) -> Column:
        return F.sum(F.when(cond, demand).otherwise(0))

    base = series.groupBy(key).agg(
        F.sum("demand").alias("total_demand"),
        F.stddev_samp("demand").alias("std_demand"),
        total_if(F.weekday(ts) >= 5).alias("weekend_demand"),
        total_if(h.between(7, 10)).alias("morning_demand"),
        total_if(h.between(16, 19)).alias("evening_demand"),
        F.count("demand").alias("active_hours"),
    )
    base = base.withColumn("mean_real", F.col("total_demand") / hours)
    base = base.withColumn("cv", F.coalesce(F.col("std_demand") / (F.col("mean_real") + eps), F.lit(0.0)))
    return base.withColumns(
        {
            "cv2": F.col("cv") * F.col("cv"),
            "adi": F.when(F.col("active_hours") > 0, hours / F.col("active_hours")).otherwise(F.lit(float("inf"))),
            "weekend_ratio": F.col("weekend_demand") / (F.col("total_demand") + eps),
            "morning_ratio": F.col("morning_demand") / (F.col("total_demand") + eps),
            "evening_ratio": F.col("evening_demand") / (F.col("total_demand") + eps),
        }
    )


def mean_volume(series: DataFrame, key: str = "Series_ID") -> DataFrame:
    return series.groupBy(key).agg(F.avg("demand").alias("mean_demand"))


def segment_summary(features: DataFrame) -> DataFrame:
    return features.groupBy("segment").agg(
        F.count("*").alias("zones"),
        F.avg("mean_real").alias("mean_volume"),
        F.avg("cv").alias("mean_cv"),
        F.avg("adi").alias("mean_adi"),
        F.min("mean_real").alias("min_volume"),
        F.max("mean_real").alias("max_volume"),
    )


def tip_incidence(trips: DataFrame) -> DataFrame:
    """Trips without and with tip, and the share without, by vendor."""
    without, tipped = F.count_if(F.col("tip_amount") == 0), F.count_if(F.col("tip_amount") > 0)
    return trips.groupBy("VendorID").agg(
        without.alias("without_tip"), tipped.alias("with_tip"), F.try_divide(without, without + tipped).alias("share_without")
    )


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.corr(a, b).alias("correlation"))


def top_routes(trips: DataFrame, k: int = 6) -> DataFrame:
    """The k busiest origin-destination pairs."""
    return (
        trips.groupBy("PULocationID", "DOLocationID")
        .agg(F.count("*").alias("total_trips"))
        .orderBy(F.desc("total_trips"), "PULocationID", "DOLocationID")
        .limit(k)
    )


def latest_rows(df: DataFrame, vendor: int, zone: int, n: int = 100, ts: str = "timestamp") -> DataFrame:
    """The last n rows of one series."""
    return df.where((F.col("VendorID") == vendor) & (F.col("PULocationID") == zone)).orderBy(F.desc(ts)).limit(n)


def ordered(df: DataFrame, *cols: Column | str) -> DataFrame:
    return df.orderBy(*cols)
