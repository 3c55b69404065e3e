"""Numeric, geographic and conditional expressions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kerbside.functions.time import as_col

# Metres per degree, metres per mile, radius of the web-mercator sphere,
# and the three landmarks as (longitude, latitude).
METRES_PER_DEGREE = 111_320
METRES_PER_MILE = 1609.34
MERCATOR_RADIUS = 6_378_137.0
LANDMARKS = {
    "nyc": (-74.001541, 40.724944),
    "chp": (-73.137393, 41.366138),
    "exp": (-74.0375, 40.736),
}


def num(c) -> Column:
    """Column, column name or number."""
    return F.lit(c) if isinstance(c, (int, float)) else as_col(c)


def rad(c: Column) -> Column:
    return c * F.lit(math.pi / 180)


def to_cents(amount: Column | str) -> Column:
    """Money to integer cents, ties to even; 32-bit amounts are multiplied in 32 bits."""
    return F.bround(as_col(amount) * F.lit(100.0).cast("float"), 0).cast("bigint")


def clamp(c: Column | str, low, high) -> Column:
    """Clip to [low, high]; NULL stays NULL."""
    c = as_col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, num(low)), num(high)))


def map_values(c: Column | str, values: Mapping, default) -> Column:
    """Replace values; the rest becomes the default."""
    c = as_col(c)
    out = None
    for key, value in values.items():
        out = F.when(c == key, value) if out is None else out.when(c == key, value)
    return F.lit(default) if out is None else out.otherwise(default)


def label_when(cases: Sequence[tuple[Column, object]], default) -> Column:
    out = F.when(*cases[0])
    for cond, value in cases[1:]:
        out = out.when(cond, value)
    return out.otherwise(default)


def finite_or_zero(c: Column | str) -> Column:
    c = as_col(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(0.0)).otherwise(c)


def log_fwd(c: Column | str, kind: str = "log1p") -> Column:
    c = as_col(c)
    return F.log1p(F.sqrt(c)) if kind == "log1p_sqrt" else F.log1p(c)


def log_inv(c: Column | str, kind: str = "log1p") -> Column:
    back = F.expm1(as_col(c))
    return back * back if kind == "log1p_sqrt" else back


def manhattan_m(lon1, lat1, lon2, lat2) -> Column:
    """Street-grid distance in metres on a locally flat earth."""
    lon1, lat1, lon2, lat2 = map(num, (lon1, lat1, lon2, lat2))
    east = F.abs(lon2 - lon1) * METRES_PER_DEGREE * F.cos(rad((lat1 + lat2) / 2))
    return east + F.abs(lat2 - lat1) * METRES_PER_DEGREE


def bearing_deg(lon1, lat1, lon2, lat2) -> Column:
    """Initial bearing in degrees, north = 0, east = 90."""
    lon1, lat1, lon2, lat2 = (rad(num(c)) for c in (lon1, lat1, lon2, lat2))
    dlon = lon2 - lon1
    y = F.sin(dlon) * F.cos(lat2)
    x = F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(dlon)
    return F.degrees(F.atan2(y, x))


def landmark_distances(
    df: DataFrame, landmarks: Mapping[str, tuple[float, float]] = LANDMARKS
) -> DataFrame:
    """Distance of both trip ends to each landmark."""
    return df.withColumns(
        {
            f"{end}_dist_{name}": manhattan_m(f"{end}_longitude", f"{end}_latitude", lon, lat)
            for name, (lon, lat) in landmarks.items()
            for end in ("pickup", "dropoff")
        }
    )


def haversine_rad(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in radians, inputs in degrees."""
    lat1, lon1, lat2, lon2 = (rad(num(c)) for c in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return 2 * F.asin(F.sqrt(a))


def mercator_xy(lon, lat) -> tuple[Column, Column]:
    """Web-mercator metres."""
    x = rad(num(lon)) * MERCATOR_RADIUS
    y = F.log(F.tan(F.lit(math.pi / 4) + rad(num(lat)) / 2)) * MERCATOR_RADIUS
    return x, y


def planar_m(x1, y1, x2, y2) -> Column:
    """Euclidean metres, rounded to an integer."""
    dx, dy = num(x2) - num(x1), num(y2) - num(y1)
    return F.bround(F.sqrt(dx * dx + dy * dy), 0).cast("bigint")


def temp_discomfort(temperature: Column | str, comfort: float = 20) -> Column:
    return F.abs(as_col(temperature) - comfort)


def denormalise(pred, std, mean, floor: float | None = None) -> Column:
    value = num(pred) * num(std) + num(mean)
    return value if floor is None else F.greatest(value, F.lit(floor))


def hourly_earnings(trips_per_driver, mean_fare, hours) -> Column:
    return F.try_divide(num(trips_per_driver) * num(mean_fare), num(hours))


def idle_hours(hours, trips_per_driver, trip_hours) -> Column:
    return num(hours) - num(trips_per_driver) * num(trip_hours)


def trips_per_driver(trips, drivers) -> Column:
    return F.try_divide(num(trips), num(drivers))


def clean_forecast(df: DataFrame, targets: Sequence[str], digits: Mapping[str, int] | None = None) -> DataFrame:
    """Round quantile forecasts and floor them at zero; demand is whole trips."""
    digits = digits or {}
    cols = {}
    for t in targets:
        for q in ("p10", "p50", "p90"):
            name = f"pred_{t}_{q}"
            n = digits.get(t, 0 if t == "demand" else 2)
            value = F.bround(F.col(name), n)
            cols[name] = F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))
    return df.withColumns(cols)


def closeness(df: DataFrame, col: str, power: float = 0.5, name: str = "closeness") -> DataFrame:
    """1 for the nearest, 0 for the farthest value of the column."""
    far = df.agg(F.max(col)).scalar()
    return df.withColumn(name, 1 - F.pow(F.try_divide(F.col(col), far), F.lit(power)))


def feature_array(*cols: Column | str) -> Column:
    return F.array(*[as_col(c).cast("double") for c in cols])
