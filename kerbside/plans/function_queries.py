"""Queries for scalar functions and reshaping."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from kerbside.functions import maths as N
from kerbside.functions import shape as SH
from kerbside.functions import text as X
from kerbside.functions import time as T
from kerbside.plans import bindings as B
from kerbside.plans.registry import register, with_tables
from kerbside.plans.rollup_queries import rounded


def events(s, d):
    return B.table(s, d, "events")


def orders(s, d):
    return B.table(s, d, "orders")


register("trunc_time",
         lambda s, d: events(s, d).select("event_id", *[T.trunc_time("ts", i).alias(f"t_{i}") for i in ("1s", "30m", "1h", "1d", "7d")]),
         """SELECT event_id, date_trunc('second', ts) AS t_1s, time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01') AS t_30m, date_trunc('hour', ts) AS t_1h,
           CAST(date_trunc('day', ts) AS TIMESTAMP) AS t_1d, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS t_7d FROM events""")
register("trunc_grain",
         lambda s, d: events(s, d).select("event_id", *[T.trunc_grain("ts", g).alias(g) for g in ("year", "month", "day", "hour")]),
         """SELECT event_id, CAST(date_trunc('year', ts) AS TIMESTAMP) AS year, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day,
           date_trunc('hour', ts) AS hour FROM events""")
register("add_months_to", lambda s, d: orders(s, d).select("o_orderkey", T.add_months_to(F.to_date("o_orderdate"), 1).alias("following")),
         "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS following FROM orders")
register("calendar_parts", lambda s, d: T.calendar_parts(events(s, d).select("event_id", "ts"), "ts"),
         """SELECT event_id, ts, CAST(hour(ts) AS INTEGER) AS hour, CAST(month(ts) AS INTEGER) AS month, CAST(dayofyear(ts) AS INTEGER) AS dayofyear,
           CAST(isodow(ts) AS INTEGER) AS weekday FROM events""")
register("fractional_hour", lambda s, d: events(s, d).select("event_id", T.fractional_hour("ts").alias("hour")),
         "SELECT event_id, hour(ts) + minute(ts) / 60.0::DOUBLE AS hour FROM events")
register("duration_minutes",
         lambda s, d: events(s, d).select("event_id", T.duration_minutes(T.trunc_time("ts", "1d"), "ts").alias("minutes"), T.duration_hours(T.trunc_time("ts", "1d"), "ts").alias("hours")),
         """SELECT event_id, (epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 60000000.0::DOUBLE AS minutes,
           (epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 3600000000.0::DOUBLE AS hours FROM events""")
register("month_to_date",
         lambda s, d: orders(s, d).select("o_orderkey", T.month_to_date(F.when(F.col("o_orderkey") % 7 != 0, F.date_format("o_orderdate", "yyyy-MM")).otherwise("n/a")).alias("month")),
         "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(date_trunc('month', o_orderdate) AS DATE) END AS month FROM orders")
register("time_signature_flags", lambda s, d: T.time_signature_flags(events(s, d).select("event_id", "ts"), "ts"),
         """SELECT event_id, ts, isodow(ts) >= 6 AS is_weekend, hour(ts) BETWEEN 7 AND 10 AS is_morning, hour(ts) BETWEEN 16 AND 19 AS is_evening FROM events""")


def _cyclic(s, d):
    out = {}
    half_hour = F.hour("ts") + F.floor(F.minute("ts") / 30) / 2
    for name, col, period in (("half_hour", half_hour, 24), ("month", F.month("ts"), 12), ("doy", F.dayofyear("ts"), 366)):
        out[f"{name}_sin"], out[f"{name}_cos"] = T.cyclic(col, period)
    return rounded(events(s, d).select("event_id", "ts").withColumns(out), 9, *out).drop("ts")


def circle(name, expr, period):
    return f"round(sin({expr} * {2 * math.pi / period!r}), 9) AS {name}_sin, round(cos({expr} * {2 * math.pi / period!r}), 9) AS {name}_cos"


register("cyclic", _cyclic, "SELECT event_id, " + circle("half_hour", "(hour(ts) + floor(minute(ts) / 30) / 2)", 24) + ", " + circle("month", "month(ts)", 12) + ", "
         + circle("doy", "dayofyear(ts)", 366) + " FROM events")
register("with_cyclic_calendar",
         lambda s, d: rounded(T.with_cyclic_calendar(B.series(s, d).select("VendorID", "PULocationID", "timestamp")), 9, "hour_sin", "hour_cos", "dow_sin", "dow_cos"),
         with_tables(B.EVENT_TRIPS, B.SERIES, select='SELECT VendorID, PULocationID, "timestamp", CAST(hour("timestamp") AS INTEGER) AS hour, CAST(isodow("timestamp") AS INTEGER) AS dow, '
                     + circle("hour", 'hour("timestamp")', 24) + ", " + circle("dow", 'isodow("timestamp")', 7) + " FROM series"))
register("epoch_ms_to_day", lambda s, d: orders(s, d).select("o_orderkey", T.epoch_ms_to_day(F.unix_date(F.to_date("o_orderdate")) * F.lit(86_400_000).cast("bigint") + F.col("o_custkey") % 2).alias("day")),
         "SELECT o_orderkey, CAST(o_orderdate + to_days(CAST(o_custkey % 2 AS INTEGER)) AS DATE) AS day FROM orders")
register("time_spine",
         lambda s, d: T.time_spine(s, events(s, d).agg(F.min(T.trunc_time("ts", "1h"))).scalar(), events(s, d).agg(F.max("ts") + F.expr("INTERVAL 48 HOUR")).scalar(), "1h"),
         """SELECT unnest(generate_series(date_trunc('hour', min(ts)), max(ts) + INTERVAL 48 HOUR, INTERVAL 1 HOUR)) AS "timestamp" FROM events""")


def _spans(s, d):
    return orders(s, d).groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


SPANS = "spans AS (SELECT o_custkey, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders GROUP BY 1)"
register("choose_grain", lambda s, d: _spans(s, d).select("o_custkey", T.choose_grain(F.col("first"), F.col("last")).alias("grain")),
         with_tables(SPANS, select="""SELECT o_custkey, CASE WHEN last - first <= INTERVAL 7 DAY THEN 'hour' WHEN last - first <= INTERVAL 365 DAY THEN 'day' ELSE 'week' END AS grain FROM spans"""))
register("chart_grain", lambda s, d: _spans(s, d).select("o_custkey", T.chart_grain(F.col("first"), F.col("last")).alias("grain")),
         with_tables(SPANS, select="""SELECT o_custkey, CASE WHEN date_diff('day', first, last) >= 365 THEN 'month' WHEN date_diff('day', first, last) >= 5 THEN 'day' ELSE 'hour' END AS grain FROM spans"""))
register("parse_count",
         lambda s, d: orders(s, d).select("o_orderkey", X.parse_count(F.when(F.col("o_custkey") % 5 == 0, F.col("o_orderpriority")).otherwise(F.format_number(F.floor(F.col("o_totalprice")), 0))).alias("n")),
         "SELECT o_orderkey, CASE WHEN o_custkey % 5 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS n FROM orders")
register("parse_decimal_comma", lambda s, d: B.table(s, d, "customer").select("c_custkey", X.parse_decimal_comma(F.replace(F.format_string("%.2f", "c_acctbal"), F.lit("."), F.lit(","))).alias("v")),
         "SELECT c_custkey, c_acctbal AS v FROM customer")


def _landmarks(s, d):
    from kerbside.operators.refdata import landmark_points

    key = F.col("c_custkey")
    text = F.concat(F.lit("New York / 40."), (key % 90 + 10).cast("string"), F.lit("°N 74."), (key % 80 + 10).cast("string"), F.lit("°W"))
    raw = B.table(s, d, "customer").select(F.col("c_name").alias("Landmark name"), F.when(key % 6 != 0, text).otherwise("unknown").alias("Location"))
    return landmark_points(raw)


register("extract_latlon", _landmarks, """SELECT c_name AS "Landmark name", CASE WHEN c_custkey % 6 <> 0 THEN CAST('40.' || (c_custkey % 90 + 10) AS DOUBLE) END AS Latitude,
  CASE WHEN c_custkey % 6 <> 0 THEN -CAST('74.' || (c_custkey % 80 + 10) AS DOUBLE) END AS Longitude FROM customer""")
register("series_key", lambda s, d: B.event_trips(s, d).select("event_id", X.series_key("VendorID", "PULocationID").alias("key"), X.route_label("PULocationID", "DOLocationID").alias("route")),
         with_tables(B.EVENT_TRIPS, select="SELECT event_id, VendorID || '_' || PULocationID AS key, 'PU: ' || PULocationID || ' -> DO: ' || DOLocationID AS route FROM trips_e"))


def _split_keys(s, d):
    vendor, zone = X.split_series_key("Series_ID")
    return B.keyed_series(s, d).select("Series_ID", vendor.alias("vendor"), zone.alias("zone")).distinct()


register("split_series_key", _split_keys, with_tables(B.EVENT_TRIPS, select="SELECT DISTINCT VendorID || '_' || PULocationID AS Series_ID, VendorID AS vendor, PULocationID AS zone FROM trips_e"))
register("log_fwd_inv",
         lambda s, d: rounded(events(s, d).select("event_id", N.log_fwd("value").alias("a"), N.log_fwd("value", "log1p_sqrt").alias("b"),
                                                  N.log_inv(N.log_fwd("value")).alias("c"), N.log_inv(N.log_fwd("value", "log1p_sqrt"), "log1p_sqrt").alias("e")), 6, "a", "b", "c", "e"),
         "SELECT event_id, round(ln(1 + value), 6) AS a, round(ln(1 + sqrt(value)), 6) AS b, round(value, 6) AS c, round(value, 6) AS e FROM events")
ENDS = """ends AS (SELECT event_id, 40.5 + 0.02::DOUBLE * PULocationID AS lat1, -74.25 + 0.03::DOUBLE * (PULocationID % 7) AS lon1,
  40.5 + 0.02::DOUBLE * DOLocationID AS lat2, -74.25 + 0.03::DOUBLE * (DOLocationID % 7) AS lon2 FROM trips_e)"""


def _ends(s, d):
    pu, do = F.col("PULocationID"), F.col("DOLocationID")
    return B.event_trips(s, d).select(
        "event_id", (F.lit(40.5) + F.lit(0.02) * pu).alias("lat1"), (F.lit(-74.25) + F.lit(0.03) * (pu % 7)).alias("lon1"),
        (F.lit(40.5) + F.lit(0.02) * do).alias("lat2"), (F.lit(-74.25) + F.lit(0.03) * (do % 7)).alias("lon2"),
    )


def manhattan_sql(lon1, lat1, lon2, lat2):
    return f"(abs({lon2} - ({lon1})) * 111320 * cos(radians(({lat1} + {lat2}) / 2)) + abs({lat2} - {lat1}) * 111320)"


def bearing_sql(lon1, lat1, lon2, lat2):
    dlon = f"(radians({lon2}) - radians({lon1}))"
    return (f"degrees(atan2(sin{dlon} * cos(radians({lat2})), cos(radians({lat1})) * sin(radians({lat2})) "
            f"- sin(radians({lat1})) * cos(radians({lat2})) * cos{dlon}))")


def haversine_sql(lat1, lon1, lat2, lon2):
    return (f"(2 * asin(sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
            f"* pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))))")


MERCATOR_X, MERCATOR_Y = "radians({lon}) * 6378137.0::DOUBLE", "ln(tan(pi() / 4 + radians({lat}) / 2)) * 6378137.0::DOUBLE"
ARGS = ("lon1", "lat1", "lon2", "lat2")
register("manhattan_m", lambda s, d: rounded(_ends(s, d).select("event_id", N.manhattan_m(*ARGS).alias("m")), 5, "m"),
         with_tables(B.EVENT_TRIPS, ENDS, select=f"SELECT event_id, round({manhattan_sql(*ARGS)}, 5) AS m FROM ends"))
register("bearing_deg", lambda s, d: rounded(_ends(s, d).select("event_id", N.bearing_deg(*ARGS).alias("b")), 6, "b"),
         with_tables(B.EVENT_TRIPS, ENDS, select=f"SELECT event_id, round({bearing_sql(*ARGS)}, 6) AS b FROM ends"))
register("haversine_rad", lambda s, d: rounded(_ends(s, d).select("event_id", N.haversine_rad("lat1", "lon1", "lat2", "lon2").alias("h")), 9, "h"),
         with_tables(B.EVENT_TRIPS, ENDS, select=f"SELECT event_id, round({haversine_sql('lat1', 'lon1', 'lat2', 'lon2')}, 9) AS h FROM ends"))


def _mercator(s, d):
    (xa, ya), (xb, yb) = N.mercator_xy("lon1", "lat1"), N.mercator_xy("lon2", "lat2")
    return rounded(_ends(s, d).select("event_id", xa.alias("x"), ya.alias("y"), N.planar_m(xa, ya, xb, yb).alias("metres")), 4, "x", "y")


register("mercator_xy", _mercator, with_tables(B.EVENT_TRIPS, ENDS, f"""m AS (SELECT event_id, {MERCATOR_X.format(lon='lon1')} AS xa, {MERCATOR_Y.format(lat='lat1')} AS ya,
  {MERCATOR_X.format(lon='lon2')} AS xb, {MERCATOR_Y.format(lat='lat2')} AS yb FROM ends)""", select="""SELECT event_id, round(xa, 4) AS x, round(ya, 4) AS y,
  CAST(round_even(sqrt((xb - xa) * (xb - xa) + (yb - ya) * (yb - ya)), 0) AS BIGINT) AS metres FROM m"""))
NAMED = {"lon1": "pickup_longitude", "lat1": "pickup_latitude", "lon2": "dropoff_longitude", "lat2": "dropoff_latitude"}
LAND = [f"{end}_dist_{n}" for n in N.LANDMARKS for end in ("pickup", "dropoff")]
LAND_SQL = ", ".join(
    f"round({manhattan_sql(lo, la, f'{lon}::DOUBLE', f'{lat}::DOUBLE')}, 5) AS {end}_dist_{n}"
    for n, (lon, lat) in N.LANDMARKS.items() for end, lo, la in (("pickup", "lon1", "lat1"), ("dropoff", "lon2", "lat2"))
)
register("landmark_distances", lambda s, d: rounded(N.landmark_distances(_ends(s, d).withColumnsRenamed(NAMED)), 5, *LAND).select("event_id", *LAND),
         with_tables(B.EVENT_TRIPS, ENDS, select=f"SELECT event_id, {LAND_SQL} FROM ends"))
register("closeness", lambda s, d: rounded(N.closeness(events(s, d).select("event_id", "value"), "value"), 9, "closeness"),
         "SELECT event_id, value, round(1 - pow(value / (SELECT max(value) FROM events), 0.5::DOUBLE), 9) AS closeness FROM events")
register("temp_discomfort", lambda s, d: B.climate(s, d).select("hour_key", N.temp_discomfort("temperature_2m").alias("t")),
         with_tables(B.DAYS, B.CLIMATE, select="SELECT hour_key, abs(temperature_2m - 20) AS t FROM climate"))


def _clean(s, d):
    v = F.col("value")
    cols = {f"pred_{t}_{q}": (v - k) * f for t, f in (("demand", 0.25), ("amount", 1.0)) for q, k in (("p10", 30.0), ("p50", 0.0), ("p90", -30.0))}
    return N.clean_forecast(events(s, d).select("event_id", *[c.alias(n) for n, c in cols.items()]), ["demand", "amount"])


register("clean_forecast", _clean, "SELECT event_id, " + ", ".join(
    f"greatest(round_even((value - {k}::DOUBLE) * {f}::DOUBLE, {n}), 0) AS pred_{t}_{q}"
    for t, f, n in (("demand", 0.25, 0), ("amount", 1.0, 2)) for q, k in (("p10", 30.0), ("p50", 0.0), ("p90", -30.0))) + " FROM events")
register("driver_ratios",
         lambda s, d: events(s, d).select("event_id", N.hourly_earnings("value", "user_id", F.col("event_id") % 5).alias("earnings"),
                                          N.idle_hours("value", "user_id", F.lit(0.25)).alias("idle"), N.trips_per_driver("value", F.col("user_id") % 3).alias("per_driver")),
         """SELECT event_id, value * user_id / nullif(event_id % 5, 0) AS earnings, value - user_id * 0.25::DOUBLE AS idle, value / nullif(user_id % 3, 0) AS per_driver FROM events""")
register("denormalise", lambda s, d: events(s, d).select("event_id", N.denormalise("value", F.lit(-2.0), "user_id", 0.0).alias("v"), N.denormalise("value", F.lit(-2.0), "user_id").alias("raw")),
         "SELECT event_id, greatest(value * -2.0::DOUBLE + user_id, 0) AS v, value * -2.0::DOUBLE + user_id AS raw FROM events")
register("feature_array", lambda s, d: events(s, d).select("event_id", N.feature_array("value", "user_id").alias("features"), F.size(N.feature_array("value", "user_id")).alias("n"),
                                                           F.element_at(N.feature_array("value", "user_id"), -1).alias("last")),
         "SELECT event_id, [value, user_id::DOUBLE] AS features, 2 AS n, user_id::DOUBLE AS last FROM events")


def _nested(s, d):
    from kerbside.operators.rollup import zone_measures_over_time

    grid = zone_measures_over_time(B.rollup(s, d), B.ids(s, d), ["total_trips", "total_price"], "1995-01-01", "2002-01-01", "week")
    nested = SH.nest_by_time_zone(grid, "time_bucket", "PULocationID", ["total_trips", "total_price"])
    return nested.select("variable", "time_bucket", F.explode("zones").alias("zone", "value"))


register("nest_by_time_zone", _nested, with_tables(B.TRIPS, B.ROLLUP, """agg AS (SELECT PULocationID AS z, time_bucket(INTERVAL 7 DAY, pickup_datetime, TIMESTAMP '1970-01-01') AS time_bucket, sum("count") AS n, sum(fare_amount) AS f
    FROM rollup_ GROUP BY 1, 2)""",
    """grid AS (SELECT z.z, b.time_bucket, coalesce(n, 0)::BIGINT AS n, coalesce(f, 0)::BIGINT AS f FROM (SELECT n_nationkey AS z FROM nation) z, (SELECT DISTINCT time_bucket FROM agg) b
      LEFT JOIN agg a ON a.z = z.z AND a.time_bucket = b.time_bucket)""",
    select="""SELECT 'total_trips' AS variable, time_bucket, CAST(z AS SMALLINT) AS zone, n::DOUBLE AS value FROM grid
      UNION ALL SELECT 'total_price', time_bucket, CAST(z AS SMALLINT), f::DOUBLE FROM grid"""))
# one column per month that orders can have
MONTHS = [f"{year}-{m:02d}" for year in range(1995, 2002) for m in range(1, 13)]


def wide_rent(s, d):
    joined = orders(s, d).join(B.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    month = F.date_format("o_orderdate", "yyyy-MM")
    cells = [F.max(F.when(month == m, F.col("o_totalprice"))).alias(m) for m in MONTHS]
    return joined.groupBy(F.concat(F.lit("area "), F.col("o_custkey") % 200).alias("areaName"), F.col("c_mktsegment").alias("Borough")).agg(*cells)


WIDE = """wide AS (SELECT 'area ' || (o_custkey % 200) AS areaName, c_mktsegment AS Borough, """ + ", ".join(
    f"""max(CASE WHEN strftime(o_orderdate, '%Y-%m') = '{m}' THEN o_totalprice END) AS "{m}\"""" for m in MONTHS
) + " FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"
register("months_to_long", lambda s, d: SH.months_to_long(wide_rent(s, d), ["areaName", "Borough"]),
         with_tables(WIDE, select="""SELECT areaName, Borough, CAST(m || '-01' AS DATE) AS "Date", AskingRent FROM wide UNPIVOT INCLUDE NULLS (AskingRent FOR m IN (""" + ", ".join(f'"{m}"' for m in MONTHS) + "))"))
register("encode_static",
         lambda s, d: SH.encode_static(B.event_trips(s, d).select("event_id", "VendorID", F.col("PULocationID").cast("double").alias("Latitude")), "VendorID", [0, 1, 2, 3], ["Latitude"]),
         with_tables(B.EVENT_TRIPS, select="""SELECT event_id, VendorID, (PULocationID - (SELECT min(PULocationID) FROM trips_e))::DOUBLE / (SELECT max(PULocationID) - min(PULocationID) FROM trips_e) AS Latitude,
           (VendorID = 1)::INTEGER::DOUBLE AS VendorID_1, (VendorID = 2)::INTEGER::DOUBLE AS VendorID_2, (VendorID = 3)::INTEGER::DOUBLE AS VendorID_3 FROM trips_e"""))
register("one_hot", lambda s, d: SH.one_hot(B.event_trips(s, d).select("event_id", "VendorID"), "VendorID", [0, 1, 2]),
         with_tables(B.EVENT_TRIPS, select="SELECT event_id, VendorID, (VendorID = 0)::INTEGER::DOUBLE AS VendorID_0, (VendorID = 1)::INTEGER::DOUBLE AS VendorID_1, (VendorID = 2)::INTEGER::DOUBLE AS VendorID_2 FROM trips_e"))
register("label_codes", lambda s, d: SH.label_codes(events(s, d).select("event_id", "event_type"), "event_type", "code"),
         "SELECT event_id, event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS code FROM events")
register("label_codes_of_ids", lambda s, d: SH.label_codes(events(s, d).select("event_id", "value"), "value", "code"),
         "SELECT event_id, value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS INTEGER) AS code FROM events")
register("label_when",
         lambda s, d: events(s, d).select("event_id", N.label_when([(F.col("value") > 100, "high"), (F.col("value") > 20, "mid")], "low").alias("label")),
         "SELECT event_id, CASE WHEN value > 100 THEN 'high' WHEN value > 20 THEN 'mid' ELSE 'low' END AS label FROM events")
