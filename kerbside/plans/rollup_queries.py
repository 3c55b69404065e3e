"""Queries for lookups, grids, roll-ups and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbside.functions.time import trunc_grain
from kerbside.operators import grid as G
from kerbside.operators import lookup as J
from kerbside.operators import rollup as A
from kerbside.operators import sketches as SK
from kerbside.operators import stats as ST
from kerbside.plans import bindings as B
from kerbside.scratch import cut_lineage
from kerbside.plans.registry import register, with_tables

START, END = "1996-03-01", "1996-03-15"
PERIOD = "pickup_datetime BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-03-15'"

# --- lookups ---------------------------------------------------------------------

register("with_centroids", lambda s, d: J.with_centroids(B.series(s, d), B.centroids(s, d)),
         with_tables(B.EVENT_TRIPS, B.SERIES, B.CENTROIDS, select="""SELECT s.*, Latitude, Longitude FROM series s
           LEFT JOIN centroids c ON s.PULocationID = c.locationid"""))
register("with_od_centroids",
         lambda s, d: J.with_od_centroids(B.event_trips(s, d), B.centroids(s, d))
         .select("event_id", "pickup_latitude", "pickup_longitude", "dropoff_latitude", "dropoff_longitude"),
         with_tables(B.EVENT_TRIPS, B.CENTROIDS, select="""SELECT event_id, p.Latitude AS pickup_latitude, p.Longitude AS pickup_longitude,
           q.Latitude AS dropoff_latitude, q.Longitude AS dropoff_longitude FROM trips_e
           JOIN centroids p ON PULocationID = p.locationid JOIN centroids q ON DOLocationID = q.locationid"""))
register("with_hourly_climate",
         lambda s, d: J.with_hourly_climate(B.trips(s, d).select("pickup_datetime", "VendorID", "l_orderkey"), B.climate(s, d)),
         with_tables(B.TRIPS, B.DAYS, B.CLIMATE, select="""SELECT pickup_datetime, VendorID, l_orderkey, temperature_2m, rain
           FROM trips JOIN climate ON date_trunc('hour', pickup_datetime) = hour_key"""))
register("with_daily_sun",
         lambda s, d: J.with_daily_sun(B.trips(s, d).select("pickup_datetime", "l_orderkey"), B.sun(s, d)),
         with_tables(B.TRIPS, B.DAYS, B.SUN, select="""SELECT pickup_datetime, l_orderkey, daylight_duration,
           CASE WHEN pickup_datetime BETWEEN sunrise AND sunset THEN 1 ELSE 0 END AS is_daylight
           FROM trips JOIN sun ON CAST(pickup_datetime AS DATE) = date_key"""))
register("with_station_weather",
         lambda s, d: J.with_station_weather(B.trips(s, d).select("pickup_datetime", "l_orderkey"), B.station(s, d)).groupBy("rain", "snow").agg(F.count("*").alias("n")),
         with_tables(B.TRIPS, B.DAYS, B.STATION, select="""SELECT PRCP > 0.41 AS rain, SNOW > 0 AS snow, count(*) AS n FROM trips
           LEFT JOIN station ON CAST(pickup_datetime AS DATE) = "DATE" GROUP BY 1, 2"""))
register("with_zone_names",
         lambda s, d: J.with_zone_names(B.event_trips(s, d), B.lookup(s, d)).select("event_id", "zone"),
         with_tables(B.EVENT_TRIPS, B.LOOKUP, select="""SELECT event_id, coalesce(Zone, 'Unknown') AS zone FROM trips_e
           LEFT JOIN lookup ON PULocationID = LocationID"""))
register("with_od_boroughs",
         lambda s, d: J.with_od_boroughs(B.event_trips(s, d), B.lookup(s, d)).select("event_id", "PUborough", "DOborough"),
         with_tables(B.EVENT_TRIPS, B.LOOKUP, select="""SELECT event_id, coalesce(a.Borough, 'Unknown') AS PUborough,
           coalesce(b.Borough, 'Unknown') AS DOborough FROM trips_e LEFT JOIN lookup a ON PULocationID = a.LocationID
           LEFT JOIN lookup b ON DOLocationID = b.LocationID"""))

# The industry report: text counts by month and licence class.
REPORT = """report AS (SELECT strftime(pickup_datetime, '%Y-%m') AS m, type,
    regexp_replace(CAST(count(*) * 1000 AS VARCHAR), '(\\d+)(\\d{3})$', '\\1,\\2') AS trips_text,
    CASE WHEN count(DISTINCT PULocationID) = 7 THEN 'n/a' ELSE CAST(count(DISTINCT PULocationID) AS VARCHAR) END AS drivers_text,
    avg(trip_distance) AS m_hours FROM trips GROUP BY 1, 2)"""
INDUSTRY = """industry AS (SELECT CAST(m || '-01' AS DATE) AS month, type, TRY_CAST(replace(trips_text, ',', '') AS BIGINT) AS num_trips,
    TRY_CAST(drivers_text AS BIGINT) AS unique_vehicles, TRY_CAST(drivers_text AS BIGINT) AS unique_drivers, m_hours,
    CAST(TRY_CAST(replace(trips_text, ',', '') AS BIGINT) AS DOUBLE) / TRY_CAST(drivers_text AS BIGINT) AS m_trips_per_driver
  FROM report WHERE type IN ('Yellow', 'Green'))"""


def _report(spark, sf):
    n, drivers = F.count("*"), F.countDistinct("PULocationID")
    raw = B.trips(spark, sf).groupBy(F.date_format("pickup_datetime", "yyyy-MM").alias("Month/Year"), F.col("type").alias("License Class")).agg(
        F.regexp_replace((n * 1000).cast("string"), r"(\d+)(\d{3})$", "$1,$2").alias("Trips Per Day"),
        F.when(drivers == 7, "n/a").otherwise(drivers.cast("string")).alias("Unique Vehicles"),
        F.when(drivers == 7, "n/a").otherwise(drivers.cast("string")).alias("Unique Drivers"),
        F.avg("trip_distance").alias("Avg Hours Per Day Per Driver"),
    )
    return J.industry_report(raw, ["Yellow", "Green"])


register("industry_report", _report, with_tables(B.TRIPS, REPORT, INDUSTRY, select="SELECT * FROM industry"))
MONTHLY_FARE = """fares AS (SELECT CAST(date_trunc('month', day) AS DATE) AS month, type, avg(daily_avg) AS monthly_avg FROM
  (SELECT CAST(pickup_datetime AS DATE) AS day, type, avg(total_amount) AS daily_avg FROM trips GROUP BY 1, 2) GROUP BY 1, 2)"""
MONTHLY_DURATION = """durations AS (SELECT CAST(date_trunc('month', pickup_datetime) AS DATE) AS month, type,
  avg((epoch_us(dropoff_datetime) - epoch_us(pickup_datetime)) / 3600000000.0::DOUBLE) AS avg_trip_duration_h FROM trips GROUP BY 1, 2)"""


def rounded(df, digits=6, *cols):
    """Doubles whose last bits depend on summation order, rounded for comparison."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


register("monthly_mean_of_daily_means", lambda s, d: rounded(A.monthly_mean_of_daily_means(B.trips(s, d)), 4, "monthly_avg"),
         with_tables(B.TRIPS, MONTHLY_FARE, select="SELECT month, type, round(monthly_avg, 4) AS monthly_avg FROM fares"))
register("monthly_mean_duration", lambda s, d: rounded(A.monthly_mean_duration(B.trips(s, d)), 9, "avg_trip_duration_h"),
         with_tables(B.TRIPS, MONTHLY_DURATION, select="SELECT month, type, round(avg_trip_duration_h, 9) AS avg_trip_duration_h FROM durations"))


def _earnings(spark, sf):
    report, fares = cut_lineage(_report(spark, sf)), A.monthly_mean_of_daily_means(B.trips(spark, sf))
    df = J.monthly_earnings(report.select("month", "type", "m_hours"), report.select("month", "type", "m_trips_per_driver"), fares)
    return rounded(rounded(df, 4, "monthly_avg"), 2, "hourly_earnings")


register("monthly_earnings", _earnings, with_tables(B.TRIPS, REPORT, INDUSTRY, MONTHLY_FARE, select="""SELECT month, type, m_hours, m_trips_per_driver,
  round(monthly_avg, 4) AS monthly_avg, round(m_trips_per_driver * monthly_avg / m_hours, 2) AS hourly_earnings
  FROM industry JOIN fares USING (month, type)"""))


def _idle(spark, sf):
    report, durations = cut_lineage(_report(spark, sf)), A.monthly_mean_duration(B.trips(spark, sf))
    df = J.monthly_idle(report.select("month", "type", "m_hours"), report.select("month", "type", "m_trips_per_driver"), durations)
    return rounded(df, 9, "avg_trip_duration_h", "free_hours")


register("monthly_idle", _idle, with_tables(B.TRIPS, REPORT, INDUSTRY, MONTHLY_DURATION, select="""SELECT month, type, m_hours, m_trips_per_driver,
  round(avg_trip_duration_h, 9) AS avg_trip_duration_h, round(m_hours - m_trips_per_driver * avg_trip_duration_h, 9) AS free_hours
  FROM industry JOIN durations USING (month, type)"""))
TOP = """top AS (SELECT PULocationID, DOLocationID, count(*) AS total_trips FROM trips GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 6)"""
register("top_routes", lambda s, d: A.top_routes(B.trips(s, d)), with_tables(B.TRIPS, TOP, select="SELECT * FROM top"))
register("restrict_to_routes",
         lambda s, d: J.restrict_to_routes(B.trips(s, d).select("PULocationID", "DOLocationID", "tip_amount"), A.top_routes(B.trips(s, d))),
         with_tables(B.TRIPS, TOP, select="SELECT PULocationID, DOLocationID, tip_amount, total_trips FROM trips JOIN top USING (PULocationID, DOLocationID)"))
register("restrict_to_routes_only",
         lambda s, d: J.restrict_to_routes(B.trips(s, d).select("PULocationID", "DOLocationID", "tip_amount"), A.top_routes(B.trips(s, d)), False),
         with_tables(B.TRIPS, TOP, select="SELECT PULocationID, DOLocationID, tip_amount FROM trips SEMI JOIN top USING (PULocationID, DOLocationID)"))
register("pair_actual_pred",
         lambda s, d: J.pair_actual_pred(B.series(s, d).select("VendorID", "PULocationID", "timestamp", "demand"),
                                         B.preds(s, d).select("VendorID", "PULocationID", "timestamp", "prediction")),
         with_tables(B.EVENT_TRIPS, B.SERIES, B.PREDS, select='SELECT VendorID, PULocationID, "timestamp", demand, prediction FROM preds'))


def _forecast_parts(spark, sf):
    """Three whole tables whose hours overlap only in part."""
    s, hour = B.series(spark, sf), F.expr("INTERVAL 1 HOUR")
    keys = ["PULocationID", "VendorID", "timestamp"]
    return (
        s.select(*keys, "demand"),
        s.withColumn("timestamp", F.col("timestamp") + hour).select(*keys, "avg_amount"),
        s.withColumn("timestamp", F.col("timestamp") - hour).select(*keys, "avg_distance"),
    )


register("merge_forecasts", lambda s, d: J.merge_forecasts(*_forecast_parts(s, d)),
         with_tables(B.EVENT_TRIPS, B.SERIES, """later AS (SELECT PULocationID, VendorID, "timestamp" + INTERVAL 1 HOUR AS "timestamp", avg_amount FROM series)""",
                     """earlier AS (SELECT PULocationID, VendorID, "timestamp" - INTERVAL 1 HOUR AS "timestamp", avg_distance FROM series)""",
                     select="""SELECT PULocationID, VendorID, "timestamp", demand, avg_amount, avg_distance FROM (SELECT PULocationID, VendorID, "timestamp", demand FROM series)
           FULL JOIN later USING (PULocationID, VendorID, "timestamp") FULL JOIN earlier USING (PULocationID, VendorID, "timestamp")"""))
register("with_fallback",
         lambda s, d: J.with_fallback(
             B.event_trips(s, d).select("event_id", "VendorID", "PULocationID"),
             B.event_trips(s, d).where("total_amount > 10000").groupBy("VendorID", "PULocationID").agg(F.max("total_amount").alias("best")),
             B.event_trips(s, d).groupBy("VendorID").agg(F.max("total_amount").alias("general")),
             ["VendorID", "PULocationID"], ["VendorID"], "best", "general"),
         with_tables(B.EVENT_TRIPS, select="""SELECT event_id, VendorID, PULocationID, coalesce(best, general) AS best, general FROM trips_e
           LEFT JOIN (SELECT VendorID, PULocationID, max(total_amount) AS best FROM trips_e WHERE total_amount > 10000 GROUP BY 1, 2) USING (VendorID, PULocationID)
           LEFT JOIN (SELECT VendorID, max(total_amount) AS general FROM trips_e GROUP BY 1) USING (VendorID)"""))


def _router(spark, sf):
    return B.keyed_series(spark, sf).groupBy("Series_ID").agg(F.sum("demand").alias("n")).where("n >= 80").select("Series_ID", F.lit("MID").alias("segment"))


register("route_to_segment",
         lambda s, d: J.route_to_segment(B.keyed_series(s, d).select("Series_ID", "timestamp"), _router(s, d)),
         with_tables(B.EVENT_TRIPS, B.SERIES, B.KEYED, select="""SELECT Series_ID, "timestamp",
           CASE WHEN sum(demand) OVER (PARTITION BY Series_ID) >= 80 THEN 'MID' ELSE 'BASELINE' END AS segment FROM keyed"""))


def _map_areas(spark, sf):
    rent = B.table(spark, sf, "orders").join(B.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("c_mktsegment").alias("areaName"), F.trunc("o_orderdate", "month").alias("Date")).agg(F.max("o_totalprice").alias("AskingRent"))
    zones = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("LocationID"), F.col("c_name").alias("Zone"))
    mapping = B.table(spark, sf, "customer").select(F.col("c_name").alias("Zone"), F.col("c_mktsegment").alias("areaName"))
    latest = rent.groupBy("areaName").agg(F.max_by("AskingRent", "Date").alias("AskingRent"))
    return J.map_areas(latest, zones, mapping.unionByName(mapping))


register("map_areas", _map_areas, """SELECT c_custkey AS LocationID, AskingRent FROM customer JOIN (
    SELECT c_mktsegment, arg_max(r, m) AS AskingRent FROM (SELECT c_mktsegment, date_trunc('month', o_orderdate) AS m, max(o_totalprice) AS r
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY 1) USING (c_mktsegment)""")

# --- grids ------------------------------------------------------------------------------

BUCKETS = """buckets AS (SELECT PULocationID, date_trunc('day', pickup_datetime) AS time_bucket, count(*) AS n FROM trips_e
  GROUP BY 1, 2)"""


def _buckets(spark, sf):
    from kerbside.functions.time import trunc_time

    e = B.event_trips(spark, sf)
    return e.groupBy("PULocationID", trunc_time("pickup_datetime", "1d").alias("time_bucket")).agg(F.count("*").alias("n"))


def _bounds(df, c):
    return df.agg(F.min(c)).scalar(), df.agg(F.max(c)).scalar()


def _int_ids(spark, sf):
    return B.centroids(spark, sf).select(F.col("locationid").alias("PULocationID"))


def _grid(spark, sf):
    return G.zone_time_grid(_int_ids(spark, sf), *_bounds(_buckets(spark, sf), "time_bucket"), "1d")


register("zone_time_grid", _grid, with_tables(B.EVENT_TRIPS, B.CENTROIDS, BUCKETS, select="""SELECT locationid AS PULocationID, time_bucket FROM centroids,
  (SELECT unnest(generate_series(min(time_bucket), max(time_bucket), INTERVAL 1 DAY)) AS time_bucket FROM buckets)"""))
register("fill_grid", lambda s, d: G.fill_grid(_grid(s, d), _buckets(s, d), ["PULocationID", "time_bucket"]),
         with_tables(B.EVENT_TRIPS, B.CENTROIDS, BUCKETS, select="""SELECT g.PULocationID, g.time_bucket, coalesce(n, 0) AS n FROM
           (SELECT locationid AS PULocationID, time_bucket FROM centroids,
            (SELECT unnest(generate_series(min(time_bucket), max(time_bucket), INTERVAL 1 DAY)) AS time_bucket FROM buckets)) g
           LEFT JOIN buckets b ON g.PULocationID = b.PULocationID AND g.time_bucket = b.time_bucket"""))
register("observed_grid", lambda s, d: G.observed_grid(_int_ids(s, d), _buckets(s, d), *_bounds(_buckets(s, d), "time_bucket"), "1d"),
         with_tables(B.EVENT_TRIPS, B.CENTROIDS, BUCKETS, select="""SELECT g.PULocationID, g.time_bucket, coalesce(n, 0) AS n FROM
           (SELECT locationid AS PULocationID, time_bucket FROM centroids, (SELECT DISTINCT time_bucket FROM buckets)) g
           LEFT JOIN buckets b ON g.PULocationID = b.PULocationID AND g.time_bucket = b.time_bucket"""))
register("all_zones", lambda s, d: G.all_zones(_int_ids(s, d), _buckets(s, d).groupBy("PULocationID").agg(F.sum("n").alias("n"))),
         with_tables(B.EVENT_TRIPS, B.CENTROIDS, BUCKETS, select="""SELECT locationid AS PULocationID, CAST(coalesce(sum(n), 0) AS BIGINT) AS n
           FROM centroids LEFT JOIN buckets ON locationid = PULocationID GROUP BY 1"""))
register("complete_spine", lambda s, d: G.complete_spine(B.series(s, d), ["VendorID", "PULocationID"], "timestamp", "1h"),
         with_tables(B.EVENT_TRIPS, B.SERIES, B.FULL, select="SELECT * FROM full_"))
register("complete_spine_global", lambda s, d: G.complete_spine(B.series(s, d), ["VendorID", "PULocationID"], "timestamp", "1h", "global").fillna(0),
         with_tables(B.EVENT_TRIPS, B.SERIES, B.FULL_GLOBAL, select="""SELECT VendorID, PULocationID, "timestamp", coalesce(demand, 0) AS demand,
           coalesce(avg_distance, 0) AS avg_distance, coalesce(avg_amount, 0) AS avg_amount FROM full_g"""))

# --- roll-ups ------------------------------------------------------------------------------

register("hourly_series", lambda s, d: A.hourly_series(B.trips(s, d)),
         with_tables(B.TRIPS, select="""SELECT VendorID, PULocationID, date_trunc('hour', pickup_datetime) AS "timestamp", CAST(count(*) AS INTEGER) AS demand,
           CAST(avg(trip_distance) AS FLOAT) AS avg_distance, CAST(avg(total_amount) AS FLOAT) AS avg_amount FROM trips GROUP BY 1, 2, 3"""))
register("hourly_series_of_hub", lambda s, d: A.hourly_series(B.hub(s, d)),
         with_tables(B.RAW, B.HUB, select="""SELECT VendorID, PULocationID, date_trunc('hour', pickup_datetime) AS "timestamp", CAST(count(*) AS INTEGER) AS demand,
           CAST(avg(trip_distance) AS FLOAT) AS avg_distance, CAST(avg(total_amount) AS FLOAT) AS avg_amount FROM hub WHERE PULocationID NOT IN (264, 265) GROUP BY 1, 2, 3"""))
register("half_hour_series",
         lambda s, d: rounded(A.half_hour_series(B.event_trips(s, d)), 4, "std_amount"),
         with_tables(B.EVENT_TRIPS, select="""SELECT VendorID, PULocationID, time_bucket(INTERVAL 30 MINUTE, pickup_datetime, TIMESTAMP '1970-01-01') AS pickup_interval,
           count(*) AS demand, avg(total_amount) AS mean_amount, round(stddev_samp(total_amount), 4) AS std_amount, avg(trip_distance) AS mean_distance
           FROM trips_e GROUP BY 1, 2, 3"""))
register("dashboard_rollup", lambda s, d: A.dashboard_rollup(B.trips(s, d)), with_tables(B.TRIPS, B.ROLLUP, select="SELECT * FROM rollup_"))
register("dashboard_rollup_period", lambda s, d: A.dashboard_rollup(B.trips(s, d), "1995-01-01", "1999-12-31 23:59:59"),
         with_tables(B.TRIPS, B.ROLLUP, select="SELECT * FROM rollup_ WHERE pickup_datetime <= TIMESTAMP '1999-12-31 23:59:59'"))
ALL_MEASURES = """CAST(sum("count") AS BIGINT) AS total_trips, CAST(sum(fare_amount) AS BIGINT) AS total_price,
  sum(fare_amount)::DOUBLE / sum("count") AS mean_price, CAST(sum(tip_amount) AS BIGINT) AS total_tip, sum(tip_amount)::DOUBLE / sum("count") AS mean_tip,
  sum(trip_distance) / sum("count") AS mean_distance, sum(duration) / sum("count") AS mean_duration,
  sum(tip_amount)::DOUBLE / sum(duration) AS mean_tip_time, sum(tip_amount)::DOUBLE / sum(trip_distance) AS mean_tip_dis,
  sum(fare_amount)::DOUBLE / sum(duration) AS mean_price_time, sum(fare_amount)::DOUBLE / sum(trip_distance) AS mean_price_dis"""
NAMES = ["total_trips", "total_price", "mean_price", "total_tip", "mean_tip", "mean_distance", "mean_duration", "mean_tip_time", "mean_tip_dis",
         "mean_price_time", "mean_price_dis"]
FILLED = ", ".join(f"coalesce({n}, 0) AS {n}" for n in NAMES)
register("zone_measures", lambda s, d: A.zone_measures(B.rollup(s, d), B.ids(s, d), NAMES, "1995-01-01", "2002-01-01"),
         with_tables(B.TRIPS, B.ROLLUP, B.IDS, select=f"""SELECT PULocationID, {FILLED} FROM ids LEFT JOIN (SELECT PULocationID, {ALL_MEASURES}
           FROM rollup_ GROUP BY 1) USING (PULocationID)"""))
# The dashboard's own filters: some vendors, some zones, a period.
register("zone_measures_filtered", lambda s, d: A.zone_measures(B.rollup(s, d), B.ids(s, d), NAMES, START, END, vendors=[0, 2], zones=[3, 5, 8]),
         with_tables(B.TRIPS, B.ROLLUP, B.IDS, select=f"""SELECT PULocationID, {FILLED} FROM (SELECT * FROM ids WHERE PULocationID IN (3, 5, 8)) LEFT JOIN (SELECT PULocationID, {ALL_MEASURES}
           FROM rollup_ WHERE {PERIOD} AND VendorID IN (0, 2) GROUP BY 1) USING (PULocationID)"""))
# Each grain with a period for which the dashboard chooses it.
for grouping, sql_bucket, first, last in (
    ("hour", "date_trunc('hour', pickup_datetime)", "1996-03-01", "1996-03-08"),
    ("day", "date_trunc('day', pickup_datetime)", "1996-03-01", "1997-03-01"),
    ("week", "time_bucket(INTERVAL 7 DAY, pickup_datetime, TIMESTAMP '1970-01-01')", "1995-01-01", "2002-01-01"),
):
    register(f"zone_measures_over_time_{grouping}",
             lambda s, d, g=grouping, a=first, b=last: A.zone_measures_over_time(B.rollup(s, d), B.ids(s, d), NAMES, a, b, g),
             with_tables(B.TRIPS, B.ROLLUP, B.IDS, f"""agg AS (SELECT PULocationID, {sql_bucket} AS time_bucket, {ALL_MEASURES} FROM rollup_
               WHERE pickup_datetime BETWEEN TIMESTAMP '{first}' AND TIMESTAMP '{last}' GROUP BY 1, 2)""",
                         select=f"""SELECT g.PULocationID, g.time_bucket, {FILLED} FROM (SELECT PULocationID, time_bucket FROM ids, (SELECT DISTINCT time_bucket FROM agg)) g
               LEFT JOIN agg a ON a.PULocationID = g.PULocationID AND a.time_bucket = g.time_bucket"""))
register("zone_popularity", lambda s, d: A.zone_popularity(B.rollup(s, d)),
         with_tables(B.TRIPS, B.ROLLUP, select="""SELECT PULocationID, CAST(sum("count") AS BIGINT) AS total_trips FROM rollup_ GROUP BY 1"""))
SCORES = """scores AS (SELECT CAST(user_id % 30 AS INTEGER) AS locationid, (user_id % 10)::DOUBLE AS x, (user_id % 7)::DOUBLE AS y,
  CASE WHEN user_id % 5 <> 0 THEN event_type END AS DBA, round_even(value, 0) AS SCORE FROM events)"""


def _scores(spark, sf):
    u = F.col("user_id")
    return B.table(spark, sf, "events").select(
        (u % 30).cast("int").alias("locationid"), (u % 10).cast("double").alias("x"), (u % 7).cast("double").alias("y"),
        F.when(u % 5 != 0, F.col("event_type")).alias("DBA"), F.bround("value", 0).alias("SCORE"),
    )


register("median_by_zone", lambda s, d: ST.median_by_zone(_scores(s, d)),
         with_tables(SCORES, select="SELECT locationid, quantile_cont(SCORE, 0.5::DOUBLE) AS SCORE FROM scores GROUP BY 1"))
register("dedupe_points", lambda s, d: A.dedupe_points(_scores(s, d)), with_tables(SCORES, select="SELECT x, y, DBA, avg(SCORE) AS SCORE FROM scores GROUP BY ALL"))
register("income_by_zone",
         lambda s, d: ST.income_by_zone(B.table(s, d, "orders").select((F.col("o_custkey") % 25).alias("locationid"), F.year("o_orderdate").alias("year"),
                                        F.col("o_totalprice").alias("median_income")), 1998),
         "SELECT o_custkey % 25 AS locationid, quantile_cont(o_totalprice, 0.5::DOUBLE) AS median_income FROM orders WHERE year(o_orderdate) = 1998 GROUP BY 1")
register("mean_by_zone_hour", lambda s, d: A.mean_by_zone_hour(B.rollup(s, d)),
         with_tables(B.TRIPS, B.ROLLUP, select="""SELECT PULocationID, CAST(hour(pickup_datetime) AS INTEGER) AS hour, avg("count") AS "count" FROM rollup_ GROUP BY 1, 2"""))
register("mean_by_zone_hour_weekend", lambda s, d: A.mean_by_zone_hour(B.rollup(s, d), [6, 7]),
         with_tables(B.TRIPS, B.ROLLUP, select="""SELECT PULocationID, CAST(hour(pickup_datetime) AS INTEGER) AS hour, avg("count") AS "count" FROM rollup_
           WHERE isodow(pickup_datetime) IN (6, 7) GROUP BY 1, 2"""))
register("od_matrix", lambda s, d: A.od_matrix(B.trips(s, d), B.lookup(s, d)),
         with_tables(B.TRIPS, B.LOOKUP, select="""SELECT CAST(date_trunc('year', pickup_datetime) AS TIMESTAMP) AS bucket, coalesce(a.Borough, 'Unknown') AS PUborough,
           coalesce(b.Borough, 'Unknown') AS DOborough, type, count(*) AS trips FROM trips LEFT JOIN lookup a ON PULocationID = a.LocationID
           LEFT JOIN lookup b ON DOLocationID = b.LocationID GROUP BY ALL"""))
for grain in ("month", "day", "hour"):
    register(f"zone_trips_by_{grain}", lambda s, d, g=grain: A.zone_trips_by(B.trips(s, d), B.lookup(s, d), g),
             with_tables(B.TRIPS, B.LOOKUP, select=f"""SELECT CAST(date_trunc('{grain}', pickup_datetime) AS TIMESTAMP) AS bucket,
               coalesce(Zone, 'Unknown') AS zone, type, count(*) AS trips FROM trips LEFT JOIN lookup ON PULocationID = LocationID GROUP BY ALL"""))
for flag, cond in (("rain", "PRCP > 0.41"), ("snow", "SNOW > 0")):
    register(f"weather_hour_profile_{flag}", lambda s, d, f=flag: A.weather_hour_profile(B.trips(s, d), B.lookup(s, d), B.station(s, d), f),
             with_tables(B.TRIPS, B.LOOKUP, B.DAYS, B.STATION, select=f"""SELECT CAST(hour(bucket) AS INTEGER) AS hour, zone, {flag}, avg(n) AS avg_trips FROM (
               SELECT date_trunc('hour', pickup_datetime) AS bucket, coalesce(Zone, 'Unknown') AS zone, {cond} AS {flag}, count(*) AS n FROM trips
               LEFT JOIN lookup ON PULocationID = LocationID LEFT JOIN station ON CAST(pickup_datetime AS DATE) = "DATE" GROUP BY ALL) GROUP BY ALL"""))


def _borough_zones(spark, sf):
    seen = B.trips(spark, sf).select(F.col("PULocationID").alias("LocationID")).distinct()
    return A.zones_per_borough(B.lookup(spark, sf).join(seen, "LocationID")).select("Borough", F.array_join("zones", ",").alias("zones"))


register("zones_per_borough", _borough_zones, with_tables(B.TRIPS, B.LOOKUP, select="""SELECT Borough, string_agg(DISTINCT Zone, ',' ORDER BY Zone) AS zones
  FROM lookup WHERE LocationID IN (SELECT PULocationID FROM trips) GROUP BY 1"""))
register("time_bounds", lambda s, d: A.time_bounds(B.trips(s, d), "pickup_datetime"),
         with_tables(B.TRIPS, select="SELECT min(pickup_datetime) AS first, max(pickup_datetime) AS last FROM trips"))
RENT = """rent AS (SELECT c_nationkey AS LocationID, CAST(date_trunc('month', o_orderdate) AS DATE) AS "Date", max(o_totalprice) AS AskingRent
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def _rent(spark, sf):
    orders, customer = B.table(spark, sf, "orders"), B.table(spark, sf, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("c_nationkey").alias("LocationID"), F.trunc("o_orderdate", "month").alias("Date")).agg(F.max("o_totalprice").alias("AskingRent"))


register("latest_per_zone", lambda s, d: A.latest_per_zone(_rent(s, d), _int_ids(s, d), "1996-01-01", "1997-06-01"),
         with_tables(RENT, B.CENTROIDS, select="""SELECT locationid AS PULocationID, coalesce(r, 0) AS asking_rent FROM centroids LEFT JOIN (
           SELECT LocationID, arg_max(AskingRent, "Date") AS r FROM rent WHERE "Date" BETWEEN DATE '1996-01-01' AND DATE '1997-06-01' GROUP BY 1) t USING (LocationID)"""))
FEATURES = """spans AS (SELECT greatest(1, round_even((epoch(max("timestamp")) - epoch(min("timestamp"))) / 3600.0::DOUBLE, 0)) AS hours FROM keyed),
  base AS (SELECT Series_ID, CAST(sum(demand) AS BIGINT) AS total_demand, stddev_samp(demand) AS std_demand,
    CAST(sum(CASE WHEN isodow("timestamp") >= 6 THEN demand ELSE 0 END) AS BIGINT) AS weekend_demand,
    CAST(sum(CASE WHEN hour("timestamp") BETWEEN 7 AND 10 THEN demand ELSE 0 END) AS BIGINT) AS morning_demand,
    CAST(sum(CASE WHEN hour("timestamp") BETWEEN 16 AND 19 THEN demand ELSE 0 END) AS BIGINT) AS evening_demand,
    count(demand) AS active_hours FROM keyed GROUP BY 1),
  ratios AS (SELECT *, total_demand / hours AS mean_real, coalesce(std_demand / (total_demand / hours + 0.0001::DOUBLE), 0) AS cv FROM base, spans),
  features AS (SELECT * EXCLUDE (hours), cv * cv AS cv2, hours / active_hours AS adi, weekend_demand / (total_demand + 0.0001::DOUBLE) AS weekend_ratio,
    morning_demand / (total_demand + 0.0001::DOUBLE) AS morning_ratio, evening_demand / (total_demand + 0.0001::DOUBLE) AS evening_ratio FROM ratios)"""
FUZZY = ["std_demand", "mean_real", "cv", "cv2", "adi", "weekend_ratio", "morning_ratio", "evening_ratio"]
register("series_features", lambda s, d: rounded(A.series_features(B.keyed_series(s, d)), 9, *FUZZY),
         with_tables(B.EVENT_TRIPS, B.SERIES, B.KEYED, FEATURES, select="SELECT * REPLACE (" + ", ".join(f"round({c}, 9) AS {c}" for c in FUZZY) + ") FROM features"))
register("mean_volume", lambda s, d: A.mean_volume(B.keyed_series(s, d)),
         with_tables(B.EVENT_TRIPS, B.SERIES, B.KEYED, select="SELECT Series_ID, avg(demand) AS mean_demand FROM keyed GROUP BY 1"))


def _summary(spark, sf):
    f = A.series_features(B.keyed_series(spark, sf)).withColumn("segment", F.when(F.col("active_hours") % 2 == 0, "MID").otherwise("LOW"))
    return rounded(A.segment_summary(f), 6, "mean_volume", "mean_cv", "mean_adi", "min_volume", "max_volume")


register("segment_summary", _summary, with_tables(B.EVENT_TRIPS, B.SERIES, B.KEYED, FEATURES, select="""SELECT CASE WHEN active_hours % 2 = 0 THEN 'MID' ELSE 'LOW' END AS segment,
  count(*) AS zones, round(avg(mean_real), 6) AS mean_volume, round(avg(cv), 6) AS mean_cv, round(avg(adi), 6) AS mean_adi, round(min(mean_real), 6) AS min_volume,
  round(max(mean_real), 6) AS max_volume FROM features GROUP BY 1"""))
register("tip_incidence", lambda s, d: A.tip_incidence(B.trips(s, d)),
         with_tables(B.TRIPS, select="""SELECT VendorID, count(*) FILTER (tip_amount = 0) AS without_tip, count(*) FILTER (tip_amount > 0) AS with_tip,
           count(*) FILTER (tip_amount = 0)::DOUBLE / count(*) FILTER (tip_amount >= 0) AS share_without FROM trips GROUP BY 1"""))
register("correlation", lambda s, d: rounded(A.correlation(B.trips(s, d), "trip_distance", "fare_amount"), 6, "correlation"),
         with_tables(B.TRIPS, select="SELECT round(corr(trip_distance, fare_amount), 6) AS correlation FROM trips"))
register("latest_rows", lambda s, d: A.latest_rows(B.series(s, d), 2, 7, 100),
         with_tables(B.EVENT_TRIPS, B.SERIES, select='SELECT * FROM series WHERE VendorID = 2 AND PULocationID = 7 ORDER BY "timestamp" DESC LIMIT 100'))
register("ordered", lambda s, d: A.ordered(B.table(s, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey"),
         "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey")

# --- order statistics ------------------------------------------------------------------------

BOX = ["trip_distance", "fare_amount", "tip_amount", "tolls_amount", "total_amount"]
LONG = "long AS (UNPIVOT (SELECT " + ", ".join(f"{c}::DOUBLE AS {c}" for c in BOX) + " FROM trips) ON COLUMNS(*) INTO NAME label VALUE v)"
register("box_stats", lambda s, d: ST.box_stats(B.trips(s, d), BOX),
         with_tables(B.TRIPS, LONG, """quart AS (SELECT label, quantile_cont(v, 0.25::DOUBLE) AS q1, quantile_cont(v, 0.5::DOUBLE) AS med, quantile_cont(v, 0.75::DOUBLE) AS q3,
           min(v) AS "min", max(v) AS "max" FROM long GROUP BY 1)""",
                     select="""SELECT label, q1, med, q3, greatest("min", q1 - 1.5::DOUBLE * (q3 - q1)) AS whislo, least("max", q3 + 1.5::DOUBLE * (q3 - q1)) AS whishi,
           "min", "max" FROM quart"""))
register("describe", lambda s, d: rounded(ST.describe(B.trips(s, d), BOX), 4, "std"),
         with_tables(B.TRIPS, LONG, select="""SELECT label, count(v) AS "count", avg(v) AS mean, round(stddev_samp(v), 4) AS std, min(v) AS "min", quantile_cont(v, 0.25::DOUBLE) AS q25,
           quantile_cont(v, 0.5::DOUBLE) AS q50, quantile_cont(v, 0.75::DOUBLE) AS q75, max(v) AS "max" FROM long GROUP BY 1"""))
BOUNDS = """bounds_ AS (SELECT list_sort(list(total_amount))[1]::DOUBLE AS "min", list_sort(list(total_amount))[1 + floor(0.99::DOUBLE * count(*))::BIGINT]::DOUBLE AS "max",
  max(total_amount)::DOUBLE AS absolute_max FROM trips_e)"""
register("value_bounds", lambda s, d: ST.value_bounds(B.event_trips(s, d), "total_amount"), with_tables(B.EVENT_TRIPS, BOUNDS, select="SELECT * FROM bounds_"))
register("normalise", lambda s, d: ST.normalise(B.event_trips(s, d).select("event_id", "total_amount"), "total_amount"),
         with_tables(B.EVENT_TRIPS, BOUNDS, select="""SELECT event_id, total_amount, CASE WHEN "min" = "max" THEN 0.5::DOUBLE WHEN total_amount >= "max" THEN 1.0::DOUBLE
           ELSE (total_amount - "min") / ("max" - "min") END AS normalised FROM trips_e, bounds_"""))
HISTOGRAM = """ends AS (SELECT min(total_amount)::DOUBLE AS lo, max(total_amount)::DOUBLE AS hi FROM trips_e)"""
register("density_histogram", lambda s, d: ST.density_histogram(B.event_trips(s, d), ["VendorID"], "total_amount", 50),
         with_tables(B.EVENT_TRIPS, HISTOGRAM, select="""SELECT VendorID, CAST(CASE WHEN total_amount = hi THEN 49 ELSE least(floor((total_amount - lo) * 50 / (hi - lo)), 49) END AS INTEGER) AS bin,
           count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY VendorID) AS share FROM trips_e, ends GROUP BY 1, 2"""))
register("density_histogram_range", lambda s, d: ST.density_histogram(B.event_trips(s, d), ["VendorID"], "total_amount", 50, 1000, 10000),
         with_tables(B.EVENT_TRIPS, select="""SELECT VendorID, CAST(CASE WHEN total_amount < 1000 THEN -1 WHEN total_amount >= 10000 THEN 50 ELSE floor((total_amount - 1000) * 50 / 9000.0::DOUBLE) END AS INTEGER) AS bin,
           count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY VendorID) AS share FROM trips_e GROUP BY 1, 2"""))


def _sketched(s, d):
    """Box statistics of two vendors over five years, from monthly states in the shared folder alone."""
    month = trunc_grain("pickup_datetime", "month").alias("month")
    state = cut_lineage(SK.quantile_state(B.trips(s, d).select("*", month), ["month", "VendorID"], BOX))
    return SK.sketched_box_stats(state.where("month < timestamp_ntz'1997-01-01'"), BOX, ["VendorID"])


register("sketched_box_stats", _sketched)
POINTS = 200
register("density_curve", lambda s, d: rounded(rounded(SK.density_curve(B.event_trips(s, d), ["VendorID"], "total_amount", POINTS), 6, "x"), 12, "density"),
         with_tables(B.EVENT_TRIPS, """ends AS (SELECT VendorID, count(*) AS n, min(total_amount) AS a, max(total_amount) AS b, stddev_samp(total_amount) * pow(count(*), -0.2::DOUBLE) AS h FROM trips_e GROUP BY 1)""",
                     f"""grid AS (SELECT *, a - 3 * h AS low, (b - a + 6 * h) / {POINTS - 1} AS step FROM ends WHERE h > 0)""",
                     """bins AS (SELECT VendorID, floor((total_amount - low) / step + 0.5::DOUBLE) AS i, count(*) AS w FROM trips_e JOIN grid USING (VendorID) GROUP BY 1, 2)""",
                     f"""curve AS (SELECT VendorID, j, low + j * step AS x, step, sum(w * exp(-pow((j - i) * step / h, 2) / 2)) AS d FROM grid JOIN bins USING (VendorID), range({POINTS}) t(j) GROUP BY ALL)""",
                     select="SELECT VendorID, round(x, 6) AS x, round(d / (sum(d) OVER (PARTITION BY VendorID) * step), 12) AS density FROM curve"))
