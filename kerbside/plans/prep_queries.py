"""Queries for unifying, filtering, clipping and narrowing."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbside.operators import prep as P
from kerbside.functions.maths import map_values, to_cents
from kerbside.plans import bindings as B
from kerbside.plans.registry import register, with_tables
from kerbside.schemas import LICENCE_TO_VENDOR, VENDOR_OTHER

MONTH = "1997-05"
IN_MONTH = "started >= TIMESTAMP '1997-05-01' AND started < TIMESTAMP '1997-06-01'"

register("rename_known",
         lambda s, d: P.rename_known(B.raw_green(s, d), {**P.GREEN_NAMES, "absent": "ignored"}).groupBy(F.to_date("pickup_datetime").alias("day")).agg(F.count("dropoff_datetime").alias("n")),
         with_tables(B.RAW, select="SELECT CAST(started AS DATE) AS day, count(ended) AS n FROM raw WHERE l_returnflag = 'N' GROUP BY 1"))
register("unify_yellow", lambda s, d: P.to_unified(P.unify_yellow(B.raw_yellow(s, d))), with_tables(B.RAW, select=B.hub_sql("A", "0")))
register("unify_green", lambda s, d: P.to_unified(P.unify_green(B.raw_green(s, d))), with_tables(B.RAW, select=B.hub_sql("N", "1")))
register("unify_hvfhv", lambda s, d: P.to_unified(P.unify_hvfhv(B.raw_app(s, d))),
         with_tables(B.RAW, select=B.hub_sql("R", B.APP_VENDOR, f"{B.APP_VENDOR} < 4", B.APP_TOTAL, "7")))
register("optional_col",
         lambda s, d: B.raw_app(s, d).select("pickup_datetime", "PULocationID", P.optional_col(B.raw_app(s, d), "tolls").alias("tolls"), P.optional_col(B.raw_app(s, d), "bcf").alias("bcf")),
         with_tables(B.RAW, select="SELECT started AS pickup_datetime, PULocationID, CAST(tolls_amount AS FLOAT) AS tolls, CAST(0 AS FLOAT) AS bcf FROM raw WHERE l_returnflag = 'R'"))
register("to_unified", lambda s, d: B.hub(s, d), with_tables(B.RAW, B.HUB, select="SELECT * FROM hub"))
register("to_cents", lambda s, d: B.table(s, d, "orders").select("o_orderkey", to_cents(F.col("o_totalprice") / 8).alias("cents")),
         "SELECT o_orderkey, CAST(round_even(o_totalprice / 8 * 100, 0) AS BIGINT) AS cents FROM orders")
register("map_values",
         lambda s, d: B.raw_app(s, d).groupBy(map_values("hvfhs_license_num", LICENCE_TO_VENDOR, VENDOR_OTHER).alias("VendorID")).agg(F.count("*").alias("n")),
         with_tables(B.RAW, select=f"SELECT {B.APP_VENDOR} AS VendorID, count(*) AS n FROM raw WHERE l_returnflag = 'R' GROUP BY 1"))
register("keep_known_vendors",
         lambda s, d: P.keep_known_vendors(B.event_trips(s, d)).select("event_id", "VendorID"),
         with_tables(B.EVENT_TRIPS, select="SELECT event_id, VendorID FROM trips_e WHERE VendorID < 4"))
register("clip_to_month", lambda s, d: P.clip_to_month(B.table(s, d, "orders"), "1998-12", "o_orderdate").select("o_orderkey", "o_orderdate"),
         "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-12-01' AND o_orderdate < TIMESTAMP '1999-01-01'")
register("unify",
         lambda s, d: P.unify(B.raw_yellow(s, d), "yellow", MONTH).unionByName(P.unify(B.raw_green(s, d), "green", MONTH)).unionByName(P.unify(B.raw_app(s, d), "fhvhv", MONTH)),
         with_tables(B.RAW, select=B.hub_sql("A", "0", IN_MONTH) + " UNION ALL " + B.hub_sql("N", "1", IN_MONTH) + " UNION ALL "
                     + B.hub_sql("R", B.APP_VENDOR, f"{B.APP_VENDOR} < 4 AND {IN_MONTH}", B.APP_TOTAL, "7")))
register("narrow_types",
         lambda s, d: P.narrow_types(B.raw_yellow(s, d).withColumn("tpep_pickup_datetime", F.col("tpep_pickup_datetime") + F.expr("INTERVAL '0.25' SECOND")))
         .select("VendorID", "tpep_pickup_datetime", "store_and_fwd_flag", "PULocationID", "payment_type", "fare_amount"),
         with_tables(B.RAW, select="""SELECT CAST(2 AS TINYINT) AS VendorID, started AS tpep_pickup_datetime, l_linestatus = 'O' AS store_and_fwd_flag,
           CAST(PULocationID AS SMALLINT) AS PULocationID, CAST(payment_type AS TINYINT) AS payment_type, CAST(fare_amount AS FLOAT) AS fare_amount
           FROM raw WHERE l_returnflag = 'A'"""))
register("money_rule", lambda s, d: B.table(s, d, "orders").select("o_orderkey", P.money_rule(F.col("o_totalprice") * 100).alias("money")),
         "SELECT o_orderkey, CAST(trunc(least(greatest(o_totalprice * 100 * 100, -2147483648), 2147483647)) AS INTEGER) AS money FROM orders")
register("pickup_column",
         lambda s, d: B.raw_green(s, d).groupBy(F.to_date(P.pickup_column(B.raw_green(s, d))).alias("day")).agg(F.count("*").alias("n")),
         with_tables(B.RAW, select="SELECT CAST(started AS DATE) AS day, count(*) AS n FROM raw WHERE l_returnflag = 'N' GROUP BY 1"))
CLIPPED = """clean AS (SELECT * REPLACE (
    CAST(trunc(least(greatest(trip_distance::DOUBLE * 1609.34::DOUBLE, 0), 200 * 1609.34::DOUBLE)) AS INTEGER) AS trip_distance,
    CAST(CASE WHEN fare_amount IS NOT NULL THEN least(greatest(fare_amount, 0), 10000) END AS SMALLINT) AS fare_amount,
    CAST(CASE WHEN tip_amount IS NOT NULL THEN least(greatest(tip_amount, 0), 10000) END AS SMALLINT) AS tip_amount,
    CAST(CASE WHEN tolls_amount IS NOT NULL THEN least(greatest(tolls_amount, 0), 5000) END AS SMALLINT) AS tolls_amount,
    CAST(CASE WHEN total_amount IS NOT NULL THEN least(greatest(total_amount, 0), 30000) END AS SMALLINT) AS total_amount) FROM hub)"""
register("clip_outliers", lambda s, d: P.clip_outliers(B.hub(s, d)), with_tables(B.RAW, B.HUB, CLIPPED, select="SELECT * FROM clean"))
register("valid_zones", lambda s, d: P.valid_zones(B.hub(s, d)).select("pickup_datetime", "PULocationID"),
         with_tables(B.RAW, B.HUB, select="SELECT pickup_datetime, PULocationID FROM hub WHERE PULocationID NOT IN (264, 265)"))
register("city_trips", lambda s, d: P.city_trips(B.hub(s, d)).groupBy("VendorID").agg(F.count("*").alias("n")),
         with_tables(B.RAW, B.HUB, select="""SELECT VendorID, count(*) AS n FROM hub
           WHERE PULocationID BETWEEN 1 AND 263 AND DOLocationID BETWEEN 1 AND 263 GROUP BY 1"""))
register("in_period", lambda s, d: P.in_period(B.table(s, d, "orders"), "1996-02-01", "1996-03-01", "o_orderdate").select("o_orderkey", "o_orderdate"),
         "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-02-01' AND TIMESTAMP '1996-03-01'")
register("optional_in",
         lambda s, d: P.optional_in(P.optional_in(B.event_trips(s, d), "VendorID", [0, 3]), "PULocationID", []).select("event_id", "VendorID"),
         with_tables(B.EVENT_TRIPS, select="SELECT event_id, VendorID FROM trips_e WHERE VendorID IN (0, 3)"))


def _timed_events(spark, sf):
    end = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("event_id") % 7 - 2).cast("int"))
    from kerbside.functions.time import duration_minutes

    return B.table(spark, sf, "events").select("event_id", duration_minutes(F.col("ts"), end).alias("duration"))


register("positive_duration", lambda s, d: P.positive_duration(_timed_events(s, d)),
         "SELECT event_id, CAST(event_id % 7 - 2 AS DOUBLE) AS duration FROM events WHERE event_id % 7 > 2")
HOLES = """holes AS (SELECT event_id, CASE WHEN value >= 5 THEN value END AS value, CASE WHEN value <= 50 THEN event_type END AS event_type FROM events)"""


def _holes(spark, sf):
    return B.table(spark, sf, "events").select(
        "event_id", F.when(F.col("value") >= 5, F.col("value")).alias("value"),
        F.when(F.col("value") <= 50, F.col("event_type")).alias("event_type"),
    )


register("drop_incomplete", lambda s, d: P.drop_incomplete(_holes(s, d)),
         with_tables(HOLES, select="SELECT * FROM holes WHERE value IS NOT NULL AND event_type IS NOT NULL"))
register("drop_incomplete_in", lambda s, d: P.drop_incomplete(_holes(s, d), ["value"]),
         with_tables(HOLES, select="SELECT * FROM holes WHERE value IS NOT NULL"))


def _non_finite(spark, sf):
    k = F.col("event_id") % 4
    v = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 2, F.lit(float("-inf"))).otherwise(F.col("value"))
    return P.clean_non_finite(B.table(spark, sf, "events").select("event_id", v.alias("value")), ["value"])


register("clean_non_finite", _non_finite, "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN value ELSE 0.0::DOUBLE END AS value FROM events")
register("zero_fill", lambda s, d: P.zero_fill(_holes(s, d), ["value"]),
         with_tables(HOLES, select="SELECT event_id, coalesce(value, 0) AS value, event_type FROM holes"))
register("drop_columns", lambda s, d: P.drop_columns(B.table(s, d, "events"), "props", "absent"),
         "SELECT event_id, ts, user_id, event_type, value FROM events")
register("nonzero_points",
         lambda s, d: P.nonzero_points(B.table(s, d, "events").select("event_id", F.floor(F.col("value") / 20).alias("lon"), F.floor(F.col("value") / 30).alias("lat"))),
         "SELECT event_id, CAST(floor(value / 20) AS BIGINT) AS lon, CAST(floor(value / 30) AS BIGINT) AS lat FROM events WHERE value >= 20")
register("has_tip", lambda s, d: P.has_tip(B.trips(s, d)).groupBy("VendorID", "has_tip").agg(F.count("*").alias("n")),
         with_tables(B.TRIPS, select="SELECT VendorID, CAST(tip_amount > 0 AS TINYINT) AS has_tip, count(*) AS n FROM trips GROUP BY 1, 2"))
register("tipped", lambda s, d: P.tipped(B.trips(s, d)).groupBy("PULocationID").agg(F.count("*").alias("n"), F.sum("tip_amount").alias("tip_amount")),
         with_tables(B.TRIPS, select="SELECT PULocationID, count(*) AS n, CAST(sum(tip_amount) AS BIGINT) AS tip_amount FROM trips WHERE tip_amount > 0 AND fare_amount > 0 GROUP BY 1"))
register("positive_values", lambda s, d: P.positive_values(B.table(s, d, "customer"), "c_acctbal").select("c_custkey", "c_acctbal"),
         "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
register("daylight_flag",
         lambda s, d: P.daylight_flag(B.table(s, d, "events").withColumns({"sunrise": F.to_date("ts").cast("timestamp_ntz") + F.expr("INTERVAL 6 HOUR"),
                                      "sunset": F.to_date("ts").cast("timestamp_ntz") + F.expr("INTERVAL 18 HOUR")}), "ts").select("event_id", "is_daylight"),
         "SELECT event_id, CASE WHEN ts BETWEEN date_trunc('day', ts) + INTERVAL 6 HOUR AND date_trunc('day', ts) + INTERVAL 18 HOUR THEN 1 ELSE 0 END AS is_daylight FROM events")
register("distinct_rows", lambda s, d: P.distinct_rows(B.trips(s, d).select("PULocationID", "DOLocationID", "VendorID")),
         with_tables(B.TRIPS, select="SELECT DISTINCT PULocationID, DOLocationID, VendorID FROM trips"))
register("fresh_window", lambda s, d: P.fresh_window(B.table(s, d, "orders"), 3, "o_orderdate").select("o_orderkey", "o_orderdate"),
         "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 3 YEAR")
register("fresh_window_since", lambda s, d: P.fresh_window(B.table(s, d, "events"), ts="ts", since="2024-01-20").select("event_id"),
         "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20'")


def _ablated(spark, sf, mode):
    from kerbside.functions.maths import landmark_distances
    from kerbside.operators.lookup import with_od_centroids

    trips = with_od_centroids(B.event_trips(spark, sf).select("event_id", "PULocationID", "DOLocationID", "trip_distance"), B.centroids(spark, sf))
    return P.ablate_features(landmark_distances(trips), mode)


PLACED = """p.Longitude AS pickup_longitude, p.Latitude AS pickup_latitude, q.Longitude AS dropoff_longitude, q.Latitude AS dropoff_latitude"""
FROM_PLACED = "trips_e JOIN centroids p ON PULocationID = p.locationid JOIN centroids q ON DOLocationID = q.locationid"
register("ablate_features", lambda s, d: _ablated(s, d, "drop_all"), with_tables(B.EVENT_TRIPS, select="SELECT event_id, PULocationID, DOLocationID, trip_distance FROM trips_e"))
register("ablate_distances", lambda s, d: _ablated(s, d, "drop_dists"),
         with_tables(B.EVENT_TRIPS, B.CENTROIDS, select=f"SELECT event_id, PULocationID, DOLocationID, trip_distance, {PLACED} FROM {FROM_PLACED}"))
