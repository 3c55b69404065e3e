"""The given tables seen as trips, zones, weather and reference data.

Each binding exists twice: as a DataFrame and as a SQL common table expression
with the same rows, so that every operator can be checked against plain SQL.
Money is in integer cents, which keeps sums exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kerbside.operators.rollup import dashboard_rollup, hourly_series
from kerbside.sources.writers import with_series_id



def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cents(c):
    return F.bround(c * 100, 0).cast("bigint")


# --- trips with money, two zones and a type -----------------------------------

TRIPS = """trips AS (
  SELECT l_orderkey, l_linenumber, l_partkey,
    CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS VendorID,
    CASE l_returnflag WHEN 'A' THEN 'Yellow' WHEN 'N' THEN 'Green' ELSE 'FHV - High Volume' END AS type,
    s_nationkey AS PULocationID, c_nationkey AS DOLocationID,
    o_orderdate + to_hours(CAST(l_orderkey % 24 AS INTEGER)) + to_minutes(l_linenumber * 7) AS pickup_datetime,
    o_orderdate + to_hours(CAST(l_orderkey % 24 AS INTEGER)) + to_minutes(l_linenumber * 7)
      + to_minutes(CAST(l_quantity AS INTEGER)) AS dropoff_datetime,
    l_quantity AS trip_distance,
    CAST(round_even(l_extendedprice * 100, 0) AS BIGINT) AS fare_amount,
    CAST(round_even(l_extendedprice * l_discount * 100, 0) AS BIGINT) AS tip_amount,
    CAST(round_even(l_extendedprice * l_tax * 100, 0) AS BIGINT) AS tolls_amount,
    CAST(round_even(l_extendedprice * (1 + l_tax) * 100, 0) AS BIGINT) AS total_amount,
    CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS payment_type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey)"""


def trips(spark: SparkSession, sf: str) -> DataFrame:
    # the join with orders needs this partitioning at any size that cannot be broadcast;
    # on a small table it spreads the rows of a single file over the cores
    line = table(spark, sf, "lineitem").repartition("l_orderkey")
    joined = (
        line.join(table(spark, sf, "orders"), line.l_orderkey == F.col("o_orderkey"))
        .join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    )
    price = F.col("l_extendedprice")
    pickup = (
        F.col("o_orderdate")
        + F.make_dt_interval(F.lit(0), (F.col("l_orderkey") % 24).cast("int"), F.col("l_linenumber") * 7)
    )
    flag = F.col("l_returnflag")
    return joined.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("VendorID"),
        F.when(flag == "A", "Yellow").when(flag == "N", "Green").otherwise("FHV - High Volume").alias("type"),
        F.col("s_nationkey").alias("PULocationID"), F.col("c_nationkey").alias("DOLocationID"),
        pickup.alias("pickup_datetime"),
        (pickup + F.make_dt_interval(F.lit(0), F.lit(0), F.col("l_quantity").cast("int"))).alias("dropoff_datetime"),
        F.col("l_quantity").alias("trip_distance"),
        cents(price).alias("fare_amount"),
        cents(price * F.col("l_discount")).alias("tip_amount"),
        cents(price * F.col("l_tax")).alias("tolls_amount"),
        cents(price * (1 + F.col("l_tax"))).alias("total_amount"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("payment_type"),
    )


ROLLUP = """rollup_ AS (
  SELECT date_trunc('hour', pickup_datetime) AS pickup_datetime, VendorID, CAST(PULocationID AS SMALLINT) AS PULocationID,
    count(*) AS "count", sum(trip_distance) AS trip_distance, CAST(sum(fare_amount) AS BIGINT) AS fare_amount,
    CAST(sum(tip_amount) AS BIGINT) AS tip_amount,
    sum((epoch_us(dropoff_datetime) - epoch_us(pickup_datetime)) / 60000000.0::DOUBLE) AS duration,
    CAST(sum(tolls_amount) AS BIGINT) AS tolls_amount, CAST(sum(total_amount) AS BIGINT) AS total_amount
  FROM trips WHERE dropoff_datetime > pickup_datetime GROUP BY 1, 2, 3)"""


def rollup(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard_rollup(trips(spark, sf))


# --- sparse hourly events --------------------------------------------------------

EVENT_TRIPS = """trips_e AS (
  SELECT event_id,
    CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS VendorID,
    CAST(user_id % 25 AS INTEGER) AS PULocationID, CAST(event_id % 25 AS INTEGER) AS DOLocationID,
    ts AS pickup_datetime, CAST(round_even(value * 100, 0) AS BIGINT) AS total_amount,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS trip_distance
  FROM events)"""


def event_trips(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        "event_id",
        F.when(kind == "click", 0).when(kind == "error", 1).when(kind == "purchase", 2).when(kind == "signup", 3).otherwise(4).alias("VendorID"),
        F.pmod("user_id", F.lit(25)).cast("int").alias("PULocationID"),
        F.pmod("event_id", F.lit(25)).cast("int").alias("DOLocationID"),
        F.col("ts").alias("pickup_datetime"),
        cents(F.col("value")).alias("total_amount"),
        F.get_json_object("props", "$.k").cast("double").alias("trip_distance"),
    )


SERIES = """series AS (
  SELECT VendorID, PULocationID, date_trunc('hour', pickup_datetime) AS "timestamp", CAST(count(*) AS INTEGER) AS demand,
    CAST(avg(trip_distance) AS FLOAT) AS avg_distance, CAST(avg(total_amount) AS FLOAT) AS avg_amount
  FROM trips_e GROUP BY 1, 2, 3)"""
# Every hour from a series' first to its last.
FULL = """bounds AS (SELECT VendorID, PULocationID, min("timestamp") AS lo, max("timestamp") AS hi FROM series GROUP BY 1, 2),
  spine AS (SELECT VendorID, PULocationID, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS "timestamp" FROM bounds),
  full_ AS (SELECT p.VendorID, p.PULocationID, p."timestamp", s.demand, s.avg_distance, s.avg_amount
    FROM spine p LEFT JOIN series s ON p.VendorID = s.VendorID AND p.PULocationID = s.PULocationID AND p."timestamp" = s."timestamp")"""
# Every hour of the table's range for every series.
FULL_GLOBAL = """spine_g AS (SELECT VendorID, PULocationID, unnest(generate_series((SELECT min("timestamp") FROM series),
    (SELECT max("timestamp") FROM series), INTERVAL 1 HOUR)) AS "timestamp" FROM (SELECT DISTINCT VendorID, PULocationID FROM series)),
  full_g AS (SELECT p.VendorID, p.PULocationID, p."timestamp", s.demand, s.avg_distance, s.avg_amount
    FROM spine_g p LEFT JOIN series s ON p.VendorID = s.VendorID AND p.PULocationID = s.PULocationID AND p."timestamp" = s."timestamp")"""


def series(spark: SparkSession, sf: str) -> DataFrame:
    return hourly_series(event_trips(spark, sf))


def keyed_series(spark: SparkSession, sf: str) -> DataFrame:
    return with_series_id(series(spark, sf))


KEYED = """keyed AS (SELECT *, VendorID || '_' || PULocationID AS Series_ID FROM series)"""

# One-step predictions: the mean of the previous five rows.
PREDS = """preds AS (SELECT *, VendorID || '_' || PULocationID AS Series_ID,
    avg(demand) OVER (PARTITION BY VendorID, PULocationID ORDER BY "timestamp" ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS prediction
  FROM series QUALIFY prediction IS NOT NULL)"""


def preds(spark: SparkSession, sf: str) -> DataFrame:
    from kerbside.operators.series import moving_average

    return moving_average(keyed_series(spark, sf)).where(F.col("prediction").isNotNull())


# --- zones -------------------------------------------------------------------------

LOOKUP = """lookup AS (SELECT n_nationkey AS LocationID, n_name AS Zone, r_name AS Borough
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""
CENTROIDS = """centroids AS (SELECT n_nationkey AS locationid, 40.5 + 0.02 * n_nationkey::DOUBLE AS Latitude,
  -74.25 + 0.03 * (n_nationkey % 7)::DOUBLE AS Longitude FROM nation)"""


def lookup(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("LocationID"), F.col("n_name").alias("Zone"), F.col("r_name").alias("Borough")
    )


def centroids(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        key.alias("locationid"),
        (F.lit(40.5) + F.lit(0.02) * key.cast("double")).alias("Latitude"),
        (F.lit(-74.25) + F.lit(0.03) * (key % 7).cast("double")).alias("Longitude"),
    )


# Zones off any regular grid, so that no two distances are equal.
ZONE_POINTS = """zone_points AS (SELECT n_nationkey AS zone, 40.5 + 0.02::DOUBLE * n_nationkey + 0.0003::DOUBLE * (n_nationkey * n_nationkey % 13) AS lat,
  -74.25 + 0.03::DOUBLE * (n_nationkey % 7) + 0.0004::DOUBLE * (n_nationkey * n_nationkey % 11) AS lon FROM nation)"""


def zone_points(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        k.alias("zone"),
        (F.lit(40.5) + F.lit(0.02) * k + F.lit(0.0003) * (k * k % 13)).alias("lat"),
        (F.lit(-74.25) + F.lit(0.03) * (k % 7) + F.lit(0.0004) * (k * k % 11)).alias("lon"),
    )


def ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("smallint").alias("PULocationID"))


IDS = """ids AS (SELECT CAST(n_nationkey AS SMALLINT) AS PULocationID FROM nation)"""

# --- places: customers as points ------------------------------------------------------

PLACES = """places AS (SELECT c_custkey AS start_id, 40.50113 + (c_custkey % 97) * 0.005::DOUBLE AS lat,
  -74.24963 + (c_custkey % 89) * 0.0021::DOUBLE AS lon FROM customer)"""


def places(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        key.alias("start_id"),
        (F.lit(40.50113) + (key % 97) * F.lit(0.005)).alias("lat"),
        (F.lit(-74.24963) + (key % 89) * F.lit(0.0021)).alias("lon"),
    )


# --- weather ----------------------------------------------------------------------------

DAYS = "days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)"
CLIMATE = """climate AS (SELECT CAST(day AS TIMESTAMP) + to_hours(CAST(h AS INTEGER)) AS hour_key,
    (dayofyear(day) % 35) - 5 + h / 4.0::DOUBLE AS temperature_2m,
    CASE WHEN dayofyear(day) % 7 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS rain
  FROM days, generate_series(0, 23) t(h))"""
SUN = """sun AS (SELECT day AS date_key, CAST(day AS TIMESTAMP) + INTERVAL 6 HOUR + to_minutes(CAST(dayofyear(day) % 60 AS INTEGER)) AS sunrise,
    CAST(day AS TIMESTAMP) + INTERVAL 18 HOUR AS sunset, 43200.0::DOUBLE - (dayofyear(day) % 60) * 60 AS daylight_duration FROM days)"""
STATION = """station AS (SELECT day AS "DATE", (dayofyear(day) % 5) * 0.2::DOUBLE AS PRCP,
    CASE WHEN dayofyear(day) % 9 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS SNOW FROM days)"""


def days(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()


def climate(spark: SparkSession, sf: str) -> DataFrame:
    hours = days(spark, sf).select("day", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("h"))
    doy = F.dayofyear("day")
    return hours.select(
        (F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("h"))).alias("hour_key"),
        ((doy % 35) - 5 + F.col("h") / F.lit(4.0)).alias("temperature_2m"),
        F.when(doy % 7 == 0, 0.5).otherwise(0.0).alias("rain"),
    )


def sun(spark: SparkSession, sf: str) -> DataFrame:
    doy, start = F.dayofyear("day"), F.col("day").cast("timestamp_ntz")
    return days(spark, sf).select(
        F.col("day").alias("date_key"),
        (start + F.make_dt_interval(F.lit(0), F.lit(6), doy % 60)).alias("sunrise"),
        (start + F.make_dt_interval(F.lit(0), F.lit(18))).alias("sunset"),
        (F.lit(43200.0) - (doy % 60) * 60).alias("daylight_duration"),
    )


def station(spark: SparkSession, sf: str) -> DataFrame:
    doy = F.dayofyear("day")
    return days(spark, sf).select(
        F.col("day").alias("DATE"),
        ((doy % 5) * F.lit(0.2)).alias("PRCP"),
        F.when(doy % 9 == 0, 1.0).otherwise(0.0).alias("SNOW"),
    )


# --- raw vendor files --------------------------------------------------------------------

RAW_MONEY = """l_quantity AS trip_distance, l_extendedprice / 1000 AS fare_amount, l_extendedprice / 1000 * l_discount AS tip_amount,
  l_extendedprice / 1000 * l_tax AS tolls_amount, l_extendedprice / 1000 * (1 + l_tax) AS total_amount"""
RAW = """raw AS (SELECT *, l_shipdate + to_hours(l_linenumber) AS started,
    l_shipdate + to_hours(l_linenumber) + to_minutes(CAST(l_quantity AS INTEGER)) AS ended,
    CAST(l_suppkey % 265 + 1 AS INTEGER) AS PULocationID, CAST(l_partkey % 265 + 1 AS INTEGER) AS DOLocationID,
    CASE WHEN l_linenumber = 1 THEN NULL ELSE l_linenumber END AS payment_type, """ + RAW_MONEY + " FROM lineitem)"


def raw_lines(spark: SparkSession, sf: str) -> DataFrame:
    start = F.col("l_shipdate") + F.make_dt_interval(F.lit(0), F.col("l_linenumber"))
    price = F.col("l_extendedprice") / 1000
    return table(spark, sf, "lineitem").withColumns(
        {
            "started": start,
            "ended": start + F.make_dt_interval(F.lit(0), F.lit(0), F.col("l_quantity").cast("int")),
            "PULocationID": (F.col("l_suppkey") % 265 + 1).cast("int"),
            "DOLocationID": (F.col("l_partkey") % 265 + 1).cast("int"),
            "payment_type": F.when(F.col("l_linenumber") != 1, F.col("l_linenumber")),
            "trip_distance": F.col("l_quantity"),
            "fare_amount": price,
            "tip_amount": price * F.col("l_discount"),
            "tolls_amount": price * F.col("l_tax"),
            "total_amount": price * (1 + F.col("l_tax")),
        }
    )


COMMON = ["PULocationID", "DOLocationID", "payment_type", "trip_distance", "fare_amount", "tip_amount", "tolls_amount", "total_amount"]


def raw_yellow(spark: SparkSession, sf: str) -> DataFrame:
    return raw_lines(spark, sf).where(F.col("l_returnflag") == "A").select(
        F.lit(2).alias("VendorID"), F.col("started").alias("tpep_pickup_datetime"),
        F.col("ended").alias("tpep_dropoff_datetime"),
        F.when(F.col("l_linestatus") == "O", "Y").otherwise("N").alias("store_and_fwd_flag"), *COMMON,
    )


def raw_green(spark: SparkSession, sf: str) -> DataFrame:
    return raw_lines(spark, sf).where(F.col("l_returnflag") == "N").select(
        F.lit(2).alias("VendorID"), F.col("started").alias("lpep_pickup_datetime"),
        F.col("ended").alias("lpep_dropoff_datetime"), *COMMON,
    )


def raw_app(spark: SparkSession, sf: str) -> DataFrame:
    """Without the columns bcf and cbd_congestion_fee, as in older months."""
    licence = F.col("l_linenumber") % 3
    return raw_lines(spark, sf).where(F.col("l_returnflag") == "R").select(
        F.when(licence == 0, "HV0003").when(licence == 1, "HV0005").otherwise("HV0002").alias("hvfhs_license_num"),
        F.col("started").alias("pickup_datetime"), F.col("ended").alias("dropoff_datetime"),
        "PULocationID", "DOLocationID", F.col("trip_distance").alias("trip_miles"),
        F.col("fare_amount").alias("base_passenger_fare"), F.col("tolls_amount").alias("tolls"),
        F.lit(0.25).alias("sales_tax"), F.lit(2.75).alias("congestion_surcharge"), F.col("tip_amount").alias("tips"),
    )


def hub_sql(flag: str, vendor: str, where: str = "TRUE", total: str = "total_amount", payment: str = "payment_type") -> str:
    """The hub projection of raw rows in SQL."""
    return f"""SELECT CAST({vendor} AS TINYINT) AS VendorID, started AS pickup_datetime, ended AS dropoff_datetime,
      CAST(trip_distance AS FLOAT) AS trip_distance, CAST(PULocationID AS SMALLINT) AS PULocationID,
      CAST(DOLocationID AS SMALLINT) AS DOLocationID, CAST(coalesce({payment}, 5) AS TINYINT) AS payment_type,
      CAST(round_even(tip_amount * 100, 0) AS BIGINT) AS tip_amount, CAST(round_even(tolls_amount * 100, 0) AS BIGINT) AS tolls_amount,
      CAST(round_even(fare_amount * 100, 0) AS BIGINT) AS fare_amount,
      CAST(round_even({total} * 100, 0) AS BIGINT) AS total_amount
    FROM raw WHERE l_returnflag = '{flag}' AND {where}"""


APP_VENDOR = "CASE l_linenumber % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 4 END"
APP_TOTAL = """(CAST(fare_amount AS FLOAT) + CAST(tolls_amount AS FLOAT) + CAST(0 AS FLOAT) + CAST(0.25 AS FLOAT)
  + CAST(2.75 AS FLOAT) + CAST(0 AS FLOAT))"""
HUB = (
    "hub AS (" + hub_sql("A", "0") + " UNION ALL " + hub_sql("N", "1") + " UNION ALL "
    + hub_sql("R", APP_VENDOR, f"{APP_VENDOR} < 4", APP_TOTAL, "7") + ")"
)


def hub(spark: SparkSession, sf: str) -> DataFrame:
    from kerbside.operators.prep import unify
    from kerbside.operators.setops import merge_months

    return merge_months(
        [unify(raw_yellow(spark, sf), "yellow"), unify(raw_green(spark, sf), "green"), unify(raw_app(spark, sf), "fhvhv")]
    )
