"""Queries for sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbside.functions.time import elapsed_micros
from kerbside.plans import bindings as B
from kerbside.plans.registry import register, with_tables
from kerbside.scratch import scratch_dir
from kerbside.sources import readers as R
from kerbside.sources import writers as W


register("read_parquet", lambda s, d: R.read_parquet(s, {f"{d}/orders.parquet"}, "o_orderkey BIGINT, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ"),
         "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders")


def _csv_round_trip(spark, sf):
    path = scratch_dir(spark, "csv")
    W.write_csv(B.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return R.read_csv(spark, path, "c_custkey BIGINT, c_name STRING, c_acctbal DOUBLE")


register("read_csv", _csv_round_trip, "SELECT c_custkey, c_name, c_acctbal FROM customer")


def _csv_inferred(spark, sf):
    path = scratch_dir(spark, "report")
    df = B.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("License Class"), F.col("o_totalprice").alias("Trips Per Day")
    )
    W.write_csv(df, path)
    return R.read_csv(spark, path).groupBy("License Class").agg(F.max("Trips Per Day").alias("most"))


register("write_csv", _csv_inferred,
         """SELECT o_orderpriority AS "License Class", max(o_totalprice) AS most FROM orders GROUP BY 1""")


def _features(spark, sf):
    """One square zone per customer, written as GeoJSON lines and read back."""
    x, y = F.col("c_custkey") % 100, F.floor(F.col("c_custkey") / 100)
    ring = F.array(F.array(x, y), F.array(x + 1, y), F.array(x + 1, y + 1), F.array(x, y + 1), F.array(x, y)).cast("array<array<double>>")
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.col("c_custkey").cast("string").alias("locationid"), F.col("c_name").alias("zone"), F.col("c_mktsegment").alias("borough")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
    )
    path = scratch_dir(spark, "features")
    B.table(spark, sf, "customer").select(F.to_json(feature).alias("value")).write.text(path)
    return R.read_features(spark, path, lines=True)


register("read_features",
         lambda s, d: _features(s, d).select("locationid", "zone", "borough", F.size("polygons").alias("parts"),
                                             F.col("polygons")[0][0][2][0].alias("x_max")),
         """SELECT CAST(c_custkey AS INTEGER) AS locationid, c_name AS zone, c_mktsegment AS borough, 1 AS parts,
              (c_custkey % 100 + 1)::DOUBLE AS x_max FROM customer""")


def _columns_to_rows(spark, sf):
    payload = B.table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").alias("rain"), F.sequence(F.lit(1), F.size("embedding")).alias("hour")
    )
    return R.columns_to_rows(payload, ["hour", "rain"], ["vec_id"])


register("columns_to_rows", _columns_to_rows,
         "SELECT vec_id, CAST(generate_subscripts(embedding, 1) AS INTEGER) AS hour, unnest(embedding) AS rain FROM embeddings")


def _two_files(spark, sf):
    orders, path = B.table(spark, sf, "orders"), scratch_dir(spark, "merged")
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    files = [f"{path}/a", f"{path}/b"]
    W.write_parquet(orders.where(early).select("o_orderkey", "o_totalprice"), files[0])
    W.write_parquet(orders.where(~early).select("o_orderkey", "o_totalprice", "o_orderstatus"), files[1])
    return files


register("read_merged", lambda s, d: R.read_merged(s, _two_files(s, d)),
         """SELECT o_orderkey, o_totalprice, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN o_orderstatus END AS o_orderstatus
            FROM orders""")


def _unequal_types(spark, sf):
    orders, path = B.table(spark, sf, "orders"), scratch_dir(spark, "unequal")
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    files = [f"{path}/a", f"{path}/b"]
    W.write_parquet(orders.where(early).select("o_orderkey", F.col("o_custkey").cast("int").alias("o_custkey")), files[0])
    W.write_parquet(orders.where(~early).select("o_orderkey", F.col("o_custkey").cast("double").alias("o_custkey")), files[1])
    from kerbside.schemas import struct

    return R.read_merged(spark, files, struct("o_orderkey BIGINT, o_custkey BIGINT, note STRING"))


register("read_merged_unequal_types", _unequal_types,
         "SELECT o_orderkey, o_custkey, CAST(NULL AS VARCHAR) AS note FROM orders")

VENDORS = ["fhvhv", "green", "yellow"]
EXPECTED = """expected AS (SELECT CAST(month AS DATE) AS month, vendor FROM
  (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS month FROM orders),
  (VALUES ('fhvhv'), ('green'), ('yellow')) v(vendor))"""


def _expected(spark, sf):
    orders = B.table(spark, sf, "orders")
    return R.expected_months_vendors(
        spark, orders.agg(F.min("o_orderdate")).scalar(), orders.agg(F.max("o_orderdate")).scalar(), VENDORS
    )


register("expected_months_vendors", _expected, with_tables(EXPECTED, select="SELECT * FROM expected"))


def _missing(spark, sf):
    status = F.col("o_orderstatus")
    existing = B.table(spark, sf, "orders").select(
        F.trunc("o_orderdate", "month").alias("month"),
        F.when(status == "F", "fhvhv").when(status == "O", "green").otherwise("yellow").alias("vendor"),
    )
    return R.missing_partitions(_expected(spark, sf), existing)


register("missing_partitions", _missing, with_tables(EXPECTED, """existing AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
  CASE o_orderstatus WHEN 'F' THEN 'fhvhv' WHEN 'O' THEN 'green' ELSE 'yellow' END AS vendor FROM orders)""",
  select="SELECT * FROM expected ANTI JOIN existing USING (month, vendor)"))


def _by_month(spark, sf):
    """All orders in one folder per vendor and month, <vendor>_<month>."""
    path, status = scratch_dir(spark, "months"), F.col("o_orderstatus")
    vendor = F.when(status == "F", "fhvhv").when(status == "O", "green").otherwise("yellow")
    rows = B.table(spark, sf, "orders").withColumn("file", F.concat_ws("_", vendor, F.date_format("o_orderdate", "yyyy-MM")))
    rows.repartition("file").write.partitionBy("file").parquet(path)
    return spark.read.option("basePath", path).parquet(path)


register("list_stored_months", lambda s, d: R.stored_partitions(_by_month(s, d)),
         """SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CASE o_orderstatus WHEN 'F' THEN 'fhvhv' WHEN 'O' THEN 'green' ELSE 'yellow' END AS vendor FROM orders""")
register("missing_stored_months", lambda s, d: R.missing_partitions(_expected(s, d), R.stored_partitions(_by_month(s, d))),
         with_tables(EXPECTED, """existing AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
           CASE o_orderstatus WHEN 'F' THEN 'fhvhv' WHEN 'O' THEN 'green' ELSE 'yellow' END AS vendor FROM orders)""", select="SELECT * FROM expected ANTI JOIN existing USING (month, vendor)"))


def _collection(spark, sf):
    """The nations as one FeatureCollection document."""
    x = F.col("n_nationkey").cast("double")
    ring = F.array(F.array(x, x), F.array(x + 1, x), F.array(x + 1, x + 1), F.array(x, x + 1), F.array(x, x))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.col("n_nationkey").cast("string").alias("locationid"), F.col("n_name").alias("zone"), F.col("n_regionkey").cast("string").alias("borough")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
    )
    path = scratch_dir(spark, "collection")
    doc = B.table(spark, sf, "nation").agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.sort_array(F.collect_list(feature)).alias("features"))).alias("value"))
    doc.write.text(path)
    return R.read_features(spark, path)


register("read_feature_collection",
         lambda s, d: _collection(s, d).select("locationid", "zone", "borough", F.size("polygons").alias("parts"), F.col("polygons")[0][0][2][0].alias("x_max")),
         "SELECT CAST(n_nationkey AS INTEGER) AS locationid, n_name AS zone, CAST(n_regionkey AS VARCHAR) AS borough, 1 AS parts, n_nationkey::DOUBLE + 1 AS x_max FROM nation")


def _parquet_round_trip(spark, sf):
    path = scratch_dir(spark, "parquet")
    W.write_parquet(B.series(spark, sf), path)
    return R.read_parquet(spark, path)


SERIES_ROWS = with_tables(B.EVENT_TRIPS, B.SERIES, select="SELECT * FROM series")
register("write_parquet", _parquet_round_trip, SERIES_ROWS)


def _zstd(spark, sf):
    path = scratch_dir(spark, "zstd")
    W.write_parquet(B.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), path, "zstd", 12)
    return R.read_parquet(spark, path)


register("write_options", _zstd, "SELECT o_orderkey, o_totalprice FROM orders")


def _series_folders(spark, sf):
    path = scratch_dir(spark, "series")
    W.write_series(B.series(spark, sf), path)
    return spark.read.parquet(path)


register("write_series", _series_folders, with_tables(B.EVENT_TRIPS, B.SERIES, B.KEYED, select="SELECT * FROM keyed"))


def _sorted_files(spark, sf):
    path = scratch_dir(spark, "sorted")
    W.write_sorted(B.rollup(spark, sf), path, ["pickup_datetime", "VendorID", "PULocationID"])
    return spark.read.parquet(path)


register("write_sorted", _sorted_files, with_tables(B.TRIPS, B.ROLLUP, select="SELECT * FROM rollup_"))


def _write_features(spark, sf):
    path = scratch_dir(spark, "points")
    W.write_features(B.places(spark, sf), path, "lon", "lat", ["start_id"])
    schema = "type STRING, properties STRUCT<start_id: BIGINT>, geometry STRUCT<type: STRING, coordinates: ARRAY<DOUBLE>>"
    return spark.read.schema(schema).json(path).select(
        "type", "properties.start_id", F.col("geometry.type").alias("shape"),
        F.col("geometry.coordinates")[0].alias("lon"), F.col("geometry.coordinates")[1].alias("lat"),
    )


register("write_features", _write_features,
         with_tables(B.PLACES, select="SELECT 'Feature' AS type, start_id, 'Point' AS shape, lon, lat FROM places"))


def _router(spark, sf):
    path = scratch_dir(spark, "router")
    segments = B.keyed_series(spark, sf).groupBy("Series_ID").agg(
        F.when(F.sum("demand") >= 80, "HIGH").otherwise("LOW").alias("segment")
    )
    W.save_router(segments, path)
    return W.load_router(spark, path)


register("save_router", _router, with_tables(B.EVENT_TRIPS, B.SERIES, B.KEYED,
         select="SELECT Series_ID, CASE WHEN sum(demand) >= 80 THEN 'HIGH' ELSE 'LOW' END AS segment FROM keyed GROUP BY 1"))
register("preview", lambda s, d: R.preview(B.table(s, d, "events"), ["ts", "event_id"]).select("event_id", "ts", "value"),
         "SELECT event_id, ts, value FROM events ORDER BY ts, event_id LIMIT 5")
register("row_count", lambda s, d: R.row_count(B.trips(s, d)), with_tables(B.TRIPS, select="SELECT count(*) AS rows FROM trips"))


def _epoch_series(spark, sf, *keys):
    from kerbside.operators.refdata import epoch_series_to_daily

    points = B.table(spark, sf, "events").select(
        *keys, F.floor(elapsed_micros(F.lit("1970-01-01").cast("timestamp_ntz"), "ts") / 1000).alias("x"), F.col("value").alias("y")
    )
    return epoch_series_to_daily(points, keys)


CEILED = """CAST(date_trunc('day', ms) + CASE WHEN ms > date_trunc('day', ms) THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS DATE) AS "Date",
  value AS cnn_fear_index FROM (SELECT *, make_timestamp(epoch_ms(ts) * 1000) AS ms FROM events)"""
register("epoch_series_to_daily", lambda s, d: _epoch_series(s, d, "event_id"), f"SELECT event_id, {CEILED}")


def _epoch_filled(spark, sf):
    """S16, then W22: many instants a day become one value for every day."""
    from kerbside.operators.series import daily_ffill

    return daily_ffill(_epoch_series(spark, sf, "event_type"), "Date", "cnn_fear_index", ["event_type"])


register("epoch_series_filled", _epoch_filled, with_tables(f"points AS (SELECT event_type, {CEILED})",
    """daily AS (SELECT event_type, "Date", max(cnn_fear_index) AS v FROM points GROUP BY 1, 2)""",
    """span AS (SELECT event_type, CAST(unnest(generate_series(min("Date"), max("Date"), INTERVAL 1 DAY)) AS DATE) AS "Date" FROM daily GROUP BY 1)""",
    select="""SELECT event_type, "Date", last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY "Date") AS cnn_fear_index FROM span LEFT JOIN daily USING (event_type, "Date")"""))
register("extract_links", lambda s, d: R.extract_links(B.table(s, d, "pages")),
         """SELECT page_id, CAST(generate_subscripts(links, 1) - 1 AS INTEGER) AS position, unnest(links) AS href
            FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS links FROM pages) WHERE len(links) > 0""")
