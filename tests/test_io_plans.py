"""Files, streams and the shape of the plans."""

import json
import re

import pytest
from pyspark.sql import functions as F

from kerbside.operators import prep as P
from kerbside.operators import refdata as RD
from kerbside.operators import rollup as A
from kerbside.plans import QUERIES, bindings as B
from kerbside.scratch import scratch_dir
from kerbside.sources import readers as R
from kerbside.sources import writers as W
from kerbside.streaming.hourly import hourly_series_stream, latest_hours, write_stream, write_updates

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_collection(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"locationid": "7", "zone": "Quay", "borough": "East"}, "geometry": {"type": "Polygon", "coordinates": square}},
        {"type": "Feature", "properties": {"locationid": "8", "zone": "Hill", "borough": "West"}, "geometry": {"type": "MultiPolygon", "coordinates": [square, square]}}]}
    (tmp_path / "zones.geojson").write_text(json.dumps(doc, indent=1))
    rows = R.read_features(spark, str(tmp_path / "zones.geojson")).orderBy("locationid").collect()
    assert [(r.locationid, r.zone, len(r.polygons)) for r in rows] == [(7, "Quay", 1), (8, "Hill", 2)]
    assert rows[0].polygons[0][0][2] == [1.0, 1.0]


def test_csv_names_with_spaces(spark, tmp_path):
    (tmp_path / "report.csv").write_text('Month/Year,License Class,Trips Per Day\n2024-01,Yellow,"12,345"\n')
    df = R.read_csv(spark, str(tmp_path / "report.csv"), "`Month/Year` STRING, `License Class` STRING, `Trips Per Day` STRING")
    assert tuple(df.first()) == ("2024-01", "Yellow", "12,345")


def test_stored_months_and_missing_only(spark, tmp_path):
    for name in ("yellow_2024-01", "green_2024-02"):
        spark.range(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    files = spark.read.parquet(*[str(p) for p in tmp_path.iterdir()])
    names = files.select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("n")).distinct()
    stored = names.select(F.to_date(F.concat(F.regexp_extract("n", r"(\d{4}-\d{2})", 1), F.lit("-01"))).alias("month"), F.regexp_extract("n", "^([a-z]+)_", 1).alias("vendor"))
    missing = R.missing_partitions(R.expected_months_vendors(spark, "2024-01-15", "2024-02-01", ["yellow", "green"]), stored)
    assert sorted((str(r.month), r.vendor) for r in missing.collect()) == [("2024-01-01", "green"), ("2024-02-01", "yellow")]


def test_one_file_per_series(spark, tmp_path):
    W.write_series(B.series(spark, SF), str(tmp_path / "s"))
    folders = [p for p in (tmp_path / "s").iterdir() if p.name.startswith("Series_ID=")]
    assert len(folders) == B.keyed_series(spark, SF).select("Series_ID").distinct().count()
    assert all(len([f for f in p.iterdir() if f.name.endswith(".parquet")]) == 1 for p in folders)


def test_sorted_files_do_not_overlap(spark, tmp_path):
    W.write_sorted(B.rollup(spark, SF), str(tmp_path / "r"), ["pickup_datetime", "VendorID"])
    files = spark.read.parquet(str(tmp_path / "r")).groupBy(F.input_file_name().alias("f")).agg(
        F.min("pickup_datetime").alias("lo"), F.max("pickup_datetime").alias("hi")).orderBy("lo").collect()
    assert all(a.hi <= b.lo for a, b in zip(files, files[1:]))


def test_overwrite_replaces(spark, tmp_path):
    for n in (5, 3):
        W.write_parquet(spark.range(n), str(tmp_path / "x"), "zstd", 3)
    assert spark.read.parquet(str(tmp_path / "x")).count() == 3


def test_wide_rents_become_complete(spark):
    rows = [("NYC", "Manhattan", 9.0, 9.0, None, 9.0), ("All Midtown", "Manhattan", None, 4.0, None, 8.0), ("Chelsea", "Manhattan", None, None, None, 7.0), ("Astoria", "Queens", None, 1.0, None, None)]
    wide = spark.createDataFrame(rows, "areaName STRING, Borough STRING, `2024-01` DOUBLE, `2024-02` DOUBLE, `2024-03` DOUBLE, `2024-04` DOUBLE")
    got = {}
    for r in RD.asking_rent(wide).orderBy("Date").collect():
        got.setdefault(r.areaName, []).append(r.AskingRent)
    # Chelsea takes its parent's original cells, then interpolates; Astoria's parent is absent
    assert got == {"NYC": [9.0, 9.0, 9.0, 9.0], "All Midtown": [9.0, 4.0, 6.0, 8.0], "Chelsea": [4.0, 4.0, 5.5, 7.0], "Astoria": [1.0, 1.0, 1.0, 1.0]}


def test_restaurants_are_complete_and_distinct(spark):
    rows = [("A", "7", "40,5", "-73,9"), ("A", "7", "40,5", "-73,9"), ("B", None, "40,5", "-73,9"), ("C", "7", "", "-73,9")]
    out = RD.restaurant_points(spark.createDataFrame(rows, "DBA STRING, SCORE STRING, Latitude STRING, Longitude STRING"))
    assert [tuple(r) for r in out.collect()] == [("A", 7.0, 40.5, -73.9)]


def test_stream_equals_batch(spark, tmp_path):
    trips = B.event_trips(spark, SF)
    source = str(tmp_path / "in")
    trips.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(trips.schema).option("maxFilesPerTrigger", 10).parquet(source)
    query = write_updates(hourly_series_stream(stream, "40 days"), str(tmp_path / "all"), str(tmp_path / "all-checkpoint"))
    query.awaitTermination(240)
    assert query.exception() is None
    whole, batch = latest_hours(spark, str(tmp_path / "all")), A.hourly_series(trips)
    assert whole.exceptAll(batch).count() == 0 and batch.exceptAll(whole).count() == 0
    stream = spark.readStream.schema(trips.schema).option("maxFilesPerTrigger", 10).parquet(source)
    query = write_stream(hourly_series_stream(stream, "1 hour"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination(240)
    assert query.exception() is None
    streamed, batch = spark.read.parquet(str(tmp_path / "out")), A.hourly_series(trips)
    # hours the watermark has not passed stay open
    newest = streamed.agg(F.max("timestamp")).first()[0]
    final = batch.where(F.col("timestamp") <= F.lit(str(newest)).cast("timestamp_ntz"))
    assert streamed.count() > 500
    assert streamed.exceptAll(final).count() == 0 and final.exceptAll(streamed).count() == 0


def test_scratch_folders_lie_in_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert scratch_dir(spark, "x").startswith(root) and scratch_dir(spark, "x") != scratch_dir(spark, "x")


FITTED = {"gaussian_mixture_tips", "tip_hurdle", "tip_tweedie", "classify_demand", "segment_series", "segment_by_volume", "lag_regression", "scenario_forecast"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FITTED))
def test_no_query_multiplies_rows_by_a_product(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # no Python rows in the plans, except Arrow batches of the model scorer
    assert "BatchEvalPython" not in text and (("MapInPandas" not in text) or name == "score_partitions")


def test_filters_and_columns_reach_the_scan(spark):
    df = P.clip_to_month(B.table(spark, SF, "orders"), "1997-03", "o_orderdate").select("o_orderkey")
    text = plan(df)
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>", text)


def test_dimension_joins_broadcast(spark):
    text = plan(QUERIES["with_od_centroids"](spark, SF))
    assert text.count("BroadcastHashJoin") >= 2 and "SortMergeJoin" not in text


def test_spine_and_window_share_one_shuffle(spark):
    from kerbside.operators.series import moving_average

    text = plan(moving_average(spark.read.parquet(f"{SF}/events.parquet").selectExpr(
        "event_id % 3 AS VendorID", "user_id AS PULocationID", "date_trunc('hour', ts) AS timestamp", "1 AS demand"), complete=True))
    assert text.count("Exchange hashpartitioning") == 1
