"""Edge rows of unifying, clipping and narrowing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kerbside import schemas as S
from kerbside.functions import maths as N
from kerbside.functions import text as X
from kerbside.functions import time as T
from kerbside.operators import prep as P
from kerbside.operators import setops as U


def ts(text):
    return dt.datetime.fromisoformat(text)


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_hvfhv_without_optional_columns(spark):
    schema = "hvfhs_license_num STRING, pickup_datetime TIMESTAMP_NTZ, dropoff_datetime TIMESTAMP_NTZ, PULocationID INT, DOLocationID INT, trip_miles DOUBLE, base_passenger_fare DOUBLE, tolls DOUBLE, sales_tax DOUBLE, congestion_surcharge DOUBLE, tips DOUBLE"
    at = ts("2024-03-01 00:00:00")
    rows = [("HV0003", at, at, 1, 2, 1.5, 10.0, 1.0, 0.5, 2.75, 3.0), ("HV0002", at, at, 1, 2, 1.5, 10.0, 1.0, 0.5, 2.75, 3.0), ("HV0005", at, at, 1, 2, 1.5, None, 1.0, 0.5, 2.75, 3.0)]
    out = P.unify(spark.createDataFrame(rows, schema), "fhvhv", "2024-03")
    assert out.schema.simpleString() == S.UNIFIED_TRIPS.simpleString()
    # airport fee and tips are not part of the total; a NULL part makes it NULL
    assert sorted(values(out, "VendorID", "payment_type", "total_amount", "tip_amount")) == sorted([(2, 7, 1425, 300), (3, 7, None, 300)])


def test_month_bounds_and_null_payment(spark):
    schema = "tpep_pickup_datetime TIMESTAMP_NTZ, tpep_dropoff_datetime TIMESTAMP_NTZ, PULocationID INT, DOLocationID INT, payment_type INT, trip_distance DOUBLE, tip_amount DOUBLE, tolls_amount DOUBLE, fare_amount DOUBLE, total_amount DOUBLE"
    rows = [(ts(t), ts(t), 1, 2, p, 1.0, 0.125, 0.0, 1.0, 1.0) for t, p in (("2024-12-01 00:00:00", None), ("2024-12-31 23:59:59", 2), ("2025-01-01 00:00:00", 1), ("2024-11-30 23:59:59", 1))]
    out = P.unify(spark.createDataFrame(rows, schema), "yellow", "2024-12")
    assert sorted(values(out, "pickup_datetime", "payment_type", "tip_amount")) == [(ts("2024-12-01 00:00:00"), 5, 12), (ts("2024-12-31 23:59:59"), 2, 12)]


def test_unknown_vendor_keeps_its_columns(spark):
    row = spark.createDataFrame([(9, ts("2024-01-05"), ts("2024-01-05"), 1.0, 3, 4, 1, 1.0, 1.0, 1.0, 1.0)], [f.name for f in S.UNIFIED_TRIPS])
    assert values(P.unify(row, "other"), "VendorID", "fare_amount") == [(9, 100)]


def test_clip_keeps_null_and_limits(spark):
    hub = spark.createDataFrame([(None, None, -5, 99999, 7), (250.0, 20000, 5, 1, None), (-1.0, 1, 2, 3, 4)], "trip_distance DOUBLE, fare_amount BIGINT, tip_amount BIGINT, tolls_amount BIGINT, total_amount BIGINT")
    got = values(P.clip_outliers(hub), "trip_distance", "fare_amount", "tip_amount", "tolls_amount", "total_amount")
    assert got == [(None, None, 0, 5000, 7), (321868, 10000, 5, 1, None), (0, 1, 2, 3, 4)]


def test_narrow_first_label_wins_and_absent_columns_are_skipped(spark):
    df = spark.createDataFrame([(3, "Y", 2.55)], "payment_type INT, wav_match_flag STRING, fee DOUBLE")
    out = P.narrow_types(df, {"int16": ["payment_type", "absent"], "int8": ["payment_type"], "bool_yn": ["wav_match_flag"], "money": ["fee"], "odd": ["fee"]})
    assert out.dtypes == [("payment_type", "smallint"), ("wav_match_flag", "boolean"), ("fee", "int")]
    assert out.first()[1] is True and out.first()[2] in (254, 255)


def test_money_rule_is_limited_to_32_bits(spark):
    df = spark.createDataFrame([(1e12,), (-1e12,), (None,)], "v DOUBLE")
    assert [r[0] for r in df.select(P.money_rule("v")).collect()] == [2**31 - 1, -(2**31), None]


def test_half_cents_round_to_even(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (None,)], "v DOUBLE")
    assert [r[0] for r in df.select(N.to_cents("v")).collect()] == [12, 38, None]


def test_zones_and_periods_are_closed(spark):
    df = spark.createDataFrame([(i, ts(f"2024-01-0{d} 00:00:00")) for i, d in ((1, 1), (263, 2), (264, 2), (265, 3))], "PULocationID INT, pickup_datetime TIMESTAMP_NTZ")
    assert [r[0] for r in P.valid_zones(df).collect()] == [1, 263]
    assert P.in_period(df, "2024-01-01", "2024-01-02").count() == 3


def test_non_finite_is_zero_but_null_stays(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (2.0,)], "v DOUBLE")
    assert [r[0] for r in P.clean_non_finite(df, ["v"]).collect()] == [0.0, 0.0, 0.0, None, 2.0]


def test_ablation(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["fare", "pickup_latitude", "pickup_dist_nyc"])
    assert [P.ablate_features(df, m).columns for m in ("all", "drop_coords", "drop_dists", "drop_all")] == [
        ["fare", "pickup_latitude", "pickup_dist_nyc"], ["fare", "pickup_dist_nyc"], ["fare", "pickup_latitude"], ["fare"]]


def test_unify_and_merge_commute(spark):
    cols = "tpep_pickup_datetime TIMESTAMP_NTZ, tpep_dropoff_datetime TIMESTAMP_NTZ, PULocationID INT, DOLocationID INT, payment_type INT, trip_distance DOUBLE, tip_amount DOUBLE, tolls_amount DOUBLE, fare_amount DOUBLE, total_amount DOUBLE"
    months = [spark.createDataFrame([(ts(t), ts(t), 1, 2, 1, 1.0, 1.0, 0.0, 1.0, 1.0)], cols) for t in ("2024-01-05", "2024-02-05")]
    a = U.merge_months([P.unify(m, "yellow") for m in months])
    b = P.unify(U.merge_months(months), "yellow")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_merge_with_unequal_types_needs_a_schema(spark):
    a, b = spark.createDataFrame([(1,)], "VendorID INT"), spark.createDataFrame([("2",)], "VendorID STRING")
    out = U.merge_months([a, b], S.struct("VendorID TINYINT, fare DOUBLE"))
    assert out.dtypes == [("VendorID", "tinyint"), ("fare", "double")]
    assert sorted(r[0] for r in out.collect()) == [1, 2]


@pytest.mark.parametrize("text,expected", [("12,345", 12345), ("", None), ("n/a", None), (None, None), ("7", 7), ("-1,000", -1000)])
def test_parse_count(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t STRING")
    assert df.select(X.parse_count("t")).first()[0] == expected


def test_parse_coordinates(spark):
    df = spark.createDataFrame([("40°42′N / 40.7128°N 74.0060°W",), ("/ ﻿40.5°N   73.9°W / x",), ("nowhere",), (None,)], "t STRING")
    lat, lon = X.extract_latlon("t")
    assert values(df.select(lat.alias("a"), lon.alias("b")), "a", "b") == [(40.7128, -74.006), (40.5, -73.9), (None, None), (None, None)]
    commas = spark.createDataFrame([("40,75",), ("x",), (None,)], "t STRING")
    assert [r[0] for r in commas.select(X.parse_decimal_comma("t")).collect()] == [40.75, None, None]


def test_times_do_not_depend_on_the_session_zone(spark):
    # 02:30 does not exist in New York on this day
    df = spark.createDataFrame([(ts("2024-03-10 02:45:10.250000"),), (ts("1969-12-31 23:59:59.500000"),)], "t TIMESTAMP_NTZ")
    got = values(df.select(*[T.trunc_time("t", i).alias(i) for i in ("1s", "30m", "1h", "7d")]), "1s", "30m", "1h", "7d")
    assert got[0] == (ts("2024-03-10 02:45:10"), ts("2024-03-10 02:30:00"), ts("2024-03-10 02:00:00"), ts("2024-03-07"))
    assert got[1] == (ts("1969-12-31 23:59:59"), ts("1969-12-31 23:30:00"), ts("1969-12-31 23:00:00"), ts("1969-12-25"))


def test_wall_clock_spans_ignore_daylight_saving(spark):
    """In New York the clocks went from 02:00 to 03:00 on 2024-03-10 and back on 2024-11-03."""
    from kerbside.operators.grid import complete_spine, zone_time_grid

    df = spark.createDataFrame([(ts("2024-03-10 01:30:00"), ts("2024-03-10 03:30:00.5")), (ts("2024-11-03 03:00:00"), ts("2024-11-03 00:30:00"))], "a TIMESTAMP_NTZ, b TIMESTAMP_NTZ")
    assert [r[0] for r in df.select(T.duration_minutes("a", "b")).collect()] == [120 + 0.5 / 60, -150.0]
    assert [r[0] for r in df.select(T.elapsed_seconds("a", "b")).collect()] == [7200, -9000]
    assert df.select(T.from_instant(T.as_instant("a")).alias("a")).collect() == df.select("a").collect()
    zones = spark.createDataFrame([(1,)], "PULocationID INT")
    for interval, n in (("1h", 25), ("1d", 2)):
        grid = zone_time_grid(zones, "2024-03-10 00:00:00", "2024-03-11 00:00:00", interval)
        assert grid.select("time_bucket").distinct().count() == n
        assert grid.agg(F.max("time_bucket")).first()[0] == ts("2024-03-11")
    s = spark.createDataFrame([(1, ts("2024-03-10 00:00:00"), 1), (1, ts("2024-03-10 05:00:00"), 1)], "k INT, t TIMESTAMP_NTZ, n INT")
    assert [r.t.hour for r in complete_spine(s, ["k"], "t", "1h").orderBy("t").collect()] == list(range(6))


def test_grain_choice(spark):
    spans = [("2024-01-01 00:00:00", "2024-01-01 03:00:00"), ("2024-01-01", "2024-01-08"), ("2024-01-01", "2024-01-09"), ("2023-01-01", "2024-01-01"), ("2023-01-01", "2024-01-02")]
    df = spark.createDataFrame([(ts(a), ts(b)) for a, b in spans], "a TIMESTAMP_NTZ, b TIMESTAMP_NTZ")
    assert [r[0] for r in df.select(T.choose_grain(F.col("a"), F.col("b"))).collect()] == ["hour", "hour", "day", "day", "week"]
    assert [r[0] for r in df.select(T.chart_grain(F.col("a"), F.col("b"))).collect()] == ["hour", "day", "day", "month", "month"]


def test_epoch_days_round_up(spark):
    df = spark.createDataFrame([(0,), (1,), (86_400_000,), (-1,)], "x BIGINT")
    assert [str(r[0]) for r in df.select(T.epoch_ms_to_day("x")).collect()] == ["1970-01-01", "1970-01-02", "1970-01-02", "1970-01-01"]


def test_optional_filters(spark):
    df = spark.createDataFrame([(0,), (1,), (2,)], "VendorID INT")
    assert P.optional_in(df, "VendorID", []).count() == 3
    assert P.optional_in(df, "VendorID", [1]).count() == 1


def test_sample_is_reproducible_and_nested(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    five, twenty = (U.sample_fraction(df, p, ["k"]) for p in (5, 20))
    assert five.join(twenty, "k", "left_anti").count() == 0
    assert 150 < five.count() < 350 and 800 < twenty.count() < 1200


def test_append_fails_on_a_gap(spark):
    a = spark.createDataFrame([(ts("2024-01-01 00:00:00"),)], "timestamp TIMESTAMP_NTZ")
    good = spark.createDataFrame([(ts("2024-01-01 01:00:00"),)], "timestamp TIMESTAMP_NTZ")
    bad = spark.createDataFrame([(ts("2024-01-03 01:00:00"),)], "timestamp TIMESTAMP_NTZ")
    assert U.append_checked(a, good).count() == 2
    with pytest.raises(Exception, match="does not continue"):
        U.append_checked(a, bad).collect()


def test_union_merges_true_duplicates(spark):
    a = spark.createDataFrame([(1, 2), (1, 2)], "a INT, b INT")
    assert U.union_distinct(a, a).count() == 1
