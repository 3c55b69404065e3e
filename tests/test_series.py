"""Spines, windows, roll-ups and metrics on hand-made series."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.operators import forecast as FC
from kerbside.operators import grid as G
from kerbside.operators import lookup as J
from kerbside.operators import metrics as M
from kerbside.operators import rollup as A
from kerbside.operators import series as W
from kerbside.operators import setops as U

KEYS = ["VendorID", "PULocationID"]
DAY = dt.datetime(2024, 1, 1)


def hours(spark, spec):
    """{(vendor, zone): {hour: demand}}"""
    rows = [(v, z, DAY + dt.timedelta(hours=h), n) for (v, z), s in spec.items() for h, n in s.items()]
    return spark.createDataFrame(rows, "VendorID INT, PULocationID INT, timestamp TIMESTAMP_NTZ, demand INT")


def by_hour(df, col, vendor=0):
    rows = df.where(F.col("VendorID") == vendor).orderBy("timestamp").collect()
    return {int((r["timestamp"] - DAY).total_seconds() // 3600): r[col] for r in rows}


@pytest.fixture(scope="module")
def gappy(spark):
    return hours(spark, {(0, 1): {0: 4, 1: 2, 5: 6}, (1, 1): {2: 9}})


def test_spine_per_series(gappy):
    full = G.complete_spine(gappy, KEYS, "timestamp", "1h")
    assert by_hour(full, "demand") == {0: 4, 1: 2, 2: None, 3: None, 4: None, 5: 6}
    assert by_hour(full, "demand", 1) == {2: 9}


def test_spine_global_covers_the_table(gappy):
    full = G.complete_spine(gappy, KEYS, "timestamp", "1h", "global")
    assert by_hour(full, "demand", 1) == {0: None, 1: None, 2: 9, 3: None, 4: None, 5: None}
    assert full.count() == 12


def test_windows_over_gaps(gappy):
    assert by_hour(W.moving_average(gappy), "prediction") == {0: None, 1: 4.0, 5: 3.0}
    assert by_hour(W.moving_average(gappy, complete=True), "prediction")[5] == pytest.approx(6 / 5)
    full = G.complete_spine(gappy, KEYS, "timestamp", "1h")
    assert by_hour(W.forward_fill(full, ["demand"]), "demand")[4] == 2
    lin = W.interpolate_linear(full.withColumn("demand", F.col("demand").cast("double")), "demand", KEYS, "timestamp")
    assert by_hour(lin, "demand") == {0: 4.0, 1: 2.0, 2: 3.0, 3: 4.0, 4: 5.0, 5: 6.0}


def test_interpolation_edges_take_the_nearest(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("a", 3, None), ("a", 4, 9.0), ("a", 5, None), ("b", 1, None)], "k STRING, t INT, v DOUBLE")
    got = {(r.k, r.t): r.v for r in W.interpolate_linear(df, "v", ["k"], "t").collect()}
    assert [got["a", t] for t in range(1, 6)] == [5.0, 5.0, 7.0, 9.0, 9.0] and got["b", 1] is None


def test_norms_of_short_and_constant_series(spark):
    s = hours(spark, {(0, 1): {0: 5, 1: 5, 2: 5}, (1, 1): {0: 3}}).withColumns({"avg_distance": F.lit(1.0), "avg_amount": F.lit(2.0)})
    out = W.expanding_norm(s)
    assert by_hour(out, "norm_demand") == {0: 0.0, 1: 0.0, 2: 0.0} and by_hour(out, "demand_sigma", 1) == {0: 1.0}
    rolled = W.rolling_norm(s)
    # the label's deviation stays 0 for a constant window and is 1 without one
    assert by_hour(rolled, "std") == {0: 1.0, 1: 1.0, 2: 0.0}
    assert by_hour(rolled, "demand_sc") == {0: 0.0, 1: 0.0, 2: 0.0}


def test_sequences_drop_short_history(spark):
    s = hours(spark, {(0, 1): {h: h for h in range(7)}, (1, 1): {h: h for h in range(3)}})
    seq = W.sequences(s, ["demand"], 5)
    assert by_hour(seq, "temporal_sequence")[6] == [[2.0], [3.0], [4.0], [5.0], [6.0]]
    assert seq.where("VendorID = 1").count() == 0


def test_leakage_audit_finds_copied_labels(spark):
    s = hours(spark, {(0, 1): {h: h for h in range(10)}})
    clean = W.sequences(W.next_label(s, "demand"), ["demand"], 3).dropna(subset=["label"])
    copied = clean.withColumn("label", F.col("temporal_sequence")[2][0])
    assert W.leakage_audit(clean).first()["label_matches"] == 0
    assert W.leakage_audit(copied).first()["match_share"] == 1.0


def test_first_trip_ties_are_decided_by_the_order(spark):
    df = spark.createDataFrame([(1, 5, 7), (1, 5, 3), (2, 9, 1)], "PULocationID INT, pickup_datetime INT, DOLocationID INT")
    assert sorted(map(tuple, W.first_per_zone(df, ["pickup_datetime", "DOLocationID"]).collect())) == [(1, 5, 3), (2, 9, 1)]


def test_splits_drop_short_series(spark):
    s = hours(spark, {(0, 1): {h: 1 for h in range(100)}, (1, 1): {h: 1 for h in range(20)}})
    parts = W.split_at_fraction(s, 0.8, 50)
    assert parts.where("VendorID = 1").count() == 0 and parts.where("is_train").count() == 80
    cut = DAY + dt.timedelta(hours=73)
    late = W.split_at_date(s, cut, context=72, horizon=10, min_after=24)
    assert late.where("in_train").count() == 73 and late.where("in_val").count() == 82
    # ends within a day of the cut
    assert W.split_at_date(s, DAY + dt.timedelta(hours=77), 72, 10, 20).count() == 0


def test_supervised_windows(spark):
    s = hours(spark, {(0, 1): {h: h for h in range(12)}})
    rows = W.supervised_windows(s, past=3, horizon=2, stride=4).orderBy("timestamp").collect()
    assert [(r.past, r.future) for r in rows] == [([0, 1, 2], [3, 4]), ([4, 5, 6], [7, 8])]


def test_scaling_is_invertible_and_fits_on_training_rows(spark):
    s = hours(spark, {(0, 1): {h: h * h for h in range(8)}, (1, 1): {h: 3 for h in range(8)}})
    fit = F.col("timestamp") < F.lit(str(DAY + dt.timedelta(hours=5))).cast("timestamp_ntz")
    for kind in ("minmax", "robust"):
        scaled = W.unscale(W.scale_per_series(s, "demand", kind, fit, name="x"), "x", "back")
        assert all(math.isclose(r.back, r.demand, abs_tol=1e-9) for r in scaled.collect())
    assert by_hour(W.scale_per_series(s, "demand", "minmax", fit, name="x"), "x")[7] == 49 / 16


def test_continuity(spark):
    a, b = hours(spark, {(0, 1): {0: 1, 4: 1}}), hours(spark, {(0, 1): {5: 1}})
    assert W.continuity_check(a, b).first()["contiguous"] is True
    row = W.continuity_check(a, hours(spark, {(0, 1): {60: 1}})).first()
    assert row["contiguous"] is False and row["gap_days"] == 2


def test_seasonal_naive_tiles_the_last_day(spark):
    s = hours(spark, {(0, 1): {h: h % 24 for h in range(48)}})
    out = FC.seasonal_naive(s, 30)
    mid = by_hour(out, "pred_demand_p50")
    assert mid == {48 + i: float(i % 24) for i in range(30)}
    assert min(by_hour(out, "pred_demand_p10").values()) == 0.0
    assert by_hour(FC.seasonal_naive(s, 5), "pred_demand_p50") == {48 + i: float(i) for i in range(5)}


def test_history_of_a_silent_series_is_zero(spark):
    s = hours(spark, {(0, 1): {100: 3}, (1, 1): {40: 7}})
    full = FC.recent_history(s, 72)
    assert full.count() == 144 and by_hour(full, "demand", 1)[100] == 0 and min(by_hour(full, "demand", 1)) == 29


def test_the_fallback_of_a_profile_counts_values_in_many_tasks(spark):
    history = spark.range(0, 5000, 1, 8).select(
        F.col("id").alias("VendorID"), F.lit(1).alias("PULocationID"), F.lit(DAY).cast("timestamp_ntz").alias("timestamp"),
        F.when(F.col("id") % 7 > 0, F.sqrt("id")).alias("x"), F.lit(None).cast("double").alias("y"),
    )
    ahead = spark.createDataFrame([(-1, 1, dt.datetime(2024, 1, 2))], "VendorID BIGINT, PULocationID INT, timestamp TIMESTAMP_NTZ")
    got = FC.with_profile(ahead, history, {"a": "x", "b": "x", "none": "y"})
    r = got.first()
    expected = np.quantile([i**0.5 for i in range(5000) if i % 7], [0.1, 0.5, 0.9])
    for name in ("a", "b"):
        assert [r[f"pred_{name}_{p}"] for p in ("p10", "p50", "p90")] == pytest.approx(expected.tolist())
    assert r.pred_none_p50 is None
    # exact percentiles buffer every value of a group: only groups of one series may have them
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [" in line and "percentile(" in line and "Aggregate [VendorID" not in line]


def test_forecast_covers_every_series_once(spark):
    s = hours(spark, {(v, 1): {h: v + 1 for h in range(200)} for v in range(3)}).withColumns({"avg_amount": F.lit(5.0), "avg_distance": F.lit(2.0)})
    router = spark.createDataFrame([("0_1", "LOW")], "Series_ID STRING, segment STRING")
    out = FC.forecast(s, router)
    assert out.count() == 72 and out.select("Series_ID").distinct().count() == 3
    assert {r.pred_demand_p50 for r in out.where("VendorID = 2").collect()} == {3.0}
    assert out.where("pred_amount_p50 <> 5").count() == 0


TRIPS = "VendorID INT, PULocationID INT, pickup_datetime TIMESTAMP_NTZ, dropoff_datetime TIMESTAMP_NTZ, trip_distance DOUBLE, fare_amount BIGINT, tip_amount BIGINT, tolls_amount BIGINT, total_amount BIGINT"


def trip(vendor, zone, minute, length, fare=100):
    start = DAY + dt.timedelta(minutes=minute)
    return (vendor, zone, start, start + dt.timedelta(minutes=length), 2.0, fare, 10, 0, fare + 10)


def test_rollup_drops_trips_that_take_no_time(spark):
    t = spark.createDataFrame([trip(0, 1, 0, 5), trip(0, 1, 59, 5), trip(0, 1, 60, 0), trip(0, 1, 60, -3)], TRIPS)
    rows = A.dashboard_rollup(t).collect()
    assert [(r["count"], r.duration, r.fare_amount) for r in rows] == [(2, 10.0, 200)]


def test_grid_has_zeros_and_only_observed_buckets(spark):
    t = spark.createDataFrame([trip(0, 1, 0, 5), trip(0, 1, 180, 5), trip(0, 99, 300, 5)], TRIPS)
    ids = spark.createDataFrame([(1,), (2,)], "PULocationID SMALLINT")
    out = A.zone_measures_over_time(A.dashboard_rollup(t), ids, ["total_trips", "mean_price"], DAY, DAY + dt.timedelta(hours=9), "hour")
    cells = {(r.PULocationID, r.time_bucket.hour): r.total_trips for r in out.collect()}
    # hour 5 occurs, though only in a zone that is not listed
    assert cells == {(1, 0): 1, (2, 0): 0, (1, 3): 1, (2, 3): 0, (1, 5): 0, (2, 5): 0}
    with pytest.raises(ValueError):
        A.zone_measures(A.dashboard_rollup(t), ids, ["nothing"], DAY, DAY)


def test_zero_denominators_give_zero(spark):
    cols = "pickup_datetime TIMESTAMP_NTZ, VendorID INT, PULocationID SMALLINT, count BIGINT, trip_distance DOUBLE, fare_amount BIGINT, tip_amount BIGINT, duration DOUBLE, tolls_amount BIGINT, total_amount BIGINT"
    r = spark.createDataFrame([(DAY, 0, 1, 3, 0.0, 50, 5, 0.0, 0, 55)], cols)
    out = A.zone_measures(r, spark.createDataFrame([(1,)], "PULocationID SMALLINT"), ["mean_tip_dis", "mean_price_time", "mean_price"], DAY, DAY).first()
    assert (out.mean_tip_dis, out.mean_price_time) == (0.0, 0.0) and out.mean_price == pytest.approx(50 / 3)


def test_unknown_zones_get_a_name(spark):
    trips = spark.createDataFrame([(1, 2), (2, 9)], "PULocationID INT, DOLocationID INT")
    zones = spark.createDataFrame([(1, "Harbour", "North")], "LocationID INT, Zone STRING, Borough STRING")
    assert {r.zone for r in J.with_zone_names(trips, zones).collect()} == {"Harbour", "Unknown"}
    assert {(r.PUborough, r.DOborough) for r in J.with_od_boroughs(trips, zones).collect()} == {("North", "Unknown"), ("Unknown", "Unknown")}


def test_missing_weather_is_null_and_fallback_applies(spark):
    trips = spark.createDataFrame([(DAY,), (DAY + dt.timedelta(days=1),)], "pickup_datetime TIMESTAMP_NTZ")
    weather = spark.createDataFrame([(DAY.date(), 0.5, 0.0)], "DATE DATE, PRCP DOUBLE, SNOW DOUBLE")
    assert {(r.rain, r.snow) for r in J.with_station_weather(trips, weather).collect()} == {(True, False), (None, None)}
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 9)], "v INT, z INT")
    out = J.with_fallback(rows, spark.createDataFrame([(1, 1, 5.0)], "v INT, z INT, s DOUBLE"), spark.createDataFrame([(1, 7.0)], "v INT, g DOUBLE"), ["v", "z"], ["v"], "s", "g")
    assert sorted((r.v, r.z, r.s) for r in out.collect()) == [(1, 1, 5.0), (1, 2, 7.0), (2, 9, None)]


def test_latest_rent_wins(spark):
    rent = spark.createDataFrame([(1, dt.date(2024, 1, 1), 9.0), (1, dt.date(2024, 2, 1), 5.0), (1, dt.date(2024, 3, 1), 1.0)], "LocationID INT, Date DATE, AskingRent DOUBLE")
    ids = spark.createDataFrame([(1,), (2,)], "PULocationID INT")
    assert sorted(map(tuple, A.latest_per_zone(rent, ids, "2024-01-01", "2024-02-15").collect())) == [(1, 5.0), (2, 0.0)]


def test_single_row_series_features(spark):
    s = hours(spark, {(0, 1): {0: 2}, (1, 1): {10: 1, 12: 3}}).withColumn("Series_ID", F.concat_ws("_", *KEYS))
    rows = {r.Series_ID: r for r in A.series_features(s).collect()}
    assert rows["0_1"].cv == 0.0 and rows["0_1"].adi == 12.0 and rows["1_1"].morning_demand == 1


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 2.0)], "demand DOUBLE, prediction DOUBLE")
    m = M.error_metrics(df).first()
    assert (m.MAE, m.RMSE, m.MedAE) == (pytest.approx(4 / 3), pytest.approx(math.sqrt(10 / 3)), 1.0)
    r = M.regression_report(df, "demand", "prediction").first()
    assert r.R2 == pytest.approx(1 - 10 / 8)
    assert M.smape(spark.createDataFrame([(0.0, 0.0), (1.0, 3.0)], "a DOUBLE, p DOUBLE"), "a", "p").first()[0] == 0.5
    assert M.huber(spark.createDataFrame([(0.1, 0.0), (1.0, 0.0)], "a DOUBLE, p DOUBLE"), "a", "p").first()[0] == pytest.approx((0.005 + 0.18) / 2)


def test_confusion_rows_sum_to_one(spark):
    df = spark.createDataFrame([(0, 1, 0.9), (0, 1, 0.2), (0, 0, 0.1), (1, 0, 0.7)], "VendorID INT, has_tip INT, p DOUBLE")
    shares = M.confusion(df, ["VendorID"], "has_tip", "p").groupBy("VendorID", "target").agg(F.sum("share").alias("s")).collect()
    assert all(r.s == 1.0 for r in shares)
    report = {r.VendorID: r for r in M.classification_report(df, ["VendorID"], "has_tip", "p").collect()}
    assert report[0].precision == 1.0 and report[0].recall == 0.5 and report[1].precision == 0.0 and report[1].recall is None


def test_balanced_sample_keeps_a_trip_of_every_zone(spark):
    rows = [(DAY + dt.timedelta(minutes=i), i % 40 + 1, 5, 1, 0, 1, 10, i) for i in range(400)]
    t = spark.createDataFrame(rows, "pickup_datetime TIMESTAMP_NTZ, PULocationID INT, DOLocationID INT, tip_amount INT, VendorID INT, payment_type INT, fare_amount INT, id INT")
    out = U.balanced_sample(t, {0: (1, 5)}, ["id"], ["pickup_datetime"])
    assert out.select("PULocationID").distinct().count() == 40 and out.count() < 100
