"""Queries for windows over series, unions, samples and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbside.operators import metrics as M
from kerbside.operators import rollup as A
from kerbside.operators import series as W
from kerbside.operators import setops as U
from kerbside.plans import bindings as B
from kerbside.plans.registry import register, with_tables
from kerbside.plans.rollup_queries import rounded

E = [B.EVENT_TRIPS, B.SERIES]
KEYS = ["VendorID", "PULocationID"]
OVER = 'PARTITION BY VendorID, PULocationID ORDER BY "timestamp"'
BEFORE5 = f"({OVER} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"


def int_series(spark, sf):
    """Series with integer-valued measures, so that window means are exact."""
    return B.series(spark, sf).select(*KEYS, "timestamp", "demand", F.floor("avg_distance").cast("double").alias("avg_distance"),
                                      F.floor("avg_amount").cast("double").alias("avg_amount"))


INT_SERIES = """s AS (SELECT VendorID, PULocationID, "timestamp", demand, floor(avg_distance)::DOUBLE AS avg_distance,
  floor(avg_amount)::DOUBLE AS avg_amount FROM series)"""

register("moving_average", lambda s, d: W.moving_average(B.series(s, d)),
         with_tables(*E, select=f"SELECT *, avg(demand) OVER {BEFORE5} AS prediction FROM series"))
register("moving_average_complete",
         lambda s, d: W.moving_average(B.series(s, d).select(*KEYS, "timestamp", "demand"), complete=True),
         with_tables(*E, B.FULL, select=f"""SELECT VendorID, PULocationID, "timestamp", coalesce(demand, 0) AS demand,
           avg(coalesce(demand, 0)) OVER {BEFORE5} AS prediction FROM full_"""))
MEASURED = ["demand", "avg_distance", "avg_amount"]
EXPANDING = ", ".join(
    f"""avg({c}) OVER w AS {c}_mu, CASE WHEN coalesce(stddev_samp({c}) OVER w, 0) = 0 THEN 1 ELSE stddev_samp({c}) OVER w END AS {c}_sigma"""
    for c in MEASURED
)
NORMED = """normed AS (SELECT *, """ + ", ".join(f"({c} - {c}_mu) / {c}_sigma AS norm_{c}" for c in MEASURED) + f""" FROM
  (SELECT *, {EXPANDING} FROM s WINDOW w AS ({OVER} ROWS UNBOUNDED PRECEDING)))"""
MUS = [f"{c}_{x}" for c in MEASURED for x in ("mu", "sigma")] + [f"norm_{c}" for c in MEASURED]


def sql_round(cols, digits=6):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


register("expanding_norm", lambda s, d: rounded(W.expanding_norm(int_series(s, d)), 6, *MUS),
         with_tables(*E, INT_SERIES, NORMED, select=f"SELECT * REPLACE ({sql_round(MUS)}) FROM normed"))
SCALED = ", ".join(
    f"coalesce(({c} - avg({c}) OVER w) / coalesce(nullif(stddev_samp({c}) OVER w, 0), 1), 0) AS {c}_sc" for c in MEASURED
)
ROLLED = f"""rolled AS (SELECT *, coalesce(avg(demand) OVER w, 0) AS mean, coalesce(stddev_samp(demand) OVER w, 1) AS std, {SCALED} FROM s
  WINDOW w AS ({OVER} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))"""
SC = [f"{c}_sc" for c in MEASURED]
register("rolling_norm", lambda s, d: rounded(W.rolling_norm(int_series(s, d)), 6, "mean", "std", *SC),
         with_tables(*E, INT_SERIES, ROLLED, select=f"SELECT * REPLACE ({sql_round(['mean', 'std', *SC])}) FROM rolled"))
PREFIX = {"demand": "d", "avg_distance": "dist", "avg_amount": "amt"}
LAGS = ", ".join(
    f"coalesce(lag({c}, {i}) OVER ({OVER})::DOUBLE, 0) AS {PREFIX[c]}_t{i}" for c in MEASURED for i in range(5, 0, -1)
)
register("lag_features", lambda s, d: W.lag_features(int_series(s, d), 5, PREFIX),
         with_tables(*E, INT_SERIES, select=f"SELECT *, {LAGS} FROM s"))
register("next_label", lambda s, d: W.next_label(int_series(s, d), "demand"),
         with_tables(*E, INT_SERIES, select=f"SELECT *, lead(demand) OVER ({OVER}) AS label FROM s"))
register("sequences",
         lambda s, d: W.sequences(int_series(s, d), ["demand", "avg_amount"], 5).select(*KEYS, "timestamp", F.flatten("temporal_sequence").alias("seq")),
         with_tables(*E, INT_SERIES, select=f"""SELECT VendorID, PULocationID, "timestamp", flatten(list([demand::DOUBLE, avg_amount]) OVER w) AS seq FROM s
           WINDOW w AS ({OVER} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER w = 5"""))


def _audit(spark, sf):
    labelled = W.next_label(int_series(spark, sf), "demand")
    return W.leakage_audit(W.sequences(labelled, ["demand"], 5).dropna(subset=["label"]))


register("leakage_audit", _audit, with_tables(*E, """l AS (SELECT *, lead(demand) OVER w AS label, lead("timestamp") OVER w AS later, row_number() OVER w AS rn FROM series
  WINDOW w AS (PARTITION BY VendorID, PULocationID ORDER BY "timestamp"))""", select="""SELECT count(*) AS rows, count(*) FILTER (later <= "timestamp") AS time_errors,
  count(*) FILTER (label = demand) AS label_matches, count(*) FILTER (label = demand)::DOUBLE / count(*) AS match_share FROM l WHERE rn >= 5 AND label IS NOT NULL"""))
register("first_per_zone",
         lambda s, d: W.first_per_zone(B.trips(s, d).select("PULocationID", "pickup_datetime", "DOLocationID", "tip_amount", "l_orderkey"), ["pickup_datetime", "DOLocationID", "tip_amount"]),
         with_tables(B.TRIPS, select="""SELECT PULocationID, pickup_datetime, DOLocationID, tip_amount, l_orderkey FROM trips
           QUALIFY row_number() OVER (PARTITION BY PULocationID ORDER BY pickup_datetime, DOLocationID, tip_amount, l_orderkey) = 1"""))
register("last_n_per_series", lambda s, d: W.last_n_per_series(B.series(s, d), 20),
         with_tables(*E, select="""SELECT * FROM series QUALIFY row_number() OVER (PARTITION BY VendorID, PULocationID ORDER BY "timestamp" DESC) <= 20"""))
register("lag_backtest", lambda s, d: W.lag_backtest(B.series(s, d)),
         with_tables(*E, B.FULL, f"""p AS (SELECT VendorID, PULocationID, abs(coalesce(demand, 0) - lag(coalesce(demand, 0), 24) OVER ({OVER})) AS err,
           row_number() OVER ({OVER}) - 73 AS pos FROM full_)""", select="""SELECT VendorID, PULocationID, CAST(pos // 24 AS INTEGER) AS block, avg(err) AS mae
           FROM p WHERE pos >= 0 GROUP BY 1, 2, 3 HAVING count(*) = 24"""))
register("shifted_rolling_mean", lambda s, d: W.shifted_rolling_mean(B.series(s, d)),
         with_tables(*E, select=f"SELECT *, avg(demand) OVER ({OVER} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS prediction FROM series"))


def _full(spark, sf):
    from kerbside.operators.grid import complete_spine

    return complete_spine(int_series(spark, sf), KEYS, "timestamp", "1h")


FULL_INT = B.FULL.replace("s.avg_distance, s.avg_amount", "floor(s.avg_distance)::DOUBLE AS avg_distance, floor(s.avg_amount)::DOUBLE AS avg_amount")
register("forward_fill", lambda s, d: W.forward_fill(_full(s, d), ["avg_distance", "avg_amount"]),
         with_tables(*E, FULL_INT, select=f"""SELECT * REPLACE (coalesce(last_value(avg_distance IGNORE NULLS) OVER w, 0) AS avg_distance,
           coalesce(last_value(avg_amount IGNORE NULLS) OVER w, 0) AS avg_amount) FROM full_ WINDOW w AS ({OVER} ROWS UNBOUNDED PRECEDING)"""))
register("fill_static",
         lambda s, d: W.fill_static(_full(s, d).withColumn("static", F.when(F.col("demand").isNotNull(), F.col("PULocationID") * 3)), ["static"]),
         with_tables(*E, FULL_INT, select="SELECT *, PULocationID * 3 AS static FROM full_"))
register("interpolate_linear",
         lambda s, d: W.interpolate_linear(_full(s, d), "avg_amount", KEYS, "timestamp"),
         with_tables(*E, FULL_INT, f"""n AS (SELECT *, row_number() OVER ({OVER}) AS p FROM full_),
           k AS (SELECT *, CASE WHEN avg_amount IS NOT NULL THEN p END AS kp FROM n),
           m AS (SELECT *, last_value(avg_amount IGNORE NULLS) OVER b AS v0, last_value(kp IGNORE NULLS) OVER b AS p0,
             first_value(avg_amount IGNORE NULLS) OVER a AS v1, first_value(kp IGNORE NULLS) OVER a AS p1 FROM k
             WINDOW b AS ({OVER} ROWS UNBOUNDED PRECEDING), a AS ({OVER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
                     select="""SELECT VendorID, PULocationID, "timestamp", demand, avg_distance,
             coalesce(avg_amount, v0 + (v1 - v0) * ((p - p0)::DOUBLE / nullif(p1 - p0, 0)), v0, v1) AS avg_amount FROM m"""))
register("split_at_fraction", lambda s, d: W.split_at_fraction(B.series(s, d), 0.8, 8),
         with_tables(*E, select="""SELECT *, row_number() OVER (PARTITION BY VendorID, PULocationID ORDER BY "timestamp") <= floor(count(*) OVER (PARTITION BY VendorID, PULocationID) * 0.8::DOUBLE) AS is_train
           FROM series QUALIFY count(*) OVER (PARTITION BY VendorID, PULocationID) >= 8"""))
CUT = "2024-01-20"
register("split_at_date", lambda s, d: W.split_at_date(_full(s, d), CUT),
         with_tables(*E, FULL_INT, """c AS (SELECT *, count(*) FILTER ("timestamp" < TIMESTAMP '2024-01-20') OVER g AS b, count(*) FILTER ("timestamp" >= TIMESTAMP '2024-01-20') OVER g AS a,
           max("timestamp") OVER g AS e, row_number() OVER (PARTITION BY VendorID, PULocationID ORDER BY "timestamp") AS rn FROM full_ WINDOW g AS (PARTITION BY VendorID, PULocationID))""",
                     select="""SELECT * EXCLUDE (a, b, e, rn), "timestamp" < TIMESTAMP '2024-01-20' AS in_train, rn > b - 72 AND rn <= b + 168 AS in_val FROM c
           WHERE b >= 72 AND a >= 24 AND e >= TIMESTAMP '2024-01-21'"""))
register("supervised_windows",
         lambda s, d: W.supervised_windows(_full(s, d).fillna(0)).select(*KEYS, "timestamp", "past", "future"),
         with_tables(*E, FULL_INT, f"""v AS (SELECT VendorID, PULocationID, "timestamp", row_number() OVER ({OVER}) - 1 AS pos,
           list(coalesce(demand, 0)) OVER ({OVER} ROWS BETWEEN 72 PRECEDING AND 1 PRECEDING) AS past,
           list(coalesce(demand, 0)) OVER ({OVER} ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) AS future FROM full_)""",
                     select="""SELECT VendorID, PULocationID, "timestamp", past, future FROM v WHERE len(past) = 72 AND len(future) = 24 AND (pos - 72) % 24 = 0"""))
register("time_index", lambda s, d: W.time_index(B.series(s, d).select(*KEYS, "timestamp"), "30m"),
         with_tables(*E, select="""SELECT VendorID, PULocationID, "timestamp", CAST((epoch("timestamp") - (SELECT epoch(min("timestamp")) FROM series)) / 1800 AS INTEGER) AS time_idx FROM series"""))


def _scaled(spark, sf, kind):
    rows = int_series(spark, sf).select(*KEYS, "timestamp", "avg_amount")
    fit = F.col("timestamp") < F.lit(CUT).cast("timestamp_ntz")
    scaled = W.scale_per_series(rows, "avg_amount", kind, fit, name="x")
    return rounded(W.unscale(scaled, "x", "back"), 6, "x", "back")


for kind, centre, spread in (
    ("minmax", "min(f) OVER g", "max(f) OVER g - min(f) OVER g"),
    ("robust", "quantile_cont(f, 0.5::DOUBLE) OVER g", "quantile_cont(f, 0.75::DOUBLE) OVER g - quantile_cont(f, 0.25::DOUBLE) OVER g"),
):
    register(f"scale_per_series_{kind}", lambda s, d, k=kind: _scaled(s, d, k),
             with_tables(*E, INT_SERIES, f"""f AS (SELECT *, CASE WHEN "timestamp" < TIMESTAMP '{CUT}' THEN avg_amount END AS f FROM s),
               c AS (SELECT *, {centre} AS x_centre, {spread} AS sp FROM f WINDOW g AS (PARTITION BY VendorID, PULocationID)),
               z AS (SELECT VendorID, PULocationID, "timestamp", avg_amount, x_centre, CASE WHEN sp = 0 THEN 1 ELSE sp END AS x_spread FROM c)""",
                         select="""SELECT *, round((avg_amount - x_centre) / x_spread, 6) AS x,
               round((avg_amount - x_centre) / x_spread * x_spread + x_centre, 6) AS back FROM z"""))
register("last_hours", lambda s, d: W.last_hours(B.series(s, d), 72),
         with_tables(*E, select="""SELECT * FROM series WHERE "timestamp" >= (SELECT max("timestamp") FROM series) - INTERVAL 71 HOUR"""))


def _halves(spark, sf, cut="2024-01-15"):
    s, c = B.series(spark, sf), F.lit(cut).cast("timestamp_ntz")
    return s.where(F.col("timestamp") < c), s.where(F.col("timestamp") >= c)


register("continuity_check", lambda s, d: W.continuity_check(*_halves(s, d)),
         with_tables(*E, select="""SELECT *, last_a + INTERVAL 1 HOUR = first_b AS contiguous, CAST(floor((epoch(first_b) - epoch(last_a)) / 86400) AS INTEGER) AS gap_days FROM
           (SELECT max("timestamp") FILTER ("timestamp" < TIMESTAMP '2024-01-15') AS last_a, min("timestamp") FILTER ("timestamp" >= TIMESTAMP '2024-01-15') AS first_b FROM series)"""))


def _append(spark, sf):
    from kerbside.operators.grid import complete_spine

    full = complete_spine(B.series(spark, sf), KEYS, "timestamp", "1h", "global")
    c = F.lit("2024-01-15").cast("timestamp_ntz")
    return U.append_checked(full.where(F.col("timestamp") < c), full.where(F.col("timestamp") >= c))


register("append_checked", _append, with_tables(*E, B.FULL_GLOBAL, select="SELECT * FROM full_g"))
DAILY = """daily AS (SELECT VendorID, PULocationID, CAST(pickup_datetime AS DATE) AS "Date", max(total_amount) AS v FROM trips_e GROUP BY 1, 2, 3)"""


def _daily_ffill(spark, sf):
    daily = B.event_trips(spark, sf).groupBy(*KEYS, F.to_date("pickup_datetime").alias("Date")).agg(F.max("total_amount").alias("v"))
    return W.daily_ffill(daily, "Date", "v", KEYS)


register("daily_ffill", _daily_ffill, with_tables(B.EVENT_TRIPS, DAILY, """span AS (SELECT VendorID, PULocationID, CAST(unnest(generate_series(min("Date"), max("Date"), INTERVAL 1 DAY)) AS DATE) AS "Date" FROM daily GROUP BY 1, 2)""",
         select="""SELECT VendorID, PULocationID, "Date", last_value(v IGNORE NULLS) OVER (PARTITION BY VendorID, PULocationID ORDER BY "Date") AS v FROM span LEFT JOIN daily USING (VendorID, PULocationID, "Date")"""))

# --- unions and samples --------------------------------------------------------------------

register("merge_months", lambda s, d: U.merge_months([_halves(s, d)[0].drop("avg_amount"), _halves(s, d)[1].drop("demand")]),
         with_tables(*E, select="""SELECT VendorID, PULocationID, "timestamp", CASE WHEN "timestamp" < TIMESTAMP '2024-01-15' THEN demand END AS demand, avg_distance,
           CASE WHEN "timestamp" >= TIMESTAMP '2024-01-15' THEN avg_amount END AS avg_amount FROM series"""))
register("union_distinct",
         lambda s, d: U.union_distinct(B.trips(s, d).select("PULocationID", "payment_type"), B.trips(s, d).select(F.col("DOLocationID").alias("PULocationID"), "payment_type")),
         with_tables(B.TRIPS, select="SELECT PULocationID, payment_type FROM trips UNION SELECT DOLocationID, payment_type FROM trips"))
register("union_all_tagged",
         lambda s, d: U.union_all_tagged({"Yellow": B.raw_yellow(s, d).select("tpep_pickup_datetime").toDF("pickup"), "Green": B.raw_green(s, d).select("lpep_pickup_datetime").toDF("pickup"), "App": B.raw_app(s, d).select("pickup_datetime").toDF("pickup")}),
         with_tables(B.RAW, select="SELECT started AS pickup, CASE l_returnflag WHEN 'A' THEN 'Yellow' WHEN 'N' THEN 'Green' ELSE 'App' END AS type FROM raw"))
register("concat_segments",
         lambda s, d: U.concat_segments(A.mean_volume(B.keyed_series(s, d)).withColumn("segment", F.lit("HIGH")), F.col("mean_demand") < 1.1),
         with_tables(*E, B.KEYED, select="SELECT Series_ID, avg(demand) AS mean_demand, CASE WHEN avg(demand) < 1.1 THEN 'BASELINE' ELSE 'HIGH' END AS segment FROM keyed GROUP BY 1"))
BUCKET = "('0x' || substr(md5(concat_ws('|', {keys}, '42')), 1, 8))::BIGINT % 100"
register("sample_fraction", lambda s, d: U.sample_fraction(B.event_trips(s, d), 5, ["event_id"]).select("event_id", "VendorID"),
         with_tables(B.EVENT_TRIPS, select=f"SELECT event_id, VendorID FROM trips_e WHERE {BUCKET.format(keys='event_id')} < 5"))
COLS = ["pickup_datetime", "PULocationID", "DOLocationID", "tip_amount", "VendorID", "payment_type", "fare_amount", "l_orderkey"]
SHARES = {0: (1, 5), 1: (2, 100), 2: (3, 20)}
register("balanced_sample",
         lambda s, d: U.balanced_sample(B.trips(s, d).select(*COLS), SHARES, ["l_orderkey"], ["pickup_datetime", "DOLocationID", "tip_amount"], (0, 24)),
         with_tables(B.TRIPS, "base AS (SELECT " + ", ".join(COLS) + """ FROM trips WHERE (VendorID, payment_type) IN ((0, 1), (1, 2), (2, 3)))""", select=f"""SELECT * FROM base WHERE {BUCKET.format(keys='l_orderkey')} < CASE VendorID WHEN 0 THEN 5 WHEN 1 THEN 100 ELSE 20 END
           UNION SELECT * FROM base QUALIFY row_number() OVER (PARTITION BY VendorID, PULocationID
             ORDER BY pickup_datetime, DOLocationID, tip_amount, payment_type, fare_amount, l_orderkey) = 1"""))
register("balanced_sample_since",
         lambda s, d: U.balanced_sample(B.trips(s, d).select(*COLS), SHARES, ["l_orderkey"], ["pickup_datetime", "DOLocationID", "tip_amount"], (0, 24), "1998-01-01"),
         with_tables(B.TRIPS, "base AS (SELECT " + ", ".join(COLS) + """ FROM trips WHERE (VendorID, payment_type) IN ((0, 1), (1, 2), (2, 3)) AND pickup_datetime >= TIMESTAMP '1998-01-01')""",
                     select=f"""SELECT * FROM base WHERE {BUCKET.format(keys='l_orderkey')} < CASE VendorID WHEN 0 THEN 5 WHEN 1 THEN 100 ELSE 20 END
           UNION SELECT * FROM base QUALIFY row_number() OVER (PARTITION BY VendorID, PULocationID
             ORDER BY pickup_datetime, DOLocationID, tip_amount, payment_type, fare_amount, l_orderkey) = 1"""))

# --- metrics ---------------------------------------------------------------------------------

P = [*E, B.PREDS]
register("error_metrics", lambda s, d: rounded(M.error_metrics(B.preds(s, d)), 9, "MAE", "RMSE"),
         with_tables(*P, select="""SELECT round(avg(abs(demand - prediction)), 9) AS MAE, round(sqrt(avg((demand - prediction) ** 2)), 9) AS RMSE,
           quantile_cont(abs(demand - prediction), 0.5::DOUBLE) AS MedAE FROM preds"""))
REPORT = ["MAE", "MSE", "RMSE", "R2", "mean_pred"]
REPORT_SQL = """round(avg(abs(demand - prediction)), 9) AS MAE, round(avg((demand - prediction) ** 2), 9) AS MSE, round(sqrt(avg((demand - prediction) ** 2)), 9) AS RMSE,
  round(1 - avg((demand - prediction) ** 2) / nullif(var_pop(demand), 0), 9) AS R2, avg(demand) AS mean_actual, round(avg(prediction), 9) AS mean_pred"""
register("regression_report", lambda s, d: rounded(M.regression_report(B.preds(s, d), "demand", "prediction"), 9, *REPORT),
         with_tables(*P, select=f"SELECT {REPORT_SQL} FROM preds"))
register("regression_report_by_vendor",
         lambda s, d: rounded(M.regression_report(B.preds(s, d).withColumn("flat", F.lit(1.0)), "demand", "prediction", ["VendorID"], "flat"), 9, *REPORT, "improvement_pct"),
         with_tables(*P, select=f"""SELECT VendorID, {REPORT_SQL}, round((sqrt(avg((demand - 1) ** 2)) - sqrt(avg((demand - prediction) ** 2))) / nullif(sqrt(avg((demand - 1) ** 2)), 0) * 100, 9) AS improvement_pct
           FROM preds GROUP BY 1"""))


def _tip_scores(spark, sf):
    return B.trips(spark, sf).select("VendorID", (F.col("tip_amount") > 400000).cast("int").alias("has_tip"), (F.col("trip_distance") / 50).alias("score"))


TIP_SCORES = "t AS (SELECT VendorID, CAST(tip_amount > 400000 AS INTEGER) AS has_tip, trip_distance / 50 AS score FROM trips)"
register("confusion", lambda s, d: M.confusion(_tip_scores(s, d), ["VendorID"], "has_tip", "score"),
         with_tables(B.TRIPS, TIP_SCORES, select="""SELECT VendorID, has_tip AS target, CAST(score > 0.5 AS INTEGER) AS pred, count(*) AS n,
           count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY VendorID, has_tip) AS share FROM t GROUP BY 1, 2, 3"""))
register("classification_report", lambda s, d: M.classification_report(_tip_scores(s, d), ["VendorID"], "has_tip", "score"),
         with_tables(B.TRIPS, TIP_SCORES, """c AS (SELECT VendorID, count(*) FILTER (has_tip = 1 AND score > 0.5)::DOUBLE AS tp, count(*) FILTER (has_tip = 0 AND score > 0.5) AS fp,
           count(*) FILTER (has_tip = 1 AND score <= 0.5) AS fn, count(*) AS n FROM t GROUP BY 1)""", select="""SELECT VendorID, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall,
           2 * tp / (2 * tp + fp + fn) AS f1, (n - fp - fn)::DOUBLE / n AS accuracy FROM c"""))
DAY_MAE = """day_mae AS (SELECT Series_ID, CAST("timestamp" AS DATE) AS day, avg(abs(demand - prediction)) AS mae FROM preds GROUP BY 1, 2),
  series_mae AS (SELECT Series_ID, avg(mae) AS mae FROM day_mae GROUP BY 1)"""
register("daily_mae", lambda s, d: rounded(M.daily_mae(B.preds(s, d)), 9, "mae"),
         with_tables(*P, DAY_MAE, select="SELECT Series_ID, day, round(mae, 9) AS mae FROM day_mae"))
register("nested_mae", lambda s, d: rounded(M.nested_mae(B.preds(s, d)), 9, "mean_mae", "median_mae"),
         with_tables(*P, DAY_MAE, select="SELECT count(*) AS series, round(avg(mae), 9) AS mean_mae, round(quantile_cont(mae, 0.5::DOUBLE), 9) AS median_mae FROM series_mae"))
register("error_vs_volume", lambda s, d: rounded(M.error_vs_volume(B.preds(s, d)), 9, "mae", "relative_error"),
         with_tables(*P, select="""SELECT Series_ID, round(avg(abs(demand - prediction)), 9) AS mae, avg(demand) AS mean_demand,
           round(avg(abs(demand - prediction)) / (avg(demand) + 0.1::DOUBLE) * 100, 9) AS relative_error FROM preds GROUP BY 1"""))
register("worst_series", lambda s, d: rounded(M.worst_series(B.preds(s, d)), 9, "mae"),
         with_tables(*P, select="SELECT Series_ID, round(avg(abs(demand - prediction)), 9) AS mae FROM preds GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"))
register("mean_std_error", lambda s, d: rounded(M.mean_std_error(B.preds(s, d)), 9, "mean_error", "std_error"),
         with_tables(*P, select="SELECT round(avg(abs(demand - prediction)), 9) AS mean_error, round(stddev_samp(abs(demand - prediction)), 9) AS std_error FROM preds"))
register("residuals", lambda s, d: M.with_residuals(B.preds(s, d).withColumn("sigma", F.lit(2.0)), "demand", "prediction", "sigma").select("Series_ID", "timestamp", "residual"),
         with_tables(*P, select="""SELECT Series_ID, "timestamp", (demand - prediction) * 2.0::DOUBLE AS residual FROM preds"""))
register("residual_mae", lambda s, d: rounded(M.residual_mae(B.preds(s, d).withColumn("sigma", F.lit(2.0)), "demand", "prediction", "sigma"), 9, "mae"),
         with_tables(*P, select="SELECT round(avg(abs((demand - prediction) * 2.0::DOUBLE)), 9) AS mae FROM preds"))
LOSSES = ["loss_p10", "loss_p50", "loss_p90", "loss"]


def _quantile_preds(spark, sf):
    p = F.col("prediction")
    return B.preds(spark, sf).select("demand", (p * 0.5).alias("q10"), p.alias("q50"), (p * 2).alias("q90"))


PIN = ", ".join(f"avg(greatest({q}::DOUBLE * (demand - {f} * prediction), ({q}::DOUBLE - 1) * (demand - {f} * prediction))) AS loss_p{round(q * 100)}"
                for q, f in ((0.1, 0.5), (0.5, 1), (0.9, 2)))
register("pinball_loss", lambda s, d: rounded(M.pinball_loss(_quantile_preds(s, d), "demand", {0.1: "q10", 0.5: "q50", 0.9: "q90"}), 9, *LOSSES),
         with_tables(*P, f"l AS (SELECT {PIN} FROM preds)", select="SELECT round(loss_p10, 9) AS loss_p10, round(loss_p50, 9) AS loss_p50, round(loss_p90, 9) AS loss_p90, round(loss_p10 + loss_p50 + loss_p90, 9) AS loss FROM l"))
register("smape", lambda s, d: rounded(M.smape(B.preds(s, d), "demand", "prediction"), 9, "smape"),
         with_tables(*P, select="SELECT round(avg(coalesce(2 * abs(demand - prediction) / nullif(abs(demand) + abs(prediction), 0), 0)), 9) AS smape FROM preds"))
register("huber", lambda s, d: rounded(M.huber(B.preds(s, d), "demand", "prediction"), 9, "huber"),
         with_tables(*P, "e AS (SELECT abs(demand - prediction) AS e FROM preds)", select="SELECT round(avg(CASE WHEN e <= 0.2::DOUBLE THEN 0.5::DOUBLE * e * e ELSE 0.2::DOUBLE * (e - 0.1::DOUBLE) END), 9) AS huber FROM e"))

# --- the roll-up on a stream -----------------------------------------------------------------


def _streamed(s, d):
    """All event trips as a file stream; every hour's latest state."""
    from kerbside.scratch import scratch_dir
    from kerbside.streaming.hourly import hourly_series_stream, latest_hours, write_updates

    source, out = scratch_dir(s, "stream-in"), scratch_dir(s, "stream-out")
    trips = B.event_trips(s, d)
    trips.write.parquet(source)
    query = write_updates(hourly_series_stream(s.readStream.schema(trips.schema).parquet(source)), out, f"{out}-state")
    query.awaitTermination()
    return latest_hours(s, out)


register("hourly_series_stream", _streamed, with_tables(*E, select="SELECT * FROM series"))


def _stateful(s, d):
    """All event trips as a file stream through the stateful moving average; one far-off trip closes the last hours."""
    from kerbside.scratch import scratch_dir
    from kerbside.streaming.forecast import moving_average_stream, use_rocksdb
    from kerbside.streaming.hourly import write_stream

    source, out = scratch_dir(s, "state-in"), scratch_dir(s, "state-out")
    trips = B.event_trips(s, d).select(*KEYS, "pickup_datetime")
    trips.write.parquet(source)
    use_rocksdb(s)
    schema, state = trips.schema, f"{out}-state"
    write_stream(moving_average_stream(s.readStream.schema(schema).parquet(source), "1000 days"), out, state).awaitTermination()
    end = trips.agg((F.max("pickup_datetime") + F.make_dt_interval(F.lit(2000))).alias("pickup_datetime"))
    end.select(*[F.lit(-1).cast("int").alias(k) for k in KEYS], "pickup_datetime").write.mode("append").parquet(source)
    write_stream(moving_average_stream(s.readStream.schema(schema).parquet(source), "1000 days"), out, state).awaitTermination()
    return s.read.parquet(out)


register("moving_average_stream", _stateful, with_tables(*E, B.FULL, select=f"""SELECT VendorID, PULocationID, "timestamp", coalesce(demand, 0) AS demand,
           avg(coalesce(demand, 0)) OVER {BEFORE5} AS prediction FROM full_"""))
