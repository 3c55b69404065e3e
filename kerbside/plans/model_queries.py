"""Queries for tips, segments, forecasts, geography, reference data and models."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from kerbside.operators import boosting as BO
from kerbside.operators import forecast as FC
from kerbside.operators import geo as GE
from kerbside.operators import metrics as M
from kerbside.operators import ml as ML
from kerbside.operators import refdata as RD
from kerbside.operators import regression as RG
from kerbside.operators import rollup as A
from kerbside.operators import segment as SG
from kerbside.operators import tips as TP
from kerbside.plans import bindings as B
from kerbside.plans.function_queries import (
    LAND, MERCATOR_X, MERCATOR_Y, MONTHS, WIDE, bearing_sql, haversine_sql, manhattan_sql, wide_rent,
)
from kerbside.functions.maths import LANDMARKS
from kerbside.functions.time import with_cyclic_calendar
from kerbside.plans.registry import register, with_tables
from kerbside.plans.rollup_queries import FEATURES, rounded
from kerbside.plans.series_queries import INT_SERIES, KEYS, OVER, ROLLED, int_series

E = [B.EVENT_TRIPS, B.SERIES]

def solved(table, size):
    """Least squares in SQL: Gauss-Jordan steps over the matrix m (a list of rows, the right side last) of a table."""
    for k in range(1, size + 1):
        step = f"list_transform(m, lambda r, i: list_transform(r, lambda x, j: CASE WHEN i = {k} THEN x / m[{k}][{k}] ELSE x - r[{k}] * m[{k}][j] / m[{k}][{k}] END))"
        table = f"(SELECT * REPLACE ({step} AS m) FROM {table})"
    return table


def matrix_sql(names, sums):
    """The normal equations' matrix from the sums of products of the named columns (the label last)."""
    return "[" + ", ".join("[" + ", ".join(sums(a, b) for b in names) + "]" for a in names[:-1]) + "]"


def reweighted(table, inputs, label, start, mean, weight, steps=30):
    """A recursive fit(it, w): iteratively reweighted least squares over a table, from the link's ``start``.

    mean and weight are expressions of the linear predictor eta and of mu.
    """
    names = [*inputs, "z"]
    eta = " + ".join(f"w[{i}] * x_{n}" for i, n in enumerate(inputs, 1))
    rows = f"""(SELECT it, mu, eta, {weight} AS v, {label} AS y, {", ".join(f"x_{n}" for n in inputs)} FROM
      (SELECT *, {mean} AS mu FROM (SELECT *, {eta} AS eta FROM {table}, fit WHERE it < {steps})))"""
    z = {**{n: f"x_{n}" for n in inputs}, "z": "(eta + (y - mu) / {slope})"}
    return lambda slope: f"""fit(it, w) AS (SELECT 0, [{start}{", 0.0::DOUBLE" * (len(inputs) - 1)}] FROM {table} UNION ALL
      SELECT it + 1, list_transform(m, lambda r: r[{len(names)}]) FROM {solved(f"(SELECT it, {matrix_sql(names, lambda a, b: f'sum(v * {z[a]} * {z[b].format(slope=slope)})')} AS m FROM {rows} GROUP BY it)", len(inputs))}),
      last_fit AS (SELECT w FROM fit ORDER BY it DESC LIMIT 1)"""


# --- tips ------------------------------------------------------------------------------

GEO = ["pickup_longitude", "pickup_latitude", "dropoff_longitude", "dropoff_latitude"]


def tip_rows(s, d):
    trips = B.trips(s, d).select("l_orderkey", "l_linenumber", "pickup_datetime", "PULocationID", "DOLocationID", "VendorID", "tip_amount", "fare_amount")
    return TP.tip_features(trips, B.centroids(s, d), B.climate(s, d), B.sun(s, d))


LAND_SQL = ", ".join(
    f"round({manhattan_sql(f'{a}.Longitude', f'{a}.Latitude', f'{lon}::DOUBLE', f'{lat}::DOUBLE')}, 5) AS {end}_dist_{n}"
    for n, (lon, lat) in LANDMARKS.items() for end, a in (("pickup", "p"), ("dropoff", "q"))
)
PQ = ("p.Longitude", "p.Latitude", "q.Longitude", "q.Latitude")
register("tip_features", lambda s, d: rounded(rounded(tip_rows(s, d), 5, "distance", *LAND), 6, "direction"),
         with_tables(B.TRIPS, B.CENTROIDS, B.DAYS, B.CLIMATE, B.SUN, select=f"""SELECT l_orderkey, l_linenumber, pickup_datetime, PULocationID, DOLocationID, VendorID, tip_amount, fare_amount,
           p.Latitude AS pickup_latitude, p.Longitude AS pickup_longitude, q.Latitude AS dropoff_latitude, q.Longitude AS dropoff_longitude,
           round({manhattan_sql(*PQ)}, 5) AS distance, round({bearing_sql(*PQ)}, 6) AS direction, {LAND_SQL}, temperature_2m, rain, abs(temperature_2m - 20) AS temp_discomfort,
           daylight_duration, CASE WHEN pickup_datetime BETWEEN sunrise AND sunset THEN 1 ELSE 0 END AS is_daylight, CAST(month(pickup_datetime) AS INTEGER) AS month,
           CAST(dayofyear(pickup_datetime) AS INTEGER) AS dayofyear, CAST(isodow(pickup_datetime) AS INTEGER) AS weekday, hour(pickup_datetime) + minute(pickup_datetime) / 60.0::DOUBLE AS hour
           FROM trips JOIN centroids p ON PULocationID = p.locationid JOIN centroids q ON DOLocationID = q.locationid
           JOIN climate ON date_trunc('hour', pickup_datetime) = hour_key JOIN sun ON CAST(pickup_datetime AS DATE) = date_key"""))
VAL, TEST = "1999-01-01", "2000-01-01"
PART = f"CASE WHEN pickup_datetime < TIMESTAMP '{VAL}' THEN 'train' WHEN pickup_datetime < TIMESTAMP '{TEST}' THEN 'val' ELSE 'test' END"
register("temporal_split", lambda s, d: TP.temporal_split(B.trips(s, d), VAL, TEST).groupBy("part", "VendorID").agg(F.count("*").alias("n")),
         with_tables(B.TRIPS, select=f"SELECT {PART} AS part, VendorID, count(*) AS n FROM trips GROUP BY 1, 2"))


def _split(s, d):
    rows = TP.temporal_split(B.trips(s, d), VAL, TEST)
    return rows.where("part = 'train'"), rows.where("part = 'test'")


register("tip_probability", lambda s, d: TP.tip_probability(_split(s, d)[0]),
         with_tables(B.TRIPS, select=f"SELECT VendorID, avg((tip_amount > 0)::INTEGER) AS base_prob FROM trips WHERE {PART} = 'train' GROUP BY 1"))
register("route_tip_mean", lambda s, d: TP.route_tip_mean(_split(s, d)[0]),
         with_tables(B.TRIPS, select=f"""SELECT PULocationID, DOLocationID, VendorID, avg(tip_amount) AS base_amount FROM trips
           WHERE {PART} = 'train' AND tip_amount > 0 AND fare_amount > 0 GROUP BY 1, 2, 3"""))


register("vendor_tip_mean", lambda s, d: TP.vendor_tip_mean(_split(s, d)[0]),
         with_tables(B.TRIPS, select=f"""SELECT VendorID, avg(tip_amount) AS fallback_amount FROM trips
           WHERE {PART} = 'train' AND tip_amount > 0 AND fare_amount > 0 GROUP BY 1"""))


def _tip_baseline(s, d):
    train, test = _split(s, d)
    return TP.tip_baseline(train, test).select("l_orderkey", "l_linenumber", "VendorID", "base_prob", "base_amount", "fallback_amount", "pred_baseline")


register("tip_baseline", _tip_baseline, with_tables(B.TRIPS, f"train AS (SELECT * FROM trips WHERE {PART} = 'train')", select=f"""SELECT l_orderkey, l_linenumber, VendorID, base_prob,
  coalesce(m, fallback_amount) AS base_amount, fallback_amount, base_prob * coalesce(m, fallback_amount) AS pred_baseline FROM trips
  LEFT JOIN (SELECT VendorID, avg((tip_amount > 0)::INTEGER) AS base_prob FROM train GROUP BY 1) USING (VendorID)
  LEFT JOIN (SELECT PULocationID, DOLocationID, VendorID, avg(tip_amount) AS m FROM train WHERE tip_amount > 0 AND fare_amount > 0 GROUP BY 1, 2, 3) USING (PULocationID, DOLocationID, VendorID)
  LEFT JOIN (SELECT VendorID, avg(tip_amount) AS fallback_amount FROM train WHERE tip_amount > 0 AND fare_amount > 0 GROUP BY 1) USING (VendorID)
  WHERE {PART} = 'test'"""))
TIP_INPUTS = ["fare", "trip_distance", "VendorID"]


def _tip_train(s, d):
    rows = TP.temporal_split(B.trips(s, d), VAL, TEST)
    return rows.select("l_orderkey", "l_linenumber", "part", "VendorID", (F.col("fare_amount") / 1e6).alias("fare"), "trip_distance", "fare_amount",
                       (F.col("tip_amount") / 100.0).alias("tip_amount"))


def _tweedie(s, d):
    rows = _tip_train(s, d)
    return TP.tip_tweedie(rows.where("part = 'train'"), TIP_INPUTS).transform(rows.where("part = 'test'")).drop("features")


X_TIPS = {"one": "1.0::DOUBLE", "fare": "fare_amount / 1e6::DOUBLE", "trip_distance": "trip_distance::DOUBLE", "VendorID": "VendorID::DOUBLE"}
TIPPING = f"""tipping AS (SELECT l_orderkey, l_linenumber, {PART} AS part, VendorID, fare_amount / 1e6::DOUBLE AS fare, trip_distance, fare_amount,
  tip_amount / 100.0::DOUBLE AS tip_amount, {", ".join(f"{x} AS x_{n}" for n, x in X_TIPS.items())} FROM trips)"""
LINEAR = " + ".join(f"w[{i}] * x_{n}" for i, n in enumerate(X_TIPS, 1))
TWEEDIE = reweighted("fitted", X_TIPS, "tip_amount", "ln(avg(tip_amount))", "exp(eta)", "pow(mu, 0.45::DOUBLE)")("mu")
RECURSIVE = "WITH RECURSIVE "
TIP_COLUMNS = "l_orderkey, l_linenumber, part, VendorID, fare, trip_distance, fare_amount, tip_amount"
register("tip_tweedie", lambda s, d: rounded(_tweedie(s, d), 2, "pred_tweedie"),
         with_tables(B.TRIPS, TIPPING, "fitted AS (SELECT * FROM tipping WHERE part = 'train')", TWEEDIE,
                     select=f"SELECT {TIP_COLUMNS}, round(exp({LINEAR}), 2) AS pred_tweedie FROM tipping, last_fit WHERE part = 'test'").replace("WITH ", RECURSIVE, 1))
N_PARTS = f"""n AS (SELECT count(*) FILTER ({PART} = 'train') AS fitted, count(*) FILTER ({PART} = 'test') AS scored FROM trips)"""


def _equations(rows, weight, observed, expected):
    """Per input: sum of weight * expected * input over sum of weight * observed * input; 1 where the fit's equations hold."""
    inputs = {"one": F.lit(1.0), **{c: F.col(c).cast("double") for c in TIP_INPUTS}}
    return [F.round(F.sum(weight * expected * x) / F.sum(weight * observed * x), 3).alias(f"eq_{n}") for n, x in inputs.items()]


EQUATIONS = ", ".join(f"1.0::DOUBLE AS eq_{n}" for n in ("one", *TIP_INPUTS))


def _tweedie_equations(s, d):
    """The score equations of the fit over its training rows, and the number of rows scored."""
    rows = _tip_train(s, d)
    model = TP.tip_tweedie(rows.where("part = 'train'"), TIP_INPUTS)
    scored = model.transform(rows).select("part", "tip_amount", "pred_tweedie", *TIP_INPUTS)
    fitted, mu = scored.where("part = 'train'"), F.col("pred_tweedie")
    sums = fitted.agg(F.count("*").alias("fitted"), *_equations(fitted, mu ** (1 - 1.55), F.col("tip_amount"), mu))
    return sums.withColumn("scored", scored.where((F.col("part") == "test") & (mu > 0)).agg(F.count("*")).scalar())


register("tip_tweedie_facts", _tweedie_equations, with_tables(B.TRIPS, N_PARTS, select=f"SELECT fitted, {EQUATIONS}, scored FROM n"))


def _hurdle(s, d):
    rows = _tip_train(s, d)
    scored = TP.score_hurdle(TP.tip_hurdle(rows.where("part = 'train'"), TIP_INPUTS), rows.where("part = 'test'"))
    return TP.mixed_prediction(scored.join(TP.tip_probability(rows.where("part = 'train'")), "VendorID", "left"))


LOGIT = reweighted("seen", X_TIPS, "has_tip", "ln(avg(has_tip) / (1 - avg(has_tip)))", "1 / (1 + exp(-eta))", "mu * (1 - mu)")("(mu * (1 - mu))")
HURDLE = [
    "seen AS (SELECT *, CASE WHEN tip_amount > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS has_tip FROM tipping WHERE part = 'train')",
    LOGIT.replace("fit(it, w)", "gate_fit(it, w)").replace(", fit WHERE", ", gate_fit WHERE").replace("last_fit", "gate").replace("FROM fit ORDER", "FROM gate_fit ORDER"),
    "fitted AS (SELECT * FROM tipping WHERE part = 'train' AND tip_amount > 0 AND fare_amount > 0)", TWEEDIE,
    "base AS (SELECT VendorID AS v, avg(has_tip) AS base_prob FROM seen GROUP BY 1)",
    f"""scored AS (SELECT {TIP_COLUMNS}, base_prob, 1 / (1 + exp(-({LINEAR.replace('w[', 'g.w[')}))) AS p_tip, exp({LINEAR.replace('w[', 'a.w[')}) AS amount
      FROM tipping CROSS JOIN gate g CROSS JOIN last_fit a LEFT JOIN base ON v = VendorID WHERE part = 'test')""",
]
register("tip_hurdle", lambda s, d: rounded(rounded(_hurdle(s, d), 6, "p_tip", "base_prob"), 0, "amount_given_tip", "pred_hurdle", "pred_mixed"),
         with_tables(B.TRIPS, TIPPING, *HURDLE, select=f"""SELECT {TIP_COLUMNS}, round(base_prob, 6) AS base_prob, round(p_tip, 6) AS p_tip, round(amount, 0) AS amount_given_tip,
           round(p_tip * amount, 0) AS pred_hurdle, round(base_prob * amount, 0) AS pred_mixed FROM scored""").replace("WITH ", RECURSIVE, 1))


def _hurdle_equations(s, d):
    """Both parts' equations over the training rows, and how the parts combine in the rows scored."""
    rows = _tip_train(s, d)
    models = TP.tip_hurdle(rows.where("part = 'train'"), TIP_INPUTS)
    scored = TP.score_hurdle(models, rows)
    fitted, tested = scored.where("part = 'train'"), scored.where("part = 'test'")
    gate = fitted.agg(F.count("*").alias("fitted"), *_equations(fitted, F.lit(1.0), F.when(F.col("tip_amount") > 0, 1.0).otherwise(0.0), F.col("p_tip")))
    mu = F.col("amount_given_tip")
    paid = fitted.where((F.col("tip_amount") > 0) & (F.col("fare_amount") > 0))
    amount = paid.agg(F.struct(*_equations(paid, mu ** (1 - 1.55), F.col("tip_amount"), mu))).scalar()
    together = tested.agg(F.count_if(F.abs(F.col("pred_hurdle") - F.col("p_tip") * mu) < 1e-9)).scalar()
    return gate.withColumns({f"amount_{n}": amount[f"eq_{n}"] for n in ("one", *TIP_INPUTS)} | {"scored": together})


register("tip_hurdle_facts", _hurdle_equations, with_tables(B.TRIPS, N_PARTS, select=f"SELECT fitted, {EQUATIONS}, " + ", ".join(f"1.0::DOUBLE AS amount_{n}" for n in ("one", *TIP_INPUTS)) + ", scored FROM n"))


ROUNDS = {"rounds": 24, "rate": 0.25, "patience": 3}


def _hurdle_boosted(s, d):
    rows = _tip_train(s, d)
    models = TP.tip_hurdle_boosted(rows, TIP_INPUTS, **ROUNDS)
    return TP.score_hurdle_boosted(models, rows.where("part = 'test'"))


register("tip_hurdle_boosted", _hurdle_boosted)


def _tweedie_boosted(s, d):
    rows = _tip_train(s, d)
    return TP.tip_tweedie_boosted(rows, TIP_INPUTS, **ROUNDS).transform(rows.where("part = 'test'"), "pred_tweedie")


register("tip_tweedie_boosted", _tweedie_boosted)
STUMP_INPUTS = ["trip_distance", "VendorID", "payment_type", "PULocationID"]


def _stump(s, d):
    """One split by the squared error of the fare: every trip has its side's mean."""
    trips = B.trips(s, d).select("l_orderkey", "l_linenumber", *STUMP_INPUTS, (F.col("fare_amount") / 100.0).alias("fare"), F.lit(False).alias("held"))
    model = BO.boost(trips, STUMP_INPUTS, "fare", "held", rounds=1, rate=1.0, depth=1)
    return rounded(model.transform(trips).select("l_orderkey", "l_linenumber", "prediction"), 4, "prediction")


SIDES = " UNION ALL ".join(
    f"SELECT {i} AS f, {c}::DOUBLE AS v, count(*) AS n, sum(fare_amount / 100.0::DOUBLE) AS s FROM trips GROUP BY 2" for i, c in enumerate(STUMP_INPUTS)
)
register("boosted_stump", _stump, with_tables(B.TRIPS, f"sides AS ({SIDES})",
         """cuts AS (SELECT f, v, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(n) OVER (PARTITION BY f) AS n_all, sum(s) OVER (PARTITION BY f) AS s_all
              FROM sides WINDOW w AS (PARTITION BY f ORDER BY v))""",
         """best AS (SELECT f, v, s / n AS low, (s_all - s) / (n_all - n) AS high FROM cuts WHERE n >= 20 AND n_all - n >= 20
              ORDER BY s * s / n + (s_all - s) * (s_all - s) / (n_all - n) DESC LIMIT 1)""",
         select="SELECT l_orderkey, l_linenumber, round(CASE WHEN [" + ", ".join(f"{c}::DOUBLE" for c in STUMP_INPUTS) + "][f + 1] <= v THEN low ELSE high END, 4) AS prediction FROM trips, best"))
register("gaussian_mixture_tips", lambda s, d: TP.mixture_parameters(s, TP.gaussian_mixture_tips(_tip_train(s, d), 3, max_iter=20)))


def _conditional_mixture(s, d):
    rows = _tip_train(s, d)
    model = TP.conditional_tip_mixture(rows.where("part = 'train'"), TIP_INPUTS, 3, 25)
    return model.transform(TP.tipped(rows.where("part = 'test'"))).select(
        "l_orderkey", "l_linenumber", "tip_amount", "pred_mean", "pred_std", "log_density", "component")


register("conditional_tip_mixture", _conditional_mixture)


def _mixture_moments(s, d):
    """The mixture's total weight, mean and second moment, which are the sample's."""
    m, v = F.col("mean"), F.col("std") * F.col("std")
    return TP.mixture_parameters(s, TP.gaussian_mixture_tips(_tip_train(s, d), 3, max_iter=20)).agg(
        F.count("*").alias("components"), F.round(F.sum("weight"), 6).alias("weight"), F.round(F.sum(F.col("weight") * m), 3).alias("mean"),
        F.round(F.sum(F.col("weight") * (v + m * m)) / F.sum(F.col("weight") * m), 2).alias("spread"))


register("gaussian_mixture_facts", _mixture_moments, with_tables(B.TRIPS, select="""SELECT 3::BIGINT AS components, 1.0::DOUBLE AS weight, round(avg(tip_amount / 100.0::DOUBLE), 3) AS mean,
  round(avg((tip_amount / 100.0::DOUBLE) * (tip_amount / 100.0::DOUBLE)) / avg(tip_amount / 100.0::DOUBLE), 2) AS spread FROM trips"""))

# --- segments ------------------------------------------------------------------------------

register("baseline_rule", lambda s, d: SG.baseline_rule(A.series_features(B.keyed_series(s, d))).select("Series_ID", "segment"),
         with_tables(*E, B.KEYED, FEATURES, select="SELECT Series_ID, CASE WHEN (adi > 1.5 AND cv2 > 0.5) OR mean_real < 0.5 THEN 'BASELINE' END AS segment FROM features"))


def daily_series(s, d):
    """Daily demand of the money trips: dense enough to leave the BASELINE segment."""
    from kerbside.functions.text import series_key
    from kerbside.functions.time import trunc_grain

    return (
        B.trips(s, d).groupBy("VendorID", "PULocationID", trunc_grain("pickup_datetime", "month").alias("timestamp")).agg(F.count("*").alias("demand"))
        .withColumn("Series_ID", series_key("VendorID", "PULocationID"))
    )


def _dense_features(s, d):
    # months as hours: one row per "hour", so that the intervals are about one
    months = daily_series(s, d)
    hours = F.months_between("timestamp", F.lit("1995-01-01").cast("timestamp_ntz")).cast("int")
    return A.series_features(months.withColumn("timestamp", F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hours)))


register("segment_series", lambda s, d: SG.segment_series(_dense_features(s, d)).select("Series_ID", "mean_real", "segment"))
# cuts between sorted distinct values, all pairs of them, by prefix sums; the best pair and its clusters' means
CUTS = """distinct_ AS (SELECT v, count(*) AS n FROM {values} WHERE v IS NOT NULL GROUP BY 1),
  mean_ AS (SELECT sum(v * n) / sum(n) AS m FROM distinct_),
  prefix AS (SELECT v, row_number() OVER w AS i, sum(n) OVER w AS n, sum(n * (v - m)) OVER w AS s, sum(n * (v - m) * (v - m)) OVER w AS q FROM distinct_, mean_ WINDOW w AS (ORDER BY v)),
  last_ AS (SELECT * FROM prefix ORDER BY i DESC LIMIT 1),
  pairs AS (SELECT a.s / a.n + m AS low, (b.s - a.s) / (b.n - a.n) + m AS mid, (z.s - b.s) / (z.n - b.n) + m AS high,
      a.q - a.s * a.s / a.n + (b.q - a.q) - (b.s - a.s) * (b.s - a.s) / (b.n - a.n) + (z.q - b.q) - (z.s - b.s) * (z.s - b.s) / (z.n - b.n) AS squares
    FROM prefix a JOIN prefix b ON a.i < b.i JOIN last_ z ON b.i < z.i CROSS JOIN mean_),
  centres AS (SELECT * FROM pairs ORDER BY squares, low, mid LIMIT 1)"""
CLASS = "CASE WHEN {x} <= (low + mid) / 2 THEN '{}' WHEN {x} <= (mid + high) / 2 THEN '{}' ELSE '{}' END"
MONTHLY = """keyed AS (SELECT VendorID || '_' || PULocationID AS Series_ID, TIMESTAMP '2024-01-01' + to_hours(CAST(datediff('month', DATE '1995-01-01', m) AS INTEGER)) AS "timestamp", demand
  FROM (SELECT VendorID, PULocationID, date_trunc('month', pickup_datetime) AS m, count(*) AS demand FROM trips GROUP BY 1, 2, 3))"""
register("segment_by_volume", lambda s, d: rounded(SG.segment_by_volume(daily_series(s, d)), 9, "mean_demand"),
         with_tables(B.TRIPS, MONTHLY, "volumes AS (SELECT Series_ID, avg(demand) AS v FROM keyed GROUP BY 1)", CUTS.format(values="volumes"),
                     select=f"SELECT Series_ID, round(v, 9) AS mean_demand, {CLASS.format('LOW', 'MID', 'HIGH', x='v')} AS segment FROM volumes, centres"))
AT_HOUR = """SELECT PULocationID, hour(pickup_datetime) AS h, avg("count") AS v FROM rollup_ WHERE pickup_datetime BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '2002-01-01'"""
register("classify_demand", lambda s, d: SG.classify_demand(B.rollup(s, d), "1995-01-01", "2002-01-01", 8, days=[1, 2, 3, 4, 5]),
         with_tables(B.TRIPS, B.ROLLUP, f"all_ AS ({AT_HOUR} GROUP BY 1, 2)", f"weekdays AS ({AT_HOUR} AND isodow(pickup_datetime) <= 5 GROUP BY 1, 2)", CUTS.format(values="all_"),
                     select=f"SELECT PULocationID, {CLASS.format('low', 'medium', 'high', x='v')} AS demand_class FROM weekdays, centres WHERE h = 8"))


def _strays(labelled, label, cols, labels):
    """Number of rows that are nearer to the mean of another label's rows than to their own's."""
    spread = labelled.agg(F.struct(*[F.stddev_samp(c).alias(c) for c in cols])).scalar()
    means = labelled.groupBy(F.col(label).alias("_of")).agg(*[F.avg(c).alias(c) for c in cols])
    packed = means.agg(F.collect_list(F.struct("_of", *cols))).scalar()  # a row for each label
    rows = labelled.withColumn("_means", packed)
    far = lambda m: sum((F.coalesce(F.try_divide(F.col(c) - m[c], F.col("_spread")[c]), F.lit(0.0)) ** 2 for c in cols), F.lit(0.0))
    nearest = F.array_min(F.transform("_means", lambda m: F.struct(far(m).alias("far"), m["_of"].alias("of"))))
    return rows.withColumn("_spread", spread).withColumn("_nearest", nearest["of"]).agg(F.count_if(F.col("_nearest") != F.col(label))).scalar()


def _in_order(labelled, label, value, labels):
    """Whether the means of the labels' rows rise in the order of the labels."""
    means = [F.avg(F.when(F.col(label) == n, F.col(value))) for n in labels]
    rising = F.lit(True)
    for low, high in zip(means, means[1:]):
        rising = rising & F.coalesce(low < high, F.lit(False))
    return rising.alias("in_order")


def _segments(s, d):
    """How many series the rule takes, and that the others lie in the cluster of their own centre."""
    found = SG.segment_series(_dense_features(s, d))
    rest = found.where("segment <> 'BASELINE'")
    counts = found.agg(F.count("*").alias("series"), F.count_if(F.col("segment") == "BASELINE").alias("baseline"), _in_order(found, "segment", "mean_real", SG.LEVELS))
    return counts.withColumn("strays", _strays(rest, "segment", ["mean_real", "cv", "weekend_ratio"], SG.LEVELS))


register("segment_series_facts", _segments, with_tables(B.TRIPS, MONTHLY, FEATURES, select="""SELECT count(*) AS series, count(*) FILTER ((adi > 1.5 AND cv2 > 0.5) OR mean_real < 0.5) AS baseline,
  true AS in_order, 0::BIGINT AS strays FROM features"""))


def _volumes(s, d):
    found = SG.segment_by_volume(daily_series(s, d))
    counts = found.agg(F.count("*").alias("series"), F.round(F.sum("mean_demand"), 6).alias("volume"), _in_order(found, "segment", "mean_demand", SG.LEVELS))
    return counts.withColumn("strays", _strays(found, "segment", ["mean_demand"], SG.LEVELS))


register("segment_by_volume_facts", _volumes, with_tables(B.TRIPS, MONTHLY, select="""SELECT count(*) AS series, round(sum(v), 6) AS volume, true AS in_order, 0::BIGINT AS strays
  FROM (SELECT Series_ID, avg(demand) AS v FROM keyed GROUP BY 1)"""))


def _demand_classes(s, d):
    """Every zone's class at eight o'clock: all zones, and no smaller demand in a higher class."""
    rollup = B.rollup(s, d)
    found = SG.classify_demand(rollup, "1995-01-01", "2002-01-01", 8)
    at = A.mean_by_zone_hour(rollup).where("hour = 8").select("PULocationID", F.col("count").alias("n"))
    top = lambda c: F.max(F.when(F.col("demand_class") == c, F.col("n")))
    low = lambda *c: F.min(F.when(F.col("demand_class").isin(*c), F.col("n")))
    ranked = F.coalesce(top("low") <= low("medium", "high"), F.lit(True)) & F.coalesce(top("medium") <= low("high"), F.lit(True))
    return found.join(at, "PULocationID").agg(F.count("*").alias("zones"), F.round(F.sum("n"), 6).alias("demand"), ranked.alias("ranked"))


register("classify_demand_facts", _demand_classes, with_tables(B.TRIPS, B.ROLLUP, select="""SELECT count(*) AS zones, round(sum(n), 6) AS demand, true AS ranked FROM (
  SELECT PULocationID, avg("count") AS n FROM rollup_ WHERE hour(pickup_datetime) = 8 GROUP BY 1)"""))


def _ordered_clusters(s, d):
    """Vendors as clusters, labelled by their mean amount."""
    from kerbside.functions.maths import map_values

    trips = B.event_trips(s, d)
    centres = [r.m for r in trips.groupBy("VendorID").agg(F.avg("total_amount").alias("m")).orderBy("VendorID").collect()]
    names = SG.order_clusters(centres, ["A", "B", "C", "D", "E"])
    return trips.groupBy("VendorID").agg(F.count("*").alias("n")).withColumn("label", map_values("VendorID", names, None))


register("order_clusters", _ordered_clusters, with_tables(B.EVENT_TRIPS, select="""SELECT VendorID, n, ['A', 'B', 'C', 'D', 'E'][row_number() OVER (ORDER BY m)] AS label
  FROM (SELECT VendorID, count(*) AS n, avg(total_amount) AS m FROM trips_e GROUP BY 1)"""))

# --- forecasts ---------------------------------------------------------------------------------

HISTORY = """recent AS (SELECT * FROM series WHERE "timestamp" >= (SELECT max("timestamp") FROM series) - INTERVAL 71 HOUR),
  grid AS (SELECT VendorID, PULocationID, unnest(generate_series((SELECT max("timestamp") FROM series) - INTERVAL 71 HOUR, (SELECT max("timestamp") FROM series), INTERVAL 1 HOUR)) AS "timestamp"
    FROM (SELECT DISTINCT VendorID, PULocationID FROM recent)),
  history AS (SELECT g.*, coalesce(demand, 0) AS demand FROM grid g LEFT JOIN recent r ON g.VendorID = r.VendorID AND g.PULocationID = r.PULocationID AND g."timestamp" = r."timestamp")"""
NAIVE = """bands AS (SELECT VendorID, PULocationID, 1.28::DOUBLE * coalesce(stddev_samp(demand), 0) AS band FROM history GROUP BY 1, 2),
  naive AS (SELECT h.VendorID, h.PULocationID, "timestamp" + to_hours(24 * (1 + k)::INTEGER) AS "timestamp", greatest(demand - band, 0) AS pred_demand_p10, demand::DOUBLE AS pred_demand_p50,
    demand + band AS pred_demand_p90 FROM history h JOIN bands b ON h.VendorID = b.VendorID AND h.PULocationID = b.PULocationID, generate_series(0, {last}) t(k)
    WHERE "timestamp" > (SELECT max("timestamp") FROM series) - INTERVAL 24 HOUR)"""
Q3 = ["pred_demand_p10", "pred_demand_p50", "pred_demand_p90"]
SQL_Q3 = ", ".join(f"round({c}, 6) AS {c}" for c in Q3)


def _history(s, d):
    return FC.recent_history(B.series(s, d).select(*KEYS, "timestamp", "demand"))


register("recent_history", _history, with_tables(*E, HISTORY, select="SELECT * FROM history"))
register("seasonal_naive", lambda s, d: rounded(FC.seasonal_naive(_history(s, d)), 6, *Q3),
         with_tables(*E, HISTORY, NAIVE.format(last=0), select=f"SELECT * REPLACE ({SQL_Q3}) FROM naive"))
register("seasonal_naive_two_days", lambda s, d: rounded(FC.seasonal_naive(_history(s, d), 48), 6, *Q3),
         with_tables(*E, HISTORY, NAIVE.format(last=1), select=f"SELECT * REPLACE ({SQL_Q3}) FROM naive"))


def quant_sql(value, name):
    return ", ".join(f"quantile_cont({value}::DOUBLE, {q}::DOUBLE) AS pred_{name}_p{round(q * 100)}" for q in (0.1, 0.5, 0.9))


register("empirical_quantile_forecast",
         lambda s, d: rounded(FC.empirical_quantile_forecast(int_series(s, d)), 6, *Q3),
         with_tables(*E, f"""prof AS (SELECT VendorID, PULocationID, isodow("timestamp") AS w, hour("timestamp") AS h, {quant_sql('demand', 'demand')} FROM series GROUP BY 1, 2, 3, 4),
           ahead AS (SELECT VendorID, PULocationID, unnest(generate_series(max("timestamp") + INTERVAL 1 HOUR, max("timestamp") + INTERVAL 24 HOUR, INTERVAL 1 HOUR)) AS "timestamp" FROM series GROUP BY 1, 2)""",
                     select=f"""SELECT a.*, {SQL_Q3} FROM ahead a LEFT JOIN prof p ON a.VendorID = p.VendorID AND a.PULocationID = p.PULocationID
           AND isodow(a."timestamp") = w AND hour(a."timestamp") = h"""))
register("sample_quantiles",
         lambda s, d: rounded(FC.sample_quantiles(B.event_trips(s, d), "total_amount", "amount", ["VendorID", "PULocationID"]), 6, *[f"pred_amount_p{p}" for p in (10, 50, 90)]),
         with_tables(B.EVENT_TRIPS, select="SELECT VendorID, PULocationID, " + ", ".join(f"round(quantile_cont(total_amount::DOUBLE, {q}::DOUBLE), 6) AS pred_amount_p{round(q * 100)}" for q in (0.1, 0.5, 0.9))
                     + " FROM trips_e GROUP BY 1, 2"))


def _forecast(s, d):
    n = F.sum("demand")
    segment = F.when(n >= 90, "HIGH").when(n >= 80, "MID").when(n >= 70, "LOW")
    router = B.keyed_series(s, d).groupBy("Series_ID").agg(segment.alias("segment")).where("segment is not null")
    return FC.forecast(B.series(s, d), router)


def half_even(x, digits):
    """A value of six decimals rounded half to even in whole numbers, where no half is lost."""
    unit, scale = 10 ** (6 - digits), 10.0**digits
    m = f"CAST(round({x} * 1e6) AS BIGINT)"
    up = f"CASE WHEN {m} % {unit} * 2 > {unit} OR ({m} % {unit} * 2 = {unit} AND {m} // {unit} % 2 = 1) THEN 1 ELSE 0 END"
    return f"greatest({m} // {unit} + {up}, 0) / {scale}::DOUBLE"


PUBLISHED = ", ".join(
    f"{half_even(f'pred_{t}_{q}', n)} AS pred_{t}_{q}" for t, n in (("demand", 0), ("amount", 2), ("distance", 2)) for q in ("p10", "p50", "p90")
)


def quants(value):
    return f"quantile_cont({value}::DOUBLE, [0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE])"


SAME = "{0}.VendorID = {1}.VendorID AND {0}.PULocationID = {1}.PULocationID"
register("forecast", _forecast, with_tables(
    *E, B.FULL_GLOBAL,
    """routed AS (SELECT VendorID, PULocationID, CASE WHEN sum(demand) >= 90 THEN 'HIGH' WHEN sum(demand) >= 80 THEN 'MID' WHEN sum(demand) >= 70 THEN 'LOW' ELSE 'BASELINE' END AS segment
         FROM series GROUP BY 1, 2)""",
    """newest AS (SELECT max("timestamp") AS t FROM series)""",
    f"""hours AS (SELECT g.VendorID, g.PULocationID, g."timestamp", coalesce(g.demand, 0) AS demand, segment FROM full_g g JOIN routed r ON {SAME.format('g', 'r')})""",
    """history AS (SELECT * FROM hours, newest WHERE segment = 'BASELINE' AND "timestamp" > t - INTERVAL 72 HOUR)""",
    NAIVE.format(last=0).replace("(SELECT max(\"timestamp\") FROM series)", "(SELECT t FROM newest)"),
    """past AS (SELECT * FROM hours, newest WHERE segment IN ('LOW', 'MID') OR (segment = 'HIGH' AND "timestamp" > t - INTERVAL 672 HOUR))""",
    f"""of_week AS (SELECT VendorID, PULocationID, isodow("timestamp") AS w, hour("timestamp") AS h, {quants('demand')} AS q FROM past WHERE segment <> 'LOW' GROUP BY 1, 2, 3, 4)""",
    f"""of_day AS (SELECT VendorID, PULocationID, hour("timestamp") AS h, {quants('demand')} AS q FROM past GROUP BY 1, 2, 3)""",
    f"""ever AS (SELECT VendorID, PULocationID, {quants('demand')} AS q FROM past GROUP BY 1, 2)""",
    """ahead AS (SELECT VendorID, PULocationID, unnest(generate_series(t + INTERVAL 1 HOUR, t + INTERVAL 24 HOUR, INTERVAL 1 HOUR)) AS "timestamp" FROM routed, newest WHERE segment <> 'BASELINE')""",
    f"""modelled AS (SELECT a.*, coalesce(o.q, y.q, e.q) AS q FROM ahead a
         LEFT JOIN of_week o ON {SAME.format('a', 'o')} AND isodow(a."timestamp") = o.w AND hour(a."timestamp") = o.h
         LEFT JOIN of_day y ON {SAME.format('a', 'y')} AND hour(a."timestamp") = y.h LEFT JOIN ever e ON {SAME.format('a', 'e')})""",
    """demand AS (SELECT VendorID, PULocationID, "timestamp", q[1] AS pred_demand_p10, q[2] AS pred_demand_p50, q[3] AS pred_demand_p90 FROM modelled
         UNION ALL SELECT VendorID, PULocationID, "timestamp", pred_demand_p10, pred_demand_p50, pred_demand_p90 FROM naive)""",
    *[f"""{n}_week AS (SELECT VendorID, PULocationID, isodow("timestamp") AS w, hour("timestamp") AS h, {quants(v)} AS q FROM series GROUP BY 1, 2, 3, 4),
       {n}_day AS (SELECT VendorID, PULocationID, hour("timestamp") AS h, {quants(v)} AS q FROM series GROUP BY 1, 2, 3),
       {n}_ever AS (SELECT VendorID, PULocationID, {quants(v)} AS q FROM series GROUP BY 1, 2),
       {n}_at AS (SELECT d.VendorID, d.PULocationID, d."timestamp", coalesce(o.q, y.q, e.q, (SELECT {quants(v)} FROM series)) AS q FROM demand d
         LEFT JOIN {n}_week o ON {SAME.format('d', 'o')} AND isodow(d."timestamp") = o.w AND hour(d."timestamp") = o.h
         LEFT JOIN {n}_day y ON {SAME.format('d', 'y')} AND hour(d."timestamp") = y.h LEFT JOIN {n}_ever e ON {SAME.format('d', 'e')})""" for n, v in (("amount", "avg_amount"), ("distance", "avg_distance"))],
    """published AS (SELECT d.*, a.q[1] AS pred_amount_p10, a.q[2] AS pred_amount_p50, a.q[3] AS pred_amount_p90, x.q[1] AS pred_distance_p10, x.q[2] AS pred_distance_p50, x.q[3] AS pred_distance_p90
         FROM demand d JOIN amount_at a USING (VendorID, PULocationID, "timestamp") JOIN distance_at x USING (VendorID, PULocationID, "timestamp"))""",
    select=f"""SELECT VendorID, PULocationID, "timestamp", VendorID || '_' || PULocationID AS Series_ID, {PUBLISHED} FROM published"""))


def _lag_regression(s, d):
    model, rows = FC.lag_regression(int_series(s, d), "demand", ["avg_amount"])
    return model.transform(rows).select(*KEYS, "timestamp", "demand", "prediction")





def _moments(s, d):
    """Mean of prediction times each input: least squares makes it that of the demand times the input."""
    model, rows = FC.lag_regression(int_series(s, d), "demand", ["avg_amount"])
    inputs = {"one": F.lit(1.0), **{c: F.col(c) for c in [*FC.REGRESSION_FEATURES, "avg_amount"]}}
    scored = model.transform(rows)
    return scored.agg(F.count("prediction").alias("rows"), *[F.round(F.avg(F.col("prediction") * x), 4).alias(f"by_{n}") for n, x in inputs.items()])


INPUTS = {
    "one": "1", **{f"lag_{i}": f"coalesce(lag(demand, {i}) OVER ({OVER}), 0)" for i in range(1, 6)},
    "hour_sin": """sin(2 * pi() * hour("timestamp") / 24)""", "hour_cos": """cos(2 * pi() * hour("timestamp") / 24)""",
    "dow_sin": """sin(2 * pi() * isodow("timestamp") / 7)""", "dow_cos": """cos(2 * pi() * isodow("timestamp") / 7)""", "avg_amount": "avg_amount",
}
LAGGED = [
    "x AS (SELECT *, " + ", ".join(f"({x})::DOUBLE AS x_{n}" for n, x in INPUTS.items()) + " FROM s)",
    "normal AS (SELECT " + matrix_sql([*INPUTS, "label"], lambda a, b: f"sum(x_{a} * {'demand' if b == 'label' else f'x_{b}'})") + " AS m FROM x)",
    f"model_ AS (SELECT list_transform(m, lambda r: r[{len(INPUTS) + 1}]) AS w FROM {solved('normal', len(INPUTS))})",
]
FITTED = "(" + " + ".join(f"w[{i}] * x_{n}" for i, n in enumerate(INPUTS, 1)) + ")"
register("lag_regression", lambda s, d: rounded(_lag_regression(s, d), 6, "prediction"),
         with_tables(*E, INT_SERIES, *LAGGED, select=f"""SELECT VendorID, PULocationID, "timestamp", demand, round({FITTED}, 6) AS prediction FROM x, model_"""))
register("lag_regression_facts", _moments, with_tables(*E, INT_SERIES, "x AS (SELECT demand, " + ", ".join(f"{x} AS x_{n}" for n, x in INPUTS.items()) + " FROM s)",
         select="SELECT count(*) AS rows, " + ", ".join(f"round(avg(demand::DOUBLE * x_{n}), 4) AS by_{n}" for n in INPUTS) + " FROM x"))


def _lag_boosted(s, d):
    """The last tenth of the table's time, predicted from trees fitted on the first eight."""
    series = int_series(s, d)
    ends = series.agg(F.unix_seconds(F.min("timestamp").cast("timestamp")).alias("a"), F.unix_seconds(F.max("timestamp").cast("timestamp")).alias("b")).first()
    first = series.agg(F.min("timestamp")).scalar()
    at = lambda share: first + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(int((ends.b - ends.a) * share)))
    found = FC.lag_boosted(series, at(0.8), at(0.9), "demand", ["avg_amount"])
    return found.select(*KEYS, "timestamp", "demand", "prediction")


register("lag_boosted", _lag_boosted)


def _since(series, share):
    """The instant after a share of the table's time, on the hour."""
    ends = series.agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).first()
    hours = int((ends.b - ends.a).total_seconds() // 3600 * share)
    return F.lit(str(ends.a)).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(hours))


def _quantile_model(s, d):
    series = B.series(s, d)
    return FC.quantile_model_forecast(series, _since(series, 0.8))


register("quantile_model_forecast", _quantile_model)


def _quantile_scores(s, d):
    """Pinball loss over the last fifth of the table's time of the regression and of the hour-of-week percentiles, and the share between p10 and p90."""
    series = B.series(s, d)
    since = _since(series, 0.8)
    model = FC.quantile_model_forecast(series, since)
    rows = FC.day_ahead_features(series).select(*KEYS, "timestamp", "demand")
    profile = FC.hour_of_week_quantiles(rows.where(F.col("timestamp") >= since), rows.where(F.col("timestamp") < since), {"demand": "demand"}).fillna(0)
    columns = {q: f"pred_demand_{n}" for n, q in FC.LEVELS.items()}
    inside = F.avg(F.col("demand").between(F.col("pred_demand_p10"), F.col("pred_demand_p90")).cast("double"))
    return M.pinball_loss(model, "demand", columns).withColumns(
        {"profile_loss": M.pinball_loss(profile, "demand", columns).select("loss").scalar(), "coverage": model.agg(inside).scalar()})


register("quantile_model_scores", _quantile_scores)
register("direct_forecast", lambda s, d: FC.direct_forecast(B.series(s, d)))


AHEAD = {"one": "1.0::DOUBLE", **{f"lag_{i}": f"lag(demand, {i}) OVER ({OVER})::DOUBLE" for i in FC.DAY_AHEAD_LAGS},
         "hour_sin": """sin(2 * pi() * hour("timestamp") / 24)""", "hour_cos": """cos(2 * pi() * hour("timestamp") / 24)""",
         "dow_sin": """sin(2 * pi() * isodow("timestamp") / 7)""", "dow_cos": """cos(2 * pi() * isodow("timestamp") / 7)"""}
AHEAD_NAMES = [*AHEAD, "demand"]
BACKTEST = [
    "filled AS (SELECT VendorID, PULocationID, \"timestamp\", coalesce(demand, 0) AS demand FROM full_g)",
    "known AS (SELECT * FROM (SELECT VendorID, PULocationID, \"timestamp\", CAST(\"timestamp\" AS DATE) AS day, demand, " + ", ".join(f"{x} AS {n}" for n, x in AHEAD.items()) + " FROM filled) WHERE lag_72 IS NOT NULL)",
    "daily AS (SELECT day, " + ", ".join(f"sum({a} * {b}) AS s_{a}_{b}" for i, a in enumerate(AHEAD_NAMES) for b in AHEAD_NAMES[i:]) + " FROM known GROUP BY 1)",
    "sofar AS (SELECT day, count(*) OVER w AS days, " + ", ".join(f"sum(s_{a}_{b}) OVER w AS s_{a}_{b}" for i, a in enumerate(AHEAD_NAMES) for b in AHEAD_NAMES[i:])
    + " FROM daily WINDOW w AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
    "origins AS (SELECT day, days, s_one_one AS rows, " + matrix_sql(AHEAD_NAMES, lambda a, b: f"s_{a}_{b}" if AHEAD_NAMES.index(a) <= AHEAD_NAMES.index(b) else f"s_{b}_{a}") + " AS m FROM sofar WHERE days >= 7)",
    f"models AS (SELECT day, days, rows, list_transform(m, lambda r: r[{len(AHEAD) + 1}]) AS w FROM {solved('origins', len(AHEAD))})",
]
register("rolling_origin", lambda s, d: RG.rolling_origin(FC.day_ahead_features(B.series(s, d)), FC.DAY_AHEAD_FEATURES, "demand", "day", 7)
         .select("day", "days", "rows", *[F.round(F.col("weights")[i], 6).alias(f"w_{n}") for i, n in enumerate(AHEAD)]),
         with_tables(*E, B.FULL_GLOBAL, *BACKTEST, select="SELECT day, days, rows::BIGINT AS rows, " + ", ".join(f"round(w[{i}], 6) AS w_{n}" for i, n in enumerate(AHEAD, 1)) + " FROM models"))


def _backtest(s, d):
    scored = FC.rolling_backtest(B.series(s, d), history=7)
    keyed = scored.withColumn("Series_ID", F.concat_ws("_", *KEYS))
    return rounded(M.nested_mae(keyed), 6, "mean_mae", "median_mae")


register("rolling_backtest", _backtest, with_tables(*E, B.FULL_GLOBAL, *BACKTEST,
         "day_mae AS (SELECT VendorID, PULocationID, day, avg(abs(demand - (" + " + ".join(f"w[{i}] * {n}" for i, n in enumerate(AHEAD, 1)) + "))) AS mae FROM known JOIN models USING (day) GROUP BY 1, 2, 3)",
         "series_mae AS (SELECT avg(mae) AS mae FROM day_mae GROUP BY VendorID, PULocationID)",
         select="SELECT count(*) AS series, round(avg(mae), 6) AS mean_mae, round(quantile_cont(mae, 0.5::DOUBLE), 6) AS median_mae FROM series_mae"))


def _scenario(s, d):
    model, rows = FC.lag_regression(int_series(s, d), "demand", ["avg_amount"])
    return FC.scenario_forecast(model, rows, {"avg_amount": 5000.0}).select(*KEYS, "timestamp", "avg_amount", "prediction", "scenario")



register("scenario_forecast", lambda s, d: rounded(_scenario(s, d), 6, "prediction", "scenario"),
         with_tables(*E, INT_SERIES, *LAGGED, select=f"""SELECT VendorID, PULocationID, "timestamp", avg_amount, round({FITTED}, 6) AS prediction,
           round({FITTED} + w[{list(INPUTS).index('avg_amount') + 1}] * (5000 - avg_amount), 6) AS scenario FROM x, model_"""))


def _scenario_shift(s, d):
    """A linear model's answer moves in proportion to the change, and not at all where there is none."""
    rows = _scenario(s, d).withColumn("change", 5000.0 - F.col("avg_amount")).withColumn("shift", F.col("scenario") - F.col("prediction"))
    slope = F.try_divide(F.sum(F.col("shift") * F.col("change")), F.sum(F.col("change") * F.col("change")))
    rows = rows.withColumn("_slope", rows.agg(slope).scalar())
    return rows.agg(
        F.count("*").alias("rows"), F.round(F.avg("avg_amount"), 4).alias("avg_amount"), F.round(F.avg("prediction"), 4).alias("prediction"),
        F.count_if(F.abs(F.col("shift") - F.col("_slope") * F.col("change")) > 1e-6).alias("off"), F.count_if((F.col("change") == 0) & (F.col("shift") != 0)).alias("moved"))


register("scenario_forecast_facts", _scenario_shift, with_tables(*E, INT_SERIES, select="""SELECT count(*) AS rows, round(avg(avg_amount), 4) AS avg_amount, round(avg(demand), 4) AS prediction,
  0::BIGINT AS off, 0::BIGINT AS moved FROM s"""))

# --- geography -------------------------------------------------------------------------------------

HALF_X, HALF_Y, HOLE = 0.012, 0.008, 0.004


def boxes(s, d):
    """A rectangle with a square hole around each zone point."""
    def ring(dx, dy):
        corners = [(-dx, -dy), (dx, -dy), (dx, dy), (-dx, dy), (-dx, -dy)]
        return F.array(*[F.array(F.col("lon") + F.lit(x), F.col("lat") + F.lit(y)) for x, y in corners])

    return B.zone_points(s, d).select(F.col("zone").alias("locationid"), F.array(F.array(ring(HALF_X, HALF_Y), ring(HOLE, HOLE))).alias("polygons"))


register("points_in_polygons",
         lambda s, d: GE.points_in_polygons(B.places(s, d).select("start_id", F.col("lon").alias("x"), F.col("lat").alias("y")), boxes(s, d)).select("start_id", "locationid"),
         with_tables(B.PLACES, B.ZONE_POINTS, select=f"""SELECT start_id, zone AS locationid FROM places p LEFT JOIN zone_points z
           ON p.lon > z.lon - {HALF_X}::DOUBLE AND p.lon < z.lon + {HALF_X}::DOUBLE AND p.lat > z.lat - {HALF_Y}::DOUBLE AND p.lat < z.lat + {HALF_Y}::DOUBLE
           AND NOT (p.lon >= z.lon - {HOLE}::DOUBLE AND p.lon <= z.lon + {HOLE}::DOUBLE AND p.lat >= z.lat - {HOLE}::DOUBLE AND p.lat <= z.lat + {HOLE}::DOUBLE)"""))


# corners of an arrow and of the hole in it, in radii; the radius of a zone depends on its number
ARROW = [(0.0, 1.0), (0.9, -0.7), (0.1, -0.3), (-0.7, -0.9)]
ARROW_HOLE = [(0.0, 0.4), (0.2, 0.0), (-0.2, 0.05)]


def arrows(s, d):
    """An arrow-shaped polygon with a hole around each zone point, from 0.004 to 0.26 degrees across."""
    radius = F.lit(0.004) * F.pow(F.lit(2.0), (F.col("zone") % 7).cast("double"))

    def ring(corners):
        return F.array(*[F.array(F.col("lon") + F.lit(x) * radius, F.col("lat") + F.lit(y) * radius) for x, y in [*corners, corners[0]]])

    return B.zone_points(s, d).select(F.col("zone").alias("locationid"), F.array(F.array(ring(ARROW), ring(ARROW_HOLE))).alias("polygons"))


ARROW_EDGES = ", ".join(
    f"({x1}::DOUBLE, {y1}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)" for ring in (ARROW, ARROW_HOLE) for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]])
)
register("points_in_arrows",
         lambda s, d: GE.points_in_polygons(B.places(s, d).select("start_id", F.col("lon").alias("x"), F.col("lat").alias("y")), arrows(s, d)).select("start_id", "locationid"),
         with_tables(B.PLACES, B.ZONE_POINTS, f"""edges AS (SELECT zone, lon + a * r AS x1, lat + b * r AS y1, lon + c * r AS x2, lat + e * r AS y2
             FROM (SELECT *, 0.004::DOUBLE * pow(2, zone % 7) AS r FROM zone_points), (VALUES {ARROW_EDGES}) t(a, b, c, e))""",
                     """inside AS (SELECT start_id, zone FROM places JOIN edges ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1
             GROUP BY 1, 2 HAVING count(*) % 2 = 1)""",
                     select="SELECT start_id, zone AS locationid FROM places LEFT JOIN inside USING (start_id)"))


def _centroids(s, d):
    x, y = F.col("lon"), F.col("lat")
    ring = F.array(F.array(x, y), F.array(x + 0.25, y), F.array(x + 0.25, y + 0.5), F.array(x, y + 0.5), F.array(x, y))
    zones = B.places(s, d).select(F.col("start_id").alias("locationid"), F.array(F.array(ring)).alias("polygons"))
    return rounded(GE.polygon_centroid(zones), 5, "Longitude", "Latitude")


register("polygon_centroid", _centroids, with_tables(B.PLACES, select="SELECT start_id AS locationid, round(lon + 0.125::DOUBLE, 5) AS Longitude, round(lat + 0.25::DOUBLE, 5) AS Latitude FROM places"))
NEAR = f"""near AS (SELECT start_id, zone, {haversine_sql('p.lat', 'p.lon', 'z.lat', 'z.lon')} AS d FROM places p, zone_points z)"""
register("zone_knn",
         lambda s, d: rounded(GE.neighbours(GE.zone_knn(B.places(s, d), B.zone_points(s, d), 5), "start_id"), 9, "d"),
         with_tables(B.PLACES, B.ZONE_POINTS, NEAR, select="""SELECT start_id, CAST(row_number() OVER w AS INTEGER) AS rank, zone, round(d, 9) AS d FROM near
           WINDOW w AS (PARTITION BY start_id ORDER BY d, zone) QUALIFY row_number() OVER w <= 5"""))


def _many_zones(s, d):
    """Customers as zones, spread so that their density stays the same however many there are."""
    i = F.col("c_custkey")
    return B.table(s, d, "customer").select(i.alias("zone"), (F.floor(i / 180) * 0.011 - 60).alias("lat"), ((i % 180) * 0.013 + (i * i % 7) * 0.0011).alias("lon"))


MANY_ZONES = "many AS (SELECT c_custkey AS zone, (c_custkey // 180) * 0.011::DOUBLE - 60 AS lat, (c_custkey % 180) * 0.013::DOUBLE + (c_custkey * c_custkey % 7) * 0.0011::DOUBLE AS lon FROM customer)"
register("zone_knn_many",
         lambda s, d: rounded(GE.neighbours(GE.zone_knn(B.places(s, d), _many_zones(s, d), 3), "start_id"), 9, "d").drop("zone"),
         with_tables(B.PLACES, MANY_ZONES, f"""near AS (SELECT start_id, zone, {haversine_sql('p.lat', 'p.lon', 'z.lat', 'z.lon')} AS d FROM places p, many z)""",
           select="""SELECT start_id, CAST(row_number() OVER w AS INTEGER) AS rank, round(d, 9) AS d FROM near
           WINDOW w AS (PARTITION BY start_id ORDER BY d, zone) QUALIFY row_number() OVER w <= 3"""))
PLANAR = f"planar AS (SELECT zone, {MERCATOR_X.format(lon='lon')} AS x, {MERCATOR_Y.format(lat='lat')} AS y FROM many)"


METRES = "CAST(round_even(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)), 0) AS BIGINT)"
register("zone_distances_within", lambda s, d: GE.zone_distances_within(_many_zones(s, d), 1500.0),
         with_tables(MANY_ZONES, PLANAR, select=f"""SELECT a.zone AS id_a, b.zone AS id_b, {METRES} AS metres FROM planar a, planar b
           WHERE a.zone < b.zone AND (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) <= 1500.0::DOUBLE * 1500.0::DOUBLE"""))
ZONE_PLANAR = f"zp AS (SELECT zone, {MERCATOR_X.format(lon='lon')} AS x, {MERCATOR_Y.format(lat='lat')} AS y FROM zone_points)"
register("pair_distances",
         lambda s, d: GE.pair_distances(B.trips(s, d).select("PULocationID", "DOLocationID").distinct(), B.zone_points(s, d), "PULocationID", "DOLocationID"),
         with_tables(B.TRIPS, B.ZONE_POINTS, ZONE_PLANAR, select=f"""SELECT PULocationID, DOLocationID, CASE WHEN PULocationID = DOLocationID THEN 0 ELSE {METRES} END AS metres
           FROM (SELECT DISTINCT PULocationID, DOLocationID FROM trips) LEFT JOIN zp a ON a.zone = PULocationID LEFT JOIN zp b ON b.zone = DOLocationID"""))


def _lookup(s, d):
    distances = GE.zone_distances_within(B.zone_points(s, d), 12000.0)
    return GE.distance_lookup(B.event_trips(s, d).select("event_id", "PULocationID", "DOLocationID"), distances, "PULocationID", "DOLocationID")


register("distance_lookup", _lookup, with_tables(B.EVENT_TRIPS, B.ZONE_POINTS, ZONE_PLANAR, select=f"""SELECT event_id, PULocationID, DOLocationID,
  CASE WHEN PULocationID = DOLocationID THEN 0 WHEN (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) <= 12000.0::DOUBLE * 12000.0::DOUBLE THEN {METRES} END AS metres
  FROM trips_e JOIN zp a ON a.zone = PULocationID JOIN zp b ON b.zone = DOLocationID"""))
PULL = f"""pop AS (SELECT PULocationID, sum("count")::DOUBLE AS n FROM rollup_ GROUP BY 1),
  zz AS (SELECT a.zone AS own, b.zone AS other, {haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS d FROM zone_points a, zone_points b),
  nn AS (SELECT * FROM zz QUALIFY row_number() OVER (PARTITION BY own ORDER BY d, other) <= 3),
  pulled AS (SELECT zone, lat, lon, 0.8::DOUBLE * coalesce(p.n, 0) + 0.2::DOUBLE * coalesce((SELECT sum(coalesce(q.n, 0) / (d + 0.0001::DOUBLE)) FROM nn LEFT JOIN pop q ON q.PULocationID = nn.other
    WHERE nn.own = z.zone AND nn.other <> z.zone), 0) AS pull FROM zone_points z LEFT JOIN pop p ON p.PULocationID = z.zone)"""
register("zone_pull", lambda s, d: rounded(GE.zone_pull(GE.zone_trips(B.zone_points(s, d), A.zone_popularity(B.rollup(s, d)))), 4, "pull"),
         with_tables(B.TRIPS, B.ROLLUP, B.ZONE_POINTS, PULL, select="SELECT zone, lat, lon, round(pull, 4) AS pull FROM pulled"))


def _routes(s, d, **options):
    routes = GE.greedy_routes(B.places(s, d), B.zone_points(s, d), A.zone_popularity(B.rollup(s, d)), **options)
    return rounded(routes.select("start_id", "route", "route_rad"), 8, "route_rad")


register("greedy_routes", _routes, "WITH RECURSIVE " + with_tables(
    B.TRIPS, B.ROLLUP, B.ZONE_POINTS, B.PLACES, PULL, f"""walk AS (SELECT start_id, lat, lon, []::INTEGER[] AS route, 0.0::DOUBLE AS len, 0 AS hop FROM places
    UNION ALL SELECT start_id, zlat, zlon, list_append(route, zone), len + d, hop + 1 FROM (
      SELECT *, row_number() OVER (PARTITION BY start_id ORDER BY pull / (d + 0.0001::DOUBLE) DESC, d, zone) AS best FROM (
        SELECT *, row_number() OVER (PARTITION BY start_id ORDER BY d, zone) AS nearest FROM (
          SELECT w.start_id, w.route, w.len, w.hop, z.zone, z.lat AS zlat, z.lon AS zlon, z.pull, {haversine_sql('w.lat', 'w.lon', 'z.lat', 'z.lon')} AS d
          FROM walk w, pulled z WHERE hop < 5))
      WHERE nearest <= 20 AND NOT list_contains(route, zone)) WHERE best = 1)""",
    select="SELECT start_id, route, round(len, 8) AS route_rad FROM walk WHERE hop = 5").removeprefix("WITH "))

# --- reference data -------------------------------------------------------------------------------------

PARENTED = """parented AS (SELECT areaName, Borough, CAST(m || '-01' AS DATE) AS "Date", AskingRent,
    'area ' || (CAST(substr(areaName, 6) AS INTEGER) // 10 * 10) AS parent FROM wide UNPIVOT INCLUDE NULLS (AskingRent FOR m IN (""" + ", ".join(f'"{m}"' for m in MONTHS) + """))),
  one AS (SELECT areaName, parent, "Date", max(AskingRent) AS AskingRent FROM parented GROUP BY 1, 2, 3)"""


def _area_rent(s, d):
    """One row per (area, month); the parent of area 17 is area 10."""
    from kerbside.functions.shape import months_to_long

    long = months_to_long(wide_rent(s, d), ["areaName", "Borough"])
    parent = F.concat(F.lit("area "), F.floor(F.substring("areaName", 6, 9).cast("int") / 10) * 10)
    return long.groupBy("areaName", parent.alias("parent"), "Date").agg(F.max("AskingRent").alias("AskingRent"))


register("impute_from_parent", lambda s, d: RD.impute_from_parent(_area_rent(s, d)),
         with_tables(WIDE, PARENTED, select="""SELECT o.areaName, o.parent, o."Date", coalesce(o.AskingRent, p.AskingRent) AS AskingRent FROM one o LEFT JOIN one p ON o.parent = p.areaName AND o."Date" = p."Date" """))
IMPUTED = """imp AS (SELECT areaName, "Date", AskingRent AS r,
    row_number() OVER (PARTITION BY areaName ORDER BY "Date") AS p FROM one),
  k AS (SELECT *, CASE WHEN r IS NOT NULL THEN p END AS kp FROM imp),
  m AS (SELECT *, last_value(r IGNORE NULLS) OVER b AS v0, last_value(kp IGNORE NULLS) OVER b AS p0, first_value(r IGNORE NULLS) OVER a AS v1, first_value(kp IGNORE NULLS) OVER a AS p1 FROM k
    WINDOW b AS (PARTITION BY areaName ORDER BY "Date" ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY areaName ORDER BY "Date" ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def _asking_rent(s, d):
    wide = _area_rent(s, d).groupBy("areaName").pivot("Date", [f"{m}-01" for m in MONTHS]).agg(F.max("AskingRent")).withColumnsRenamed({f"{m}-01": m for m in MONTHS})
    return RD.asking_rent(wide.withColumn("Borough", F.lit("Manhattan")), MONTHS).select("areaName", "Date", "AskingRent")


register("asking_rent", _asking_rent, with_tables(WIDE, PARENTED, IMPUTED, select="""SELECT areaName, "Date", coalesce(r, v0 + (v1 - v0) * ((p - p0)::DOUBLE / nullif(p1 - p0, 0)), v0, v1) AS AskingRent FROM m"""))


def _restaurants(s, d):
    key = F.col("c_custkey") % 400
    text = lambda c: F.replace(F.format_string("%.3f", c), F.lit("."), F.lit(","))
    raw = B.table(s, d, "customer").select(
        F.concat(F.lit("place "), key).alias("DBA"), F.when(F.col("c_acctbal") >= 0, key % 50).alias("SCORE"),
        text(F.lit(40.0) + key / 1000).alias("Latitude"), F.when(F.col("c_acctbal") <= 9000, text(F.lit(-74.0) + key / 1000)).otherwise("").alias("Longitude"))
    return RD.restaurant_points(raw)


register("restaurant_points", _restaurants, """SELECT DISTINCT 'place ' || (c_custkey % 400) AS DBA, (c_custkey % 400 % 50)::DOUBLE AS SCORE,
  CAST(format('{:.3f}', 40.0::DOUBLE + (c_custkey % 400) / 1000) AS DOUBLE) AS Latitude, CAST(format('{:.3f}', -74.0::DOUBLE + (c_custkey % 400) / 1000) AS DOUBLE) AS Longitude
  FROM customer WHERE c_acctbal BETWEEN 0 AND 9000""")
register("parent_area",
         lambda s, d: B.table(s, d, "customer").select("c_custkey", RD.parent_area(
             F.when(F.col("c_custkey") % 3 == 0, "Chelsea").otherwise(F.col("c_name")), F.when(F.col("c_custkey") % 2 == 0, "Queens").otherwise("Manhattan")).alias("parent")),
         "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'All Midtown' WHEN c_custkey % 2 = 0 THEN 'Queens' ELSE 'NYC' END AS parent FROM customer")

# --- models ------------------------------------------------------------------------------------------------


def located(s, d):
    from kerbside.operators.lookup import with_centroids

    return with_cyclic_calendar(with_centroids(int_series(s, d), B.centroids(s, d)))


def _score(s, d):
    def load():
        weights = {"demand": 2.0, "avg_distance": 0.5}
        return lambda batch: sum(batch[c].astype("float64") * w for c, w in weights.items())

    return ML.score_partitions(int_series(s, d), load)


register("score_partitions", _score, with_tables(*E, select="""SELECT VendorID, PULocationID, "timestamp", demand, floor(avg_distance)::DOUBLE AS avg_distance, floor(avg_amount)::DOUBLE AS avg_amount,
  demand * 2.0::DOUBLE + floor(avg_distance)::DOUBLE * 0.5::DOUBLE AS prediction FROM series"""))


def _weighted(s, d):
    vector = VectorAssembler(inputCols=["demand", "avg_distance"], outputCol="v").transform(int_series(s, d))
    return ML.WeightedSum(inputCol="v", outputCol="prediction", weights=[2.0, 0.5], intercept=1.0).transform(vector).drop("v")


register("weighted_sum_stage", _weighted, with_tables(*E, select="""SELECT VendorID, PULocationID, "timestamp", demand, floor(avg_distance)::DOUBLE AS avg_distance, floor(avg_amount)::DOUBLE AS avg_amount,
  1.0::DOUBLE + demand * 2.0::DOUBLE + floor(avg_distance)::DOUBLE * 0.5::DOUBLE AS prediction FROM series"""))


def _sql_stage(s, d):
    from pyspark.ml.feature import SQLTransformer

    out = ML.SeriesHistory(label="demand").transform(int_series(s, d))
    out = SQLTransformer(statement="SELECT *, demand_sc AS prediction FROM __THIS__").transform(out)
    out = SQLTransformer(statement=ML.DENORMALISE).transform(out)
    return rounded(out.select(*KEYS, "timestamp", "mean", "std", "demand_sc", "prediction_real"), 6, "mean", "std", "demand_sc", "prediction_real")


register("sql_stages", _sql_stage, with_tables(*E, f"""r AS (SELECT *, coalesce(avg(demand) OVER w, 0) AS mean, coalesce(stddev_samp(demand) OVER w, 1) AS std,
  coalesce((demand - avg(demand) OVER w) / coalesce(nullif(stddev_samp(demand) OVER w, 0), 1), 0) AS sc FROM series WINDOW w AS ({OVER} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))""",
  select="""SELECT VendorID, PULocationID, "timestamp", round(mean, 6) AS mean, round(std, 6) AS std, round(sc, 6) AS demand_sc, round(sc * std + mean, 6) AS prediction_real FROM r"""))


def _features(s, d):
    from pyspark.ml.functions import vector_to_array

    rows = located(s, d)
    out = ML.feature_pipeline("demand").fit(rows).transform(rows)
    return rounded(out.select(*KEYS, "timestamp", F.size(vector_to_array("features")).alias("width"), "mean", "std", "d_t1", "amt_t5"), 6, "std", "d_t1", "amt_t5")


# vendors + 2 coordinates + 4 calendar values + 15 lags
register("feature_matrix", _features, with_tables(*E, INT_SERIES, ROLLED, select=f"""SELECT VendorID, PULocationID, "timestamp",
  CAST((SELECT count(DISTINCT VendorID) FROM s) + 21 AS INTEGER) AS width, mean, round(std, 6) AS std, round(coalesce(lag(demand_sc) OVER ({OVER}), 0), 6) AS d_t1,
  round(coalesce(lag(avg_amount_sc, 5) OVER ({OVER}), 0), 6) AS amt_t5 FROM rolled"""))
register("encode_vendor",
         lambda s, d: ML.encode_vendor(B.event_trips(s, d).select("event_id", "VendorID")),
         with_tables(B.EVENT_TRIPS, """codes AS (SELECT VendorID, row_number() OVER (ORDER BY count(*) DESC, VendorID::VARCHAR) AS i FROM trips_e GROUP BY 1)""",
                     select="""SELECT event_id, VendorID, list_transform(generate_series(1, (SELECT max(i) FROM codes)), lambda k: (k = i)::INTEGER::DOUBLE) AS vendor_array FROM trips_e JOIN codes USING (VendorID)"""))


def _evaluator(s, d):
    value = ML.evaluate(B.preds(s, d), "demand", "prediction", "mae")
    rows = B.preds(s, d).agg(F.count("*").alias("rows"))
    return rows.select("rows", F.round(F.lit(value), 9).alias("mae"))


register("evaluator", _evaluator, with_tables(*E, B.PREDS, select="SELECT count(*) AS rows, round(avg(abs(demand - prediction)), 9) AS mae FROM preds"))
