"""24-hour quantile forecasts per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window, functions as F

from kerbside.functions.maths import clean_forecast
from kerbside.functions.text import series_key
from kerbside.functions.time import cyclic, iso_weekday, step
from kerbside.operators.boosting import assembled, boosted_regression
from kerbside.operators.grid import complete_spine
from kerbside.operators.lookup import route_to_segment
from kerbside.operators.regression import Quantiles, backtest, quantile_regression, vector_least_squares, vector_predictions
from kerbside.operators.series import by_series, fill_static, supervised_windows
from kerbside.operators.stats import linear, order_statistics, quantiles
from kerbside.scratch import cut_lineage

KEYS = ["VendorID", "PULocationID"]
Z80 = 1.28
LEVELS = {"p10": 0.1, "p50": 0.5, "p90": 0.9}


def recent_history(
    series: DataFrame, hours: int = 72, static: Sequence[str] = (), keys=KEYS, newest: Column | None = None
) -> DataFrame:
    """The last hours up to the newest instant (of the table), completed with zero demand."""
    newest = newest if newest is not None else series.agg(F.max("timestamp")).scalar()
    oldest = newest - step((hours - 1) * 3600)
    recent = series.where(F.col("timestamp") >= oldest)
    full = complete_spine(recent, keys, "timestamp", "1h", "global", start=oldest, end=newest)
    values = [c for c in series.columns if c not in (*keys, "timestamp", *static)]
    full = fill_static(full, static, keys) if static else full
    return full.fillna(0, subset=values)


def seasonal_naive(history: DataFrame, horizon: int = 24, value: str = "demand", name: str = "demand", keys=KEYS) -> DataFrame:
    """Repeat the last 24 values; the band is 1.28 deviations of the history wide, p10 at least 0.

    history has no gaps; one of fewer than 24 rows repeats what it has. Every row
    fans out to the steps it predicts, so nothing is joined.
    """
    w = Window.partitionBy(*keys)
    rows = history.withColumns(
        {
            "_back": F.row_number().over(w.orderBy(F.desc("timestamp"))),
            "_last": F.max("timestamp").over(w),
            "_band": F.coalesce(F.stddev_samp(value).over(w), F.lit(0.0)) * Z80,
            "_period": F.least(F.count(F.lit(1)).over(w), F.lit(24)).cast("int"),
        }
    ).where(F.col("_back") <= F.col("_period"))
    first = F.col("_period") + 1 - F.col("_back")
    repeats = F.when(first <= horizon, F.sequence(first, F.lit(horizon), F.col("_period")))
    steps = rows.withColumn("_step", F.explode(repeats))
    mid = F.col(value).cast("double")
    return steps.select(
        *keys,
        (F.col("_last") + F.make_dt_interval(F.lit(0), F.col("_step").cast("int"))).alias("timestamp"),
        F.greatest(mid - F.col("_band"), F.lit(0.0)).alias(f"pred_{name}_p10"),
        mid.alias(f"pred_{name}_p50"),
        (mid + F.col("_band")).alias(f"pred_{name}_p90"),
    )


def hour_of_week_quantiles(rows: DataFrame, history: DataFrame, targets: dict[str, str], keys=KEYS) -> DataFrame:
    """pred_<name>_p10 / p50 / p90 of history's values at the weekday and hour of the given rows.

    targets maps output names to value columns. A (series, weekday, hour) group has
    one value per week of history.
    """
    levels = F.array(*[F.lit(q) for q in LEVELS.values()])
    slot = {"_dow": iso_weekday("timestamp"), "_hour": F.hour("timestamp")}
    profile = history.groupBy(*keys, *[c.alias(n) for n, c in slot.items()]).agg(
        *[F.percentile(value, levels).alias(f"_{name}") for name, value in targets.items()]
    )
    at = rows.withColumns(slot).join(profile, [*keys, *slot], "left")
    picked = [F.col(f"_{t}")[i].alias(f"pred_{t}_{p}") for t in targets for i, p in enumerate(LEVELS)]
    return at.select(*rows.columns, *picked)


def horizon_rows(series: DataFrame, horizon: int, keys=KEYS) -> DataFrame:
    """The next hours of every series."""
    last = series.groupBy(*keys).agg(F.max("timestamp").alias("_last"))
    ahead = F.sequence(F.col("_last") + step(3600), F.col("_last") + step(horizon * 3600), step(3600))
    return last.select(*keys, F.explode(ahead).alias("timestamp"))


def empirical_quantile_forecast(series: DataFrame, horizon: int = 24, value: str = "demand", name: str = "demand", keys=KEYS) -> DataFrame:
    """Hour-of-week quantiles of the series' own history for its next hours."""
    return hour_of_week_quantiles(horizon_rows(series, horizon, keys), series, {name: value}, keys)


def sample_quantiles(samples: DataFrame, value: str, name: str, keys=("Series_ID", "timestamp")) -> DataFrame:
    """p10 / p50 / p90 over the sample draws of each (series, instant), however many there are."""
    return quantiles(samples, keys, value, {f"pred_{name}_{p}": q for p, q in LEVELS.items()}).drop("total")


def _slots(ts: str = "timestamp") -> list[Column]:
    """Numbers of an instant's hour of the week, its hour of the day, and of all time: the levels of a profile."""
    return [iso_weekday(ts) * 24 + F.hour(ts), F.lit(1000) + F.hour(ts), F.lit(-1)]


def with_profile(
    rows: DataFrame, history: DataFrame, targets: dict[str, str], keys=KEYS, levels: Column | None = None, overall: bool = True
) -> DataFrame:
    """pred_<name>_p10 / p50 / p90 of the value columns at each row's time, never empty where there is any value.

    The quantiles are those of the series at the row's hour of the week; where it has no
    value then, those of the hour of the day, then of the whole series, then (with ``overall``) of all series.
    targets maps output names to value columns. levels, an array of history's, replaces the numbers of the levels that a row counts for.

    One aggregate makes the quantiles of all levels; a series' levels, 193 at most, become one row that its rows are joined with.
    """
    shares = F.array(*[F.lit(q) for q in LEVELS.values()])
    counted = history.select(*keys, *dict.fromkeys(targets.values()), F.explode(levels if levels is not None else F.array(*_slots())).alias("_slot"))
    profile = counted.groupBy(*keys, "_slot").agg(*[F.percentile(v, shares).alias(f"_{n}") for n, v in targets.items()])
    named = {k: f"_key{i}" for i, k in enumerate(keys)}
    found = profile.groupBy(*keys).agg(*[
        F.map_from_entries(F.collect_list(F.when(F.col(f"_{n}").isNotNull(), F.struct("_slot", f"_{n}")))).alias(f"_{n}") for n in targets
    ]).withColumnsRenamed(named)
    on = F.lit(True)
    for k, n in named.items():
        on = on & F.col(k).eqNullSafe(F.col(n))
    out = rows.join(found, on, "left")
    last: dict[str, Column] = {}
    if overall:
        whole = order_statistics(history, [], list(dict.fromkeys(targets.values())), {p: linear(q) for p, q in LEVELS.items()})
        ever = {r.label: [r[p] for p in LEVELS] for r in whole.collect()}
        last = {n: F.array(*[F.lit(x) for x in ever[v]]) for n, v in targets.items() if v in ever}
    chain = {n: F.coalesce(*[F.try_element_at(F.col(f"_{n}"), slot) for slot in _slots()], *([last[n]] if n in last else [])) for n in targets}
    picked = [q[i].alias(f"pred_{n}_{p}") for n, q in chain.items() for i, p in enumerate(LEVELS)]
    return out.select(*rows.columns, *picked)


# History that the model of a segment learns from, in hours: all, or the newest ones.
SEGMENT_HISTORY = {"LOW": None, "MID": None, "HIGH": 28 * 24}


def forecast(series: DataFrame, router: DataFrame, horizon: int = 24) -> DataFrame:
    """Demand, amount and distance quantiles of the next hours of every series, ready to publish.

    All series are forecast from the newest hour of the table on; hours without a row have no
    demand, also at the end of a series that has fallen silent. Demand by segment: BASELINE
    repeats yesterday's; LOW has the quantiles of the hour of the day, MID those of
    the hour of the week, HIGH those of the hour of the week in the last four weeks. Amount and distance have those of the
    hours with trips: at the hour of the week, else the hour of the day, else of the
    whole series, else of all series.

    The series are checkpointed (one row per series and hour), so the trips are read once.
    """
    series = cut_lineage(series)
    newest = series.agg(F.max("timestamp")).scalar()
    keyed = series.withColumn("Series_ID", series_key("VendorID", "PULocationID"))
    routes = route_to_segment(keyed.select(*KEYS, "Series_ID").distinct(), router).select(*KEYS, "segment")
    hours = complete_spine(series.select(*KEYS, "timestamp", "demand"), KEYS, "timestamp", "1h", "global", end=newest)
    routed = hours.fillna(0, subset=["demand"]).join(routes, KEYS)
    naive = seasonal_naive(
        routed.where((F.col("segment") == "BASELINE") & (F.col("timestamp") > newest - step(72 * 3600))).drop("segment"), horizon
    )
    recent = F.lit(False)
    for segment, length in SEGMENT_HISTORY.items():
        new = F.lit(True) if length is None else F.col("timestamp") > newest - step(length * 3600)
        recent = recent | ((F.col("segment") == segment) & new)
    past = routed.where(recent)
    # LOW series have one profile of the day for all weekdays
    levels = F.when(F.col("segment") == "LOW", F.array(*_slots()[1:])).otherwise(F.array(*_slots()))
    modelled = with_profile(horizon_rows(past, horizon), past, {"demand": "demand"}, levels=levels, overall=False)
    full = with_profile(naive.unionByName(modelled), series, {"amount": "avg_amount", "distance": "avg_distance"})
    # values that differ in the last bit must not fall on two sides of a half
    exact = {c: F.round(c, 6) for c in full.columns if c.startswith("pred_")}
    return clean_forecast(full.withColumns({**exact, "Series_ID": series_key("VendorID", "PULocationID")}), ["demand", "amount", "distance"])


def lag_features_for_regression(series: DataFrame, lags: int = 5, value: str = "demand", keys=KEYS) -> DataFrame:
    w = by_series(keys)
    hour_sin, hour_cos = cyclic(F.hour("timestamp"), 24)
    dow_sin, dow_cos = cyclic(iso_weekday("timestamp"), 7)
    cols = {f"lag_{i}": F.coalesce(F.lag(value, i).over(w).cast("double"), F.lit(0.0)) for i in range(1, lags + 1)}
    return series.withColumns(
        {**cols, "hour_sin": hour_sin, "hour_cos": hour_cos, "dow_sin": dow_sin, "dow_cos": dow_cos}
    )


REGRESSION_FEATURES = [*[f"lag_{i}" for i in range(1, 6)], "hour_sin", "hour_cos", "dow_sin", "dow_cos"]


def lag_regression(series: DataFrame, value: str = "demand", extra: Sequence[str] = (), keys=KEYS):
    """One linear model for all series on lags and calendar; returns (fitted model, features)."""
    rows = lag_features_for_regression(series, value=value, keys=keys)
    stages = [
        VectorAssembler(inputCols=[*REGRESSION_FEATURES, *extra], outputCol="features", handleInvalid="skip"),
        LinearRegression(featuresCol="features", labelCol=value, predictionCol="prediction", solver="normal"),
    ]
    return Pipeline(stages=stages).fit(rows), rows


def lag_boosted(series: DataFrame, val_from, test_from, value: str = "demand", extra: Sequence[str] = (), keys=KEYS, **options) -> DataFrame:
    """The rows from ``test_from`` on with the prediction of boosted trees on lags and calendar.

    One model for all series: fitted before ``val_from``, stopped on the rows between. Lags are
    those of the whole series.
    """
    rows = lag_features_for_regression(series, value=value, keys=keys)
    features = [*REGRESSION_FEATURES, *extra]
    past = rows.where(F.col("timestamp") < test_from).withColumn("_val", F.col("timestamp") >= val_from)
    model = boosted_regression(past, features, value, "_val", **options)
    return model.transform(assembled(rows.where(F.col("timestamp") >= test_from), features)).select(*rows.columns, "prediction")


# what is known a day ahead
DAY_AHEAD_LAGS = (24, 48, 72)
DAY_AHEAD_FEATURES = [*[f"lag_{i}" for i in DAY_AHEAD_LAGS], "hour_sin", "hour_cos", "dow_sin", "dow_cos"]


def day_ahead_features(series: DataFrame, value: str = "demand", keys=KEYS) -> DataFrame:
    """Every hour of every series with the values one, two and three days before, its calendar and its day.

    Hours without a row have no demand; a series' first three days have no lags and are left out.
    """
    full = complete_spine(series.select(*keys, "timestamp", value), keys, "timestamp", "1h", "global").fillna(0, subset=[value])
    w = by_series(keys)
    hour_sin, hour_cos = cyclic(F.hour("timestamp"), 24)
    dow_sin, dow_cos = cyclic(iso_weekday("timestamp"), 7)
    lags = {f"lag_{i}": F.lag(value, i).over(w).cast("double") for i in DAY_AHEAD_LAGS}
    calendar = {"hour_sin": hour_sin, "hour_cos": hour_cos, "dow_sin": dow_sin, "dow_cos": dow_cos}
    return full.withColumns({**lags, **calendar, "day": F.to_date("timestamp")}).dropna(subset=list(lags))


def rolling_backtest(series: DataFrame, value: str = "demand", history: int = 3, keys=KEYS) -> DataFrame:
    """Each day's hours as predicted by a linear model of what was known before that day."""
    return backtest(day_ahead_features(series, value, keys), DAY_AHEAD_FEATURES, value, "day", history)


def demand_quantiles(series: DataFrame, until, value: str = "demand", keys=KEYS) -> Quantiles:
    """Linear p10, p50 and p90 of the demand on day-old lags and the calendar, fitted before ``until``."""
    rows = day_ahead_features(series, value, keys).where(F.col("timestamp") < until)
    return quantile_regression(rows, DAY_AHEAD_FEATURES, value, LEVELS)


def quantile_model_forecast(series: DataFrame, since, value: str = "demand", name: str = "demand", keys=KEYS) -> DataFrame:
    """pred_<name>_p10 / p50 / p90 of the hours from ``since`` on, by quantile regression on the hours before; none is negative."""
    model = demand_quantiles(series, since, value, keys)
    ahead = day_ahead_features(series, value, keys).where(F.col("timestamp") >= since)
    found = model.transform(ahead, f"pred_{name}_").select(*keys, "timestamp", value, *[f"pred_{name}_{p}" for p in LEVELS])
    return found.withColumns({f"pred_{name}_{p}": F.greatest(f"pred_{name}_{p}", F.lit(0.0)) for p in LEVELS})


def direct_forecast(series: DataFrame, past: int = 72, horizon: int = 24, stride: int = 24, value: str = "demand", keys=KEYS) -> DataFrame:
    """The next hours of every series, all steps at once: one linear map from the last ``past`` values to the next ``horizon`` ones.

    Fitted on all windows of all series, whose silent hours count as zero. (keys, timestamp, prediction).
    """
    full = complete_spine(series.select(*keys, "timestamp", value), keys, "timestamp", "1h", "global").fillna(0, subset=[value])
    full = cut_lineage(full)
    weights = vector_least_squares(supervised_windows(full, past, horizon, stride, keys, value), "past", "future")
    w = by_series(keys)
    last = full.select(
        *keys, "timestamp", F.lead("timestamp").over(w).alias("_next"), F.collect_list(value).over(w.rowsBetween(1 - past, 0)).alias("_past")
    ).where(F.col("_next").isNull() & (F.size("_past") == past))
    steps = vector_predictions(last, "_past", weights, "_ahead").select(*keys, "timestamp", F.posexplode("_ahead").alias("_i", "prediction"))
    return steps.select(*keys, (F.col("timestamp") + F.make_dt_interval(F.lit(0), F.col("_i") + 1)).alias("timestamp"), "prediction")


def scenario_forecast(model, rows: DataFrame, overrides: dict[str, float]) -> DataFrame:
    """Score rows as they are and with covariates replaced; adds prediction and scenario."""
    keep = [*rows.columns, "prediction"]
    base = model.transform(rows).select(*keep)
    held = {f"_held_{c}": F.col(c) for c in overrides}
    changed = base.withColumnRenamed("prediction", "_base").withColumns(held)
    changed = changed.withColumns({c: F.lit(float(v)) for c, v in overrides.items()})
    scored = model.transform(changed).withColumnRenamed("prediction", "scenario")
    back = {c: F.col(f"_held_{c}") for c in overrides}
    return scored.withColumns(back).withColumnRenamed("_base", "prediction").select(*keep, "scenario")
