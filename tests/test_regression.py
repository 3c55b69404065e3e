"""Regressions from sums of products against direct fits and planted answers."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.operators import forecast as FC
from kerbside.operators import metrics as M
from kerbside.operators import regression as R
from kerbside.operators import tips as TP

DAY = dt.datetime(2024, 1, 1)


def planted(spark, n=3000):
    """Two regimes: y = 1 + 2x (share 0.7, deviation 0.3) and y = 10 - x (0.3, 0.6)."""
    rng = np.random.default_rng(4)
    x, first = rng.uniform(0, 4, n), rng.random(n) < 0.7
    y = np.where(first, 1 + 2 * x + rng.normal(0, 0.3, n), 10 - x + rng.normal(0, 0.6, n))
    return spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(x, y, first)], "x double, y double, first int")


def test_mixture_recovers_its_parts(spark):
    rows = planted(spark)
    model = R.mixture_regression(rows, ["x"], "y", k=2, rounds=60)
    assert all(b >= a - 1e-9 for a, b in zip(model.likelihoods, model.likelihoods[1:])) and model.likelihoods[-1] > model.likelihoods[0]
    mean, spread = model.inputs.means[0], model.inputs.spreads[0]
    lines = sorted((w[1] / spread, w[0] - w[1] * mean / spread, s, p) for w, s, p in zip(model.weights, model.spreads, model.shares))
    assert np.allclose(lines, [(-1, 10, 0.6, 0.3), (2, 1, 0.3, 0.7)], atol=0.1)
    scored = model.transform(rows)
    right = scored.groupBy("component").agg(F.avg("first").alias("p")).collect()
    assert max(r.p for r in right) > 0.93 and min(r.p for r in right) < 0.07
    alone = R.mixture_regression(rows, ["x"], "y", k=1)
    density = lambda m: m.transform(rows).agg(F.avg("log_density")).first()[0]
    assert density(model) > density(alone) + 0.5 and density(model) == pytest.approx(model.likelihoods[-1], abs=1e-3)


def test_density_integrates_to_one(spark):
    model = R.mixture_regression(planted(spark, 600), ["x"], "y", k=2, rounds=10)
    grid = spark.range(-2000, 4000).select(F.lit(1.5).alias("x"), (F.col("id") / 100).alias("y"))
    found = model.transform(grid).agg(F.sum(F.exp("log_density")) / 100, F.sum(F.exp("log_density") * F.col("y")) / 100, F.max("pred_mean")).first()
    assert found[0] == pytest.approx(1, abs=1e-6) and found[1] == pytest.approx(found[2], abs=1e-6)


def test_mixture_of_few_and_missing_rows(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0), (None, 1.0), (2.0, None)], "x double, y double")
    model = R.mixture_regression(rows, ["x"], "y", k=2)
    assert model.transform(rows.dropna()).agg(F.min("pred_mean"), F.max("pred_mean")).first()[0] == pytest.approx(2.0, abs=1e-6)
    with pytest.raises(ValueError):
        R.mixture_regression(rows.where("x > 5"), ["x"], "y")


def test_conditional_tip_density_beats_one_line(spark):
    rows = planted(spark).withColumns({"tip_amount": F.col("y"), "fare_amount": F.lit(1.0)})
    train, test = rows.where(F.pmod(F.hash("x"), F.lit(2)) == 0), rows.where(F.pmod(F.hash("x"), F.lit(2)) == 1)
    density = lambda k: TP.conditional_tip_mixture(train, ["x"], k).transform(test).agg(F.avg("log_density")).first()[0]
    assert density(2) > density(1) + 0.5


def test_quantiles_are_least_in_pinball_loss(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(0, 3, 2000)
    y = 2 + x + (0.5 + x) * rng.exponential(1, 2000)
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    levels = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    model = R.quantile_regression(rows, ["x"], "y", levels)
    assert model.losses[-1] <= min(model.losses) * 1.0001
    scored = model.transform(rows)
    assert scored.columns == ["x", "y", "pred_p10", "pred_p50", "pred_p90"]
    below = scored.agg(*[F.avg((F.col("y") <= F.col(f"pred_{p}")).cast("double")) for p in levels]).first()
    assert np.allclose(below, list(levels.values()), atol=0.01)
    assert scored.where("pred_p10 > pred_p50 or pred_p50 > pred_p90").count() == 0
    # no small move of a weight lowers the loss by a ten-thousandth
    for i, q in enumerate(levels.values()):
        mean, spread = model.inputs.means[0], model.inputs.spreads[0]
        z = np.stack([np.ones_like(x), (x - mean) / spread])
        loss = lambda w: np.mean(np.maximum(q * (y - w @ z), (q - 1) * (y - w @ z)))  # noqa: E731,B023
        least = loss(np.array(model.weights[i]))
        for move in ((0.05, 0), (-0.05, 0), (0, 0.05), (0, -0.05)):
            assert loss(np.array(model.weights[i]) + move) > least * (1 - 1e-4)


def series(spark, days=20, zones=3):
    rng = np.random.default_rng(8)
    rows = []
    for z in range(zones):
        for h in range(24 * days):
            n = rng.poisson((2 + z) * (1.5 + np.sin(2 * np.pi * h / 24) + (h % 24 == 8) * 3))
            if n:
                rows.append((1, z, DAY + dt.timedelta(hours=h), int(n)))
    return spark.createDataFrame(rows, "VendorID int, PULocationID int, timestamp timestamp_ntz, demand int")


def test_quantile_model_beats_the_percentiles_of_the_past(spark):
    hours = series(spark)
    since = F.lit("2024-01-15").cast("timestamp_ntz")
    found = FC.quantile_model_forecast(hours, since)
    rows = FC.day_ahead_features(hours).select("VendorID", "PULocationID", "timestamp", "demand")
    profile = FC.hour_of_week_quantiles(rows.where(F.col("timestamp") >= since), rows.where(F.col("timestamp") < since), {"demand": "demand"}).fillna(0)
    columns = {q: f"pred_demand_{p}" for p, q in FC.LEVELS.items()}
    assert found.count() == profile.count() == 3 * 6 * 24
    assert M.pinball_loss(found, "demand", columns).first()["loss"] < M.pinball_loss(profile, "demand", columns).first()["loss"]
    assert 0.7 < found.agg(F.avg(F.col("demand").between(F.col("pred_demand_p10"), F.col("pred_demand_p90")).cast("double"))).first()[0] < 0.95


def test_every_origin_has_the_model_of_its_past(spark):
    rows = FC.day_ahead_features(series(spark))
    table = rows.toPandas()
    models = {r.day: r for r in R.rolling_origin(rows, FC.DAY_AHEAD_FEATURES, "demand").collect()}
    assert min(models) == dt.date(2024, 1, 7) and max(models) == dt.date(2024, 1, 20)  # three days of lags, three of history
    for day in (dt.date(2024, 1, 7), dt.date(2024, 1, 12), dt.date(2024, 1, 20)):
        past = table[table.day < day]
        z = np.column_stack([np.ones(len(past)), past[FC.DAY_AHEAD_FEATURES].to_numpy(float)])
        direct, *_ = np.linalg.lstsq(z, past.demand.to_numpy(float), rcond=None)
        # early weekdays depend on each other, so their predictions are compared, not their weights
        assert models[day].rows == len(past) and np.allclose(z @ models[day].weights, z @ direct, atol=1e-6)
    scored = R.backtest(rows, FC.DAY_AHEAD_FEATURES, "demand")
    assert scored.count() == 14 * 24 * 3 and scored.where("prediction is null").count() == 0


def test_direct_forecast_is_numpys(spark):
    hours = series(spark, days=24)
    found = FC.direct_forecast(hours, past=12, horizon=6, stride=3)
    full = FC.complete_spine(hours, ["VendorID", "PULocationID"], "timestamp", "1h", "global").fillna(0, subset=["demand"]).toPandas().sort_values("timestamp")
    x, y, last = [], [], {}
    for zone, own in full.groupby("PULocationID"):
        v = own.demand.to_numpy(float)
        for at in range(12, len(v) - 5, 3):
            x.append([1, *v[at - 12 : at]])
            y.append(v[at : at + 6])
        last[zone] = np.array([1, *v[-12:]])
    weights, *_ = np.linalg.lstsq(np.array(x), np.array(y), rcond=None)
    end = full.timestamp.max().to_pydatetime()
    got = {(r.PULocationID, (r.timestamp - end).total_seconds() / 3600): r.prediction for r in found.collect()}
    wanted = {(z, i + 1.0): p for z, v in last.items() for i, p in enumerate(v @ weights)}
    assert got.keys() == wanted.keys() and np.allclose([got[k] for k in wanted], list(wanted.values()), atol=1e-3)


def test_vector_rows_that_do_not_count(spark):
    rows = spark.createDataFrame([([1.0, 2.0], [3.0]), ([2.0, 1.0], [5.0]), ([0.0, 4.0], [1.0]), ([5.0, 5.0], [11.0]), ([1.0, None], [0.0]), (None, [1.0]), ([1.0], [9.0])], "x array<double>, y array<double>")
    w = R.vector_least_squares(rows, "x", "y", ridge=0)
    assert np.allclose(w, [[1.0, 2.0, 0.0]], atol=1e-9)
    got = R.vector_predictions(rows.limit(1), "x", w).first()["predictions"]
    assert np.allclose(got, [3.0])
