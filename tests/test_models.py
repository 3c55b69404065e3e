"""Models on data whose answer is known, and the spark.ml surface."""

import datetime as dt

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from kerbside.operators import boosting as BO
from kerbside.operators import forecast as FC
from kerbside.operators import ml as ML
from kerbside.operators import segment as SG
from kerbside.operators import tips as TP

DAY = dt.datetime(2024, 1, 1)


def test_clusters_are_labelled_by_centre():
    assert SG.order_clusters([5.0, 1.0, 9.0], ("low", "medium", "high")) == {1: "low", 0: "medium", 2: "high"}


def features(spark):
    rows = [(f"{s}_{i}", m + i * 0.01, 0.2, 0.3, 1.0, 0.04) for s, m in (("l", 2.0), ("m", 30.0), ("h", 200.0)) for i in range(8)]
    rows += [("lumpy", 5.0, 1.0, 0.3, 3.0, 1.0), ("tiny", 0.1, 0.2, 0.3, 1.0, 0.04)]
    return spark.createDataFrame(rows, "Series_ID STRING, mean_real DOUBLE, cv DOUBLE, weekend_ratio DOUBLE, adi DOUBLE, cv2 DOUBLE")


def test_segments_of_separable_series(spark):
    got = {r.Series_ID: r.segment for r in SG.segment_series(features(spark)).collect()}
    assert got["lumpy"] == got["tiny"] == "BASELINE"
    for prefix, label in (("l_", "LOW"), ("m_", "MID"), ("h_", "HIGH")):
        assert {s for k, s in got.items() if k.startswith(prefix)} == {label}


def test_volume_segments(spark):
    rows = [(k, n) for k, n in (("a", 1), ("b", 2), ("c", 50), ("d", 52), ("e", 300), ("f", 310)) for _ in range(3)]
    got = {r.Series_ID: r.segment for r in SG.segment_by_volume(spark.createDataFrame(rows, "Series_ID STRING, demand INT")).collect()}
    assert got == {"a": "LOW", "b": "LOW", "c": "MID", "d": "MID", "e": "HIGH", "f": "HIGH"}


def test_demand_classes_are_fitted_on_all_days(spark):
    rows = [(DAY + dt.timedelta(days=d, hours=8), 0, z, n) for z, n in ((1, 1), (2, 40), (3, 200)) for d in range(7)]
    roll = spark.createDataFrame(rows, "pickup_datetime TIMESTAMP_NTZ, VendorID INT, PULocationID INT, count BIGINT")
    got = SG.classify_demand(roll, DAY, DAY + dt.timedelta(days=9), 8, days=[6, 7]).collect()
    assert {r.PULocationID: r.demand_class for r in got} == {1: "low", 2: "medium", 3: "high"}
    assert SG.classify_demand(roll, DAY, DAY + dt.timedelta(days=9), 9).count() == 0


def tip_rows(spark):
    return spark.range(600).select(
        (F.col("id") % 2).cast("int").alias("VendorID"), F.lit(1).alias("PULocationID"), F.lit(2).alias("DOLocationID"),
        (F.col("id") % 20 + 1).cast("double").alias("fare_amount"),
        F.when(F.col("id") % 20 >= 5, (F.col("id") % 20 + 1) * 0.2).otherwise(0.0).alias("tip_amount"),
    )


def test_tip_models_follow_the_fare(spark):
    rows = tip_rows(spark)
    one = TP.tip_tweedie(rows, ["fare_amount"]).transform(rows)
    assert one.agg(F.corr("fare_amount", "pred_tweedie")).first()[0] > 0.8
    assert one.where("pred_tweedie <= 0").count() == 0
    two = TP.score_hurdle(TP.tip_hurdle(rows, ["fare_amount"]), rows)
    means = two.groupBy((F.col("tip_amount") > 0).alias("tipped")).agg(F.avg("p_tip").alias("p")).collect()
    p = {r.tipped: r.p for r in means}
    assert p[True] > 0.9 > 0.1 > p[False]
    assert two.where(F.abs(F.col("pred_hurdle") - F.col("p_tip") * F.col("amount_given_tip")) > 1e-9).count() == 0


def test_tip_baseline_falls_back_to_the_vendor(spark):
    cols = "PULocationID INT, DOLocationID INT, VendorID INT, tip_amount BIGINT, fare_amount BIGINT"
    train = spark.createDataFrame([(1, 1, 0, 10, 5), (1, 1, 0, 0, 5), (2, 2, 0, 30, 5), (1, 1, 0, 99, 0), (3, 3, 1, 0, 4)], cols)
    test = spark.createDataFrame([(1, 1, 0, 0, 0), (9, 9, 0, 0, 0), (3, 3, 1, 0, 0), (1, 1, 7, 0, 0)], cols)
    got = {(r.PULocationID, r.VendorID): (r.base_prob, r.base_amount, r.pred_baseline) for r in TP.tip_baseline(train, test).collect()}
    assert got[1, 0] == (0.75, 10.0, 7.5) and got[9, 0] == (0.75, 20.0, 15.0)
    assert got[3, 1] == (0.0, None, None) and got[1, 7] == (None, None, None)
    # the separate figures agree
    assert {r.VendorID: r.base_prob for r in TP.tip_probability(train).collect()} == {0: 0.75, 1: 0.0}
    assert {r.VendorID: r.fallback_amount for r in TP.vendor_tip_mean(train).collect()} == {0: 20.0}


def test_mixture_finds_separate_components(spark):
    rows = spark.range(400).select(F.when(F.col("id") % 2 == 0, 10 + F.randn(1)).otherwise(50 + F.randn(2)).alias("tip_amount"))
    parts = TP.mixture_parameters(spark, TP.gaussian_mixture_tips(rows, 2)).collect()
    assert [round(p["mean"]) for p in parts] == [10, 50] and all(abs(p.weight - 0.5) < 0.05 for p in parts)


def series(spark, n=60):
    rows = [(v, z, DAY + dt.timedelta(hours=h), (h * (z + 1) + v) % 9 + 1, 2.0 + v, 10.0 + z, 40.0 + z, -74.0 + v) for v in (0, 1) for z in (1, 2) for h in range(n)]
    df = spark.createDataFrame(rows, "VendorID INT, PULocationID INT, timestamp TIMESTAMP_NTZ, demand INT, avg_distance DOUBLE, avg_amount DOUBLE, Latitude DOUBLE, Longitude DOUBLE")
    from kerbside.functions.time import with_cyclic_calendar

    return with_cyclic_calendar(df)


def test_scenario_changes_only_the_forecast(spark):
    rows = series(spark).withColumn("demand", (F.col("avg_amount") * 3).cast("int"))
    model, feats = FC.lag_regression(rows, "demand", ["avg_amount"])
    out = FC.scenario_forecast(model, feats, {"avg_amount": 99.0})
    assert out.count() == rows.count() and out.where("avg_amount > 50").count() == 0
    assert out.where(F.abs(F.col("scenario") - F.col("prediction")) > 1).count() > 0


def test_partition_scoring_loads_once_per_task(spark):
    def load():
        calls = {"n": 0}

        def predict(batch):
            calls["n"] += 1
            return batch["demand"] * 0.0 + calls["n"]

        return predict

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        scored = ML.score_partitions(series(spark).coalesce(1), load).agg(F.max("prediction")).first()[0]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert scored == 12.0


def test_pipeline_with_scorer_round_trips(spark, tmp_path):
    rows = series(spark)
    base = ML.feature_pipeline("demand").fit(rows).transform(rows)
    width = base.first()["features"].size
    # weight one on the newest demand lag: the prediction is the previous z-score
    weights = [0.0] * width
    weights[-3] = 1.0
    fitted = ML.feature_pipeline("demand", scorer=ML.WeightedSum(inputCol="features", weights=weights)).fit(rows)
    fitted.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model")).transform(rows)
    wrong = again.where(F.abs(F.col("prediction_real") - (F.col("d_t1") * F.col("std") + F.col("mean"))) > 1e-9)
    assert again.count() == rows.count() and wrong.count() == 0


def test_unseen_vendor_is_kept(spark):
    rows = series(spark)
    fitted = ML.feature_pipeline("demand").fit(rows)
    assert fitted.transform(rows.withColumn("VendorID", F.lit(9))).count() == rows.count()


def test_weighted_sum(spark):
    df = spark.createDataFrame([(1.0, 2.0), (0.0, -1.0)], "a DOUBLE, b DOUBLE")
    stage = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="v"), ML.WeightedSum(inputCol="v", weights=[3.0, 4.0], intercept=0.5)])
    assert [r.prediction for r in stage.fit(df).transform(df).collect()] == [11.5, -3.5]


def test_evaluator_agrees_with_the_aggregate(spark):
    df = spark.createDataFrame([(1, 2.0), (4, 2.0), (3, None)], "demand INT, prediction DOUBLE")
    assert ML.evaluate(df, "demand", "prediction") == pytest.approx(1.5)


def steps(spark, n=4000):
    """A label that no line follows, in three parts."""
    x, y = F.col("id") % 40, F.floor(F.col("id") / 40) % 25
    jump = F.when((x > 12) & (y < 10), 9.0).when(x > 30, 2.0).otherwise(4.0)
    part = F.when(F.col("id") % 5 == 0, "test").when(F.col("id") % 5 == 1, "val").otherwise("train")
    return spark.range(n).select("id", x.cast("double").alias("x"), y.cast("double").alias("y"), jump.alias("jump"), part.alias("part"), (F.pmod(F.hash("id"), F.lit(100)) / 100).alias("noise"))


def error_of(df, label, pred):
    return df.agg(F.avg(F.abs(F.col(label) - F.col(pred)))).first()[0]


@pytest.mark.parametrize(
    ("loss", "label", "mean"), [("squared", "jump + noise", "jump + 0.495"), ("tweedie", "if(noise > 0.5, jump, 0.0)", "jump * 0.49")]
)
def test_boosted_trees_beat_the_linear_model(spark, loss, label, mean):
    rows = steps(spark).withColumns({"label": F.expr(label), "held": F.col("part") == "val"})
    model = BO.boost(rows.where("part <> 'test'"), ["x", "y"], "label", "held", loss=loss, rate=0.4, rounds=8)
    tests = rows.where("part = 'test'")
    train = rows.where("part = 'train'")
    line = Pipeline(stages=[VectorAssembler(inputCols=["x", "y"], outputCol="f"), LinearRegression(featuresCol="f", labelCol="label", predictionCol="p")]).fit(train)
    assert 1 <= len(model.trees) <= 20 and min(model.losses) < 0.99 * model.losses[0]
    squared = lambda df, p: df.agg(F.avg((F.expr(mean) - F.col(p)) ** 2)).first()[0]
    assert squared(model.transform(tests), "prediction") < 0.5 * squared(line.transform(tests), "p")
    assert model.transform(tests).columns == [*tests.columns, "prediction"]


def test_boosting_stops_on_the_validation_rows(spark):
    rows = steps(spark).withColumns({"label": F.rand(3), "held": F.col("part") == "val"})
    model = BO.boost(rows, ["x", "y"], "label", "held", rounds=12, patience=2)
    assert len(model.losses) - 1 < 12 and len(model.trees) == model.losses.index(min(model.losses))
    everything = BO.boost(rows.withColumn("held", F.lit(False)), ["x", "y"], "label", "held", rounds=2)
    assert len(everything.trees) == 2


def test_a_logistic_step_is_a_newton_step(spark):
    rows = steps(spark).withColumns({"label": (F.col("jump") > 5).cast("double"), "held": F.lit(False)})
    model = BO.boost(rows, ["x"], "label", "held", loss="logistic", rounds=1, rate=1.0, depth=1)
    p = rows.agg(F.avg("label")).first()[0]
    got = {r.side: (r.m, r.s) for r in model.transform(rows).groupBy((F.col("x") > 12).alias("side")).agg(F.avg("label").alias("m"), F.max("prediction").alias("s")).collect()}
    import math

    for mean, score in got.values():
        step = math.log(p / (1 - p)) + (mean - p) / (p * (1 - p))
        assert score == pytest.approx(1 / (1 + math.exp(-step)), abs=1e-9)


def test_boosting_joins_rows_alike(spark, monkeypatch):
    monkeypatch.setattr(BO, "JOINED", 100)
    rows = steps(spark).withColumns({"label": F.expr("jump + noise"), "held": F.col("part") == "val"})
    for n in (4000, 16_000):  # places are the same, however many rows lie there
        more = steps(spark, n).withColumns({"label": F.expr("jump + noise"), "held": F.lit(False)})
        found = BO.cells(more, ["x", "y"], "label", "held")
        assert found.count() <= 1000 and found.agg(F.sum("_n")).first()[0] == n
    joined = BO.boost(rows, ["x", "y"], "label", "held", rounds=3, rate=0.4, min_rows=30)
    monkeypatch.setattr(BO, "JOINED", 10**9)
    single = BO.boost(rows, ["x", "y"], "label", "held", rounds=3, rate=0.4, min_rows=30)
    assert joined.losses == pytest.approx(single.losses, rel=1e-9)
    assert [t.numNodes for t in joined.trees] == [t.numNodes for t in single.trees]
    both = joined.transform(single.transform(rows, "a"), "b")
    assert both.where(F.abs(F.col("a") - F.col("b")) > 1e-9).count() == 0


def test_ranges_of_many_values(spark, monkeypatch):
    monkeypatch.setattr(BO, "JOINED", 100)
    monkeypatch.setattr(BO, "EXACT", 200)
    monkeypatch.setattr(BO, "FINE", 64)
    rows = spark.range(20_000).select((F.col("id") / 7).alias("x"), (F.col("id") % 3).alias("g"), (F.col("id") > 5000).cast("double").alias("label"), F.lit(False).alias("held"))
    assert BO.cells(rows, ["x", "g"], "label", "held").count() <= 65 * 3
    model = BO.boost(rows, ["x", "g"], "label", "held", rounds=1, rate=1.0, depth=2)
    wrong = model.transform(rows).where(F.abs(F.col("prediction") - F.col("label")) > 0.5).count()
    assert wrong <= 20_000 / 64


def test_mixture_spreads_its_rows(spark, monkeypatch):
    monkeypatch.setattr(TP, "MOST_IN_TASK", 40)
    seen = []
    fit = TP.GaussianMixture._fit
    monkeypatch.setattr(TP.GaussianMixture, "_fit", lambda self, df: seen.append(df.rdd.getNumPartitions()) or fit(self, df))
    rows = spark.range(400).coalesce(1).select(F.when(F.col("id") % 2 == 0, 10 + F.randn(1)).otherwise(50 + F.randn(2)).alias("tip_amount"))
    parts = TP.mixture_parameters(spark, TP.gaussian_mixture_tips(rows, 2)).collect()
    assert seen == [10] and [round(p["mean"]) for p in parts] == [10, 50]


def test_boosted_hurdle_beats_the_linear_one(spark):
    x = F.col("x")
    rows = steps(spark).withColumns({
        "tip_amount": F.when(((x > 12) & (x < 25)) | (F.col("noise") > 0.9), F.col("jump") + F.col("noise")).otherwise(0.0), "fare_amount": F.lit(5.0),
    })
    tests = rows.where("part = 'test'")
    trees = TP.score_hurdle_boosted(TP.tip_hurdle_boosted(rows, ["x", "y"], rounds=6, rate=0.4), tests)
    lines = TP.score_hurdle(TP.tip_hurdle(rows.where("part = 'train'"), ["x", "y"]), tests)
    assert trees.count() == tests.count()
    assert error_of(trees, "tip_amount", "pred_hurdle") < 0.8 * error_of(lines, "tip_amount", "pred_hurdle")


def test_boosted_lags_beat_the_linear_model(spark):
    hours = F.col("id")
    jumpy = spark.range(1500).select(
        F.lit(1).alias("VendorID"), F.lit(2).alias("PULocationID"), (F.lit(str(DAY)).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hours.cast("int"))).alias("timestamp"),
        (F.when(hours % 24 == 8, 60).when(hours % 24 == 17, 35).otherwise(3) + F.hash("id") % 3).cast("int").alias("demand"),
    )
    val, test = (F.lit(str(DAY + dt.timedelta(hours=h))).cast("timestamp_ntz") for h in (1000, 1200))
    trees = FC.lag_boosted(jumpy, val, test)
    model, rows = FC.lag_regression(jumpy.where(F.col("timestamp") < test))
    lines = model.transform(FC.lag_features_for_regression(jumpy)).where(F.col("timestamp") >= test)
    assert trees.count() == 300
    assert error_of(trees, "demand", "prediction") < 0.5 * error_of(lines, "demand", "prediction")
