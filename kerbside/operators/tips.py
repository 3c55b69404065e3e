"""Tip features, historical tip baselines and tip models."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame, functions as F

from kerbside.functions.maths import bearing_deg, landmark_distances, manhattan_m, temp_discomfort
from kerbside.functions.time import fractional_hour, iso_weekday, ntz
from kerbside.operators.boosting import Boosted, assembled, boost, boosted_gate
from kerbside.operators.lookup import with_daily_sun, with_fallback, with_hourly_climate, with_od_centroids
from kerbside.operators.prep import has_tip, tipped
from kerbside.operators.regression import Mixture, mixture_regression
from kerbside.scratch import cut_lineage

MOST_IN_TASK = 500_000  # rows that a task of an iterated fit keeps: some 100 bytes for each
ROUTE = ["PULocationID", "DOLocationID", "VendorID"]


def tip_features(trips: DataFrame, centroids: DataFrame, climate: DataFrame, sun: DataFrame) -> DataFrame:
    """Geometry, landmark, weather, daylight and calendar features of each trip."""
    ends = ("pickup_longitude", "pickup_latitude", "dropoff_longitude", "dropoff_latitude")
    df = with_od_centroids(trips, centroids).withColumns(
        {"distance": manhattan_m(*ends), "direction": bearing_deg(*ends)}
    )
    df = with_hourly_climate(landmark_distances(df), climate)
    df = with_daily_sun(df.withColumn("temp_discomfort", temp_discomfort("temperature_2m")), sun)
    ts = "pickup_datetime"
    return df.withColumns(
        {
            "month": F.month(ts),
            "dayofyear": F.dayofyear(ts),
            "weekday": iso_weekday(ts),
            "hour": fractional_hour(ts),
        }
    )


def temporal_split(df: DataFrame, val_date, test_date, ts: str = "pickup_datetime") -> DataFrame:
    """Adds 'train', 'val' or 'test' by pickup time; filter on it to get the parts."""
    return df.withColumn(
        "part",
        F.when(F.col(ts) < ntz(val_date), "train").when(F.col(ts) < ntz(test_date), "val").otherwise("test"),
    )


def tip_probability(train: DataFrame) -> DataFrame:
    return has_tip(train).groupBy("VendorID").agg(F.avg("has_tip").alias("base_prob"))


def route_tip_mean(train: DataFrame) -> DataFrame:
    """Mean tip by route and vendor among tipped trips."""
    return tipped(train).groupBy(*ROUTE).agg(F.avg("tip_amount").alias("base_amount"))


def vendor_tip_mean(train: DataFrame) -> DataFrame:
    return tipped(train).groupBy("VendorID").agg(F.avg("tip_amount").alias("fallback_amount"))


def tip_baseline(train: DataFrame, test: DataFrame) -> DataFrame:
    """Expected tip of the test trips: P(tip) by vendor x mean tip by route, else by vendor.

    The training trips are read once: counts and sums by route give the vendor
    figures as well.
    """
    paid = (F.col("tip_amount") > 0) & (F.col("fare_amount") > 0)
    routes = train.groupBy(*ROUTE).agg(
        F.count("tip_amount").alias("_n"),
        F.count_if(F.col("tip_amount") > 0).alias("_tipped"),
        F.count_if(paid).alias("_paid"),
        F.sum(F.when(paid, F.col("tip_amount"))).alias("_sum"),
    )
    vendors = routes.groupBy("VendorID").agg(
        F.try_divide(F.sum("_tipped"), F.sum("_n")).alias("base_prob"),
        F.try_divide(F.sum("_sum"), F.sum("_paid")).alias("fallback_amount"),
    )
    amounts = routes.select(*ROUTE, F.try_divide("_sum", "_paid").alias("base_amount"))
    scored = with_fallback(test, amounts, vendors, ROUTE, ["VendorID"], "base_amount", "fallback_amount")
    return scored.withColumn("pred_baseline", F.col("base_prob") * F.col("base_amount"))


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")


def _training_rows(train: DataFrame, features: Sequence[str], *labels: str) -> DataFrame:
    """Assembled rows in the shared folder, as narrow as the fit needs: its passes read these instead of the trips."""
    return cut_lineage(_assembler(features).transform(train).select("features", *labels))


def _tweedie(rows: DataFrame, power: float, label: str):
    return GeneralizedLinearRegression(
        family="tweedie", variancePower=power, linkPower=0.0, labelCol=label,
        featuresCol="features", predictionCol="pred_tweedie", maxIter=50, tol=1e-10,
    ).fit(rows)


def tip_tweedie(train: DataFrame, features: Sequence[str], power: float = 1.55, label: str = "tip_amount"):
    """Tweedie regression with log link, a fitted pipeline with output ``pred_tweedie``."""
    return PipelineModel([_assembler(features), _tweedie(_training_rows(train, features, label), power, label)])


def tip_hurdle(train: DataFrame, features: Sequence[str]):
    """Two fitted parts: P(tip > 0), and the amount among tipped trips. The training trips are read once."""
    rows = _training_rows(has_tip(train), features, "has_tip", "tip_amount", "fare_amount")
    gate = GeneralizedLinearRegression(
        family="binomial", labelCol="has_tip", featuresCol="features", predictionCol="p_tip", maxIter=50, tol=1e-10,
    ).fit(rows)
    assembler = _assembler(features)
    return PipelineModel([assembler, gate]), PipelineModel([assembler, _tweedie(tipped(rows), 1.55, "tip_amount")])


def score_hurdle(models, df: DataFrame) -> DataFrame:
    """p_tip, the amount given a tip, and their product."""
    gate, amount = models
    df = amount.transform(gate.transform(df).drop("features"))
    df = df.withColumnRenamed("pred_tweedie", "amount_given_tip").drop("features")
    return df.withColumn("pred_hurdle", F.col("p_tip") * F.col("amount_given_tip"))


def tip_tweedie_boosted(rows: DataFrame, features: Sequence[str], **options) -> Boosted:
    """Boosted trees under the Tweedie loss for the rows whose ``part`` is train, stopped on those of val."""
    parts = rows.where(F.col("part").isin("train", "val")).withColumn("_val", F.col("part") == "val")
    return boost(parts, features, "tip_amount", "_val", loss="tweedie", **options)


def tip_hurdle_boosted(rows: DataFrame, features: Sequence[str], **options):
    """Boosted trees for P(tip > 0) and, under the Tweedie loss, for the amount among tipped trips.

    Both are fitted on the rows whose ``part`` is train and stopped on those of val.
    """
    parts = has_tip(rows.where(F.col("part").isin("train", "val"))).withColumn("_val", F.col("part") == "val")
    gate = boosted_gate(parts, features, "has_tip", "_val")
    return gate, boost(tipped(parts), features, "tip_amount", "_val", loss="tweedie", **options)


def score_hurdle_boosted(models, df: DataFrame) -> DataFrame:
    """p_tip, the amount given a tip, and their product."""
    gate, amount = models
    scored = gate.transform(assembled(df, amount.features))
    scored = scored.select(*df.columns, vector_to_array("_probability")[1].alias("p_tip"))
    return amount.transform(scored, "amount_given_tip").withColumn("pred_hurdle", F.col("p_tip") * F.col("amount_given_tip"))


def mixed_prediction(scored: DataFrame) -> DataFrame:
    """Historical probability x modelled amount."""
    return scored.withColumn("pred_mixed", F.col("base_prob") * F.col("amount_given_tip"))


def gaussian_mixture_tips(df: DataFrame, k: int = 3, col: str = "tip_amount", seed: int = 42, max_iter: int = 50):
    """Mixture density of the tip; a fitted pipeline with output ``component``."""
    rows = cut_lineage(df.select(col))  # the trips are read once; every pass of the fit reads these
    tasks = math.ceil(rows.count() / MOST_IN_TASK)
    if tasks > rows.rdd.getNumPartitions():
        rows = rows.repartition(tasks)
    gmm = GaussianMixture(
        k=k, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="component", probabilityCol="component_p"
    )
    return Pipeline(stages=[_assembler([col]), gmm]).fit(rows)


def conditional_tip_mixture(train: DataFrame, features: Sequence[str], k: int = 3, rounds: int = 40) -> Mixture:
    """Density of the tip given the trip: a mixture of regressions over the tipped trips."""
    return mixture_regression(tipped(train), features, "tip_amount", k, rounds)


def mixture_parameters(spark, model) -> DataFrame:
    """Weight, mean and deviation of the k components, ordered by mean."""
    gmm = model.stages[-1]
    parts = sorted(
        (float(g.mean[0]), float(w), float(g.cov.toArray()[0][0]) ** 0.5) for w, g in zip(gmm.weights, gmm.gaussians)
    )
    rows = [(i, w, m, s) for i, (m, w, s) in enumerate(parts)]
    return spark.createDataFrame(rows, "component INT, weight DOUBLE, mean DOUBLE, std DOUBLE")
