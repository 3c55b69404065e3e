"""spark.ml surface: feature pipeline, partition scoring, custom stage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Pipeline, Transformer
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from kerbside.operators.series import lag_features, rolling_norm

LAG_PREFIXES = ("d", "dist", "amt")
CALENDAR = ["hour_sin", "hour_cos", "dow_sin", "dow_cos"]


def score_partitions(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.Series]], output: str = "prediction") -> DataFrame:
    """Score Arrow batches with a model that is loaded once per task.

    load() runs in the task and returns a function from a batch to its predictions.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for batch in batches:
            yield batch.assign(**{output: predict(batch)})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{output}` double"])
    return df.mapInPandas(run, schema)


class WeightedSum(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage: intercept + weights . vector, evaluated as a Spark expression."""

    weights = Param(Params._dummy(), "weights", "one weight per vector entry", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "constant term", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, inputCol=None, outputCol="prediction", weights=None, intercept=0.0):
        super().__init__()
        self._setDefault(outputCol="prediction", intercept=0.0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        w = F.array(*[F.lit(v) for v in self.getOrDefault(self.weights)])
        products = F.zip_with(vector_to_array(self.getInputCol()), w, lambda a, b: a * b)
        total = F.aggregate(products, F.lit(float(self.getOrDefault(self.intercept))), lambda s, v: s + v)
        return df.withColumn(self.getOutputCol(), total)


class SeriesHistory(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage: the z-scores and lags of ``series.rolling_norm`` and ``series.lag_features``."""

    label = Param(Params._dummy(), "label", "column whose rolling mean and deviation are kept", TypeConverters.toString)
    rows = Param(Params._dummy(), "rows", "number of earlier rows", TypeConverters.toInt)

    @keyword_only
    def __init__(self, label="demand", rows=5):
        super().__init__()
        self._setDefault(label="demand", rows=5)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        n = self.getOrDefault(self.rows)
        return lag_features(rolling_norm(df, self.getOrDefault(self.label), n), n)


# back to the label's scale, as a stage
DENORMALISE = "SELECT t.*, t.mean + t.std * t.prediction AS prediction_real FROM __THIS__ AS t"


def feature_pipeline(label: str, n: int = 5, scorer: Transformer | None = None) -> Pipeline:
    """One vector ``features``: vendor flags, standardised place, calendar, lags.

    With a scorer (a stage from ``features`` to ``prediction``) the prediction is
    also brought back to the label's scale.
    """
    history = [f"{prefix}_t{i}" for i in range(n, 0, -1) for prefix in LAG_PREFIXES]
    parts = {"vendor_flags": ["vendor_code"], "place_z": ["place"]}
    stages = [
        VectorAssembler(inputCols=["Latitude", "Longitude"], outputCol=parts["place_z"][0]),
        StandardScaler(inputCol=parts["place_z"][0], outputCol="place_z", withMean=True),
        StringIndexer(inputCol="VendorID", outputCol=parts["vendor_flags"][0], handleInvalid="keep"),
        OneHotEncoder(inputCols=parts["vendor_flags"], outputCols=["vendor_flags"]),
        SeriesHistory(label=label, rows=n),
        VectorAssembler(inputCols=[*parts, *CALENDAR, *history], outputCol="features"),
    ]
    tail = [] if scorer is None else [scorer, SQLTransformer(statement=DENORMALISE)]
    return Pipeline(stages=stages + tail)


def encode_vendor(df: DataFrame, col: str = "VendorID") -> DataFrame:
    """Full one-hot array of the vendor (most frequent vendor first)."""
    stages = [
        StringIndexer(inputCol=col, outputCol="_index"),
        OneHotEncoder(inputCol="_index", outputCol="_vector", dropLast=False),
    ]
    out = Pipeline(stages=stages).fit(df).transform(df)
    return out.withColumn("vendor_array", vector_to_array("_vector")).drop("_index", "_vector")


def evaluate(df: DataFrame, label: str, prediction: str, metric: str = "mae") -> float:
    rows = df.select(F.col(label).cast("double").alias(label), F.col(prediction).cast("double").alias(prediction)).dropna()
    return RegressionEvaluator(labelCol=label, predictionCol=prediction, metricName=metric).evaluate(rows)


