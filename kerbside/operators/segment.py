"""Volume segments and demand classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from kerbside.functions.maths import map_values
from kerbside.operators.clusters import nearest, optimal_centres
from kerbside.operators.prep import in_period, optional_in
from kerbside.operators.rollup import mean_by_zone_hour, mean_volume
from kerbside.operators.setops import concat_segments

LEVELS = ("LOW", "MID", "HIGH")


def order_clusters(centres: Sequence[float], labels: Sequence[str]) -> dict[int, str]:
    """Cluster number -> label, smallest centre first. centres has one number per cluster."""
    ranked = sorted(range(len(centres)), key=lambda i: centres[i])
    return {cluster: labels[rank] for rank, cluster in enumerate(ranked)}


def _kmeans(df: DataFrame, cols: Sequence[str], k: int, scaled: bool, seed: int):
    stages = [VectorAssembler(inputCols=list(cols), outputCol="_raw")]
    features = "_raw"
    if scaled:
        stages.append(StandardScaler(inputCol="_raw", outputCol="_std", withMean=True, withStd=True))
        features = "_std"
    stages.append(KMeans(k=k, seed=seed, featuresCol=features, predictionCol="_cluster", maxIter=50))
    return Pipeline(stages=stages).fit(df)


def lumpy(adi_above: float = 1.5, cv2_above: float = 0.5, mean_below: float = 0.5) -> Column:
    """Series that are too intermittent and erratic, or too small, to model."""
    return ((F.col("adi") > adi_above) & (F.col("cv2") > cv2_above)) | (F.col("mean_real") < mean_below)


def baseline_rule(features: DataFrame) -> DataFrame:
    """The rule part of the segmentation: BASELINE or NULL."""
    return features.withColumn("segment", F.when(lumpy(), "BASELINE"))


def segment_series(features: DataFrame, seed: int = 42) -> DataFrame:
    """BASELINE for lumpy series, LOW / MID / HIGH clusters by volume for the rest."""
    cols = ["mean_real", "cv", "weekend_ratio"]
    model = _kmeans(features.where(~lumpy()), cols, len(LEVELS), True, seed)
    # scaling keeps the order of the first coordinate
    names = order_clusters([float(c[0]) for c in model.stages[-1].clusterCenters()], LEVELS)
    labelled = model.transform(features).withColumn("segment", map_values("_cluster", names, None))
    return concat_segments(labelled, lumpy()).drop("_raw", "_std", "_cluster")


def segment_by_volume(series: DataFrame, key: str = "Series_ID") -> DataFrame:
    """LOW / MID / HIGH by mean demand: the three clusters with the least squared distances."""
    volume = mean_volume(series, key)
    return volume.withColumn("segment", nearest("mean_demand", optimal_centres(volume, "mean_demand", len(LEVELS)), LEVELS))


def classify_demand(rollup: DataFrame, start, end, hour: int, vendors=None, days: Sequence[int] | None = None) -> DataFrame:
    """low / medium / high demand of each zone at one hour of the day.

    The classes are the three optimal clusters of all zones' hourly means, learnt from all days; the rows to classify come only from the given
    weekdays and get the class of the nearest centre.
    """
    rows = optional_in(in_period(rollup, start, end), "VendorID", vendors)
    centres = optimal_centres(mean_by_zone_hour(rows), "count", 3)
    at = mean_by_zone_hour(rows, days).where(F.col("hour") == hour)
    return at.select("PULocationID", nearest("count", centres, ("low", "medium", "high")).alias("demand_class"))
