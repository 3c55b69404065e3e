"""Session settings the plans were tuned with. All are runtime settings."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # re-plan with measured sizes: broadcast small sides, split skewed partitions, merge tiny ones
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # generated methods above 8000 bytes are never compiled by the JVM; wide feature
    # projections run faster as separate, smaller pieces
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
