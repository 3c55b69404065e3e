"""Where intermediate and written tables go."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_used: set[str] = set()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share.

    It lies below the folder ``spark.checkpoint.dir`` names; where that is unset,
    below the warehouse, which is shared as well. The folders of a session go when
    the program ends.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.conf.get("spark.sql.warehouse.dir")
    own = f"{root.rstrip('/')}/kerbside-{spark.sparkContext.applicationId}"
    if own not in _used:
        _used.add(own)
        atexit.register(_remove, spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder, if its session still runs."""
    if spark.sparkContext._jsc is None:
        return
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and continue from there."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_dir(spark, "checkpoint"))
    return df.checkpoint()
