"""Quantiles of any period from stored sketches, and density curves from fine bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Values a sketch keeps on its lowest levels; a rank is off by about 0.1 % of the rows.
SKETCH = 4000


def quantile_state(df: DataFrame, by: Sequence[str], cols: Sequence[str], size: int = SKETCH) -> DataFrame:
    """A mergeable state of each group: for every column a quantile sketch, the number of values, the least and the largest.

    Missing values and NaN don't count. The rows are what a month's load adds to a table of states.
    """
    out: list[Column] = []
    for c in cols:
        x = F.col(c).cast("double")
        x = F.when(~F.isnan(x), x)
        out += [F.kll_sketch_agg_double(x, size).alias(f"{c}_sketch"), F.count(x).alias(f"{c}_n"), F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max")]
    return df.groupBy(*by).agg(*out)


def merge_state(state: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """The states of coarser groups, or of everything, from finer ones; no other data is read."""
    out: list[Column] = []
    for c in cols:
        out += [
            F.kll_merge_agg_double(F.when(F.col(f"{c}_n") > 0, F.col(f"{c}_sketch"))).alias(f"{c}_sketch"),
            F.sum(f"{c}_n").alias(f"{c}_n"), F.min(f"{c}_min").alias(f"{c}_min"), F.max(f"{c}_max").alias(f"{c}_max"),
        ]
    return state.groupBy(*by).agg(*out)


def state_quantile(col: str, p: float) -> Column:
    """Approximate quantile of a column of a state; null without values."""
    return F.when(F.col(f"{col}_n") > 0, F.kll_sketch_get_quantile_double(F.col(f"{col}_sketch"), F.lit(float(p))))


def sketched_box_stats(state: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers and extremes of the merged states, one row per group and column.

    Extremes and counts are exact, quartiles are off by the sketch's rank error. A column without values has none.
    """
    merged = merge_state(state, by, cols)
    packed = [
        F.struct(
            F.lit(c).alias("label"), F.col(f"{c}_n").alias("n"), *[state_quantile(c, p).alias(q) for q, p in (("q1", 0.25), ("med", 0.5), ("q3", 0.75))],
            F.col(f"{c}_min").alias("min"), F.col(f"{c}_max").alias("max"),
        )
        for c in cols
    ]
    rows = merged.select(*by, F.explode(F.array(*packed)).alias("s")).select(*by, "s.*")
    iqr = F.col("q3") - F.col("q1")
    return rows.select(
        *by, "label", "n", "q1", "med", "q3", F.greatest("min", F.col("q1") - 1.5 * iqr).alias("whislo"),
        F.least("max", F.col("q3") + 1.5 * iqr).alias("whishi"), "min", "max",
    )


def density_curve(df: DataFrame, by: Sequence[str], col: str, points: int = 200, reach: float = 3.0) -> DataFrame:
    """Gaussian kernel density of each group at equally spaced points: (by, x, density).

    A group's bandwidth is its deviation times n to the power -1/5, its points go ``reach`` bandwidths beyond its values. Values are
    counted at their nearest point, so the rows are aggregated to at most ``points`` a group, and the kernel runs over these. Missing and
    not finite values don't count; groups whose values don't differ have no curve. Each group's curve has area one.
    """
    x = F.col(col).cast("double")
    fine = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).select(*by, x.alias("_x"))
    ends = fine.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_x").alias("_a"), F.max("_x").alias("_b"), F.stddev_samp("_x").alias("_s")).where("_s > 0")
    width = F.col("_s") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    grid = ends.withColumn("_h", width).withColumns({"_low": F.col("_a") - reach * F.col("_h"), "_step": (F.col("_b") - F.col("_a") + 2 * reach * F.col("_h")) / (points - 1)})
    frame = grid.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], "_n", "_h", "_low", "_step")
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    place = F.floor((F.col("_x") - F.col("_low")) / F.col("_step") + 0.5).cast("int")
    counted = fine.join(frame, same).groupBy(*by, "_n", "_h", "_low", "_step", place.alias("_i")).agg(F.count("*").alias("_w"))
    packed = counted.groupBy(*by, "_n", "_h", "_low", "_step").agg(F.array_sort(F.collect_list(F.struct("_i", "_w"))).alias("_bins"))  # at most ``points``
    at = packed.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))

    def kernel(total: Column, b: Column) -> Column:
        z = (F.col("_j") - b["_i"]) * F.col("_step") / F.col("_h")
        return total + b["_w"] * F.exp(-z * z / 2)

    raw = at.withColumn("_d", F.aggregate("_bins", F.lit(0.0), kernel))
    area = F.sum("_d").over(Window.partitionBy(*by)) * F.col("_step")
    return raw.select(*by, (F.col("_low") + F.col("_j") * F.col("_step")).alias("x"), (F.col("_d") / area).alias("density"))
