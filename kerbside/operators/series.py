"""Windows over hourly series.

Every window is partitioned by series. A series has at most one row per hour of
the covered span, whatever the number of trips, so no partition grows with the
trip volume.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from kerbside.functions.time import elapsed_seconds, interval_seconds, ntz, step
from kerbside.operators.grid import complete_spine

KEYS = ["VendorID", "PULocationID"]
MEASURED = ["demand", "avg_distance", "avg_amount"]


def by_series(keys: Sequence[str] = KEYS, ts: str = "timestamp"):
    return Window.partitionBy(*keys).orderBy(ts)


def moving_average(series: DataFrame, n: int = 5, complete: bool = False, keys=KEYS, value: str = "demand") -> DataFrame:
    """Mean of the previous n rows; complete=True adds the missing hours as zeros first."""
    if complete:
        series = complete_spine(series, keys, "timestamp", "1h").fillna(0, subset=[value])
    return series.withColumn("prediction", F.avg(value).over(by_series(keys).rowsBetween(-n, -1)))


def expanding_norm(series: DataFrame, cols: Sequence[str] = MEASURED, keys=KEYS) -> DataFrame:
    """Mean, deviation (0 and NULL become 1) and z-score of all rows so far."""
    w = by_series(keys).rowsBetween(Window.unboundedPreceding, 0)
    stats = {}
    for c in cols:
        std = F.coalesce(F.stddev_samp(c).over(w), F.lit(0.0))
        stats[f"{c}_mu"] = F.avg(c).over(w)
        stats[f"{c}_sigma"] = F.when(std == 0, F.lit(1.0)).otherwise(std)
    out = series.withColumns(stats)
    return out.withColumns({f"norm_{c}": (F.col(c) - F.col(f"{c}_mu")) / F.col(f"{c}_sigma") for c in cols})


def rolling_norm(series: DataFrame, label: str = "demand", n: int = 5, cols: Sequence[str] = MEASURED, keys=KEYS) -> DataFrame:
    """z-scores against the previous n rows, with the label's mean and deviation."""
    w = by_series(keys).rowsBetween(-n, -1)
    out = {
        "mean": F.coalesce(F.avg(label).over(w), F.lit(0.0)),
        "std": F.coalesce(F.stddev_samp(label).over(w), F.lit(1.0)),
    }
    for c in cols:
        spread = F.coalesce(F.nullif(F.stddev_samp(c).over(w), F.lit(0.0)), F.lit(1.0))
        out[f"{c}_sc"] = F.coalesce((F.col(c) - F.avg(c).over(w)) / spread, F.lit(0.0))
    return series.withColumns(out)


def lag_features(series: DataFrame, n: int = 5, cols: dict[str, str] | None = None, keys=KEYS) -> DataFrame:
    """prefix_t1 ... prefix_tn, zero where the series has no such row."""
    cols = cols or {"demand_sc": "d", "avg_distance_sc": "dist", "avg_amount_sc": "amt"}
    w = by_series(keys)
    return series.withColumns(
        {
            f"{prefix}_t{i}": F.coalesce(F.lag(c, i).over(w).cast("double"), F.lit(0.0))
            for c, prefix in cols.items()
            for i in range(n, 0, -1)
        }
    )


def next_label(series: DataFrame, col: str = "norm_demand", keys=KEYS) -> DataFrame:
    return series.withColumn("label", F.lead(col, 1).over(by_series(keys)))


def sequences(series: DataFrame, features: Sequence[str], n: int = 5, keys=KEYS) -> DataFrame:
    """The last n feature vectors of each row; rows with fewer are dropped."""
    stepped = series.withColumn("feat_step", F.array(*[F.col(c).cast("double") for c in features]))
    w = by_series(keys).rowsBetween(-(n - 1), 0)
    return (
        stepped.withColumn("temporal_sequence", F.collect_list("feat_step").over(w))
        .where(F.size("temporal_sequence") == n)
        .drop("feat_step")
    )


def leakage_audit(sequenced: DataFrame, keys=KEYS) -> DataFrame:
    """Rows whose successor is not later, and rows whose label equals the last step."""
    ahead = sequenced.withColumn("_next", F.lead("timestamp").over(by_series(keys)))
    last = F.element_at(F.element_at("temporal_sequence", -1), 1)
    return ahead.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("_next") <= F.col("timestamp")).alias("time_errors"),
        F.count_if(F.col("label") == last).alias("label_matches"),
    ).withColumn("match_share", F.try_divide("label_matches", "rows"))


def first_per_zone(trips: DataFrame, order: Sequence[str], zone: Sequence[str] = ("PULocationID",)) -> DataFrame:
    """The earliest trip of every zone; equal times are decided by the further order columns.

    A minimum of the ordered struct instead of a ranking: it is reduced on the
    map side, so a zone with a third of all trips costs no more than others.
    """
    rest = [c for c in trips.columns if c not in zone and c not in order]
    row = F.struct(*order, *rest)
    return trips.groupBy(*zone).agg(F.min(row).alias("_r")).select(*zone, "_r.*").select(*trips.columns)


def last_n_per_series(series: DataFrame, n: int = 72, keys=KEYS, ts: str = "timestamp") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(ts))
    return series.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def lag_backtest(series: DataFrame, lag: int = 24, context: int = 72, keys=KEYS, value: str = "demand") -> DataFrame:
    """Daily MAE of repeating the value of ``lag`` hours ago on the completed series.

    Whole blocks of ``lag`` hours after the first ``context`` hours count.
    """
    full = complete_spine(series.select(*keys, "timestamp", value), keys, "timestamp", "1h").fillna(0, subset=[value])
    w = by_series(keys)
    pos = full.withColumns(
        {
            "_err": F.abs(F.col(value) - F.lag(value, lag).over(w)),
            "_pos": F.row_number().over(w) - 1 - context,
        }
    )
    blocks = pos.where(F.col("_pos") >= 0).groupBy(*keys, F.floor(F.col("_pos") / lag).cast("int").alias("block"))
    return blocks.agg(F.avg("_err").alias("mae"), F.count("*").alias("_n")).where(F.col("_n") == lag).drop("_n")


def shifted_rolling_mean(series: DataFrame, n: int = 2, keys=KEYS, value: str = "demand") -> DataFrame:
    return series.withColumn("prediction", F.avg(value).over(by_series(keys).rowsBetween(-n, -1)))


def forward_fill(df: DataFrame, cols: Sequence[str], keys=KEYS, ts: str = "timestamp", default=0) -> DataFrame:
    """Last known value so far, then the default."""
    w = by_series(keys, ts).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns(
        {
            c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(default)) if default is not None else F.last(c, ignorenulls=True).over(w)
            for c in cols
        }
    )


def fill_static(df: DataFrame, cols: Sequence[str], keys=KEYS) -> DataFrame:
    """Spread a series' constant over its rows."""
    w = Window.partitionBy(*keys)
    return df.withColumns({c: F.max(c).over(w) for c in cols})


def interpolate_linear(df: DataFrame, value: str, keys: Sequence[str], ts: str) -> DataFrame:
    """Linear between known neighbours by position; edges take the nearest known value.

    The next known value is the last one so far in reverse order: a frame that
    reaches forward to the end would be evaluated anew for every row.
    """
    group = Window.partitionBy(*keys)
    w = group.orderBy(ts)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = group.orderBy(F.desc(ts)).rowsBetween(Window.unboundedPreceding, 0)
    known = df.withColumn("_p", F.row_number().over(w)).withColumn("_kp", F.when(F.col(value).isNotNull(), F.col("_p")))
    known = known.withColumns(
        {
            "_v0": F.last(value, ignorenulls=True).over(back),
            "_p0": F.last("_kp", ignorenulls=True).over(back),
            "_v1": F.last(value, ignorenulls=True).over(ahead),
            "_p1": F.last("_kp", ignorenulls=True).over(ahead),
        }
    )
    between = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * F.try_divide(
        F.col("_p") - F.col("_p0"), F.col("_p1") - F.col("_p0")
    )
    filled = F.coalesce(F.col(value), between, F.col("_v0"), F.col("_v1"))
    return known.withColumn(value, filled).drop("_p", "_kp", "_v0", "_p0", "_v1", "_p1")


def split_at_fraction(series: DataFrame, share: float = 0.8, min_rows: int = 300, keys=KEYS) -> DataFrame:
    """Marks the first share of each series' rows as training; short series are dropped."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return (
        series.withColumns({"_n": n, "_rn": F.row_number().over(by_series(keys))})
        .where(F.col("_n") >= min_rows)
        .withColumn("is_train", F.col("_rn") <= F.floor(F.col("_n") * share))
        .drop("_n", "_rn")
    )


def split_at_date(series: DataFrame, cut, context: int = 72, horizon: int = 168, min_after: int = 24, keys=KEYS, ts: str = "timestamp") -> DataFrame:
    """Training rows before the cut; validation = last context rows + horizon rows after it.

    Series with too few rows on either side, or ending within a day of the cut,
    are dropped. Context rows are in both parts.
    """
    cut = ntz(cut)
    group = Window.partitionBy(*keys)
    counted = series.withColumns(
        {
            "_before": F.count_if(F.col(ts) < cut).over(group),
            "_after": F.count_if(F.col(ts) >= cut).over(group),
            "_end": F.max(ts).over(group),
            "_rn": F.row_number().over(by_series(keys, ts)),
        }
    )
    kept = counted.where(
        (F.col("_before") >= context) & (F.col("_after") >= min_after) & (F.col("_end") >= cut + step(86_400))
    )
    return kept.withColumns(
        {
            "in_train": F.col(ts) < cut,
            "in_val": (F.col("_rn") > F.col("_before") - context) & (F.col("_rn") <= F.col("_before") + horizon),
        }
    ).drop("_before", "_after", "_end", "_rn")


def supervised_windows(series: DataFrame, past: int = 72, horizon: int = 24, stride: int = 24, keys=KEYS, value: str = "demand", ts: str = "timestamp") -> DataFrame:
    """(past vector, future vector) at every stride-th anchor with full context."""
    w = by_series(keys, ts)
    at = series.select(
        *keys,
        ts,
        (F.row_number().over(w) - 1).alias("_pos"),
        F.collect_list(value).over(w.rowsBetween(-past, -1)).alias("past"),
        F.collect_list(value).over(w.rowsBetween(0, horizon - 1)).alias("future"),
    )
    full = (F.size("past") == past) & (F.size("future") == horizon)
    return at.where(full & ((F.col("_pos") - past) % stride == 0)).drop("_pos")


def time_index(df: DataFrame, freq: str, ts: str = "timestamp") -> DataFrame:
    """Whole steps since the first instant of the table."""
    first = df.agg(F.min(ts)).scalar()
    return df.withColumn("time_idx", F.floor(elapsed_seconds(first, ts) / interval_seconds(freq)).cast("int"))


def scale_per_series(df: DataFrame, col: str, kind: str = "minmax", fit_on: Column | None = None, keys=KEYS, name: str | None = None) -> DataFrame:
    """Scale by statistics of the series' fitting rows; adds centre and spread columns."""
    w = Window.partitionBy(*keys)
    x = F.col(col) if fit_on is None else F.when(fit_on, F.col(col))
    if kind == "minmax":
        centre, spread = F.min(x).over(w), F.max(x).over(w) - F.min(x).over(w)
    elif kind == "robust":
        q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(w)
        centre, spread = q[1], q[2] - q[0]
    else:
        raise ValueError(kind)
    name = name or f"{col}_scaled"
    out = df.withColumns({f"{name}_centre": centre.cast("double"), f"{name}_spread": spread.cast("double")})
    safe = F.when(F.col(f"{name}_spread") == 0, 1.0).otherwise(F.col(f"{name}_spread"))
    return out.withColumn(f"{name}_spread", safe).withColumn(
        name, (F.col(col) - F.col(f"{name}_centre")) / F.col(f"{name}_spread")
    )


def unscale(df: DataFrame, name: str, out: str) -> DataFrame:
    """Inverse of scale_per_series."""
    return df.withColumn(out, F.col(name) * F.col(f"{name}_spread") + F.col(f"{name}_centre"))


def last_hours(series: DataFrame, hours: int = 72, ts: str = "timestamp") -> DataFrame:
    """Rows of the given number of hours ending at the newest row of the table."""
    newest = series.agg(F.max(ts)).scalar()
    return series.where(F.col(ts) >= newest - step((hours - 1) * 3600))


def continuity_check(a: DataFrame, b: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Does b start one hour after a ends? One row with the gap in days."""
    ends = a.agg(F.max(ts).alias("last_a"))
    return ends.withColumn("first_b", b.agg(F.min(ts)).scalar()).select(
        "last_a",
        "first_b",
        (F.col("last_a") + step(3600) == F.col("first_b")).alias("contiguous"),
        F.floor(elapsed_seconds("last_a", "first_b") / 86_400).cast("int").alias("gap_days"),
    )


def daily_ffill(df: DataFrame, date: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row per day, the last value carried over missing days.

    Several points of one day become one with the largest value; rows without a date are left out.
    """
    points = df.where(F.col(date).isNotNull())
    days = (points.repartition(*keys) if keys else points).groupBy(*keys, date).agg(F.max(value).alias(value))
    after = F.lead(date).over(Window.partitionBy(*keys).orderBy(date))
    held = days.withColumn("_last", F.coalesce(F.date_sub(after, 1), F.col(date)))
    filled = held.withColumn("_day", F.explode(F.sequence(F.col(date), F.col("_last"), F.expr("INTERVAL 1 DAY"))))
    return filled.select(*keys, F.col("_day").alias(date), value)
