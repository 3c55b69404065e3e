"""Time spines and zero-filled grids.

Missing rows come from exploding a time sequence, never from a product join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from kerbside.functions.time import elapsed_seconds, interval_seconds, ntz, step


def zone_time_grid(ids: DataFrame, start, end, interval: str, zone: str = "PULocationID", bucket: str = "time_bucket") -> DataFrame:
    """Every zone with every bucket from start to end.

    start and end may be literals or (scalar sub-query) columns.
    """
    spine = F.sequence(ntz(start), ntz(end), step(interval_seconds(interval)))
    # one row per zone fans out to the whole period: spread the zones first
    return ids.select(zone).repartition(zone).select(zone, F.explode(spine).alias(bucket))


def fill_grid(grid: DataFrame, agg: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Aggregates on the grid, zero where there are none."""
    values = [c for c in agg.columns if c not in keys]
    return grid.join(agg, list(keys), "left").fillna(0, subset=values)


def observed_grid(
    ids: DataFrame, agg: DataFrame, start, end, interval: str, zone: str = "PULocationID", bucket: str = "time_bucket"
) -> DataFrame:
    """Grid of the zones and those buckets that have any row in agg, zero-filled.

    The buckets that occur are recognised after the join, by bucket, so agg is
    computed once. A bucket holds one row per zone, however many trips there are.
    """
    values = [c for c in agg.columns if c not in (zone, bucket)]
    grid = zone_time_grid(ids, start, end, interval, zone, bucket).withColumn("_grid", F.lit(True))
    both = grid.join(agg.withColumn("_seen", F.lit(True)), [zone, bucket], "full")
    seen = F.max("_seen").over(Window.partitionBy(bucket))
    return (
        both.withColumn("_any", seen)
        .where(F.col("_any") & F.col("_grid"))
        .select(zone, bucket, *values)
        .fillna(0, subset=values)
    )


def all_zones(ids: DataFrame, agg: DataFrame, zone: str = "PULocationID") -> DataFrame:
    """One row per zone, zero where there is no aggregate."""
    return fill_grid(ids.select(zone), agg, [zone])


def complete_spine(
    series: DataFrame,
    keys: Sequence[str],
    ts: str,
    freq: str,
    scope: str = "series",
    start: Column | None = None,
    end: Column | None = None,
) -> DataFrame:
    """One row per instant of every series; instants without a row have NULL values.

    Each row is extended up to its successor, so the only shuffle is the one by
    series, which later windows over the same keys reuse. scope='series' spans
    every series' own range; 'global' spans the whole table's (or start..end).

    Instants count in steps of freq from the series' first row; a global spine's
    from start, or from the table's first row. A row between two steps belongs to
    the step before it. Rows of a series at one instant become one: per value the
    largest, NULLs aside. Rows without an instant, or outside start..end, are left out.
    """
    seconds = interval_seconds(freq)
    every = step(seconds)
    values = [c for c in series.columns if c not in (*keys, ts)]
    dealt = series.where(F.col(ts).isNotNull()).repartition(*keys)
    if scope == "global":
        low = start if start is not None else series.agg(F.min(ts)).scalar()
        high = end if end is not None else series.agg(F.max(ts)).scalar()
        placed = dealt.withColumns({"_from": low, "_to": high}).where(F.col(ts).between(F.col("_from"), F.col("_to")))
    elif scope == "series":
        own = Window.partitionBy(*keys)
        placed = dealt.withColumns({"_from": F.min(ts).over(own), "_to": F.max(ts).over(own)})
    else:
        raise ValueError(scope)
    passed = F.floor(elapsed_seconds("_from", ts) / seconds) * seconds
    at = F.col("_from") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), passed.cast("decimal(18,6)"))
    # dealt out by series already: neither the reduction nor the window shuffles
    rows = placed.withColumn("_at", at).groupBy(*keys, "_at").agg(
        F.min("_from").alias("_from"), F.max("_to").alias("_to"), *[F.max(v).alias(v) for v in values]
    )
    w = Window.partitionBy(*keys).orderBy("_at")
    first, last = F.col("_at"), F.coalesce(F.lead("_at").over(w) - every, F.col("_at"))
    if scope == "global":
        first = F.when(F.lag("_at").over(w).isNull(), F.col("_from")).otherwise(first)
        last = F.coalesce(F.lead("_at").over(w) - every, F.col("_to"))
    spans = rows.withColumns({"_first": first, "_last": last}).withColumn(ts, F.explode(F.sequence("_first", "_last", every)))
    return spans.select(*keys, ts, *[F.when(F.col(ts) == F.col("_at"), F.col(v)).alias(v) for v in values])
