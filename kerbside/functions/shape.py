"""Reshaping: melt, encode, nest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from kerbside.scratch import cut_lineage


def months_to_long(df: DataFrame, ids: Sequence[str], months: Sequence[str] | None = None) -> DataFrame:
    """One column per 'YYYY-MM' -> rows (ids, Date, AskingRent)."""
    months = months or [c for c in df.columns if "-" in c]
    long = df.unpivot(list(ids), [F.col(f"`{m}`") for m in months], "month", "AskingRent")
    return long.select(*ids, F.to_date(F.concat("month", F.lit("-01"))).alias("Date"), "AskingRent")


def one_hot(df: DataFrame, col: str, values: Sequence, drop_first: bool = False) -> DataFrame:
    """0/1 columns for the listed values; other values are all zero."""
    kept = list(values)[1:] if drop_first else list(values)
    return df.withColumns({f"{col}_{v}": F.coalesce(F.col(col) == v, F.lit(False)).cast("double") for v in kept})


def minmax_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Scale columns to [0, 1] over the whole table; flat columns become 0.

    The ends of all columns come from one aggregate.
    """
    ends = df.agg(F.struct(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(cols) for n, f in (("low", F.min), ("high", F.max))])).scalar()
    out = {}
    for i, c in enumerate(cols):
        low, high = F.col("_ends")[f"low_{i}"], F.col("_ends")[f"high_{i}"]
        out[c] = F.when(high == low, F.lit(0.0)).otherwise(F.try_divide(F.col(c) - low, high - low))
    return df.withColumn("_ends", ends).withColumns(out).drop("_ends")


def label_codes(df: DataFrame, col: str, name: str) -> DataFrame:
    """0-based codes of the distinct values in ascending order; NULL has none.

    The distinct values are dealt out by range and sorted in their tasks, and each task's
    codes start after the values of the tasks before it. They are checkpointed in that order.
    """
    labels = df.select(col).where(F.col(col).isNotNull()).distinct().repartitionByRange(col).sortWithinPartitions(col)
    numbered = cut_lineage(labels.withColumn("_at", F.monotonically_increasing_id())).withColumn("_task", F.shiftright("_at", 33))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = numbered.groupBy("_task").agg(F.count("*").alias("_n"))  # a row for each task
    bases = tasks.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    code = F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    codes = numbered.join(bases, "_task").select(col, code.cast("int").alias(name))
    return df.join(codes, col, "left")


def encode_static(df: DataFrame, vendor: str, vendors: Sequence, coords: Sequence[str]) -> DataFrame:
    """Static covariates of a series: drop-first vendor columns and scaled coordinates."""
    return minmax_columns(one_hot(df, vendor, vendors, drop_first=True), coords)


def nest_by_time_zone(df: DataFrame, bucket: str, zone: str, variables: Sequence[str]) -> DataFrame:
    """One row per (variable, bucket) with a zone -> value map.

    A map never has more entries than there are zones.
    """
    long = df.unpivot([bucket, zone], [F.col(v).cast("double").alias(v) for v in variables], "variable", "value")
    entries = F.sort_array(F.collect_list(F.struct(F.col(zone).alias("k"), F.col("value").alias("v"))))
    return long.groupBy("variable", bucket).agg(F.map_from_entries(entries).alias("zones"))


def ablation_columns(columns: Sequence[str], mode: str) -> list[str]:
    """Feature subset for an ablation mode."""
    coords = {c for c in columns if c.endswith(("_latitude", "_longitude"))}
    dists = {c for c in columns if "_dist_" in c}
    dropped = {"all": set(), "drop_coords": coords, "drop_dists": dists, "drop_all": coords | dists}[mode]
    return [c for c in columns if c not in dropped]


