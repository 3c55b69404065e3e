"""Unions, merges and samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from kerbside.functions.maths import map_values
from kerbside.functions.time import ntz
from kerbside.operators.prep import city_trips
from kerbside.operators.series import continuity_check, first_per_zone
from kerbside.scratch import cut_lineage


def merge_months(frames: Sequence[DataFrame], schema=None) -> DataFrame:
    """Stack tables by column name, absent columns become NULL.

    With a schema every table is first cast to it, for months whose types differ.
    """
    if schema is not None:
        from kerbside.schemas import conform

        frames = [conform(f, schema) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def append_checked(a: DataFrame, b: DataFrame, ts: str = "timestamp") -> DataFrame:
    """a followed by b; fails at run time unless b starts one hour after a ends."""
    ok = continuity_check(a, b, ts).select("contiguous").scalar()
    checked = b.where(F.assert_true(ok, F.lit("the second table does not continue the first")).isNull())
    return a.unionByName(checked)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """SQL UNION: duplicates within and across the inputs are merged."""
    return a.unionByName(b).distinct()


def union_all_tagged(frames: Mapping[str, DataFrame], tag: str = "type") -> DataFrame:
    return reduce(DataFrame.unionByName, [f.withColumn(tag, F.lit(name)) for name, f in frames.items()])


def concat_segments(features: DataFrame, dead, segment: str = "segment", label: str = "BASELINE") -> DataFrame:
    """Label the dead series in place of splitting and stacking the table."""
    return features.withColumn(segment, F.when(dead, label).otherwise(F.col(segment)))


def hash_bucket(keys: Sequence[str], seed: int = 42):
    """0..99, reproducible in any engine that has MD5."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") % 100


def sample_fraction(df: DataFrame, percent: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """About percent % of the rows, chosen by a hash of their keys."""
    return df.where(hash_bucket(keys, seed) < percent)


def balanced_sample(
    trips: DataFrame,
    shares: Mapping[int, tuple[int, int]],
    keys: Sequence[str],
    order: Sequence[str],
    zones: tuple[int, int] = (1, 263),
    since=None,
    ts: str = "pickup_datetime",
) -> DataFrame:
    """Per vendor (payment type, percent): a sample plus each zone's first trip.

    All vendors are sampled in one pass, with the vendor's own percentage; trips before
    ``since`` don't count. Like SQL UNION this merges equal rows; keep a row id among the
    columns to avoid that. The trips that count are checkpointed, so the table is read once.
    """
    paid = map_values("VendorID", {v: payment for v, (payment, _) in shares.items()}, None)
    percent = map_values("VendorID", {v: share for v, (_, share) in shares.items()}, 0)
    counted = trips if since is None else trips.where(F.col(ts) >= ntz(since))
    base = cut_lineage(city_trips(counted, *zones).where(F.col("payment_type") == paid))
    sampled = base.where(hash_bucket(keys) < percent)
    return union_distinct(sampled, first_per_zone(base, order, ["VendorID", "PULocationID"]))
