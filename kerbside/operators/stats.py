"""Order statistics and distributions."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from kerbside.scratch import cut_lineage

# Accuracy of the sketch that brackets a rank: it is off by at most 1 / ACCURACY of the rows.
ACCURACY = 10_000
# Up to so many values a bracket is the whole group; beyond, the sketch's slack is several rows.
BRACKETED = 20_000
# Rows that a window sorts at most, about.
WINDOW_ROWS = 100_000

Rank = tuple[float, Callable[[Column], Column]]


def linear(p: float) -> Rank:
    """Rank of a quantile among sorted values, interpolated linearly."""
    return p, lambda total: F.lit(float(p)) * (total - 1)


def _same(a: Sequence[str], b: Sequence[str]) -> Column:
    out = F.lit(True)
    for x, y in zip(a, b):
        out = out & F.col(x).eqNullSafe(F.col(y))
    return out


def _bracket(values: Column, p: float) -> Column:
    """Two values of a group between which that of a rank lies."""
    slack = 3 / ACCURACY
    sketch = F.percentile_approx(values, [max(0.0, p - slack), min(1.0, p + slack)], ACCURACY)
    small = F.count(values) <= BRACKETED
    return F.struct(F.when(small, F.min(values)).otherwise(sketch[0]).alias("lo"), F.when(small, F.max(values)).otherwise(sketch[1]).alias("hi"))


def dealt_by_range(df: DataFrame, parts: int, order: Sequence[str]) -> DataFrame:
    """The rows with _part, the number of their range in the given order; ranges hold about as many rows."""
    return cut_lineage(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))


def running_totals(counted: DataFrame, keys: Sequence[str], value: str, n: str) -> DataFrame:
    """Adds _end, the sum of n over the rows of equal keys up to the value; values of a group differ.

    Where there are more rows than a window should sort they are dealt by range, so that a window holds one part of
    a group, and the sums of the parts before, one row each, are added.
    """
    stored = cut_lineage(counted)
    rows = stored.count()
    if rows <= WINDOW_ROWS:
        return stored.withColumn("_end", F.sum(n).over(Window.partitionBy(*keys).orderBy(value)))
    dealt = dealt_by_range(stored, math.ceil(rows / WINDOW_ROWS), [*keys, value])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(*keys, "_part").agg(F.sum(n).alias("_sum"))
    named = {k: f"_p{i}" for i, k in enumerate([*keys, "_part"])}
    bases = parts.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum").withColumnsRenamed(named)
    inside = F.sum(n).over(Window.partitionBy(*keys, "_part").orderBy(value))
    met = dealt.withColumn("_run", inside).join(bases, _same(list(named), list(named.values())))
    return met.withColumn("_end", F.col("_base") + F.col("_run")).drop("_part", "_run", "_base", *named.values())


def order_statistics(
    df: DataFrame, by: Sequence[str], cols: Sequence[str], ranks: Mapping[str, Rank], extra: Mapping[str, Callable[[Column], Column]] | None = None
) -> DataFrame:
    """Exact values at 0-based ranks of the sorted non-null values, by group and column.

    One row per group and column: the keys, label (the column's name), total, one double per
    name in ranks, and the aggregates ``extra`` of the column. Fractional ranks interpolate
    linearly. NaN counts as larger than any number, as in Spark's ``percentile``; ranks
    are found among the values as they are, so large whole numbers are told apart.
    A group or column without values gives no row.

    A sketch brackets every rank between two values. A second aggregate counts the values below each bracket, a third
    those inside, value by value; only these, a share of 1 / ACCURACY of large groups, leave the first tasks as rows. Their running totals
    give the ranks, by windows of about WINDOW_ROWS rows at most, whatever the size of the table. The brackets' rows are written
    when the statistics are asked for.
    """
    extra = extra or {}
    keys, others = [f"_k{i}" for i in range(len(by))], [f"_t{i}" for i in range(len(by))]
    names = [f"_v{i}" for i in range(len(cols))]
    values = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], *[F.col(c).alias(v) for c, v in zip(cols, names)])
    each = [(i, k, v, p) for i, v in enumerate(names) for k, (p, _) in enumerate(ranks.values())]
    found = [_bracket(F.col(v), p).alias(f"_b{i}_{k}") for i, k, v, p in each]
    totals = [F.count(v).alias(f"_n{i}") for i, v in enumerate(names)]
    more = [f(F.col(v)).alias(f"_x{i}_{e}") for i, v in enumerate(names) for e, f in extra.items()]
    sketched = cut_lineage(values.groupBy(*keys).agg(*found, *totals, *more))
    brackets = sketched.select(*[F.col(k).alias(t) for k, t in zip(keys, others)], *[f"_b{i}_{k}" for i, k, *_ in each])
    if keys:
        met, low = values.join(brackets, _same(keys, others)), {(i, k): (F.col(f"_b{i}_{k}.lo"), F.col(f"_b{i}_{k}.hi")) for i, k, *_ in each}
    else:
        row = brackets.first()
        met, low = values, {(i, k): (F.lit(row[f"_b{i}_{k}"].lo), F.lit(row[f"_b{i}_{k}"].hi)) for i, k, *_ in each}
    below = met.groupBy(*keys).agg(*[F.count_if(F.col(v) < low[i, k][0]).alias(f"_u{i}_{k}") for i, k, v, _ in each])

    kinds = {values.schema[v].dataType.simpleString() for v in names}
    wide = (lambda x: x) if len(kinds) == 1 else (lambda x: x.cast("double"))
    inside = [
        F.when((F.col(v) >= low[i, k][0]) & (F.col(v) <= low[i, k][1]), F.struct(F.lit(i).alias("_c"), F.lit(k).alias("_k"), wide(F.col(v)).alias("_v")))
        for i, k, v, _ in each
    ]
    entries = met.select(*keys, F.explode(F.array(*inside)).alias("e")).where("e is not null").select(*keys, "e.*")
    place = [*keys, "_c", "_k"]
    ranked = running_totals(entries.groupBy(*place, "_v").agg(F.count("*").alias("_n")), place, "_v", "_n")

    # a row for each group, column and rank: total, values below the bracket, and the position asked for
    asked = F.array(*[
        F.struct(F.lit(i).alias("_c"), F.lit(k).alias("_k"), F.col(f"_n{i}").alias("total"), F.col(f"_u{i}_{k}").alias("_under"), r.cast("double").alias("_at"))
        for i, k, *_ in each for r in [list(ranks.values())[k][1](F.col(f"_n{i}"))]
    ])
    counts = sketched.select(*keys, *[f"_n{i}" for i in range(len(names))])
    if keys:
        counts = counts.withColumnsRenamed(dict(zip(keys, others))).join(below, _same(keys, others)).drop(*others)
    else:
        counts = counts.withColumns({c: F.lit(n) for c, n in below.first().asDict().items()})
    wanted = counts.select(*[F.col(k).alias(t) for k, t in zip(keys, others)], F.explode(asked).alias("a")).select(
        *others, F.col("a._c").alias("_tc"), F.col("a._k").alias("_tk"), "a.total", "a._under", "a._at"
    )
    held = ranked.join(F.broadcast(wanted) if not keys else wanted, _same([*keys, "_c", "_k"], [*others, "_tc", "_tk"]))
    start, end = F.col("_under") + F.col("_end") - F.col("_n"), F.col("_under") + F.col("_end")

    def at(position: Column) -> Column:
        return F.max(F.when((position >= start) & (position < end), F.col("_v"))).cast("double")

    ends = held.groupBy(*place).agg(F.max("total").alias("total"), F.max("_at").alias("_at"), at(F.floor("_at")).alias("_low"), at(F.ceil("_at")).alias("_high"))
    value = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_at") - F.floor("_at")))
    label = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("_c") + 1)
    picked = ends.groupBy(*keys, "_c").agg(F.max("total").alias("total"), *[F.max(F.when(F.col("_k") == k, value)).alias(n) for k, n in enumerate(ranks)]).withColumn("label", label)
    if extra:
        packed = F.explode(F.array(*[F.struct(F.lit(i).alias("_tc"), *[F.col(f"_x{i}_{e}").alias(e) for e in extra]) for i in range(len(names))]))
        long = sketched.select(*[F.col(k).alias(t) for k, t in zip(keys, others)], packed.alias("_e")).select(*others, "_e.*")
        picked = picked.join(long, _same([*keys, "_c"], [*others, "_tc"]))
    return picked.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], "label", "total", *ranks, *extra)


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles by group: keys, total, one column per name."""
    return order_statistics(df, by, [value], {n: linear(p) for n, p in probs.items()}).drop("label")


def median_by(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    return quantiles(df, by, value, {name: 0.5}).drop("total")


def median_by_zone(points: DataFrame, zone: str = "locationid", score: str = "SCORE") -> DataFrame:
    return median_by(points, [zone], score, score)


def income_by_zone(income: DataFrame, year: int) -> DataFrame:
    return median_by(income.where(F.col("year") == year), ["locationid"], "median_income", "median_income")


def box_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers and extremes, one row per column."""
    extremes = {"min": lambda v: F.min(v).cast("double"), "max": lambda v: F.max(v).cast("double")}
    quart = order_statistics(df, [], cols, {"q1": linear(0.25), "med": linear(0.5), "q3": linear(0.75)}, extremes)
    iqr = F.col("q3") - F.col("q1")
    return quart.select(
        "label", "q1", "med", "q3",
        F.greatest("min", F.col("q1") - 1.5 * iqr).alias("whislo"),
        F.least("max", F.col("q3") + 1.5 * iqr).alias("whishi"),
        "min", "max",
    )


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles, max, one row per column."""
    moments = {
        "mean": F.avg, "std": F.stddev_samp, "min": lambda v: F.min(v).cast("double"), "max": lambda v: F.max(v).cast("double"),
    }
    quart = {"q25": linear(0.25), "q50": linear(0.5), "q75": linear(0.75)}
    found = order_statistics(df, [], cols, quart, moments)
    return found.select("label", F.col("total").alias("count"), "mean", "std", "min", "q25", "q50", "q75", "max")


def value_bounds(df: DataFrame, col: str, share: float = 0.99) -> DataFrame:
    """Smallest value, value at index floor(share * n) of the sorted list, largest value."""
    ends = {"min": lambda v: F.min(v).cast("double"), "absolute_max": lambda v: F.max(v).cast("double")}
    index = {"max": (share, lambda total: F.floor(F.lit(share) * total))}
    return order_statistics(df, [], [col], index, ends).select("min", "max", "absolute_max")


def normalise(df: DataFrame, col: str, name: str = "normalised", share: float = 0.99) -> DataFrame:
    """Position between the bounds, at most 1; 0.5 when the bounds coincide."""
    bounds = value_bounds(df, col, share).select(F.struct("min", "max")).scalar()
    low, high = bounds["min"], bounds["max"]
    v = F.col(col)
    return df.withColumn(
        name,
        F.when(v.isNull(), F.lit(None).cast("double"))
        .when(low == high, 0.5)
        .when(v >= high, 1.0)
        .otherwise(F.try_divide(v - low, high - low)),
    )


def density_histogram(
    df: DataFrame, by: Sequence[str], col: str, bins: int, low: float | None = None, high: float | None = None
) -> DataFrame:
    """Relative frequency of equal bins from low to high within each group.

    The range is by default that of the table's finite values, so no value is left
    out; the largest one is in the last bin. With a given range, smaller values are
    in bin -1 and values from high on in bin ``bins``; infinite values always are. Shares
    are of all values of the group but NULL and NaN.
    """
    x = F.col(col).cast("double")
    finite = F.when(F.abs(x) < float("inf"), x)
    ends = df.agg(F.struct(F.min(finite).alias("low"), F.max(finite).alias("high"))).scalar()
    first = F.lit(float(low)) if low is not None else ends["low"]
    last = F.lit(float(high)) if high is not None else ends["high"]
    place = F.floor(F.coalesce(F.try_divide((finite - first) * bins, last - first), F.lit(0.0)))
    inner = F.when((x == last) & F.lit(high is None), F.lit(bins - 1)).when(finite < first, -1).when(finite >= last, bins).otherwise(F.least(place, F.lit(bins - 1)))
    at = F.when(finite.isNull(), F.when(x > 0, bins).otherwise(-1)).otherwise(inner)
    binned = df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*by, at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return binned.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))
