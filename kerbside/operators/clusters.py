"""Optimal one-dimensional clusters: least squared distances to the clusters' means, exactly."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

from kerbside.scratch import cut_lineage

MOST_BUCKETS = 2000


def _spread(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    """squares[i, j]: sum of squares about the mean of the buckets i, ..., j - 1; infinite for j < i."""
    n, s, q = (np.concatenate([[0.0], np.cumsum(x)]) for x in (n, s, q))
    count = n[None, :] - n[:, None]
    total = s[None, :] - s[:, None]
    found = q[None, :] - q[:, None] - np.divide(total * total, count, out=np.zeros_like(total), where=count > 0)
    return np.where(np.tri(len(n), k=-1, dtype=bool), np.inf, np.maximum(found, 0.0))


def _best_cuts(squares: np.ndarray, k: int) -> tuple[float, list[int]]:
    """Least sum over k clusters of whole buckets, and the first bucket of every cluster but the first."""
    m = len(squares) - 1
    best, choices = squares[0].copy(), []  # of the first j buckets
    for _ in range(k - 1):
        through = best[:, None] + squares
        choices.append(through.argmin(axis=0))
        best = through.min(axis=0)
    cuts, at = [], m
    for choice in reversed(choices):
        at = int(choice[at])
        cuts.append(at)
    return float(best[m]), sorted({c for c in cuts if 0 < c < m})


def _loose(squares: np.ndarray, k: int, divisible: np.ndarray, most: float) -> np.ndarray:
    """Those of the divisible buckets inside which a cut of an optimal solution may lie.

    A cut lies between two buckets or inside a divisible one. In the latter case the bucket's values are shared by two clusters,
    whose squares are no larger without them, so the least sum over solutions that leave out the buckets cut inside is a lower bound.
    """
    m, inside = len(squares) - 1, np.flatnonzero(divisible)
    ends = np.concatenate([np.arange(m + 1), inside])  # a cluster ends before this bucket ...
    starts = np.concatenate([np.arange(m + 1), inside + 1])  # ... and the next one starts with this
    between = squares[starts][:, ends]
    at = np.arange(m + 1, len(ends))
    between[at, at] = 0.0  # both cuts inside one bucket
    ahead, back = [squares[0, ends]], [squares[starts, m]]
    for _ in range(k - 2):
        ahead.append((ahead[-1][:, None] + between).min(axis=0))
        back.append((between + back[-1][None, :]).min(axis=1))
    bound = np.min([ahead[j] + back[k - 2 - j] for j in range(k - 1)], axis=0)
    loose = np.zeros(m, dtype=bool)
    loose[inside] = bound[m + 1 :] <= most
    return loose


def optimal_centres(values: DataFrame, col: str, k: int, buckets: int = MOST_BUCKETS) -> list[float]:
    """Means of the k clusters with the least sum of squared distances, rising; fewer where fewer values differ.

    Missing and not finite values don't count. Distinct values with their counts are cut into at most about ``buckets`` ranges,
    whose counts, sums and sums of squares are one aggregate; over these the driver finds the best
    cuts at range ends by dynamic programming on prefix sums. A lower bound tells which ranges could hold a better cut inside; only
    those are cut finer and all are summed again, until none is left. Up to ``buckets`` distinct values need one round. The driver
    holds the ranges' sums, never the values.
    """
    x = F.col(col).cast("double")
    fine = values.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    counted = cut_lineage(fine.groupBy(x.alias("v")).agg(F.count("*").alias("n")))
    ends = counted.agg(F.count("*").alias("m"), F.min("v").alias("low"), F.max("v").alias("high"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean")).first()
    if ends.m <= k:
        return sorted(r.v for r in counted.collect())
    edges, closed = _finer(counted, [(ends.low, float("inf"), ends.m)], buckets), set()
    while True:
        edges = sorted({ends.low, *edges})
        ranged = Bucketizer(splits=[*edges, float("inf")], inputCol="v", outputCol="b").transform(counted)
        d = F.col("v") - ends.mean  # small numbers lose no digits in the squares
        found = ranged.groupBy("b").agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * d).alias("s"), F.sum(F.col("n") * d * d).alias("q"), F.count("*").alias("m")
        )
        rows = sorted(found.collect(), key=lambda r: r.b)
        n, s, q = (np.array([r[c] for r in rows], dtype=float) for c in "nsq")
        squares = _spread(n, s, q)
        least, cuts = _best_cuts(squares, k)
        lows = [edges[int(r.b)] for r in rows]
        divisible = np.array([r.m > 1 and low not in closed for r, low in zip(rows, lows)])
        loose = _loose(squares, k, divisible, least + 1e-9 * squares[0, -1]) if k > 1 else divisible & False
        if not loose.any():
            clusters = zip([0, *cuts], [*cuts, len(rows)])
            return [float(ends.mean + s[a:b].sum() / n[a:b].sum()) for a, b in clusters]
        highs = [*lows[1:], float("inf")]
        # neighbouring ranges that hold no cut become one, which stays whole
        firm = [low for i, low in enumerate(lows) if not loose[i] and (not i or loose[i - 1] or i in cuts)]
        closed = set(firm)
        edges = firm + [lows[i] for i in np.flatnonzero(loose)] + _finer(counted, [(lows[i], highs[i], rows[i].m) for i in np.flatnonzero(loose)], buckets)


def _finer(counted: DataFrame, ranges: Sequence[tuple[float, float, int]], buckets: int) -> list[float]:
    """Lower ends of parts of the ranges [low, high): every distinct value where they are few, else quantiles of each range."""
    top = float("inf")
    splits = [-top, *sorted({x for low, high, _ in ranges for x in (low, high)} - {top}), top]
    own = [float(splits.index(low)) for low, *_ in ranges]
    within = Bucketizer(splits=splits, inputCol="v", outputCol="b").transform(counted).where(F.col("b").isin(own))
    if sum(m for *_, m in ranges) <= buckets:
        return [r.v for r in within.select("v").collect()]
    parts = max(2, buckets // len(ranges))
    shares = [i / parts for i in range(1, parts)]
    found = within.groupBy("b").agg(F.percentile_approx("v", shares, 10 * max(parts, 100)).alias("e"), F.max("v").alias("most"))
    # the largest value's own range makes sure that every range of several values is divided
    return [e for r in found.collect() for e in [*r.e, r.most]]


def nearest(col: str, centres: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the nearest of the rising centres, the lower one of two; null for a missing value."""
    x, found = F.col(col), F.lit(labels[0])
    for low, high, label in zip(centres, centres[1:], labels[1:]):
        found = F.when(x > (low + high) / 2, label).otherwise(found)
    return F.when(x.isNotNull() & F.lit(bool(centres)), found)
