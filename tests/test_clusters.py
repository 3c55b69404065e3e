"""Optimal one-dimensional clusters against a search over all cuts."""

import random
from itertools import combinations

import pytest

from kerbside.operators import clusters as C


def squares(values):
    mean = sum(values) / len(values)
    return sum((v - mean) ** 2 for v in values)


def best(values, k):
    """Centres of the best cuts between distinct values."""
    values, distinct = sorted(values), sorted(set(values))
    least = None
    for cuts in combinations(distinct[1:], min(k, len(distinct)) - 1):
        parts = [[v for v in values if low <= v < high] for low, high in zip([float("-inf"), *cuts], [*cuts, float("inf")])]
        found = (sum(squares(p) for p in parts), [sum(p) / len(p) for p in parts])
        least = min(least, found) if least else found
    return least


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v double")


@pytest.mark.parametrize("seed", range(6))
def test_equals_the_search_over_all_cuts(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice([rng.gauss(0, 1), rng.gauss(8, 2), 1e6 + rng.random(), 3.0]) for _ in range(60)]
    k = 2 + seed % 3
    assert C.optimal_centres(frame(spark, values), "v", k) == pytest.approx(best(values, k)[1], rel=1e-9)


def test_ranges_are_cut_finer_where_a_cut_may_lie(spark):
    """As good with 12 ranges at a time as with one for each value."""
    rng = random.Random(9)
    values = [rng.gauss(0, 3) for _ in range(300)] + [rng.gauss(9, 1) for _ in range(90)] + [40.0] * 20
    df = frame(spark, values)
    whole = C.optimal_centres(df, "v", 3)
    assert C.optimal_centres(df, "v", 3, buckets=12) == pytest.approx(whole, rel=1e-9)
    assert whole == pytest.approx(best([round(v, 6) for v in values[::6]], 3)[1], rel=0.5)


def test_few_missing_and_infinite_values(spark):
    df = frame(spark, [2.0, None, 1.0, float("nan"), float("inf"), 2.0])
    assert C.optimal_centres(df, "v", 3) == [1.0, 2.0]
    assert C.optimal_centres(df.where("false"), "v", 3) == []
    assert C.optimal_centres(frame(spark, [1.0, 2.0, 6.0]), "v", 1) == [3.0]
    labelled = df.select("v", C.nearest("v", [1.0, 2.0], ("a", "b", "c")).alias("l"), C.nearest("v", [], ("a",)).alias("none"))
    assert {(r.l, r.none) for r in labelled.where("v < 3").collect()} == {("a", None), ("b", None)}


def test_a_tie_goes_to_the_lower_centre(spark):
    got = {r.v: r.l for r in frame(spark, [1.0, 2.0, 2.1, 3.0]).select("v", C.nearest("v", [1.0, 3.0], ("low", "high")).alias("l")).collect()}
    assert got == {1.0: "low", 2.0: "low", 2.1: "high", 3.0: "high"}
