"""Merged sketches against exact ranks, density curves against numpy."""

import numpy as np
from pyspark.sql import functions as F

from kerbside.operators import sketches as S


def values(spark, n=60_000):
    rng = np.random.default_rng(2)
    rows = [(int(m), int(v), float(x)) for m, v, x in zip(rng.integers(0, 12, n), rng.integers(0, 3, n), rng.lognormal(2, 1.5, n))]
    return spark.createDataFrame(rows, "month int, vendor int, x double").withColumn("none", F.lit(None).cast("double"))


def test_merged_states_keep_the_rank_error(spark, tmp_path):
    rows = values(spark)
    S.quantile_state(rows, ["month", "vendor"], ["x", "none"]).write.parquet(str(tmp_path / "state"))
    state = spark.read.parquet(str(tmp_path / "state"))
    assert state.count() == 36
    exact = rows.toPandas()
    for by, months in (([], range(12)), (["vendor"], (3, 4, 5))):
        got = S.sketched_box_stats(state.where(F.col("month").isin(*months)), ["x", "none"], by).collect()
        assert len(got) == 2 * (3 if by else 1)
        for r in got:
            own = exact[exact.month.isin(months) & ((exact.vendor == r["vendor"]) if by else True)].x.sort_values().to_numpy()
            if r.label == "none":
                assert (r.n, r.q1, r.med, r["min"], r.whishi) == (0, None, None, None, None)
                continue
            assert (r.n, r["min"], r["max"]) == (len(own), own[0], own[-1])
            for p, v in ((0.25, r.q1), (0.5, r.med), (0.75, r.q3)):
                assert abs(np.searchsorted(own, v) / len(own) - p) < 0.005
            assert r.whislo == max(own[0], r.q1 - 1.5 * (r.q3 - r.q1)) and r.whishi == min(own[-1], r.q3 + 1.5 * (r.q3 - r.q1))


def test_odd_values_of_a_state(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, float("nan")), (1, None), (2, None)], "g int, x double")
    got = {r.g: (r.n, r.med) for r in S.sketched_box_stats(S.quantile_state(rows, ["g"], ["x"]), ["x"], ["g"]).collect()}
    assert got == {1: (1, 2.0), 2: (0, None)}
    assert S.sketched_box_stats(S.quantile_state(rows.where("false"), ["g"], ["x"]), ["x"], ["g"]).count() == 0


def test_density_is_numpys(spark):
    rows = values(spark, 3000).where("x < 100")
    got = S.density_curve(rows, ["vendor"], "x").toPandas()
    exact = rows.toPandas()
    for vendor, curve in got.groupby("vendor"):
        x = exact[exact.vendor == vendor].x.to_numpy()
        curve = curve.sort_values("x")
        h, step = x.std(ddof=1) * len(x) ** -0.2, curve.x.diff().iloc[1]
        assert len(curve) == 200 and np.isclose(curve.x.iloc[0], x.min() - 3 * h) and np.isclose(curve.x.iloc[-1], x.max() + 3 * h)
        direct = np.exp(-(((curve.x.to_numpy()[:, None] - x) / h) ** 2) / 2).sum(axis=1) / (len(x) * h * np.sqrt(2 * np.pi))
        assert np.isclose(curve.density.sum() * step, 1) and np.abs(curve.density - direct).max() < 0.02 * direct.max()


def test_groups_without_a_curve(spark):
    rows = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, None), (3, float("inf")), (None, 1.0), (None, 2.0)], "g int, x double")
    assert {r.g for r in S.density_curve(rows, ["g"], "x", 10).collect()} == {None}
    assert S.density_curve(rows, [], "x", 10).count() == 10
