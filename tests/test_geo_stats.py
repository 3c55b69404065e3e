"""Geography and order statistics against brute force."""

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kerbside.operators import geo as GE
from kerbside.operators import stats as ST

FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def haversine(a, b):
    (la, lo), (lb, lp) = (tuple(map(math.radians, p)) for p in (a, b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * math.asin(math.sqrt(h))


def zone_table(n, seed=7):
    rng = np.random.default_rng(seed)
    return [(i, float(40.5 + rng.random()), float(-74 + rng.random())) for i in range(1, n + 1)]


@FEW
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.floats(-1e6, 1e6)), min_size=1, max_size=60))
def test_quantiles_equal_numpy(spark, rows):
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE")
    got = {r.k: r for r in ST.quantiles(df, ["k"], "v", {"low": 0.1, "mid": 0.5, "high": 0.99}).collect()}
    assert set(got) == {k for k, _ in rows}
    for k in got:
        vals = [v for kk, v in rows if kk == k]
        assert got[k].total == len(vals)
        assert np.allclose([got[k].low, got[k].mid, got[k].high], np.quantile(vals, [0.1, 0.5, 0.99]), rtol=1e-12, atol=1e-9)


def test_quantiles_of_one_hot_group(spark):
    """A third of all rows share one key and one value."""
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k"),
        F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id").cast("double")).alias("v"),
    )
    rows = {r.k: r.mid for r in ST.quantiles(df, ["k"], "v", {"mid": 0.5}).collect()}
    want = df.groupBy("k").agg(F.median("v").alias("m")).collect()
    assert rows == {r.k: r.m for r in want}


def test_bounds_and_flat_normalisation(spark):
    df = spark.createDataFrame([(float(i),) for i in range(200)] + [(None,)], "v DOUBLE")
    assert tuple(ST.value_bounds(df, "v").first()) == (0.0, 198.0, 199.0)
    scaled = {r.v: r.normalised for r in ST.normalise(df, "v").collect()}
    assert scaled[0.0] == 0.0 and scaled[199.0] == 1.0 and scaled[99.0] == 0.5 and scaled[None] is None
    flat = ST.normalise(spark.createDataFrame([(3.0,), (3.0,)], "v DOUBLE"), "v")
    assert {r.normalised for r in flat.collect()} == {0.5}


def test_order_statistics_of_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    groups = {"nan": [1.0, 2.0, 3.0, nan], "inf": [-inf, 1.0, 2.0, inf], "all nan": [nan, nan], "ties": [5.0] * 9 + [6.0], "one": [0.5]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("none", None)], "k STRING, v DOUBLE")
    want = {r.k: list(r.q) for r in df.groupBy("k").agg(F.percentile("v", F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0))).alias("q")).where("k != 'none'").collect()}
    got = {r.k: [r.low, r.mid, r.high] for r in ST.quantiles(df, ["k"], "v", {"low": 0.0, "mid": 0.5, "high": 1.0}).collect()}
    assert repr(sorted(got.items())) == repr(sorted(want.items()))
    wide = {r.label: (r.total, r.low, r.mid, r.high) for r in ST.order_statistics(df, [], ["v"], {"low": ST.linear(0.0), "mid": ST.linear(0.25), "high": ST.linear(1.0)}).collect()}
    assert wide["v"][0] == 21 and wide["v"][1] == -inf and math.isnan(wide["v"][3])


def test_brackets_are_exact_beyond_the_small_groups(spark, monkeypatch):
    monkeypatch.setattr(ST, "BRACKETED", 50)
    monkeypatch.setattr(ST, "ACCURACY", 60)
    rng = random.Random(3)
    rows = [("narrow", 40.7 + rng.random() * 1e-9) for _ in range(4000)] + [("wide", rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300)) for _ in range(3000)] + [
        ("ties", float(rng.randrange(3))) for _ in range(3000)] + [("ids", float(1_700_000_000 + i)) for i in range(5000)]
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE").repartition(4)
    probs = {"a": 0.0, "b": 0.013, "c": 0.5, "d": 0.77, "e": 1.0}
    for r in ST.quantiles(df, ["k"], "v", probs).collect():
        values = sorted(v for k, v in rows if k == r.k)
        for name, p in probs.items():
            at = p * (len(values) - 1)
            low, high = values[math.floor(at)], values[math.ceil(at)]
            assert r[name] == pytest.approx(low + (high - low) * (at - math.floor(at)), rel=1e-12)
    big = spark.createDataFrame([(2**53 + i,) for i in range(0, 9, 2)], "v BIGINT")
    assert ST.quantiles(big, [], "v", {"m": 0.5}).first().m == float(2**53 + 4)


def test_histogram_leaves_nothing_out(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 50.0, None, float("nan"), float("inf"))], "v DOUBLE")
    own = {r.bin: (r.n, r.share) for r in ST.density_histogram(df, [], "v", 7).collect()}
    assert own == {0: (3, 0.6), 6: (1, 0.2), 7: (1, 0.2)}
    given = {r.bin: r.n for r in ST.density_histogram(df, [], "v", 4, 2, 10).collect()}
    assert given == {-1: 1, 0: 2, 4: 2}


def test_box_whiskers_stay_inside_the_data(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 100)], "v DOUBLE")
    r = ST.box_stats(df, ["v"]).first()
    assert (r.q1, r.med, r.q3, r.whislo, r.whishi, r["max"]) == (2.0, 3.0, 4.0, 1.0, 7.0, 100.0)


@pytest.mark.parametrize("n", [3, 60, 900])
def test_nearest_zones(spark, n):
    zones, points = zone_table(n), [(i, la, lo) for i, la, lo in zone_table(25, 3)]
    df = GE.zone_knn(
        spark.createDataFrame(points, "start_id INT, lat DOUBLE, lon DOUBLE"),
        spark.createDataFrame(zones, "zone INT, lat DOUBLE, lon DOUBLE"), 4)
    got = {r.start_id: [z.zone for z in r.near] for r in df.collect()}
    for i, la, lo in points:
        want = sorted(zones, key=lambda z: haversine((la, lo), z[1:]))[:4]
        assert got[i] == [z[0] for z in want]


def test_nearest_zones_of_repeated_and_missing_places(spark):
    zones = [(4_000_000_000, 40.0, -74.0), (5, 40.2, -74.0), (6, None, -74.0), (None, 40.0, -74.0), (7, 40.0, 179.99), (8, 40.0, -179.99)]
    points = [(1, 40.19, -74.0), (1, 40.01, -74.0), (2, None, -74.0), (3, 40.0, float("nan")), (None, 40.0, 179.999), (4, 40.11, -74.0)]
    df = GE.zone_knn(spark.createDataFrame(points, "start_id INT, lat DOUBLE, lon DOUBLE"), spark.createDataFrame(zones, "zone BIGINT, lat DOUBLE, lon DOUBLE"), 2)
    got = sorted(((r.start_id or 0, [z.zone for z in r.near]) for r in df.collect()), key=lambda r: (r[0], r[1][:1]))
    assert got == [(0, [7, 8]), (1, [5, 4_000_000_000]), (1, [4_000_000_000, 5]), (2, []), (3, []), (4, [5, 4_000_000_000])]
    none = spark.createDataFrame([], "zone BIGINT, lat DOUBLE, lon DOUBLE")
    assert {tuple(r.near) for r in GE.zone_knn(spark.createDataFrame(points, "start_id INT, lat DOUBLE, lon DOUBLE"), none, 2).collect()} == {()}


def test_candidates_do_not_grow_with_the_zones(spark):
    per_place = {}
    for side in (20, 80):
        zones = [(i * side + j, 40 + 0.01 * i, -74 + 0.01 * j) for i in range(side) for j in range(side)]
        places = [(40.003 + 0.01 * i, -73.996 + 0.01 * i) for i in range(0, side, 2)]
        met = GE.candidates(spark.createDataFrame(places, "lat DOUBLE, lon DOUBLE"), spark.createDataFrame(zones, "zone INT, lat DOUBLE, lon DOUBLE"), 5)
        per_place[side] = met.count() / len(places)
    assert per_place[80] < 2 * per_place[20] and per_place[80] < 1000


def test_candidates_of_far_places_do_not_grow_with_the_zones(spark):
    per_place = {}
    for side in (20, 80):
        zones = [(i * side + j, -50 + 0.01 * i, 1 + 0.01 * j) for i in range(side) for j in range(side)]
        places = [(40.0 + 0.1 * i, -74.0 + 0.05 * i) for i in range(10)]
        met = GE.candidates(spark.createDataFrame(places, "lat DOUBLE, lon DOUBLE"), spark.createDataFrame(zones, "zone INT, lat DOUBLE, lon DOUBLE"), 3)
        per_place[side] = met.count() / len(places)
    assert per_place[80] < 2 * per_place[20] and per_place[80] < 200


def test_nearest_zones_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(GE, "MOST_SENT", 10)
    zones, places = zone_table(300), [(i, -la, lo + 90) for i, la, lo in zone_table(20, 3)]
    df = GE.zone_knn(
        spark.createDataFrame(places, "start_id INT, lat DOUBLE, lon DOUBLE"),
        spark.createDataFrame(zones, "zone INT, lat DOUBLE, lon DOUBLE"), 4)
    got = {r.start_id: [z.zone for z in r.near] for r in df.collect()}
    for i, la, lo in places:
        assert got[i] == [z[0] for z in sorted(zones, key=lambda z: haversine((la, lo), z[1:]))[:4]]
    # cells that many zones spread to are not taken for a small side
    sent = GE.candidates(df.select("lat", "lon"), spark.createDataFrame(zones, "zone INT, lat DOUBLE, lon DOUBLE"), 4)
    assert "SortMergeJoin" in sent._jdf.queryExecution().executedPlan().toString()


def test_routes_with_large_zone_ids(spark):
    zones = [(3_000_000_000 + i, 40 + 0.01 * i, -74.0) for i in range(4)]
    df = GE.greedy_routes(
        spark.createDataFrame([(1, 40.0, -74.0), (2, None, None)], "start_id INT, lat DOUBLE, lon DOUBLE"), spark.createDataFrame(zones, "zone BIGINT, lat DOUBLE, lon DOUBLE"),
        spark.createDataFrame([(3_000_000_002, 5)], "PULocationID BIGINT, total_trips BIGINT"))
    got = {r.start_id: list(r.route) for r in df.collect()}
    assert sorted(got[1]) == [z for z, _, _ in zones] and got[2] == []


def walk(start, zones, trips, stops, k=20, eps=1e-4, limit=None):
    """The route one stop at a time, for comparison."""
    where = {z: (la, lo) for z, la, lo in zones}
    at, seen, length = start, [], 0.0
    for _ in range(stops):
        if limit is not None and length * 6371.0088 >= limit:
            break
        near = sorted(where, key=lambda z: haversine(at, where[z]))[:k]
        best = None
        for z in near:
            if z in seen:
                continue
            around = sorted(where, key=lambda o: haversine(where[z], where[o]))[:3]
            pull = sum(trips.get(o, 0) / (haversine(where[z], where[o]) + eps) for o in around if o != z)
            d = haversine(at, where[z])
            score = (0.8 * trips.get(z, 0) + 0.2 * pull) / (d + eps)
            if best is None or score > best[0]:
                best = (score, z, d)
        if best is None:
            break
        seen.append(best[1])
        length += best[2]
        at = where[best[1]]
    return seen, length


@pytest.mark.parametrize("k,limit", [(20, None), (2, None), (20, 30.0)])
def test_routes_equal_the_stepwise_walk(spark, k, limit):
    zones = zone_table(30)
    trips = {z: (z * 37) % 101 for z, _, _ in zones if z % 7}
    starts = zone_table(12, 11)
    df = GE.greedy_routes(
        spark.createDataFrame(starts, "start_id INT, lat DOUBLE, lon DOUBLE"),
        spark.createDataFrame(zones, "zone INT, lat DOUBLE, lon DOUBLE"),
        spark.createDataFrame(list(trips.items()), "PULocationID INT, total_trips BIGINT"), k=k, max_km=limit)
    got = {r.start_id: r for r in df.collect()}
    for i, la, lo in starts:
        seen, length = walk((la, lo), zones, trips, 5, k, limit=limit)
        assert list(got[i].route) == seen
        assert got[i].route_rad == pytest.approx(length, abs=1e-9)


SQUARE = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]
HOLE = [[1.0, 1.0], [1.0, 2.0], [2.0, 2.0], [2.0, 1.0], [1.0, 1.0]]
TRIANGLE = [[10.0, 0.0], [14.0, 0.0], [12.0, 3.0], [10.0, 0.0]]


@pytest.fixture(scope="module")
def areas(spark):
    return spark.createDataFrame([(1, [[SQUARE, HOLE]]), (2, [[TRIANGLE], [[[20.0, 0.0], [21.0, 0.0], [21.0, 1.0], [20.0, 0.0]]]])],
                                 "locationid INT, polygons ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>")


def test_points_in_polygons(spark, areas):
    points = [("in", 3.0, 3.0, 1), ("hole", 1.5, 1.5, None), ("edge", 4.0, 2.0, None), ("corner", 0.0, 0.0, None), ("hole edge", 1.0, 1.5, None),
              ("out", 9.0, 9.0, None), ("tri", 12.0, 1.0, 2), ("second part", 20.9, 0.5, 2), ("slanted edge", 20.5, 0.5, None), ("twice", 3.0, 3.0, 1)]
    df = GE.points_in_polygons(spark.createDataFrame([p[:3] for p in points], "name STRING, x DOUBLE, y DOUBLE"), areas)
    assert {r["name"]: r.locationid for r in df.collect()} == {p[0]: p[3] for p in points}
    assert df.count() == len(points)


def test_overlapping_polygons_give_one_row_each(spark):
    zones = spark.createDataFrame([(1, [[SQUARE]]), (2, [[SQUARE]])], "locationid INT, polygons ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>")
    df = GE.points_in_polygons(spark.createDataFrame([(3.0, 3.0)], "x DOUBLE, y DOUBLE"), zones)
    assert sorted(r.locationid for r in df.collect()) == [1, 2]


def test_centroids_subtract_holes(areas):
    got = {r.locationid: (r.Longitude, r.Latitude) for r in GE.polygon_centroid(areas).collect()}
    # 16 square units around (2, 2) without one around (1.5, 1.5)
    assert got[1] == pytest.approx(((32 - 1.5) / 15, (32 - 1.5) / 15))
    assert got[2] == pytest.approx(((12 * 6 + 0.5 * (62 / 3)) / 6.5, (6 + 0.5 / 3) / 6.5))


def test_distances_within_equal_brute_force(spark):
    zones = zone_table(80)
    df = spark.createDataFrame(zones, "zone INT, lat DOUBLE, lon DOUBLE")
    radius = 30_000.0
    plane = {r.zone: (r.x, r.y) for r in GE.planar_zones(df).collect()}
    want = {(a, b): round(math.dist(plane[a], plane[b])) for a in plane for b in plane if a < b and math.dist(plane[a], plane[b]) <= radius}
    got = {(r.id_a, r.id_b): r.metres for r in GE.zone_distances_within(df, radius).collect()}
    assert got == want and len(want) > 50


def test_distance_lookup_is_symmetric(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (1, 9)], "a INT, b INT")
    table = spark.createDataFrame([(1, 2, 500)], "id_a INT, id_b INT, metres BIGINT")
    assert {(r.a, r.b): r.metres for r in GE.distance_lookup(pairs, table, "a", "b").collect()} == {(1, 2): 500, (2, 1): 500, (3, 3): 0, (1, 9): None}


def test_distance_of_unknown_zones_is_null(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 99), (1, 2)], "a INT, b INT")
    zones = spark.createDataFrame(zone_table(2), "zone INT, lat DOUBLE, lon DOUBLE")
    got = {(r.a, r.b): r.metres for r in GE.pair_distances(pairs, zones, "a", "b").collect()}
    assert got[1, 1] == 0 and got[1, 99] is None and got[1, 2] > 0


@pytest.mark.parametrize("n", [3_000, 30_000])
def test_windows_of_order_statistics_do_not_grow(spark, monkeypatch, n):
    """The same results, and parts of the same size, whatever the size of the table."""
    monkeypatch.setattr(ST, "WINDOW_ROWS", 500)
    monkeypatch.setattr(ST, "BRACKETED", 10**9)  # every distinct value is a row of the window
    rng = np.random.default_rng(n)
    values, groups = rng.normal(0, 10, n).round(3), rng.integers(0, 2, n)
    df = spark.createDataFrame([(int(g) or None, float(v)) for g, v in zip(groups, values)], "k int, v double")
    probs = {"low": 0.013, "mid": 0.5, "high": 0.999}
    got = {r.k: [r.low, r.mid, r.high] for r in ST.quantiles(df, ["k"], "v", probs).collect()}
    for k in (None, 1):
        assert np.allclose(got[k], np.quantile(values[groups == (k or 0)], list(probs.values())), atol=1e-12)
    counted = df.groupBy("k", "v").agg(F.count("*").alias("n"))
    parts = ST.dealt_by_range(counted, -(-counted.count() // 500), ["k", "v"]).groupBy("k", "_part").count()
    assert parts.agg(F.max("count")).first()[0] < 1500
    totals = {(r.k, r.v): r._end for r in ST.running_totals(counted, ["k"], "v", "n").collect()}
    for k in (None, 1):
        own = np.sort(values[groups == (k or 0)])
        assert all(totals[k, v] == np.searchsorted(own, v, side="right") for v in own[::97])


def test_the_cells_of_a_polygon_are_bounded(spark):
    """From a metre to ten degrees; cells inside need no test, and every answer is that of ray casting."""
    import math

    rng = np.random.default_rng(7)
    rows, shapes = [], {}
    for i, radius in enumerate((1e-5, 0.01, 0.5, 10.0)):
        cx, cy = 3.0 * i, -2.0 * i
        outer = [(cx + radius * r * math.cos(t), cy + radius * r * math.sin(t)) for t, r in zip(np.linspace(0, 2 * math.pi, 41)[:-1], rng.uniform(0.3, 1.0, 40))]
        hole = [(cx + radius * 0.1 * dx, cy + radius * 0.1 * dy) for dx, dy in ((1, 0), (0, 1), (-1, -1))]
        rings = [[[float(x), float(y)] for x, y in [*ring, ring[0]]] for ring in (outer, hole)]
        rows.append((i, [rings]))
        shapes[i] = rings
    zones = spark.createDataFrame(rows, "locationid int, polygons array<array<array<array<double>>>>")
    cells = GE.polygon_cells(zones).groupBy("_zone").agg(F.count("*").alias("n"), F.count_if("whole").alias("inside"), F.count_if(F.col("edges").isNull()).alias("bare")).collect()
    assert len(cells) == 4 and all(r.n <= (GE.ACROSS + 2) ** 2 and r.inside == r.bare > 4 for r in cells)

    def inside(x, y, rings):
        crossings = 0
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
                if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                    crossings += 1
        return crossings % 2 == 1

    points = [(n, float(3.0 * i + s * dx), float(-2.0 * i + s * dy)) for n, (i, s, dx, dy) in enumerate(zip(rng.integers(0, 4, 4000), rng.choice([1e-5, 0.01, 0.5, 10.0], 4000), rng.uniform(-1, 1, 4000), rng.uniform(-1, 1, 4000)))]
    points += [(4000, None, 1.0), (4001, float("nan"), 1.0), (4001, 500.0, 1.0)]
    got = {}
    for r in GE.points_in_polygons(spark.createDataFrame(points, "n int, x double, y double"), zones).collect():
        got.setdefault((r.n, r.x), set()).add(r.locationid)
    for n, x, y in points[:4000]:
        assert got[n, x] == ({i for i, rings in shapes.items() if inside(x, y, rings)} or {None})
    assert got[4000, None] == {None} and got[4001, 500.0] == {None} and len(got) == 4003


def test_points_keep_their_repetitions(spark):
    square = [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]]]
    large = [[[[-9.0, -9.0], [9.0, -9.0], [9.0, 9.0], [-9.0, 9.0], [-9.0, -9.0]]]]
    zones = spark.createDataFrame([(1, square), (2, large)], "locationid int, polygons array<array<array<array<double>>>>")
    points = spark.createDataFrame([(0.5, 0.5), (0.5, 0.5), (5.0, 5.0), (99.0, 0.0), (99.0, 0.0)], "x double, y double")
    got = sorted((r.x, r.locationid or 0) for r in GE.points_in_polygons(points, zones).collect())
    assert got == [(0.5, 1), (0.5, 1), (0.5, 2), (0.5, 2), (5.0, 2), (99.0, 0), (99.0, 0)]
    assert [r.locationid for r in GE.points_in_polygons(points.limit(1), zones.where("false")).collect()] == [None]
