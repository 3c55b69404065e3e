"""Spatial joins, nearest zones, distances and routes."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window, functions as F

from kerbside.functions.maths import haversine_rad, mercator_xy, planar_m, rad
from kerbside.scratch import cut_lineage

# Grid cells of level l are 2 ** (l - FINEST) wide, on the unit sphere in space; the eight of the last level hold everything.
FINEST, COARSEST = 24, 25
STEP = 2  # levels that a search goes down at once


def _on_sphere(df: DataFrame) -> DataFrame:
    """Adds the unit vector of (lat, lon): straight-line distance between such points
    orders them like the great-circle distance, without trigonometry per pair."""
    lat, lon = rad(F.col("lat")), rad(F.col("lon"))
    return df.withColumns({"_x": F.cos(lat) * F.cos(lon), "_y": F.cos(lat) * F.sin(lon), "_z": F.sin(lat)})


def _cell(level: Column) -> list[Column]:
    """The cell of a unit vector at a level, as columns of level and place."""
    width = F.pow(F.lit(2.0), level - FINEST)
    return [level.cast("int").alias("_level"), *[F.floor(F.col(a) / width).cast("bigint").alias(f"_c{a}") for a in AXES]]


AXES = ["_x", "_y", "_z"]
CELL = [f"_c{a}" for a in AXES]

# Rows of a join's zone side that are sent to every task at most: their number is counted before.
MOST_SENT = 500_000


def _sent(df: DataFrame, rows: int) -> DataFrame:
    """A join side for all tasks, or one that is shuffled: Spark's own estimate misses the rows that an explode adds."""
    return F.broadcast(df) if rows <= MOST_SENT else df.hint("merge")


def candidates(places: DataFrame, zones: DataFrame, k: int) -> DataFrame:
    """(lat, lon, zone, _lat, _lon, _chord): zones among which the k nearest of every distinct place are.

    Cells form a tree: those of a level lie in those four times as wide. Each holds the number of its zones and the box
    around them. A place starts with the coarsest cells and goes down: of the cells that it has
    reached, the nearest ones that hold k zones bound the distance of the k-th by the far ends of their boxes, and cells
    that begin beyond it are left. So a place keeps cells about as far as its k-th zone, whether that is near
    or at the other end of the world, and their number does not grow with the zones. Every step is an equi-join on
    cells. The finest level follows from the number and the extent of the zones.

    The zones, then the cells of every level are counted first. Where they are few enough to be sent to every task, a place is moved once, to
    find the distinct ones, and its cells, its candidates and whatever is grouped by place afterwards need no further exchange.
    """
    located = lambda df: df.where((F.abs(F.col("lat")) <= 90) & (F.abs(F.col("lon")) < float("inf")))
    z = _on_sphere(located(zones.where(F.col("zone").isNotNull()).select("zone", "lat", "lon")))
    p = _on_sphere(located(places.select("lat", "lon")).distinct())
    spans = [F.max(c) - F.min(c) for c in AXES]
    typical = F.log2(F.try_divide(F.greatest(*spans, F.lit(2.0**-FINEST)), F.sqrt(F.count("*")))) + FINEST
    found = z.agg(F.greatest(F.least(F.floor(typical), F.lit(COARSEST)), F.lit(0)).cast("int").alias("finest"), F.count("*").alias("n")).first()
    finest = COARSEST if found.finest is None else found.finest
    levels = [*range(COARSEST, finest, -STEP), finest]
    boxes = [e(c).alias(f"{n}{c}") for c in AXES for n, e in (("_lo", F.min), ("_hi", F.max))]
    tree = z.withColumn("_l", F.explode(F.array(*map(F.lit, levels)))).groupBy(*_cell(F.col("_l"))).agg(F.count("*").alias("_held"), *boxes)
    cells = dict.fromkeys(levels, found.n)
    if found.n > MOST_SENT:
        tree = cut_lineage(tree)
        cells = {r._level: r["count"] for r in tree.groupBy("_level").count().collect()}

    # squares are products: rounding keeps their order, so a bound never passes what it bounds
    ahead = {c: F.greatest(F.col(f"_lo{c}") - F.col(c), F.col(c) - F.col(f"_hi{c}"), F.lit(0.0)) for c in AXES}
    across = {c: F.greatest(F.abs(F.col(f"_lo{c}") - F.col(c)), F.abs(F.col(f"_hi{c}") - F.col(c))) for c in AXES}
    least, most = (sum((d[c] * d[c] for c in AXES), F.lit(0.0)) for d in (ahead, across))
    by_far = Window.partitionBy("lat", "lon").orderBy("_most")
    by_place = Window.partitionBy("lat", "lon")
    corners = F.array(*[F.struct(*[F.lit(i).cast("bigint").alias(c) for c, i in zip(CELL, at)]) for at in product((-1, 0), repeat=3)])
    reached = p.withColumn("_c", F.explode(corners)).select("lat", "lon", *AXES, *[F.col(f"_c.{c}") for c in CELL])
    for level, above in zip(levels, [COARSEST, *levels]):
        up = [F.floor(F.col(c) / 2.0 ** (above - level)).cast("bigint").alias(f"_up{c}") for c in CELL]
        inner = _sent(tree.where(F.col("_level") == level).select(*CELL, *up, "_held", *[f"{n}{c}" for c in AXES for n in ("_lo", "_hi")]), cells.get(level, 0))
        outer = reached.withColumnsRenamed({c: f"_up{c}" for c in CELL})
        met = outer.join(inner, [f"_up{c}" for c in CELL]).select("lat", "lon", *AXES, *CELL, "_held", least.alias("_least"), most.alias("_most"))
        enough = F.when(F.sum("_held").over(by_far) >= k, F.col("_most"))  # all cells where they hold fewer than k
        bound = F.coalesce(F.min("_enough").over(by_place), F.lit(float("inf")))
        reached = met.withColumn("_enough", enough).withColumn("_bound", bound).where(F.col("_least") <= F.col("_bound")).select("lat", "lon", *AXES, *CELL)
    inside = z.select("zone", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), *[F.col(c).alias(f"{c}z") for c in AXES], *_cell(F.lit(finest))[1:])
    chord = sum(((F.col(f"{c}z") - F.col(c)) * (F.col(f"{c}z") - F.col(c)) for c in AXES), F.lit(0.0))
    return reached.join(_sent(inside, found.n), CELL).select("lat", "lon", "zone", "_lat", "_lon", chord.alias("_chord"))


def nearest_zones(places: DataFrame, zones: DataFrame, k: int) -> DataFrame:
    """(lat, lon, near): the k zones nearest to every distinct place, nearest first, as (d, zone).

    Distances are great-circle radians; of equally near zones the smaller id
    comes first. Places without finite coordinates, and zones without them or without id, are left out.
    """
    rank = F.row_number().over(Window.partitionBy("lat", "lon").orderBy("_chord", "zone"))
    best = candidates(places, zones, k).withColumn("_rank", rank).where(F.col("_rank") <= k)
    d = haversine_rad(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
    entries = F.sort_array(F.collect_list(F.struct("_rank", d.alias("d"), "zone")))
    return best.groupBy("lat", "lon").agg(F.transform(entries, lambda e: F.struct(e["d"].alias("d"), e["zone"].alias("zone"))).alias("near"))


def zone_knn(points: DataFrame, zones: DataFrame, k: int) -> DataFrame:
    """points with near, the k zones nearest to each as (d, zone), nearest first.

    points has lat and lon; zones: zone, lat, lon. Points without finite coordinates have an
    empty list. Rows are kept as they are, whatever their ids.
    """
    near = nearest_zones(points, zones, k).withColumnsRenamed({"lat": "_lat", "lon": "_lon"})
    joined = points.join(near, (F.col("lat") == F.col("_lat")) & (F.col("lon") == F.col("_lon")), "left")
    empty = F.array().cast(near.schema["near"].dataType)
    return joined.select(*points.columns, F.coalesce("near", empty).alias("near"))


def neighbours(knn: DataFrame, *keep: str) -> DataFrame:
    """One row per (point, neighbour) with its rank."""
    ranked = F.transform("near", lambda z, i: F.struct((i + 1).alias("rank"), z["zone"].alias("zone"), z["d"].alias("d")))
    return knn.select(*keep, F.inline(ranked))


def planar_zones(zones: DataFrame) -> DataFrame:
    x, y = mercator_xy("lon", "lat")
    return zones.select("zone", x.alias("x"), y.alias("y"))


def zone_distances_within(zones: DataFrame, radius_m: float) -> DataFrame:
    """(id_a, id_b, metres) of the zone pairs a < b at most radius_m apart.

    Zones meet through grid cells as wide as the radius, so only zones of the
    same or adjacent cells are compared.
    """
    z = planar_zones(zones).withColumns(
        {"cx": F.floor(F.col("x") / radius_m).cast("bigint"), "cy": F.floor(F.col("y") / radius_m).cast("bigint")}
    )
    around = F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = z.select(F.col("zone").alias("id_a"), F.col("x").alias("xa"), F.col("y").alias("ya"), F.explode(around).alias("c"))
    a = a.select("id_a", "xa", "ya", "c.cx", "c.cy")
    b = z.select(F.col("zone").alias("id_b"), F.col("x").alias("xb"), F.col("y").alias("yb"), "cx", "cy")
    dx, dy = F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya")
    pairs = a.join(b, ["cx", "cy"]).where((F.col("id_a") < F.col("id_b")) & (dx * dx + dy * dy <= radius_m * radius_m))
    return pairs.select("id_a", "id_b", planar_m("xa", "ya", "xb", "yb").alias("metres"))


def pair_distances(pairs: DataFrame, zones: DataFrame, a: str, b: str) -> DataFrame:
    """Metres between the zones of each given pair; 0 for equal, NULL for unknown zones."""
    z = planar_zones(zones)
    za = z.select(F.col("zone").alias(a), F.col("x").alias("_xa"), F.col("y").alias("_ya"))
    zb = z.select(F.col("zone").alias(b), F.col("x").alias("_xb"), F.col("y").alias("_yb"))
    return (
        pairs.join(za, a, "left").join(zb, b, "left")
        .withColumn("metres", F.when(F.col(a) == F.col(b), F.lit(0).cast("bigint")).otherwise(planar_m("_xa", "_ya", "_xb", "_yb")))
        .drop("_xa", "_ya", "_xb", "_yb")
    )


def distance_lookup(pairs: DataFrame, distances: DataFrame, a: str, b: str) -> DataFrame:
    """Symmetric lookup in a table of pairs a < b: 0 for equal ids, NULL when absent."""
    keyed = pairs.withColumns({"id_a": F.least(a, b), "id_b": F.greatest(a, b)})
    return (
        keyed.join(distances, ["id_a", "id_b"], "left")
        .withColumn("metres", F.when(F.col(a) == F.col(b), F.lit(0).cast("bigint")).otherwise(F.col("metres")))
        .drop("id_a", "id_b")
    )


def polygon_column(geometry_type: Column, coordinates: Column) -> Column:
    """GeoJSON coordinates text as polygons > rings > points > (lon, lat)."""
    many = F.from_json(coordinates, "array<array<array<array<double>>>>")
    one = F.array(F.from_json(coordinates, "array<array<array<double>>>"))
    return F.when(geometry_type == "MultiPolygon", many).otherwise(one)


def _ring_edges(ring: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.size(ring) - 1),
        lambda i: F.struct(
            F.get(F.get(ring, i - 1), F.lit(0)).alias("x1"),
            F.get(F.get(ring, i - 1), F.lit(1)).alias("y1"),
            F.get(F.get(ring, i), F.lit(0)).alias("x2"),
            F.get(F.get(ring, i), F.lit(1)).alias("y2"),
        ),
    )


def polygon_edges(zones: DataFrame, polygons: str = "polygons") -> DataFrame:
    """Adds the edges of all rings and the bounding box."""
    edges = F.flatten(F.transform(F.flatten(F.col(polygons)), _ring_edges))
    df = zones.withColumn("edges", edges)
    xs, ys = F.transform("edges", lambda e: e["x1"]), F.transform("edges", lambda e: e["y1"])
    return df.withColumns(
        {"x_min": F.array_min(xs), "x_max": F.array_max(xs), "y_min": F.array_min(ys), "y_max": F.array_max(ys)}
    )


def strictly_inside(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd ray casting over all rings; points on an edge are outside."""
    crossings = F.aggregate(
        edges,
        F.lit(0),
        lambda n, e: n
        + F.when(
            ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]), 1
        ).otherwise(0),
    )
    on_edge = F.exists(
        edges,
        lambda e: ((e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"]))
        & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])),
    )
    return (crossings % 2 == 1) & ~on_edge


# Cells that cover a polygon: at most (ACROSS + 2) squared, whatever its size.
ACROSS = 16


def polygon_cells(zones: DataFrame, zone_id: str = "locationid") -> DataFrame:
    """(_zone, _level, _cx, _cy, whole, edges): grid cells that cover each polygon.

    Cells are 2 ** _level wide, and a polygon's extent is at most ACROSS cells. A cell that no edge touches lies inside the polygon as a whole, and needs
    no test, or outside, and is left out. The others keep the edges that a ray from inside them towards greater x can touch.
    """
    boxed = polygon_edges(zones).where(F.size("edges") > 0)
    extent = F.greatest(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min"))
    level = F.ceil(F.log2(F.greatest(extent, F.lit(1e-12)) / ACROSS)).cast("int")
    sized = boxed.select(F.col(zone_id).alias("_zone"), "edges", "x_min", "x_max", "y_min", "y_max", level.alias("_level")).withColumn("_w", F.pow(F.lit(2.0), F.col("_level")))
    span = {a: F.sequence(F.floor(F.col(f"{a}_min") / F.col("_w")), F.floor(F.col(f"{a}_max") / F.col("_w"))) for a in ("x", "y")}
    cells = sized.withColumn("_ys", span["y"]).withColumn("_cx", F.explode(span["x"])).withColumn("_cy", F.explode("_ys"))
    slack = F.col("_w") * 1e-6  # covers the rounding of the cell numbers
    low = {a: F.col(f"_c{a}") * F.col("_w") - slack for a in ("x", "y")}
    high = {a: (F.col(f"_c{a}") + 1) * F.col("_w") + slack for a in ("x", "y")}

    def reaches(e: Column) -> Column:
        return (F.greatest(e["x1"], e["x2"]) >= low["x"]) & (F.greatest(e["y1"], e["y2"]) >= low["y"]) & (F.least(e["y1"], e["y2"]) <= high["y"])

    ahead = cells.withColumn("edges", F.filter("edges", reaches)).where(F.size("edges") > 0)
    near = F.exists("edges", lambda e: F.least(e["x1"], e["x2"]) <= high["x"])  # an edge's box, so never too few
    middle = [(F.col(f"_c{a}") + 0.5) * F.col("_w") for a in ("x", "y")]
    tested = ahead.withColumn("whole", ~near).withColumn("_in", strictly_inside(F.col("edges"), *middle))
    kept = tested.where(~F.col("whole") | F.col("_in"))
    edges = F.when(~F.col("whole"), F.col("edges"))
    return kept.select("_zone", "_level", F.col("_cx").cast("bigint").alias("_cx"), F.col("_cy").cast("bigint").alias("_cy"), "whole", edges.alias("edges"))


def points_in_polygons(points: DataFrame, zones: DataFrame, zone_id: str = "locationid") -> DataFrame:
    """Left spatial join: every point with the zones it lies within, NULL when there is none.

    points has x and y; zones has the polygons column. Points meet polygons through the cells that cover them, whose size follows the
    polygon's; the exact test, for cells at a border, is part of the join condition. Points are looked up once for each size of
    cells; where there are several sizes, a point's answers are then brought together. Points without coordinates lie nowhere.
    """
    cells = cut_lineage(polygon_cells(zones, zone_id))
    found = cells.groupBy("_level").agg(F.count("*").alias("n")).collect()
    cells, levels = _sent(cells.withColumnsRenamed({"_cx": "_zx", "_cy": "_zy"}), sum(r.n for r in found)), sorted(r._level for r in found)
    if not levels:
        return points.withColumn(zone_id, F.lit(None).cast(zones.schema[zone_id].dataType))
    # a generator in the lookup would repeat the points without a zone
    keyed = points if len(levels) == 1 else points.withColumn("_point", F.monotonically_increasing_id())
    at = keyed.withColumn("_at", F.lit(levels[0]) if len(levels) == 1 else F.explode(F.array(*map(F.lit, levels))))
    width = F.pow(F.lit(2.0), F.col("_at"))
    located = at.withColumns({f"_c{a}": F.floor(F.col(a) / width) for a in ("x", "y")})
    inside = F.col("whole") | strictly_inside(F.col("edges"), F.col("x"), F.col("y"))
    met = (F.col("_at") == F.col("_level")) & (F.col("_cx") == F.col("_zx")) & (F.col("_cy") == F.col("_zy")) & inside
    joined = located.join(cells, met, "left")
    if len(levels) == 1:
        return joined.select(*points.columns, F.col("_zone").alias(zone_id))
    grouped = joined.groupBy("_point").agg(F.first(F.struct(*[F.col(c) for c in points.columns])).alias("_row"), F.collect_list("_zone").alias("_zones"))
    return grouped.select("_row.*", F.explode_outer("_zones").alias(zone_id))


def polygon_centroid(zones: DataFrame, polygons: str = "polygons", zone_id: str = "locationid") -> DataFrame:
    """Area-weighted centroid; the rings after a polygon's first are holes."""
    rings = (
        zones.select(zone_id, F.explode(polygons).alias("_poly"))
        .select(zone_id, F.posexplode("_poly").alias("_i", "_ring"))
        .withColumn("_e", F.explode(_ring_edges(F.col("_ring"))))
    )
    cross = F.col("_e.x1") * F.col("_e.y2") - F.col("_e.x2") * F.col("_e.y1")
    parts = rings.groupBy(zone_id, "_i", "_ring").agg(
        F.sum(cross).alias("_a"),
        F.sum((F.col("_e.x1") + F.col("_e.x2")) * cross).alias("_x"),
        F.sum((F.col("_e.y1") + F.col("_e.y2")) * cross).alias("_y"),
    )
    # orient every ring positively, then subtract the holes
    sign = F.signum("_a") * F.when(F.col("_i") == 0, 1).otherwise(-1)
    total = F.sum(sign * F.col("_a"))
    return parts.groupBy(zone_id).agg(
        (F.sum(sign * F.col("_x")) / (3 * total)).alias("Longitude"),
        (F.sum(sign * F.col("_y")) / (3 * total)).alias("Latitude"),
    )


def zone_trips(zones: DataFrame, popularity: DataFrame) -> DataFrame:
    """Zones with their total trips, 0 for zones without any."""
    pop = popularity.select(F.col("PULocationID").alias("_p"), F.col("total_trips").cast("double").alias("_n"))
    return zones.join(pop, F.col("zone") == F.col("_p"), "left").select(
        "zone", "lat", "lon", F.coalesce("_n", F.lit(0.0)).alias("trips")
    )


def zone_pull(counted: DataFrame, nearest: int = 3, eps: float = 1e-4) -> DataFrame:
    """Attractiveness of a zone: 0.8 own trips + 0.2 sum of neighbours' trips over their distance.

    counted comes from zone_trips. The nearest zones of a zone include itself; it
    does not count as its own neighbour. Zones without coordinates have no neighbours.
    """
    near = neighbours(zone_knn(counted.select("zone", "lat", "lon").withColumnRenamed("zone", "_own"), counted, nearest), "_own")
    trips = counted.select(F.col("zone").alias("_z"), F.col("trips").alias("_t"))
    others = near.join(trips, (F.col("zone") == F.col("_z")) & (F.col("zone") != F.col("_own")))
    around = others.groupBy("_own").agg(F.sum(F.col("_t") / (F.col("d") + eps)).alias("_around"))
    joined = counted.join(around, F.col("zone") == F.col("_own"), "left")
    return joined.select("zone", "lat", "lon", (0.8 * F.col("trips") + 0.2 * F.coalesce("_around", F.lit(0.0))).alias("pull"))


def _with_pull(near: DataFrame, pulled: DataFrame) -> DataFrame:
    """(lat, lon, choices): the near zones of each place with their pull and place, nearest first."""
    pull = pulled.select(F.col("zone").alias("_z"), "pull", F.col("lat").alias("zlat"), F.col("lon").alias("zlon"))
    rows = near.select("lat", "lon", F.inline("near")).join(pull, F.col("zone") == F.col("_z"))
    return rows.groupBy("lat", "lon").agg(F.sort_array(F.collect_list(F.struct("d", "zone", "pull", "zlat", "zlon"))).alias("choices"))


def greedy_routes(
    starts: DataFrame,
    zones: DataFrame,
    popularity: DataFrame,
    stops: int = 5,
    k: int = 20,
    nearest: int = 3,
    eps: float = 1e-4,
    max_km: float | None = None,
) -> DataFrame:
    """Routes of up to ``stops`` zones for all starting points at once.

    Every hop takes, among the k zones nearest to the current place, the unvisited
    one with the greatest pull per distance (ties: the nearer, then the lower id).
    starts: lat, lon and any other columns. Adds route (zone ids) and route_rad (length). A
    start without coordinates has an empty route.

    A hop is one equi-join of the routes with the choices at their place, which are
    found once for all places, those of the starts and of the zones, and checkpointed. From the second hop on only those of the
    zones are joined, sent to every task where they are counted to be few.
    """
    pulled = cut_lineage(zone_pull(cut_lineage(zone_trips(zones, popularity)), nearest, eps))
    pulled = _sent(pulled, pulled.count())
    places = starts.select("lat", "lon").union(zones.select("lat", "lon"))
    lists = cut_lineage(_with_pull(nearest_zones(places, zones, k), pulled))
    lists = lists.select(F.col("lat").alias("_llat"), F.col("lon").alias("_llon"), "choices")
    ends = zones.select(F.col("lat").alias("_llat"), F.col("lon").alias("_llon")).distinct()
    # after the first hop a route stands at a zone
    onward = cut_lineage(lists.join(ends, ["_llat", "_llon"], "left_semi"))
    onward = _sent(onward, onward.count() * k)
    kept = starts.columns
    zone_type = zones.schema["zone"].dataType.simpleString()
    routes = starts.withColumns({
        "_lat": F.col("lat").cast("double"), "_lon": F.col("lon").cast("double"), "route": F.array().cast(f"array<{zone_type}>"), "route_rad": F.lit(0.0)
    })
    for hop in range(stops):
        at = routes.join(lists if hop == 0 else onward, (F.col("_lat") == F.col("_llat")) & (F.col("_lon") == F.col("_llon")), "left")
        open_zones = F.filter("choices", lambda c: ~F.array_contains(F.col("route"), c["zone"]))
        if max_km is not None:
            open_zones = F.when(F.col("route_rad") * 6371.0088 < max_km, open_zones)
        scored = F.transform(open_zones, lambda c: F.struct((-c["pull"] / (c["d"] + eps)).alias("_s"), c["d"].alias("_d"), c["zone"].alias("_stop"), c["zlat"].alias("_zlat"), c["zlon"].alias("_zlon")))
        # a generator evaluates the choice once, however many of its fields are used
        chosen = at.select(*kept, "route", "route_rad", F.inline_outer(F.array(F.array_min(scored))))
        routes = chosen.select(
            *kept,
            F.when(F.col("_stop").isNotNull(), F.array_append("route", F.col("_stop"))).otherwise(F.col("route")).alias("route"),
            (F.col("route_rad") + F.coalesce("_d", F.lit(0.0))).alias("route_rad"),
            F.col("_zlat").alias("_lat"), F.col("_zlon").alias("_lon"),
        )
    return routes.select(*kept, "route", "route_rad")
