"""Points and polygons: assignment by bucketed joins, region filters, areas and nearest boundaries.

points(point_id, lon, lat, plate_id); rings(plate_id, ring_id, is_hole, ring) with open rings of struct<x: lon, y: lat>
that do not cross ±180 (split them there first).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import space
from ..tables import cut
from . import cells


#: Degrees of the largest cell; a box of any ring fits into two of them along each axis.
ROOT = 512.0


def candidates(points: DataFrame, rings: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of points and rings that contain them (strict ray cast).

    Rings are dealt to the cells of their own size that their boxes touch, points look into one cell of each size that
    there is: an equality join, whose pairs lie within a ring's width of each other, however dense or uneven both tables
    are. Only pairs in the ring's box meet its shape. Rows also have to agree in the columns `also`, such as a tick.
    """
    low = lambda c: F.array_min(F.transform("ring", lambda p: p[c]))
    high = lambda c: F.array_max(F.transform("ring", lambda p: p[c]))
    boxed = rings.withColumns({"_w": low("x"), "_s": low("y"), "_e": high("x"), "_n": high("y")})
    dealt = cells.dealt(boxed, [F.col("_w"), F.col("_s")], [F.col("_e"), F.col("_n")], ROOT)
    at = cells.probes(points, [F.col("lon"), F.col("lat")], ROOT, dealt)
    met = at.join(dealt.withColumnRenamed("plate_id", "ring_plate"), [*cells.keys(2), *also]).where("lon between _w and _e and lat between _s and _n")
    return met.drop(*cells.keys(2), "_w", "_s", "_e", "_n").where(space.point_in_ring(F.col("lon"), F.col("lat"), F.col("ring")))


def plates_at(points: DataFrame, rings: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """lon, lat, plate_id (and `also`): the plates with a place in an outer ring and in no hole, once for each different place.

    Points at one place are looked up once, and rings of one shape, plate and kind meet them once, however many there are.
    """
    spots = points.select("lon", "lat", *also).distinct()
    met = candidates(spots, rings.select("plate_id", "is_hole", "ring", *also).distinct(), also)
    inside = met.groupBy("lon", "lat", "ring_plate", *also).agg(F.count_if(~F.col("is_hole")).alias("o"), F.count_if("is_hole").alias("h"))
    return inside.where("o > 0 and h = 0").select("lon", "lat", F.col("ring_plate").alias("plate_id"), *also)


def containing(points: DataFrame, rings: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """point_id, plate_id of plates with the point in an outer ring and in no hole."""
    return points.select("point_id", "lon", "lat", *also).join(plates_at(points, rings, also), ["lon", "lat", *also]).select("point_id", "plate_id", *also)


def assign_plate(points: DataFrame, rings: DataFrame) -> DataFrame:
    """Points without a plate get the first (by id) that contains them, else null; others keep theirs."""
    found = plates_at(points.where("plate_id is null"), rings).groupBy("lon", "lat").agg(F.min("plate_id").alias("_found"))
    return points.join(found, ["lon", "lat"], "left").withColumn("plate_id", F.coalesce("plate_id", "_found")).select(*points.columns)


def plate_query(points: DataFrame, rings: DataFrame) -> DataFrame:
    """plate, candidates and confidence: Boundary on a ring's vertex, Certain for one plate, Uncertain for more, Unassigned for none."""
    inside = plates_at(points, rings).groupBy("lon", "lat").agg(F.min("plate_id").alias("plate"), F.count(F.lit(1)).alias("n_candidates"))
    vertex = rings.select(F.explode("ring").alias("v")).select(F.col("v.x").alias("lon"), F.col("v.y").alias("lat")).distinct().withColumn("on_ring", F.lit(True))
    rows = points.select("point_id", "lon", "lat").join(inside, ["lon", "lat"], "left").join(vertex, ["lon", "lat"], "left")
    n = F.coalesce("n_candidates", F.lit(0))
    return rows.select("point_id", "plate", n.cast("long").alias("n_candidates"), F.when(F.col("on_ring"), "Boundary").when(n == 1, "Certain").when(n > 1, "Uncertain").otherwise("Unassigned").alias("confidence"))


def assign_holes(outers: DataFrame, holes: DataFrame) -> DataFrame:
    """Each hole's smallest outer that contains its centroid, the least id on ties; null for orphans. Columns ring_id, ring.

    Holes with one centroid are looked up once, outers of one shape meet them once, by their least id.
    """
    at = holes.select("ring_id", space.ring_mean(F.col("ring"), "x").alias("lon"), space.ring_mean(F.col("ring"), "y").alias("lat"))
    met = candidates(at.select("lon", "lat").distinct(), outers.groupBy("ring").agg(F.min("ring_id").alias("plate_id")))
    best = met.groupBy("lon", "lat").agg(F.min(F.struct(F.abs(space.planar_ring_area(F.col("ring"))).alias("a"), "ring_plate")).alias("m"))
    return at.join(best, ["lon", "lat"], "left").select(F.col("ring_id").alias("hole"), F.col("m.ring_plate").alias("outer"))


def in_shell(p: Column, low: float, high: float) -> Column:
    return space.norm(p).between(low, high)


def in_cap(p: Column, centre: Column, radius: float) -> Column:
    return space.great_circle_angle(p, centre) <= radius


def slice_plane(points: DataFrame, u: Column, v: Column, width: float, height: float) -> DataFrame:
    """Orthographic coordinates in a plane and a clip to a centred rectangle. Column p."""
    cut = points.withColumn("u", space.dot(F.col("p"), u)).withColumn("v", space.dot(F.col("p"), v))
    return cut.where(F.col("u").between(-width / 2, width / 2) & F.col("v").between(-height / 2, height / 2))


def arc_distance(p: Column, a: Column, b: Column) -> Column:
    """Angle from a point to a great-circle arc: to its plane where the foot lies on it, else to the nearer end."""
    n = space.normalize(space.cross(a, b))
    return _distance(p, a, b, n, space.cross(n, a), space.cross(b, n))


def _distance(p: Column, a: Column, b: Column, n: Column, after: Column, before: Column) -> Column:
    """arc_distance() from the arc's normal n, n x a and b x n, which are worth computing once for each arc."""
    foot = (space.dot(after, p) >= 0) & (space.dot(before, p) >= 0) & (space.dot(n, n) > 0)
    ends = F.acos(space.clamp(F.greatest(space.dot(p, a), space.dot(p, b)), -1.0, 1.0))
    return F.when(foot, F.abs(F.asin(space.clamp(space.dot(p, n), -1.0, 1.0)))).otherwise(ends)


def nearest_boundary(points: DataFrame, boundaries: DataFrame, reach_deg: float | None = None) -> DataFrame:
    """point_id, boundary_id, degrees: the nearest boundary of each point (columns point_id, lon, lat; lon0, lat0, lon1, lat1).

    Points that have none within the reach are looked up again with twice the reach, up to the whole sphere. The
    first reach, where none is given, follows the number of different lines: a few should be within it on average.
    Distances that are equal to 1e-9 degrees go to the least id. No boundaries give no rows. Points at one place are
    looked up once, and boundaries with the same ends meet them once, by their least id.
    """
    lines = cut(boundaries.groupBy("lon0", "lat0", "lon1", "lat1").agg(F.min("boundary_id").alias("boundary_id")))
    if reach_deg is None:
        reach_deg = min(5.0, max(0.1, 2 * math.sqrt(41_253 / max(1, lines.count()))))  # square degrees of the sphere
    spots = cut(points.groupBy("lon", "lat").agg(F.min("point_id").alias("point_id")))
    found, left, reach = None, spots, reach_deg
    while True:
        some = cut(within_reach(left, lines, reach))
        found = some if found is None else found.unionByName(some)
        left = cut(left.join(some.select("point_id"), "point_id", "left_anti"))
        if reach >= 180 or left.isEmpty():
            break
        reach = min(180.0, 2 * reach)
    at = spots.join(found, "point_id").drop("point_id")
    return points.select("point_id", "lon", "lat").join(at, ["lon", "lat"]).select("point_id", "boundary_id", "degrees")


def within_reach(points: DataFrame, boundaries: DataFrame, reach_deg: float) -> DataFrame:
    """nearest_boundary() of the points that have one within the reach.

    Segments are dealt to the buckets of their arcs' boxes, which may reach nearer to a pole than both ends, widened by the reach (by latitude in longitude, up to
    all the way round near the poles); points have one bucket each. Longitudes are wrapped.
    """
    cols = max(1, int(360 / reach_deg))
    size = 360 / cols
    top = F.least(F.greatest(F.abs("_south"), F.abs("_north")) + reach_deg, F.lit(89.0))
    wide = F.least(reach_deg / F.cos(F.radians(top)), F.lit(180.0))
    low = F.floor((F.least("lon0", "lon1") - wide + 180) / size).cast("int")
    high = F.least(F.floor((F.greatest("lon0", "lon1") + wide + 180) / size).cast("int"), low + cols - 1)
    unit = lambda la, lo: space.latlon_to_unit(F.col(la), F.col(lo))
    arcs = boundaries.withColumns({"_a": unit("lat0", "lon0"), "_b": unit("lat1", "lon1")})
    arcs = arcs.withColumn("_n", space.normalize(space.cross(F.col("_a"), F.col("_b"))))
    arcs = arcs.withColumns({"_after": space.cross(F.col("_n"), F.col("_a")), "_before": space.cross(F.col("_b"), F.col("_n"))})
    # An arc reaches its circle's greatest latitude between its ends where both directions into it lead polewards.
    peak, real = F.degrees(F.acos(F.least(F.abs(F.col("_n.z")), F.lit(1.0)))), space.dot(F.col("_n"), F.col("_n")) > 0
    north, south = (F.col("_after.z") > 0) & (F.col("_before.z") > 0) & real, (F.col("_after.z") < 0) & (F.col("_before.z") < 0) & real
    arcs = arcs.withColumns({"_south": F.least("lat0", "lat1", F.when(south, -peak)), "_north": F.greatest("lat0", "lat1", F.when(north, peak))})
    dealt = arcs.withColumn("_bx", F.explode(F.sequence(low, high))).withColumn("_bx", F.pmod("_bx", F.lit(cols)))
    y = lambda c: F.floor((F.least(F.greatest(c, F.lit(-90.0)), F.lit(90.0)) + 90) / size).cast("int")
    dealt = dealt.withColumn("_by", F.explode(F.sequence(y(F.col("_south") - reach_deg), y(F.col("_north") + reach_deg))))
    at = points.select("point_id", unit("lat", "lon").alias("_p"), F.pmod(F.floor((F.col("lon") + 180) / size).cast("int"), F.lit(cols)).alias("_bx"), y(F.col("lat")).alias("_by"))
    d = F.degrees(_distance(*(F.col(c) for c in ("_p", "_a", "_b", "_n", "_after", "_before"))))
    met = at.join(dealt, ["_bx", "_by"]).select("point_id", "boundary_id", d.alias("d")).where(F.col("d") <= reach_deg)
    return met.groupBy("point_id").agg(F.min(F.struct(F.round("d", 9).alias("r"), "boundary_id", "d")).alias("m")).select("point_id", F.col("m.boundary_id").alias("boundary_id"), F.col("m.d").alias("degrees"))


def in_local_box(p: Column, centre: tuple[float, float, float], half: tuple[float, float, float]) -> Column:
    return (F.abs(p["x"] - centre[0]) <= half[0]) & (F.abs(p["y"] - centre[1]) <= half[1]) & (F.abs(p["z"] - centre[2]) <= half[2])


def in_patch(p: Column, box: tuple[float, float, float, float], low: float, high: float, radius: float = 1.0) -> Column:
    """In a lon/lat box (west, south, east, north) and between two altitudes over the radius."""
    unit = space.normalize(p)
    return (space.norm(p) - radius).between(low, high) & space.in_bbox(space.unit_lon(unit), space.unit_lat(unit), *box)


def in_polygon(p: Column, ring: Column) -> Column:
    unit = space.normalize(p)
    return space.point_in_ring(space.unit_lon(unit), space.unit_lat(unit), ring)
