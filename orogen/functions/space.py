"""Column functions on vectors, quaternions, points of the unit sphere and rings. Vectors are struct<x,y,z>, quaternions struct<x,y,z,w>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def vec(x, y, z) -> Column:
    number = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(number(x).cast("double").alias("x"), number(y).cast("double").alias("y"), number(z).cast("double").alias("z"))


def quat(x, y, z, w) -> Column:
    number = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(number(x).alias("x"), number(y).alias("y"), number(z).alias("z"), number(w).alias("w"))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, where it would otherwise be written out at each use."""
    return F.transform(F.array(value), body)[0]


IDENTITY = (0.0, 0.0, 0.0, 1.0)


def vec_add(a: Column, b: Column) -> Column:
    return vec(a["x"] + b["x"], a["y"] + b["y"], a["z"] + b["z"])


def vec_sub(a: Column, b: Column) -> Column:
    return vec(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"])


def vec_scale(a: Column, s) -> Column:
    return vec(a["x"] * s, a["y"] * s, a["z"] * s)


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """The zero vector stays zero."""
    n = norm(a)
    part = lambda c: F.when(n > 0, a[c] / n).otherwise(0.0)
    return vec(part("x"), part("y"), part("z"))


def quat_multiply(a: Column, b: Column) -> Column:
    """Hamilton product, not renormalised."""
    return quat(
        a["w"] * b["x"] + a["x"] * b["w"] + a["y"] * b["z"] - a["z"] * b["y"],
        a["w"] * b["y"] - a["x"] * b["z"] + a["y"] * b["w"] + a["z"] * b["x"],
        a["w"] * b["z"] + a["x"] * b["y"] - a["y"] * b["x"] + a["z"] * b["w"],
        a["w"] * b["w"] - a["x"] * b["x"] - a["y"] * b["y"] - a["z"] * b["z"],
    )


def quat_norm(q: Column) -> Column:
    return F.sqrt(q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"] + q["w"] * q["w"])


def quat_normalize(q: Column) -> Column:
    """Identity for the zero quaternion."""

    def body(v: Column) -> Column:
        part = lambda c, other: F.when(v["n"] > 0, v["q"][c] / v["n"]).otherwise(other)
        return quat(part("x", 0.0), part("y", 0.0), part("z", 0.0), part("w", 1.0))

    return let(q, lambda v: let(F.struct(v.alias("q"), quat_norm(v).alias("n")), body))


def quat_inverse(q: Column) -> Column:
    """Conjugate over the squared norm; identity for the zero quaternion."""
    n2 = q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"] + q["w"] * q["w"]
    part = lambda v, other: F.when(n2 > 0, v / n2).otherwise(other)
    return quat(part(-q["x"], 0.0), part(-q["y"], 0.0), part(-q["z"], 0.0), part(q["w"], 1.0))


def from_axis_angle(axis: Column, angle: Column) -> Column:
    """The axis is taken as a unit vector."""
    s = F.sin(angle / 2)
    return quat(axis["x"] * s, axis["y"] * s, axis["z"] * s, F.cos(angle / 2))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def angle_between(a: Column, b: Column) -> Column:
    d = a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"] + a["w"] * b["w"]
    return 2 * F.acos(clamp(F.abs(d), 0.0, 1.0))


def rotate(p: Column, q: Column) -> Column:
    """q p q⁻¹ for a point or vector."""
    turned = let(quat_multiply(q, quat(p["x"], p["y"], p["z"], 0.0)), lambda h: quat_multiply(h, quat_inverse(q)))
    return let(turned, lambda r: vec(r["x"], r["y"], r["z"]))


def rotate_line(line: Column, q: Column) -> Column:
    """For an array of points."""
    return F.transform(line, lambda p: rotate(p, q))


def compose(first: Column, then: Column) -> Column:
    """`first` is applied before `then`, so the product is then * first."""
    return quat_multiply(then, first)


def rotation_angle(q: Column) -> Column:
    """2 acos(w), in 0 to 2π: the shorter way round is not chosen."""
    return 2 * F.acos(clamp(q["w"], -1.0, 1.0))


def rotation_axis(q: Column) -> Column:
    """The unit axis; +X when there is no rotation."""
    s = F.sqrt(q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"])
    part = lambda c, other: F.when(s > EPS, q[c] / s).otherwise(other)
    return vec(part("x", 1.0), part("y", 0.0), part("z", 0.0))


def is_identity(q: Column, eps: float = EPS) -> Column:
    """Up to sign."""
    return (F.abs(q["x"]) < eps) & (F.abs(q["y"]) < eps) & (F.abs(q["z"]) < eps) & (F.abs(F.abs(q["w"]) - 1) < eps)


def is_unit(q: Column, off: float = 1e-6) -> Column:
    """Validity flag of the stable variants: the norm is off one by no more than this."""
    return F.abs(quat_norm(q) - 1) <= off


def wrap_azimuth_microdeg(c: Column) -> Column:
    """To ±180 degrees."""
    turn = 360_000_000
    m = c.cast("long") % turn
    return F.when(m > turn // 2, m - turn).when(m < -(turn // 2), m + turn).otherwise(m).cast("int")


def clamp_elevation_microdeg(c: Column) -> Column:
    return F.least(F.greatest(c.cast("long"), F.lit(-90_000_000)), F.lit(90_000_000)).cast("int")


def euler_pole_axis(azimuth_microdeg: Column, elevation_microdeg: Column) -> Column:
    az, el = F.radians(azimuth_microdeg / 1e6), F.radians(elevation_microdeg / 1e6)
    return vec(F.cos(el) * F.cos(az), F.cos(el) * F.sin(az), F.sin(el))


def stage_rotation(azimuth_microdeg: Column, elevation_microdeg: Column, angle_microdeg: Column, fraction: Column) -> Column:
    """The part of a segment's rotation, the fraction clamped to 0..1."""
    return from_axis_angle(euler_pole_axis(azimuth_microdeg, elevation_microdeg), F.radians(angle_microdeg / 1e6) * clamp(fraction, 0.0, 1.0))


def latlon_to_unit(lat: Column, lon: Column) -> Column:
    a, b = F.radians(lat), F.radians(lon)
    return vec(F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a))


def unit_lat(p: Column) -> Column:
    return F.degrees(F.asin(clamp(p["z"], -1.0, 1.0)))


def unit_lon(p: Column) -> Column:
    return F.degrees(F.atan2(p["y"], p["x"]))


def great_circle_angle(a: Column, b: Column) -> Column:
    """atan2 of cross and dot products: good at small and large angles."""
    return F.atan2(norm(cross(a, b)), dot(a, b))


def great_circle_distance(a: Column, b: Column, radius=1.0) -> Column:
    return great_circle_angle(a, b) * radius


def slerp(a: Column, b: Column, t: Column) -> Column:
    return weighted(a, (w := slerp_weights(great_circle_angle(a, b), t))[0], b, w[1])


def slerp_weights(w: Column, t: Column) -> tuple[Column, Column]:
    """What both points, w apart, weigh in the one at the part t of the arc between them."""
    s = F.sin(w)
    flat = F.abs(s) < EPS
    return F.when(flat, 1 - t).otherwise(F.sin((1 - t) * w) / s), F.when(flat, t).otherwise(F.sin(t * w) / s)


def weighted(a: Column, of_a: Column, b: Column, of_b: Column) -> Column:
    return vec(*(of_a * a[c] + of_b * b[c] for c in "xyz"))


def great_circle_arc(a: Column, b: Column, n: int) -> Column:
    """n + 1 points from a to b."""
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: slerp(a, b, i / float(n)))


def triangle_excess(a: Column, b: Column, c: Column) -> Column:
    """Area of the spherical triangle, with the sign of its triple product (Van Oosterom and Strackee's form)."""
    return 2 * F.atan2(dot(a, cross(b, c)), 1 + dot(a, b) + dot(b, c) + dot(c, a))


def east(p: Column) -> Column:
    """Unit east at a point; +Y at the poles."""
    flat = F.sqrt(p["x"] * p["x"] + p["y"] * p["y"])
    return vec(F.when(flat > EPS, -p["y"] / flat).otherwise(0.0), F.when(flat > EPS, p["x"] / flat).otherwise(1.0), 0.0)


def north(p: Column) -> Column:
    return cross(p, east(p))


def tangent_angle(p: Column, direction: Column) -> Column:
    """From east, anticlockwise."""
    return F.atan2(dot(direction, north(p)), dot(direction, east(p)))


def azimuth(p: Column, v: Column) -> Column:
    """From north, clockwise, in 0 to 2π; 0 for the zero vector."""
    a = F.atan2(dot(v, east(p)), dot(v, north(p)))
    return F.when(norm(v) < EPS, 0.0).when(a < 0, a + 2 * F.pi()).otherwise(a)


def linear_velocity(omega: Column, p: Column) -> Column:
    return cross(omega, p)


def boundary_normal(p: Column, tangent: Column, left: Column, right: Column) -> Column:
    n = normalize(cross(p, tangent))
    sign = F.when(left > right, -1.0).otherwise(1.0)
    return vec_scale(n, sign)


def ring_open(ring: Column) -> Column:
    """Without the closing vertex."""
    closed = (F.size(ring) > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1))
    return F.when(closed, F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))).otherwise(ring)


def spherical_ring_area(ring: Column) -> Column:
    """Signed area of an open ring of unit points: a fan of triangle excesses from its first vertex; 0 under three vertices."""
    fan = F.sequence(F.lit(2), F.size(ring) - 1)
    total = F.aggregate(fan, F.lit(0.0), lambda s, i: s + triangle_excess(F.element_at(ring, 1), F.element_at(ring, i), F.element_at(ring, i + 1)))
    return F.when(F.size(ring) < 3, 0.0).otherwise(total)


def planar_ring_area(ring: Column, x: str = "x", y: str = "y") -> Column:
    """Signed shoelace area of an open ring."""
    n = F.size(ring)
    at = lambda i: F.element_at(ring, (i % n + 1).cast("int"))
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + at(i)[x] * at(i + 1)[y] - at(i + 1)[x] * at(i)[y])
    return F.when(n < 3, 0.0).otherwise(total / 2)


def is_ccw(ring: Column) -> Column:
    return planar_ring_area(ring) >= 0


def ring_mean(ring: Column, c: str) -> Column:
    """One coordinate of the mean of an open ring's vertices."""
    return F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[c], lambda s: s / F.size(ring))


def point_in_ring(x: Column, y: Column, ring: Column, cx: str = "x", cy: str = "y") -> Column:
    """Strict planar ray cast on an open ring."""
    n = F.size(ring)
    at = lambda i: F.element_at(ring, (i % n + 1).cast("int"))

    def crossed(inside, i):
        a, b = at(i), at(i + 1)
        hit = ((a[cy] > y) != (b[cy] > y)) & (x < (b[cx] - a[cx]) * (y - a[cy]) / (b[cy] - a[cy]) + a[cx])
        return inside != F.coalesce(hit, F.lit(False))

    return F.when(n < 3, F.lit(False)).otherwise(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), crossed))


def point_on_ring_vertex(x: Column, y: Column, ring: Column, off: float = 1e-10) -> Column:
    return F.exists(ring, lambda p: (F.abs(p["x"] - x) < off) & (F.abs(p["y"] - y) < off))


def ring_canonical(ring: Column) -> Column:
    """Anticlockwise, from the least vertex, closed."""
    n = F.size(ring)
    turned = F.when(is_ccw(ring), ring).otherwise(F.reverse(ring))
    at = F.array_position(turned, F.array_min(turned)).cast("int")
    started = F.concat(F.slice(turned, at, n), F.slice(turned, 1, at - 1))
    return F.when(n == 0, ring).otherwise(F.concat(started, F.slice(started, 1, 1)))


def in_bbox(lon: Column, lat: Column, west: float, south: float, east_: float, north_: float) -> Column:
    return lon.between(west, east_) & lat.between(south, north_)


def strike_slip_sense(tangential: Column, off: float = 1e-12) -> Column:
    return F.when(tangential > off, "right-lateral").when(tangential < -off, "left-lateral").otherwise("none")


def obliquity_deg(tangential: Column, normal: Column) -> Column:
    return F.degrees(F.atan2(F.abs(tangential), F.abs(normal)))


def bounds_95(rate: Column, sigma: Column) -> tuple[Column, Column]:
    return rate - 1.96 * sigma, rate + 1.96 * sigma


def segment_tangent(p: Column, q: Column) -> Column:
    """The direction from p to q in the tangent plane of p; east where they are one point, or opposite."""
    flat = let(vec_sub(q, p), lambda d: vec_sub(d, vec_scale(p, dot(d, p))))
    return let(flat, lambda t: F.when(norm(t) > EPS, normalize(t)).otherwise(east(p)))


def convergence_rate(normal: Column) -> Column:
    return F.greatest(-normal, F.lit(0.0))


def divergence_rate(normal: Column) -> Column:
    return F.greatest(normal, F.lit(0.0))


def bbox_from_center(lon: Column, lat: Column, half_lon: float, half_lat: float) -> Column:
    """Struct of west, south, east, north; latitudes are clamped, longitudes are not wrapped."""
    return F.struct((lon - half_lon).alias("west"), F.greatest(lat - half_lat, F.lit(-90.0)).alias("south"), (lon + half_lon).alias("east"), F.least(lat + half_lat, F.lit(90.0)).alias("north"))


def bounds_in_common(a: list[Column], b: list[Column]) -> Column:
    """The rectangle that two (west, south, east, north) share; null where they only touch or do not meet."""
    w, s, e, n = F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])
    return F.when((w < e) & (s < n), F.struct(w.alias("west"), s.alias("south"), e.alias("east"), n.alias("north")))


def ring_neighbours(ring: Column) -> Column:
    """Each vertex of an open ring (at) with the one before and the one after it."""
    n = F.size(ring)
    return F.transform(ring, lambda p, i: F.struct(p.alias("at"), F.element_at(ring, F.when(i == 0, n).otherwise(i)).alias("before"), F.element_at(ring, ((i + 1) % n + 1).cast("int")).alias("after")))


def double_order(x: Column) -> list[Column]:
    """Keys of a total order: numbers as they are, minus zero before zero, NaN last (Spark has NaN last, and both zeros equal)."""
    sign = F.when(x == 0, F.when(F.substring(x.cast("string"), 1, 1) == "-", 0).otherwise(1)).otherwise(0)
    return [x, sign]


def spherical_centroid(line: Column) -> Column:
    """The unit vector along the mean of unit points; zero where they cancel."""
    total = F.aggregate(line, vec(0, 0, 0), vec_add)
    return let(total, normalize)
