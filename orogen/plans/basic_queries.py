"""Queries on vectors, rotations, predicates, orders and bounds: one for each family of column functions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..domain import sql, table
from ..functions import ids, space
from ..operators import grid, motion, rates, spatial
from ..registry import query
from ..tables import r6
from .grid_queries import SHIFTED, WORLD, cells
from .measure_queries import _AT, _ENDS, _OMEGA, _R, at, ends, omegas
from .motion_queries import _ONE_TICK, _at_57, _mul

_QS = """with s as (select segment_id, plate_id, tick_a, tick_b, radians(azimuth / 1e6) as az, radians(elevation / 1e6) as el, radians(angle / 1e6) as an from segments),
q as (select *, cos(el)*cos(az)*sin(an/2) as x, cos(el)*sin(az)*sin(an/2) as y, sin(el)*sin(an/2) as z, cos(an/2) as w from s)
"""


def quats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "segments")
    return s.select("segment_id", "plate_id", space.stage_rotation(F.col("azimuth"), F.col("elevation"), F.col("angle"), F.lit(1.0)).alias("q"))


@query(sql("boundaries", _ENDS + "select boundary_id, " + _R(("ax + bx", "sum_x"), ("az - bz", "off_z"), ("ay * 2.5", "scaled_y"), ("ax*bx + ay*by_ + az*bz", "dot"), ("ay*bz - az*by_", "cross_x"), ("sqrt(power(ax+bx,2)+power(ay+by_,2)+power(az+bz,2))", "norm"),
  ("(az + bz) / sqrt(power(ax+bx,2)+power(ay+by_,2)+power(az+bz,2))", "unit_z"), ("0.0", "zero")) + " from g"))
def f1_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q = F.col("p"), F.col("q")
    total = space.vec_add(p, q)
    zero = space.normalize(space.vec_sub(p, p))
    parts = {"sum_x": total["x"], "off_z": space.vec_sub(p, q)["z"], "scaled_y": space.vec_scale(p, 2.5)["y"], "dot": space.dot(p, q), "cross_x": space.cross(p, q)["x"], "norm": space.norm(total), "unit_z": space.normalize(total)["z"], "zero": space.norm(zero)}
    return ends(spark, sf_dir).select("boundary_id", *(r6(c).alias(n) for n, c in parts.items()))


@query(sql("segments", _QS + "select segment_id, " + _R(("x*cos(0.3) + y*sin(0.3)", "x"), ("y*cos(0.3) - x*sin(0.3)", "y"), ("w*sin(0.3) + z*cos(0.3)", "z"), ("w*cos(0.3) - z*sin(0.3)", "w"), ("-x", "inverse_x"), ("w", "inverse_w"), ("degrees(2 * acos(least(1, abs(w*cos(0.3) + z*sin(0.3)))))", "between")) + " from q"))
def f2_quaternions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with a turn about the pole by 0.6, inverses, and the angle between both."""
    turn = space.from_axis_angle(space.vec(0, 0, 1), F.lit(0.6))
    rows = quats(spark, sf_dir).withColumn("t", turn).withColumn("m", space.quat_multiply(F.col("q"), F.col("t"))).withColumn("i", space.quat_inverse(F.col("q")))
    return rows.select("segment_id", *(r6(F.col(f"m.{c}")).alias(c) for c in "xyzw"), r6(F.col("i.x")).alias("inverse_x"), r6(F.col("i.w")).alias("inverse_w"), r6(F.degrees(space.angle_between(F.col("q"), F.col("t")))).alias("between"))


@query(sql("points", f"with {_AT} select point_id, k, " + _R(("x*cos(0.5) - y*sin(0.5)", "x"), ("x*sin(0.5) + y*cos(0.5)", "y"), ("z", "z")) + " from (select point_id, 0 as k, x, y, z from pt union all select point_id, 1, -x, y, z from pt)"))
def f3_rotated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of two points turned about the pole by 0.5."""
    mirrored = space.vec(-F.col("p.x"), F.col("p.y"), F.col("p.z"))
    lines = at(spark, sf_dir).select("point_id", space.rotate_line(F.array("p", mirrored), space.from_axis_angle(space.vec(0, 0, 1), F.lit(0.5))).alias("line"))
    return lines.select("point_id", F.posexplode("line").alias("k", "p")).select("point_id", "k", *(r6(F.col(f"p.{c}")).alias(c) for c in "xyz"))


@query(sql("segments", _QS + ", f as (select *, an * least(greatest((tick_a % 40) / 20.0 - 0.5, 0), 1) / 2 as h from s) select segment_id, " + _R(("cos(el)*cos(az)", "axis_x"), ("sin(el)", "axis_z"), ("cos(el)*sin(az)*sin(h)", "y"), ("cos(h)", "w")) + " from f"))
def f4_stage_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of stage rotations, the fraction from -0.5 to 1.5 clamped."""
    s = table(spark, sf_dir, "segments")
    axis = space.euler_pole_axis(F.col("azimuth"), F.col("elevation"))
    q = space.stage_rotation(F.col("azimuth"), F.col("elevation"), F.col("angle"), (F.col("tick_a") % 40) / 20.0 - 0.5)
    return s.select("segment_id", axis.alias("a"), q.alias("q")).select("segment_id", r6(F.col("a.x")).alias("axis_x"), r6(F.col("a.z")).alias("axis_z"), r6(F.col("q.y")).alias("y"), r6(F.col("q.w")).alias("w"))


@query("""with a as (select p_partkey, (p_partkey * 123456789) % 900000000 - 450000000 as az, (p_partkey * 7654321) % 300000000 - 150000000 as el from part)
select p_partkey, cast(case when az % 360000000 > 180000000 then az % 360000000 - 360000000 when az % 360000000 < -180000000 then az % 360000000 + 360000000 else az % 360000000 end as integer) as azimuth,
  cast(least(greatest(el, -90000000), 90000000) as integer) as elevation from a""")
def f5_wrapped_poles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", ((k * 123456789) % 900_000_000 - 450_000_000).alias("az"), ((k * 7654321) % 300_000_000 - 150_000_000).alias("el"))
    return rows.select("p_partkey", space.wrap_azimuth_microdeg(F.col("az")).alias("azimuth"), space.clamp_elevation_microdeg(F.col("el")).alias("elevation"))


@query(sql("segments", _QS + "select segment_id, " + _R(("degrees(an)", "angle"), ("cos(el)*cos(az)", "axis_x"), ("sin(el)", "axis_z"), ("w*w + x*x + y*y + z*z", "with_inverse")) + ", false as is_identity, true as no_turn, true as is_unit, plate_id = 3 as is_stretched from q"))
def f6_rotation_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angle and axis, the product with the inverse, identities, and the validity flag of rotations that are off unit length."""
    q, back = F.col("q"), space.compose(F.col("q"), space.quat_inverse(F.col("q")))
    stretched = space.quat(*(F.col(f"q.{c}") * F.when(F.col("plate_id") == 3, 1.1).otherwise(1.0) for c in "xyzw"))
    return quats(spark, sf_dir).select(
        "segment_id", r6(F.degrees(space.rotation_angle(q))).alias("angle"), r6(space.rotation_axis(q)["x"]).alias("axis_x"), r6(space.rotation_axis(q)["z"]).alias("axis_z"), r6(back["w"]).alias("with_inverse"),
        space.is_identity(q).alias("is_identity"), space.is_identity(space.quat(*(-back[c] for c in "xyzw")), 1e-9).alias("no_turn"), space.is_unit(q).alias("is_unit"), (~space.is_unit(stretched)).alias("is_stretched"),
    )


@query(sql("points", f"with {_AT} select point_id, " + _R(("x", "x"), ("y", "y"), ("z", "z"), ("lat", "lat"), ("lon", "lon")) + " from pt join points using (point_id)"))
def f7_latitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To unit vectors and back."""
    return at(spark, sf_dir).select("point_id", *(r6(F.col(f"p.{c}")).alias(c) for c in "xyz"), r6(space.unit_lat(F.col("p"))).alias("lat"), r6(space.unit_lon(F.col("p"))).alias("lon"))


@query(sql("points plates", f"with {_AT}, {_OMEGA}, v as (select pt.*, (case when point_id % 10 = 0 then 0 else 1 end) * (oy*z - oz*y) as vx, (case when point_id % 10 = 0 then 0 else 1 end) * (oz*x - ox*z) as vy, (case when point_id % 10 = 0 then 0 else 1 end) * (ox*y - oy*x) as vz from pt join om using (plate_id)), a as (select *, vx*vx + vy*vy + vz*vz as s, atan2(-vx*sin(lo) + vy*cos(lo), -vx*sin(la)*cos(lo) - vy*sin(la)*sin(lo) + vz*cos(la)) as az from v) select point_id, round(degrees(case when s < 1e-18 then 0 when az < 0 then az + 2*pi() else az end), 5) + 0.0 as azimuth from a"))
def f13_azimuths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From north, clockwise; points whose id ends in 0 do not move and have 0."""
    moved = at(spark, sf_dir).join(omegas(spark, sf_dir), "plate_id").withColumn("v", space.vec_scale(space.linear_velocity(F.col("omega"), F.col("p")), F.when(F.col("point_id") % 10 == 0, 0.0).otherwise(1.0)))
    return moved.select("point_id", (F.round(F.degrees(space.azimuth(F.col("p"), F.col("v"))), 5) + 0.0).alias("azimuth"))


@query(sql("boundaries", _ENDS + """, t as (select g.*, plate_left, plate_right, (bx-ax)/ch as tx, (by_-ay)/ch as ty, (bz-az)/ch as tz from g join boundaries using (boundary_id)),
c as (select *, ay*tz - az*ty as nx, az*tx - ax*tz as ny, ax*ty - ay*tx as nz from t), m as (select *, (case when plate_left > plate_right then -1 else 1 end) / sqrt(nx*nx + ny*ny + nz*nz) as k from c)
select boundary_id, """ + _R(("nx*k", "x"), ("ny*k", "y"), ("nz*k", "z")) + " from m"))
def f14_boundary_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "boundaries").select("boundary_id", "plate_left", "plate_right")
    rows = ends(spark, sf_dir).join(b, "boundary_id")
    n = space.boundary_normal(F.col("p"), space.normalize(space.vec_sub(F.col("q"), F.col("p"))), F.col("plate_left"), F.col("plate_right"))
    return rows.select("boundary_id", n.alias("n")).select("boundary_id", *(r6(F.col(f"n.{c}")).alias(c) for c in "xyz"))


@query(sql("boundaries", _ENDS + """, t as (select *, boundary_id % 7 = 0 as flat, bx - ax as dx, by_ - ay as dy, bz - az as dz from g), m as (select *, dx*ax + dy*ay + dz*az as d from t), p as (select *, dx - d*ax as px, dy - d*ay as py, dz - d*az as pz from m)
select boundary_id, """ + _R(*((f"case when flat then {e} else {c} / sqrt(px*px + py*py + pz*pz) end", n) for n, c, e in (("x", "px", "-sin(lo)"), ("y", "py", "cos(lo)"), ("z", "pz", "0.0")))) + " from p"))
def f15_segment_tangents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The direction of a leg in the tangent plane of its start; legs of no length (each seventh here) have east."""
    rows = ends(spark, sf_dir).select("boundary_id", "p", F.when(F.col("boundary_id") % 7 == 0, F.col("p")).otherwise(F.col("q")).alias("q"))
    return rows.select("boundary_id", space.segment_tangent(F.col("p"), F.col("q")).alias("t")).select("boundary_id", *(r6(F.col(f"t.{c}")).alias(c) for c in "xyz"))


@query("""with r as (select c_custkey, (c_custkey % 7 - 3) * 0.5::double as t, (c_custkey % 5 - 2) * 0.25::double as n from customer)
select c_custkey, case when t > 0 then 'right-lateral' when t < 0 then 'left-lateral' else 'none' end as sense, greatest(-n, 0.0) as convergence, greatest(n, 0.0) as divergence, abs(t) as slip, round(degrees(atan2(abs(t), abs(n))), 6) + 0.0 as obliquity from r""")
def f16_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k, ((k % 7 - 3) * 0.5).alias("t"), ((k % 5 - 2) * 0.25).alias("n"))
    t, n = F.col("t"), F.col("n")
    return rows.select("c_custkey", space.strike_slip_sense(t).alias("sense"), space.convergence_rate(n).alias("convergence"), space.divergence_rate(n).alias("divergence"), F.abs(t).alias("slip"), r6(space.obliquity_deg(t, n)).alias("obliquity"))


@query("""with p as (select c_custkey, cast(c_custkey % 13 as double) as x, cast(c_custkey % 11 as double) as y from customer)
select c_custkey, (x >= 2 and x < 8 and y >= 1 and y < 7) as inside, (x in (2, 8) and y in (1, 7)) as on_vertex from p""")
def f18_points_in_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ray cast against a box; its flavour that counts vertices tells these apart."""
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((2, 1), (8, 1), (8, 7), (2, 7))))
    k = F.col("c_custkey")
    p = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k, (k % 13).cast("double").alias("x"), (k % 11).cast("double").alias("y"), ring.alias("ring"))
    return p.select("c_custkey", space.point_in_ring(F.col("x"), F.col("y"), F.col("ring")).alias("inside"), space.point_on_ring_vertex(F.col("x"), F.col("y"), F.col("ring")).alias("on_vertex"))


@query(sql("points cells", """with p as (select point_id, cast(least(greatest(floor((lon * 1.1 + 180) / 10), 0), 35) as bigint) as c, cast(least(greatest(floor((90 - lat * 1.2) / 10), 0), 17) as bigint) as r from points)
select p.point_id, tick, p.r, p.c, round(value, 4) + 0.0 as value from p join cells using (r, c)"""))
def f20_values_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell of each place, clamped to the raster's edge, and its value at every tick."""
    p = table(spark, sf_dir, "points").select("point_id", (F.col("lon") * 1.1).alias("lon"), (F.col("lat") * 1.2).alias("lat"))
    return grid.value_at(p, cells(spark, sf_dir), 36, 18, WORLD).select("point_id", "tick", "r", "c", (F.round("value", 4) + 0.0).alias("value"))


@query(sql("points", "select point_id, greatest(lat - 8, -90.0) as south, least(lat + 8, 90.0) as north, lon - 12 as west, lon + 12 as east from points where 10.25 between lon - 12 and lon + 12 and 20.25 between greatest(lat - 8, -90) and least(lat + 8, 90)"))
def p6_boxes_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes around points that hold a given place; latitudes are clamped, longitudes are not."""
    p = table(spark, sf_dir, "points").withColumn("box", space.bbox_from_center(F.col("lon"), F.col("lat"), 12.0, 8.0))
    inside = F.lit(10.25).between(F.col("box.west"), F.col("box.east")) & F.lit(20.25).between(F.col("box.south"), F.col("box.north"))
    return p.where(inside).select("point_id", "box.south", "box.north", "box.west", "box.east")


@query(sql("points", "select point_id, plate_id from points where plate_id is not null"))
def p7_has_plate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.with_plate(table(spark, sf_dir, "points")).select("point_id", "plate_id")


@query("""with r as (select c_custkey, (c_custkey % 7 - 3) * 0.5 as t, (c_custkey % 5 - 2) * 0.25 as n from customer)
select c_custkey, 'divergent' as kind from r where n > 0 union all select c_custkey, 'convergent' from r where n < 0 union all select c_custkey, 'strike-slip' from r where abs(t) > 1e-12""")
def p8_rate_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k, ((k % 7 - 3) * 0.5).alias("tangential_rate"), ((k % 5 - 2) * 0.25).alias("normal_rate"))
    kinds = [f(rows).select("c_custkey", F.lit(name).alias("kind")) for name, f in (("divergent", rates.divergent), ("convergent", rates.convergent), ("strike-slip", rates.slipping))]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


@query(sql("points", f"""with {_AT}, h as (select *, 1.0 + (point_id % 5 - 2) * 0.01 as k from pt)
select point_id, abs(x*k - 0.5) <= 0.3 and abs(y*k) <= 0.4 and abs(z*k - 0.25) <= 0.5 as in_box, k - 1 between -0.005 and 0.015 and degrees(lo) between -20 and 60 and degrees(la) between -30 and 40 as in_patch,
  k between 0.985 and 1.015 and degrees(lo) between -50 and 50 and degrees(la) > -45 and degrees(la) < 45 as in_shell_polygon from h"""))
def p9_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local boxes, patches between altitudes, and shells clipped by a polygon."""
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((-50, -45), (50, -45), (50, 45), (-50, 45))))
    p = at(spark, sf_dir).withColumn("p", space.vec_scale(F.col("p"), 1.0 + (F.col("point_id") % 5 - 2) * 0.01))
    box = spatial.in_local_box(F.col("p"), (0.5, 0.0, 0.25), (0.3, 0.4, 0.5))
    patch = spatial.in_patch(F.col("p"), (-20, -30, 60, 40), -0.005, 0.015)
    shell = spatial.in_shell(F.col("p"), 0.985, 1.015) & spatial.in_polygon(F.col("p"), ring)
    return p.select("point_id", box.alias("in_box"), patch.alias("in_patch"), shell.alias("in_shell_polygon"))


@query(sql("boundaries", "select 'boundary:' || boundary_id as feature_id, plate_left as plate_id, boundary_type, lon0, lat0, lon1, lat1 from boundaries where not is_retired"))
def p11_boundaries_as_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = motion.boundaries_as_features(table(spark, sf_dir, "boundaries"))
    return f.select("feature_id", "plate_id", "boundary_type", "lon0", "lat0", "lon1", "lat1")


@query(sql("boundaries plates", f"with {_OMEGA} select boundary_id, " + _R(("l.ox::double", "left_x"), ("l.oz::double", "left_z"), ("r.oy::double", "right_y"), ("(r.ox - l.ox)::double", "relative_x")) + " from boundaries join om l on l.plate_id = plate_left join om r on r.plate_id = plate_right"))
def j6_boundary_omegas(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = rates.boundary_omegas(table(spark, sf_dir, "boundaries"), omegas(spark, sf_dir))
    return b.select("boundary_id", r6(F.col("omega_left.x")).alias("left_x"), r6(F.col("omega_left.z")).alias("left_z"), r6(F.col("omega_right.y")).alias("right_y"), r6(F.col("omega_right.x") - F.col("omega_left.x")).alias("relative_x"))


@query(sql("velocity", """select c.j, c.i, round(e.ve, 6) + 0.0 as east, round(w.ve, 6) + 0.0 as west, round(n.ve, 6) + 0.0 as north, round(s.ve, 6) + 0.0 as south from velocity c
left join velocity e on e.j = c.j and e.i = (c.i + 1) % 36 left join velocity w on w.j = c.j and w.i = (c.i + 35) % 36 left join velocity n on n.i = c.i and n.j = c.j + 1 left join velocity s on s.i = c.i and s.j = c.j - 1"""))
def j13_grid_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grid.neighbours(table(spark, sf_dir, "velocity"), ["ve"], 36)
    return found.select("j", "i", *(r6(F.col(f"ve_{d}")).alias(d) for d in ("east", "west", "north", "south")))


@query(sql("plates segments", "select p.plate_id, t.tick from plates p, (select distinct tick_a as tick from segments) t where p.active"))
def j17_plate_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every active plate at every tick at which a segment begins."""
    ticks = table(spark, sf_dir, "segments").select(F.col("tick_a").alias("tick"))
    return motion.plate_ticks(table(spark, sf_dir, "plates").where("active"), ticks)


@query(sql("boundaries", _ENDS + """, v as (select boundary_id, 0 as pos, 0.0::double as arc from g union all select boundary_id, 1, w from g union all select boundary_id, 2, w + w from g)
select boundary_id, pos, round(arc, 6) + 0.0 as arc from v"""))
def w4_arc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Along each boundary and back again."""
    v = ends(spark, sf_dir).select("boundary_id", F.posexplode(F.array("p", "q", "p")).alias("pos", "p"))
    return rates.arc_lengths(v).select("boundary_id", "pos", r6(F.col("arc")).alias("arc"))


@query(sql("boundaries", """with v as (select boundary_id as ring_id, k, lon0 + dx as x, lat0 + dy as y, lon0 + px as before_x, lat0 + ny as after_y from boundaries,
  (values (0, 0, 0, 0, 0), (1, 6, 0, 0, 4), (2, 6, 4, 6, 4), (3, 0, 4, 6, 0)) u(k, dx, dy, px, ny)) select * from v"""))
def w7_ring_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vertex of a ring with the one before and the one after it, round the end."""
    from .space_queries import rings

    v = rings(spark, sf_dir).select("ring_id", space.ring_neighbours(F.col("ring")).alias("v")).select("ring_id", F.posexplode("v").alias("k", "v"))
    return v.select("ring_id", "k", F.col("v.at.x").alias("x"), F.col("v.at.y").alias("y"), F.col("v.before.x").alias("before_x"), F.col("v.after.y").alias("after_y"))


_REGIONAL = """with c as (select * from velocity where i < 20 and j < 12),
n as (select c.j, c.i, c.ve, e.ve as e, w.ve as w, n.ve as n, s.ve as s from c left join c e on e.j = c.j and e.i = c.i + 1 left join c w on w.j = c.j and w.i = c.i - 1 left join c n on n.i = c.i and n.j = c.j + 1 left join c s on s.i = c.i and s.j = c.j - 1)
"""


@query(sql("velocity", _REGIONAL + """select j, i, round((coalesce(e, ve) - coalesce(w, ve)) / ((case when e is null or w is null then 1 else 2 end) * pi() / 18), 6) + 0.0 as di,
  round((coalesce(n, ve) - coalesce(s, ve)) / ((case when n is null or s is null then 1 else 2 end) * pi() / 18), 6) + 0.0 as dj from n"""))
def w9_regional_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences on a part of the globe: one-sided at all four edges."""
    part = table(spark, sf_dir, "velocity").where("i < 20 and j < 12")
    return grid.gradients(part, ["ve"], 18, 36, wraps=False).select("j", "i", r6(F.col("d_ve_di")).alias("di"), r6(F.col("d_ve_dj")).alias("dj"))


@query("select c_nationkey, arg_max(c_custkey, c_acctbal) as richest, arg_min(c_custkey, c_acctbal) as poorest from customer group by c_nationkey")
def w11_first_and_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-1 choices in one aggregation, without a sort of the groups; the least key on ties."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    by = lambda sign: F.when(F.col("c_acctbal").isNotNull(), F.struct("c_acctbal", sign * F.col("c_custkey")))
    return c.groupBy("c_nationkey").agg(F.max_by("c_custkey", by(-1)).alias("richest"), F.min_by("c_custkey", by(1)).alias("poorest"))


@query(sql("boundaries", "select boundary_id, row_number() over (order by plate_left, plate_right, boundary_id) as place from boundaries order by place limit 200"))
def o1_canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page in canonical order: by left plate, right plate, then id. The order is made at the sink only."""
    page = motion.canonical_order(table(spark, sf_dir, "boundaries"), "plate_left", "plate_right", "boundary_id").limit(200)
    return page.select("boundary_id", F.row_number().over(Window.orderBy("plate_left", "plate_right", "boundary_id")).cast("long").alias("place"))  # 200 rows


@query("""with v as (select c_nationkey, c_custkey, case c_custkey % 6 when 0 then 'NaN'::double when 1 then -0.0 when 2 then 0.0 when 3 then 'inf'::double when 4 then '-inf'::double else c_acctbal end as x from customer),
k as (select *, case when isnan(x) then 3 when x = 'inf'::double then 2 when x = '-inf'::double then 0 else 1 end as g, c_custkey % 6 = 2 as positive from v)
select c_custkey, row_number() over (partition by c_nationkey order by g, case when g = 1 then x end, positive, c_custkey) as place from k""")
def o4_order_of_doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A total order: NaN last, minus zero before zero, then the key."""
    k, nan, inf = F.col("c_custkey"), float("nan"), float("inf")
    x = F.when(k % 6 == 0, nan).when(k % 6 == 1, -0.0).when(k % 6 == 2, 0.0).when(k % 6 == 3, inf).when(k % 6 == 4, -inf).otherwise(F.col("c_acctbal"))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_nationkey", "c_custkey", x.alias("x"))
    w = Window.partitionBy("c_nationkey").orderBy(*space.double_order(F.col("x")), "c_custkey")
    return rows.select("c_custkey", F.row_number().over(w).cast("long").alias("place"))


@query(sql("boundaries", """with b as (select boundary_id, least(lon0, lon1) as w, least(lat0, lat1) as s, greatest(lon0, lon1) as e, greatest(lat0, lat1) as n from boundaries),
i as (select boundary_id, greatest(w, -30.0) as west, greatest(s, -20.0) as south, least(e, 40.0) as east, least(n, 25.0) as north from b) select * from i where west < east and south < north"""))
def u5_bounds_in_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of each boundary's box in a given one; boxes that only touch have none."""
    b = table(spark, sf_dir, "boundaries")
    box = [F.least("lon0", "lon1"), F.least("lat0", "lat1"), F.greatest("lon0", "lon1"), F.greatest("lat0", "lat1")]
    common = space.bounds_in_common(box, [F.lit(x) for x in (-30.0, -20.0, 40.0, 25.0)])
    return b.select("boundary_id", common.alias("b")).where("b is not null").select("boundary_id", "b.*")


@query(sql("points plates", f"with {_AT}, {_OMEGA}, v as (select plate_id, sqrt(power(oy*z - oz*y, 2) + power(oz*x - ox*z, 2) + power(ox*y - oy*x, 2)) as s from pt join om using (plate_id)) select plate_id, count(*) as n, round(avg(s), 6) + 0.0 as mean_speed, round(min(s), 6) + 0.0 as min_speed, round(max(s), 6) + 0.0 as max_speed, round(stddev_pop(s), 6) + 0.0 as deviation from v group by plate_id"))
def a22_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rates.speed_statistics(at(spark, sf_dir).join(omegas(spark, sf_dir), "plate_id").withColumn("v", space.linear_velocity(F.col("omega"), F.col("p"))), "plate_id")
    return s.select("plate_id", "n", *(r6(F.col(c)).alias(c) for c in ("mean_speed", "min_speed", "max_speed", "deviation")))


@query(sql("points plates", f"with {_AT}, {_OMEGA} select p.point_id, " + _R(("oy*z - oz*y", "x"), ("oz*x - ox*z", "y"), ("ox*y - oy*x", "z")) + ", 'above' as band from pt p join om using (plate_id) where z > 0.5"))
def e3_kept_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampler that keeps what lies north of 30 degrees, with a note on each sample."""
    s = at(spark, sf_dir).join(omegas(spark, sf_dir), "plate_id").withColumn("v", space.linear_velocity(F.col("omega"), F.col("p")))
    kept = motion.kept_samples(s, F.col("p.z") > 0.5, band=F.lit("above"))
    return kept.select("point_id", *(r6(F.col(f"v.{c}")).alias(c) for c in "xyz"), "band")


@query(sql("plates", f"with {_OMEGA} select a.plate_id, 3::bigint as against, " + _R(("a.ox::double", "absolute_x"), ("(a.ox - b.ox)::double", "x"), ("(a.oy - b.oy)::double", "y"), ("(a.oz - b.oz)::double", "z")) + " from om a, om b where b.plate_id = 3"))
def e1_velocity_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute and relative angular velocities of a model: a function from (plate, tick) rows to omegas."""
    own = omegas(spark, sf_dir)
    model = motion.VelocityModel(lambda ticks: ticks.join(own, "plate_id"))
    t = table(spark, sf_dir, "plates").select("plate_id", F.lit(0).cast("long").alias("tick"))
    rel = model.relative(t.withColumn("against", F.lit(3).cast("long")))
    return rel.select("plate_id", "against", r6(F.col("omega.x")).alias("absolute_x"), *(r6(F.col(f"relative.{c}")).alias(c) for c in "xyz"))


_NODES = """n as (select j, i, -90 + j * 10.0 as lat, -180 + i * 10.0 + {off} as lon from (select unnest(range(0, 19)) as j) a, (select unnest(range(0, 36)) as i) b)"""


@query(sql("boundaries plates", f"""with rings as (select boundary_id as ring_id, plate_left as plate_id, boundary_id % 3 = 0 as is_hole, lon0 as w, lat0 as s, lon0 + 6 as e, lat0 + 4 as n from boundaries),
{_NODES.format(off="0.25")}, met as (select n.j, n.i, n.lat, n.lon, r.plate_id, count(*) filter (where not is_hole) as o, count(*) filter (where is_hole) as h from n join rings r on n.lon >= w and n.lon < e and n.lat >= s and n.lat < r.n group by all),
own as (select j, i, lat, lon, min(plate_id) as plate_id from met where o > 0 and h = 0 group by all), {_OMEGA},
v as (select own.*, radians(lat) as la, radians(lon) as lo, ox, oy, oz from own join om using (plate_id)),
x as (select *, cos(la)*cos(lo) as x, cos(la)*sin(lo) as y, sin(la) as z from v), c as (select *, oy*z - oz*y as vx, oz*x - ox*z as vy, ox*y - oy*x as vz from x)
select j, i, plate_id, round(-vx*sin(lo) + vy*cos(lo), 6) + 0.0 as east, round(-vx*sin(la)*cos(lo) - vy*sin(la)*sin(lo) + vz*cos(la), 6) + 0.0 as north, round(sqrt(vx*vx + vy*vy + vz*vz), 6) + 0.0 as speed from c where abs(lat) < 90"""))
def y11_sampled_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Velocities on a gridline-registered global grid of 10 degrees: plates by polygons, velocities by plates (E7)."""
    from .space_queries import rings

    nodes = grid.global_grid(spark, 10.0, "gridline").withColumn("lon", F.col("lon") + 0.25)
    field = grid.sample_field(nodes, rings(spark, sf_dir), omegas(spark, sf_dir))
    return field.where("plate_id is not null and abs(lat) < 90").select("j", "i", "plate_id", *(r6(F.col(c)).alias(c) for c in ("east", "north", "speed")))


@query(sql("points plates", f"with {_AT}, {_OMEGA} select point_id, 'plate:' || plate_id as frame, cast(round(1e6 * (ox*0 + oy*z - oz*y)) as bigint) as vx_micro, cast(round(1e6 * (oz*x - ox*z)) as bigint) as vy_micro, cast(round(1e6 * (ox*y - oy*x)) as bigint) as vz_micro from pt join om using (plate_id)"))
def y34_exchange_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Velocities to JSON records with the name of their frame, and back."""
    s = at(spark, sf_dir).join(omegas(spark, sf_dir), "plate_id").withColumn("v", space.linear_velocity(F.col("omega"), F.col("p")))
    back = motion.from_exchange(motion.velocity_exchange(s.select("point_id", "plate_id", "v"), "point_id"))
    return back.select(F.col("id").alias("point_id"), "frame", *(F.round(F.col(f"v.{c}") * 1e6).cast("long").alias(f"v{c}_micro") for c in "xyz"))


_KEPLER = """with recursive b as (select body_id, t, ecc, a_m, (m0 + sqrt(6.6743e-11 * 2e30 / (a_m*a_m*a_m)) * t) as raw from bodies, (values (0.0), (86400.0), (864000.0)) v(t)),
m as (select body_id, t, ecc, a_m, raw - 2 * pi() * floor(raw / (2 * pi())) as mean from b),
k as (select *, 0 as n, mean + ecc * sin(mean) / (1 - sin(mean + ecc) + sin(mean)) as e from m
  union all select body_id, t, ecc, a_m, mean, n + 1, e - (e - ecc * sin(e) - mean) / (1 - ecc * cos(e)) from k where n < 12)
"""


@query(sql("bodies", _KEPLER + """select body_id, t, round(a_m * (cos(e) - ecc) / 1e6, 3) + 0.0 as x, round(a_m * sqrt(1 - ecc * ecc) * sin(e) / 1e6, 3) + 0.0 as y, round(a_m * (1 - ecc * cos(e)) / 1e6, 3) + 0.0 as r from k where n = 12"""))
def y29_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions in the orbital plane; the SQL solves Kepler's equation from another first value."""
    from ..operators import stellar

    b = table(spark, sf_dir, "bodies").withColumn("parent_mass", F.lit(2e30))
    e = stellar.ephemeris(b, [0.0, 86400.0, 864000.0])
    return e.select("body_id", "t", *((F.round(F.col(c) / 1e6, 3) + 0.0).alias(c) for c in ("x", "y", "r")))


@query(sql("bodies", _KEPLER + """, v as (select *, sqrt(6.6743e-11 * 2e30 / (a_m * (1 - ecc * ecc))) as p, 2 * atan(sqrt((1 + ecc) / (1 - ecc)) * tan(e / 2)) as nu from k where n = 12)
select body_id, t, round(-p * sin(nu), 3) + 0.0 as vx, round(p * (ecc + cos(nu)), 3) + 0.0 as vy, round(sin(nu), 6) + 0.0 as sin_anomaly, round(cos(nu), 6) + 0.0 as cos_anomaly from v"""))
def y29_velocities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Velocities and true anomalies; the SQL has them from the half-angle form and the orbit's parameter."""
    from ..operators import stellar

    b = table(spark, sf_dir, "bodies").withColumn("parent_mass", F.lit(2e30))
    e = stellar.ephemeris(b, [0.0, 86400.0, 864000.0])
    at = lambda c, x, d: (F.round(x, d) + 0.0).alias(c)
    nu = F.col("true_anomaly")
    return e.select("body_id", "t", at("vx", F.col("vx"), 3), at("vy", F.col("vy"), 3), at("sin_anomaly", F.sin(nu), 6), at("cos_anomaly", F.cos(nu), 6))


@query(sql("bodies points", """with o as (select body_id, sqrt(6.6743e-11 * 2e30 / (a_m*a_m*a_m)) as n, sqrt(2 * 6.6743e-11 * mass_kg / 6e6) as v from bodies)
select body_id, round(n * 1e9, 4) + 0.0 as mean_motion, round(v / 1000, 6) + 0.0 as escape from o"""))
def f25_motions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import stellar

    b = table(spark, sf_dir, "bodies")
    n, v = stellar.mean_motion(F.col("a_m"), F.lit(2e30)), stellar.escape_velocity(F.lit(6e6), F.col("mass_kg"))
    return b.select("body_id", (F.round(n * 1e9, 4) + 0.0).alias("mean_motion"), r6(v / 1000).alias("escape"))


@query(sql("points", f"""with d as (select point_id, radians(lat) as la, asin(sin(radians(23.44)) * sin(2 * pi() * 172 / 365.25)) as dec, radians((point_id % 24 - 12) * 15.0) as h from points)
select point_id, round(degrees(acos(least(1, greatest(-1, sin(la)*sin(dec) + cos(la)*cos(dec)*cos(h))))), 5) + 0.0 as zenith from d"""))
def f26_zenith_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import stellar

    p = table(spark, sf_dir, "points").withColumn("dec", stellar.declination(F.lit(172.0), F.lit(23.44)))
    angle = stellar.zenith_angle(F.col("lat"), F.col("dec"), F.radians((F.col("point_id") % 24 - 12) * 15.0))
    return p.select("point_id", (F.round(F.degrees(angle), 5) + 0.0).alias("zenith"))


@query(sql("boundaries", "select boundary_id as ring_id, 24.0 as area, true as ccw, lon0 + 3 as mean_x, round(radians(6.0) * (sin(radians(lat0 + 4)) - sin(radians(lat0))), 6) + 0.0 as band from boundaries"))
def a15_planar_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shoelace areas, winding and means of boxes, with the area of the band that each spans on the sphere."""
    from .space_queries import rings

    r = rings(spark, sf_dir)
    band = math.radians(6.0) * (F.sin(F.radians(F.col("ring")[2]["y"])) - F.sin(F.radians(F.col("ring")[0]["y"])))
    return r.select("ring_id", r6(space.planar_ring_area(F.col("ring"))).alias("area"), space.is_ccw(F.col("ring")).alias("ccw"), space.ring_mean(F.col("ring"), "x").alias("mean_x"), r6(band).alias("band"))


@query(sql("segments boundaries plates", _ONE_TICK + """, wr as (select *, 1.0 + plate_id % 4 as wt from rot where plate_id % 5 > 0),
f as (select x as fx, y as fy, z as fz, w as fw from wr order by plate_id limit 1), s as (select tick, wt * (case when x*fx + y*fy + z*fz + w*fw < 0 then -1 else 1 end) as k, x, y, z, w from wr, f),
t as (select tick, sum(k*x) as x, sum(k*y) as y, sum(k*z) as z, sum(k*w) as w from s group by tick), n as (select *, sqrt(x*x + y*y + z*z + w*w) as n from t),
u as (select tick, -x / n as x, -y / n as y, -z / n as z, w / n as w from n), left_ as (select r.plate_id, r.tick, """ + _mul("u", "r") + " from rot r join u using (tick)) select plate_id, tick, " + _R(*((c, c) for c in "xyzw")) + " from left_"))
def a8_against_the_mantle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plates' rotations without the net rotation of all."""
    p, turned = F.col("plate_id"), _at_57(spark, sf_dir)
    net = rates.net_rotation(turned, F.when(p % 5 > 0, 1.0 + p % 4).otherwise(0.0))
    return rates.without_net_rotation(turned, net).select("plate_id", "tick", *(r6(F.col(f"q.{c}")).alias(c) for c in "xyzw"))


@query(sql("boundaries", _ENDS + ", s as (select boundary_id, ax + bx as x, ay + by_ as y, az + bz + 1 as z from g) select boundary_id, " + _R(*((f"{c} / sqrt(x*x + y*y + z*z)", c) for c in "xyz")) + " from s"))
def a16_spherical_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the triangle of each boundary and the pole."""
    c = ends(spark, sf_dir).select("boundary_id", space.spherical_centroid(F.array("p", "q", space.vec(0, 0, 1))).alias("c"))
    return c.select("boundary_id", *(r6(F.col(f"c.{k}")).alias(k) for k in "xyz"))


@query(sql("points", """select point_id, left(sha256(concat('slice', chr(10), 's' || point_id % 4, chr(10), point_id % 9, chr(10), 'mantle')), 16) as slice,
  left(sha256(concat('point', chr(10), cast(round(lat * 1000000) as bigint), chr(10), cast(round(lon * 1000000) as bigint), chr(10), point_id % 9)), 16) as point from points"""))
def f22_slices_and_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "points"), F.col("point_id")
    return p.select("point_id", ids.slice_hash(F.concat(F.lit("s"), (k % 4).cast("string")), k % 9, F.lit("mantle")).alias("slice"), ids.point_hash(F.col("lat"), F.col("lon"), k % 9).alias("point"))


@query(sql("boundaries cells", """with g as (select boundary_id as ring_id, plate_left as plate_id, boundary_id % 3 = 0 as is_hole, lon0 as w, lat0 as s, lon0 + 6 as e, lat0 + 4 as n from boundaries),
k as (select distinct r, c, -175 + (c + 0.52) * 10 as lon, 90 - (r + 0.52) * 10 as lat from cells),
met as (select k.r, k.c, g.plate_id, count(*) filter (where not is_hole) as o, count(*) filter (where is_hole) as h from k join g on lon > w and lon < e and lat > s and lat < n group by all)
select tick, m.plate_id, count(value) as n, round(avg(value), 4) + 0.0 as mean, round(min(value), 4) + 0.0 as min, round(max(value), 4) + 0.0 as max from cells join met m using (r, c) where o > 0 and h = 0 group by tick, m.plate_id"""))
def y28_zones_of_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .space_queries import rings

    zones = grid.zones_in(cells(spark, sf_dir), rings(spark, sf_dir), 36, 18, SHIFTED, at=0.52)
    stats = grid.zonal_stats(cells(spark, sf_dir), zones)
    return stats.select("tick", "plate_id", "n", *((F.round(c, 4) + 0.0).alias(c) for c in ("mean", "min", "max")))


@query(sql("bodies", """with k as (select body_id, ecc, m0, sqrt(6.6743e-11 * 2e30 / (a_m*a_m*a_m)) as n, atan2(sqrt(1 - ecc*ecc) * sin(1.0), ecc + cos(1.0)) as e from bodies), w as (select *, e - ecc * sin(e) - m0 - n * 1000000.0 as d from k)
select body_id, round((1000000.0 + (d - 2 * pi() * floor(d / (2 * pi()))) / n) / 1000, 3) + 0.0 as kiloseconds from w"""))
def y29_next_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first time after 1,000,000 s at which each body has a true anomaly of one radian."""
    from ..operators import stellar

    t = stellar.time_at_true_anomaly(F.col("a_m"), F.col("ecc"), F.col("m0"), F.lit(2e30), F.lit(1.0), F.lit(1e6))
    return table(spark, sf_dir, "bodies").select("body_id", (F.round(t / 1000, 3) + 0.0).alias("kiloseconds"))
