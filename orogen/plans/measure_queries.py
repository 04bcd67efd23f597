"""Queries on arcs, frames at points, velocities and rotations in a plate's frame, and masks by plates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domain import sql, table
from ..functions import space
from ..operators import grid, motion, rates, topology
from ..registry import query
from ..tables import r6
from .grid_queries import SHIFTED, cells
from .motion_queries import _ONE_TICK, _at_57, _mul
from .plate_queries import _GRID, _grid_map
from .space_queries import _RINGS, rings

#: Both ends of each boundary as unit vectors a and b, with the angle w between them.
_ENDS = """with u as (select boundary_id, radians(lat0) as la, radians(lon0) as lo, radians(lat1) as lb, radians(lon1) as lp from boundaries),
e as (select boundary_id, la, lo, lb, lp, cos(la)*cos(lo) as ax, cos(la)*sin(lo) as ay, sin(la) as az, cos(lb)*cos(lp) as bx, cos(lb)*sin(lp) as by_, sin(lb) as bz from u),
g as (select *, atan2(sqrt(power(ay*bz-az*by_,2)+power(az*bx-ax*bz,2)+power(ax*by_-ay*bx,2)), ax*bx+ay*by_+az*bz) as w, sqrt(power(bx-ax,2)+power(by_-ay,2)+power(bz-az,2)) as ch from e)
"""
_AT = "pt as (select point_id, plate_id, radians(lat) as la, radians(lon) as lo, cos(radians(lat))*cos(radians(lon)) as x, cos(radians(lat))*sin(radians(lon)) as y, sin(radians(lat)) as z from points)"
_OMEGA = "om as (select plate_id, 0.01 * (plate_id % 5 - 2) as ox, 0.01 * (plate_id % 7 - 3) as oy, 0.01 * (plate_id % 3 - 1) as oz from plates)"


def ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "boundaries")
    return b.select("boundary_id", space.latlon_to_unit(F.col("lat0"), F.col("lon0")).alias("p"), space.latlon_to_unit(F.col("lat1"), F.col("lon1")).alias("q"))


def at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "points").select("point_id", "plate_id", space.latlon_to_unit(F.col("lat"), F.col("lon")).alias("p"))


def omegas(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("plate_id")
    return table(spark, sf_dir, "plates").select("plate_id", space.vec(0.01 * (p % 5 - 2), 0.01 * (p % 7 - 3), 0.01 * (p % 3 - 1)).alias("omega"))


def _xyz(p: str, names: str = "xyz") -> list[Column]:
    return [r6(F.col(f"{p}.{c}")).alias(c) for c in names]


_R = lambda *parts: ", ".join(f"round({p}, 6) + 0.0 as {n}" for p, n in parts)


@query(sql("boundaries", _ENDS + "select boundary_id, k, " + _R(*((f"(sin((1-k/4.0)*w)*a{c} + sin(k/4.0*w)*b{d})/sin(w)", c) for c, d in (("x", "x"), ("y", "y_"), ("z", "z")))) + " from g, (values (0), (1), (2), (3), (4)) v(k)"))
def f9_great_circle_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = ends(spark, sf_dir).select("boundary_id", F.posexplode(space.great_circle_arc(F.col("p"), F.col("q"), 4)).alias("k", "p"))
    return arcs.select("boundary_id", "k", *_xyz("p"))


@query(sql("boundaries", _ENDS + """, s as (select *, pi()/2 - la as u, pi()/2 - lb as v, (w + (pi()/2 - la) + (pi()/2 - lb)) / 2 as s from g)
select boundary_id, round(sign(ax*by_ - ay*bx) * 4 * atan(sqrt(greatest(0, tan(s/2) * tan((s-w)/2) * tan((s-u)/2) * tan((s-v)/2)))), 6) + 0.0 as excess from s"""))
def f10_triangle_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triangle of each boundary and the pole; the SQL takes the area from the sides alone."""
    return ends(spark, sf_dir).select("boundary_id", r6(space.triangle_excess(F.col("p"), F.col("q"), space.vec(0, 0, 1))).alias("excess"))


@query(sql("points", f"with {_AT} select point_id, " + _R(("-sin(lo)", "ex"), ("cos(lo)", "ey"), ("-sin(la)*cos(lo)", "nx"), ("-sin(la)*sin(lo)", "ny"), ("cos(la)", "nz"), ("atan2(-sin(la)*cos(lo), -sin(lo))", "angle_of_x")) + " from pt"))
def f11_tangent_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = at(spark, sf_dir).withColumn("e", space.east(F.col("p"))).withColumn("n", space.north(F.col("p")))
    angle = space.tangent_angle(F.col("p"), space.vec(1, 0, 0))
    return p.select("point_id", *(r6(F.col(f"{a}.{c}")).alias(f"{a}{c}") for a, c in (("e", "x"), ("e", "y"), ("n", "x"), ("n", "y"), ("n", "z"))), r6(angle).alias("angle_of_x"))


_SEEN = f"with {_AT}, {_OMEGA}, fr as (select o.plate_id, o.ox - f.ox as ox, o.oy - f.oy as oy, o.oz - f.oz as oz from om o, (select * from om where plate_id = {{}}) f), v as (select pt.*, oy*z - oz*y as vx, oz*x - ox*z as vy, ox*y - oy*x as vz from pt join fr using (plate_id))\n"


@query(sql("points plates", f"with {_AT}, {_OMEGA} select point_id, " + _R(("oy*z - oz*y", "x"), ("oz*x - ox*z", "y"), ("ox*y - oy*x", "z")) + " from pt join om using (plate_id)"))
def f12_linear_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = at(spark, sf_dir).join(omegas(spark, sf_dir), "plate_id")
    return moved.select("point_id", space.linear_velocity(F.col("omega"), F.col("p")).alias("v")).select("point_id", *_xyz("v"))


@query(sql("points plates", _SEEN.format(4) + """, a as (select point_id, sqrt(vx*vx + vy*vy + vz*vz) as s, atan2(-vx*sin(lo) + vy*cos(lo), -vx*sin(la)*cos(lo) - vy*sin(la)*sin(lo) + vz*cos(la)) as az from v)
select point_id, round(s, 6) + 0.0 as speed, case when s > 1e-9 then round(degrees(case when az < 0 then az + 2*pi() else az end), 6) + 0.0 end as azimuth from a"""))
def y10_velocity_in_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = motion.velocity_in_frame(at(spark, sf_dir), omegas(spark, sf_dir), anchor=4)
    return seen.select("point_id", r6(F.col("speed")).alias("speed"), r6(F.degrees("azimuth")).alias("azimuth"))


@query(sql("points plates", _SEEN.format(7) + """, a as (select point_id, sqrt(vx*vx + vy*vy + vz*vz) as s, atan2(-vx*sin(lo) + vy*cos(lo), -vx*sin(la)*cos(lo) - vy*sin(la)*sin(lo) + vz*cos(la)) as az from v)
select point_id, 5::bigint as tick, round(s, 6) + 0.0 as speed, case when s > 1e-9 then round(degrees(case when az < 0 then az + 2*pi() else az end), 6) + 0.0 end as azimuth from a"""))
def y10_velocity_in_custom_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame for each nation stands on the frame before it or, the first of every five, on the plate two further on; seen from the frame that ends at plate 7."""
    n, name = F.col("n_nationkey"), lambda c: F.concat(F.lit("c"), c.cast("string"))
    links = spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        name(n).alias("frame"), n.cast("long").alias("position"), F.when(n % 5 == 0, F.concat(F.lit("plate:"), (n + 2).cast("string"))).otherwise(name(n - 1)).alias("base_frame"),
        F.lit(None).cast("long").alias("from_tick"), F.lit(None).cast("long").alias("to_tick"), F.lit(None).cast("int").alias("sequence_hint"), space.from_axis_angle(space.vec(0, 0, 1), n * 0.1).alias("q"),
    )
    ticks = links.select("frame", F.lit(5).cast("long").alias("tick"))
    chains = motion.frame_chains(ticks, links, ["mantle", *(f"plate:{k}" for k in range(25))])
    at_tick = lambda rows: rows.withColumn("tick", F.lit(5).cast("long"))
    seen = motion.velocity_in_custom_frame(at_tick(at(spark, sf_dir)), at_tick(omegas(spark, sf_dir)), chains, "c8")
    return seen.select("point_id", "tick", r6(F.col("speed")).alias("speed"), r6(F.degrees("azimuth")).alias("azimuth"))


@query("select c_custkey, round(c_acctbal - 1.96 * (c_custkey % 10), 6) + 0.0 as low, round(c_acctbal + 1.96 * (c_custkey % 10), 6) + 0.0 as high from customer")
def f17_rate_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    low, high = space.bounds_95(F.col("c_acctbal"), F.col("c_custkey") % 10)
    return c.select("c_custkey", r6(low).alias("low"), r6(high).alias("high"))


_FRAMED = _ONE_TICK + ", fr as (select tick, -x as x, -y as y, -z as z, w from rot where plate_id = 3), seen as (select r.plate_id, r.tick, " + _mul("f", "r") + " from rot r join fr f using (tick))\n"
_Q = _R(*((c, c) for c in "xyzw"))


@query(sql("segments boundaries plates", _FRAMED + f"select plate_id, tick, {_Q} from seen"))
def y15_rotations_in_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.rotations_in_frame(_at_57(spark, sf_dir), 3).select("plate_id", "tick", *_xyz("q", "xyzw"))


@query(sql("segments boundaries plates", _ONE_TICK + """, wr as (select *, 1.0 + plate_id % 4 as wt from rot where plate_id % 5 > 0),
f as (select x as fx, y as fy, z as fz, w as fw from wr order by plate_id limit 1), s as (select tick, wt * (case when x*fx + y*fy + z*fz + w*fw < 0 then -1 else 1 end) as k, x, y, z, w from wr, f),
t as (select tick, sum(k*x) as x, sum(k*y) as y, sum(k*z) as z, sum(k*w) as w from s group by tick), n as (select *, sqrt(x*x + y*y + z*z + w*w) as n from t)
select tick, """ + _R(*((f"{c} / n", c) for c in "xyzw")) + " from n"))
def a8_net_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plates of every fifth id have no area and are skipped."""
    p = F.col("plate_id")
    weight = F.when(p % 5 > 0, 1.0 + p % 4).otherwise(0.0)
    return rates.net_rotation(_at_57(spark, sf_dir), weight).select("tick", *_xyz("q", "xyzw"))


@query(sql("segments boundaries plates", _ONE_TICK + ", tw as (select 0.0 as x, 0.0 as y, sin(0.1) as z, cos(0.1) as w), on_ as (select r.plate_id, r.tick, " + _mul("t", "r") + f" from rot r, tw t) select plate_id, tick, {_Q} from on_"))
def e6_polar_wander(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole body turns by 0.2 rad about its pole at every tick that has a plate."""
    turned = _at_57(spark, sf_dir)
    wander = turned.select("tick").distinct().withColumn("q", space.from_axis_angle(space.vec(0, 0, 1), F.lit(0.2)))
    return motion.with_polar_wander(turned, wander).select("plate_id", "tick", *_xyz("q", "xyzw"))


@query(sql("boundaries", f"with {_RINGS} select ring_id, w + 3 as lon, s + 2 as lat from rings"))
def a16_ring_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rings(spark, sf_dir).select("ring_id", space.ring_mean(F.col("ring"), "x").alias("lon"), space.ring_mean(F.col("ring"), "y").alias("lat"))


@query(sql("boundaries", _ENDS + ", k as (select *, unnest(range(0, cast(floor((ch + 1e-9) / 0.03) as bigint) + 1)) as sample from g) select boundary_id, sample, " + _R(*((f"a{c} + (b{d} - a{c}) * sample * 0.03 / ch", c) for c, d in (("x", "x"), ("y", "y_"), ("z", "z")))) + " from k"))
def w6_sample_by_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = ends(spark, sf_dir).select("boundary_id", F.array("p", "q").alias("line"))
    return rates.sample_by_spacing(line, 0.03).select("boundary_id", "sample", *_xyz("p"))


@query(_GRID + "select id as boundary_id, s as start_junction, e as end_junction from b")
def j14_match_boundary_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _grid_map(spark, sf_dir)
    b = m["boundaries"].select("boundary_id", "start", "end")
    incidents = b.select("boundary_id", F.explode(F.array("end", "start")).alias("junction_id"))
    first = b.join(m["positions"], F.col("start") == F.col("junction_id")).select("boundary_id", F.col("position").alias("first"))
    return topology.match_ends(incidents, m["positions"], first).select("boundary_id", F.col("start").alias("start_junction"), F.col("end").alias("end_junction"))


@query(sql("boundaries cells", f"""with {_RINGS}, k as (select distinct r, c, -175 + (c + 0.52) * 10 as lon, 90 - (r + 0.52) * 10 as lat from cells),
met as (select k.r, k.c, g.plate_id, count(*) filter (where not is_hole) as o, count(*) filter (where is_hole) as h from k join rings g on lon > w and lon < e and lat > s and lat < n group by all),
i as (select distinct r, c from met where o > 0 and h = 0)
select tick, x.r, x.c, case when i.r is not null then round(value, 4) + 0.0 end as value from cells x left join i on i.r = x.r and i.c = x.c"""))
def y25_raster_mask_plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster that begins at 175 degrees west, tested a little off the centres, as these lie on edges of the rings."""
    masked = grid.mask_plates(cells(spark, sf_dir), rings(spark, sf_dir), 36, 18, SHIFTED, at=0.52)
    return masked.select("tick", "r", "c", (F.round("value", 4) + 0.0).alias("value"))
