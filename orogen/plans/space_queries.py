"""Queries on points, polygons and boundary rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domain import sql, table
from ..functions import space
from ..operators import rates, spatial
from ..registry import query
from ..tables import r6

#: A box around each order's start, 6 by 4 degrees; every third is a hole.
_RINGS = "rings as (select boundary_id as ring_id, plate_left as plate_id, boundary_id % 3 = 0 as is_hole, lon0 as w, lat0 as s, lon0 + 6 as e, lat0 + 4 as n from boundaries)"


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "boundaries")
    v = lambda dx, dy: F.struct((F.col("lon0") + dx).alias("x"), (F.col("lat0") + dy).alias("y"))
    return b.select(F.col("boundary_id").alias("ring_id"), F.col("plate_left").alias("plate_id"), (F.col("boundary_id") % 3 == 0).alias("is_hole"), F.array(v(0, 0), v(6, 0), v(6, 4), v(0, 4)).alias("ring"))


_INSIDE = f"""with {_RINGS}, met as (select p.point_id, r.plate_id, count(*) filter (where not is_hole) as o, count(*) filter (where is_hole) as h from points p join rings r on p.lon > w and p.lon < e and p.lat > s and p.lat < n group by all),
inside as (select point_id, plate_id from met where o > 0 and h = 0)
"""


@query(sql("boundaries points", _INSIDE + "select p.point_id, coalesce(p.plate_id, min(i.plate_id)) as plate_id from points p left join inside i on i.point_id = p.point_id and p.plate_id is null group by p.point_id, p.plate_id"))
def j3_assign_plate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.assign_plate(table(spark, sf_dir, "points"), rings(spark, sf_dir)).select("point_id", "plate_id")


@query(sql("boundaries points", _INSIDE + """select p.point_id, min(i.plate_id) as plate, count(i.plate_id) as n_candidates, case count(i.plate_id) when 0 then 'Unassigned' when 1 then 'Certain' else 'Uncertain' end as confidence from points p left join inside i using (point_id) group by p.point_id
union all select -1 - ring_id, null, null, 'Boundary' from rings"""))
def y5_plate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points, and the first corner of each ring: these lie on the boundary, whatever plates are around."""
    r = rings(spark, sf_dir)
    corners = r.select((-1 - F.col("ring_id")).alias("point_id"), F.col("ring")[0]["x"].alias("lon"), F.col("ring")[0]["y"].alias("lat"))
    found = spatial.plate_query(table(spark, sf_dir, "points").select("point_id", "lon", "lat").unionByName(corners), r)
    own = lambda c: F.when(F.col("point_id") >= 0, F.col(c)).alias(c)
    return found.select("point_id", own("plate"), own("n_candidates"), "confidence")


@query(sql("boundaries", f"""with {_RINGS}, h as (select ring_id as hole, w + 3 as x, s + 2 as y from rings where is_hole), o as (select * from rings where not is_hole)
select hole, min(ring_id) as outer_ring from h left join o on x >= w and x < e and y >= s and y < n group by hole"""))
def j15_assign_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rings(spark, sf_dir)
    return spatial.assign_holes(r.where("not is_hole"), r.where("is_hole")).select("hole", F.col("outer").alias("outer_ring"))


@query(sql("boundaries", f"with {_RINGS} select ring_id, -24.0 as area, false as ccw, w as first_x, s as first_y, 5 as n_closed from rings"))
def f19_canonical_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rings(spark, sf_dir).withColumn("ring", F.reverse("ring"))
    c = space.ring_canonical(F.col("ring"))
    return r.select("ring_id", r6(space.planar_ring_area(F.col("ring"))).alias("area"), space.is_ccw(F.col("ring")).alias("ccw"), c[0]["x"].alias("first_x"), c[0]["y"].alias("first_y"), F.size(c).alias("n_closed"))


_TRIANGLE = "select boundary_id, radians(lat0) as a, radians(lon0) as b, radians(lat1) as c, radians(lon1) as d from boundaries"


@query(sql("boundaries", f"""with t as ({_TRIANGLE}), u as (select boundary_id, cos(a)*cos(b) as ax, cos(a)*sin(b) as ay, sin(a) as az, cos(c)*cos(d) as bx, cos(c)*sin(d) as by_, sin(c) as bz from t)
select boundary_id, round(2 * atan2(ax*by_ - ay*bx, 1 + (ax*bx + ay*by_ + az*bz) + bz + az), 6) + 0.0 as area from u"""))
def a14_ring_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spherical area of the triangle of each boundary and the pole."""
    b = table(spark, sf_dir, "boundaries")
    ring = F.array(space.latlon_to_unit(F.col("lat0"), F.col("lon0")), space.latlon_to_unit(F.col("lat1"), F.col("lon1")), space.vec(0, 0, 1))
    return b.select("boundary_id", r6(space.spherical_ring_area(ring)).alias("area"))


@query(sql("boundaries", """select boundary_id, round(degrees(2 * asin(least(1, sqrt(power(sin(radians(lat1 - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat1)) * power(sin(radians(lon1 - lon0) / 2), 2))))), 6) + 0.0 as degrees,
  round(degrees(case when az < 0 then az + 2 * pi() else az end), 6) + 0.0 as azimuth from (select *, atan2(sin(radians(lon1 - lon0)) * cos(radians(lat1)), cos(radians(lat0)) * sin(radians(lat1)) - sin(radians(lat0)) * cos(radians(lat1)) * cos(radians(lon1 - lon0))) as az from boundaries)"""))
def f8_great_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "boundaries")
    p, q = space.latlon_to_unit(F.col("lat0"), F.col("lon0")), space.latlon_to_unit(F.col("lat1"), F.col("lon1"))
    rows = b.select("boundary_id", p.alias("p"), q.alias("q"))
    return rows.select("boundary_id", r6(F.degrees(space.great_circle_angle(F.col("p"), F.col("q")))).alias("degrees"), r6(F.degrees(space.azimuth(F.col("p"), space.vec_sub(F.col("q"), F.col("p"))))).alias("azimuth"))


@query(sql("points", "select point_id, lon, lat from points where lon between -60 and 40 and lat between -30 and 50 and (plate_id % 2 = 0 or plate_id is null)"))
def p5_feature_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "points")
    return p.where(space.in_bbox(F.col("lon"), F.col("lat"), -60, -30, 40, 50) & ((F.col("plate_id") % 2 == 0) | F.col("plate_id").isNull())).select("point_id", "lon", "lat")


@query(sql("points", "select point_id from points where degrees(acos(least(1, sin(radians(lat)) * sin(radians(20)) + cos(radians(lat)) * cos(radians(20)) * cos(radians(lon - 30))))) <= 25.0001"))
def p9_in_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "points")
    at = space.latlon_to_unit(F.col("lat"), F.col("lon"))
    centre = space.latlon_to_unit(F.lit(20.0), F.lit(30.0))
    return p.where(spatial.in_shell(at, 0.5, 1.5) & spatial.in_cap(at, centre, 25.0001 * 3.141592653589793 / 180)).select("point_id")


@query(sql("points", """select point_id, round(cos(radians(lat)) * cos(radians(lon)), 6) + 0.0 as u, round(sin(radians(lat)), 6) + 0.0 as v from points where abs(cos(radians(lat)) * cos(radians(lon))) <= 0.4 and abs(sin(radians(lat))) <= 0.3"""))
def p10_slice_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "points").withColumn("p", space.latlon_to_unit(F.col("lat"), F.col("lon")))
    return spatial.slice_plane(p, space.vec(1, 0, 0), space.vec(0, 0, 1), 0.8, 0.6).select("point_id", r6(F.col("u")).alias("u"), r6(F.col("v")).alias("v"))


_SAMPLES = """with u as (select *, radians(lat0) as la, radians(lon0) as lo, radians(lat1) as lb, radians(lon1) as lp from boundaries),
xyz as (select *, cos(la)*cos(lo) as ax, cos(la)*sin(lo) as ay, sin(la) as az, cos(lb)*cos(lp) as bx, cos(lb)*sin(lp) as by_, sin(lb) as bz from u),
g as (select *, atan2(sqrt(power(ay*bz-az*by_,2)+power(az*bx-ax*bz,2)+power(ax*by_-ay*bx,2)), ax*bx+ay*by_+az*bz) as w from xyz),
s as (select g.*, k as sample, (sin((1-k/4.0)*w))/sin(w) as fa, sin(k/4.0*w)/sin(w) as fb from g, range(0, 5) r(k)),
p as (select *, fa*ax+fb*bx as x, fa*ay+fb*by_ as y, fa*az+fb*bz as z, sqrt(power(bx-ax,2)+power(by_-ay,2)+power(bz-az,2)) as ch from s),
om as (select plate_id, 0.01 * (plate_id % 5 - 2) as ox, 0.01 * (plate_id % 7 - 3) as oy, 0.01 * (plate_id % 3 - 1) as oz from plates),
v as (select p.*, (bx-ax)/ch as tx, (by_-ay)/ch as ty, (bz-az)/ch as tz, r.ox-l.ox as dx, r.oy-l.oy as dy, r.oz-l.oz as dz from p join om l on l.plate_id = plate_left join om r on r.plate_id = plate_right),
c as (select *, dy*z-dz*y as vx, dz*x-dx*z as vy, dx*y-dy*x as vz, y*tz-z*ty as nx, z*tx-x*tz as ny, x*ty-y*tx as nz from v),
rate as (select boundary_id, sample, x, y, z, sample / 4.0 * w as arc, vx*tx+vy*ty+vz*tz as tangential_rate, (case when plate_left > plate_right then -1 else 1 end) * (vx*nx+vy*ny+vz*nz) / sqrt(nx*nx+ny*ny+nz*nz) as normal_rate from c)
"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.array(space.latlon_to_unit(F.col("lat0"), F.col("lon0")), space.latlon_to_unit(F.col("lat1"), F.col("lon1")))
    return table(spark, sf_dir, "boundaries").select("boundary_id", "plate_left", "plate_right", line.alias("line"))


def rate_samples(spark: SparkSession, sf_dir: str, summed: bool = True) -> DataFrame:
    """Rates at five samples of each boundary; `summed`: those of one boundary lie in one task."""
    part = lambda k, d: F.expr(f"0.01BD * (plate_id % {k} - {d})")
    omegas = table(spark, sf_dir, "plates").select("plate_id", F.struct(part(5, 2).alias("x"), part(7, 3).alias("y"), part(3, 1).alias("z")).alias("omega"))
    b = lines(spark, sf_dir)
    return rates.boundary_velocities(rates.sample_along(rates.gathered(b, 5) if summed else b, 5), None, omegas)


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *(r6(F.col(c)).alias(c) for c in df.columns if c not in keys))


@query(sql("boundaries plates", _SAMPLES + "select boundary_id, sample::integer as sample, round(x, 6) + 0.0 as x, round(y, 6) + 0.0 as y, round(z, 6) + 0.0 as z, round(arc, 6) + 0.0 as arc from p"  .replace("from p", "from rate")))
def w5_sample_along(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rates.sample_along(lines(spark, sf_dir), 5).select("boundary_id", "sample", F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("p.z").alias("z"), "arc"), "boundary_id", "sample")


@query(sql("boundaries plates", _SAMPLES + "select boundary_id, sample::integer as sample, round(tangential_rate, 6) + 0.0 as tangential_rate, round(normal_rate, 6) + 0.0 as normal_rate from rate"))
def y9_boundary_velocities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rate_samples(spark, sf_dir, summed=False).select("boundary_id", "sample", "tangential_rate", "normal_rate"), "boundary_id", "sample")


@query(sql("boundaries plates", _SAMPLES + """select boundary_id, count(*) as n, round(min(normal_rate), 6) + 0.0 as min_normal, round(max(normal_rate), 6) + 0.0 as max_normal, round(avg(normal_rate), 6) + 0.0 as mean_normal, round(avg(abs(tangential_rate)), 6) + 0.0 as mean_slip,
  cast(arg_min(sample, {'r': round(normal_rate, 9), 's': sample}) as integer) as min_sample, cast(arg_min(sample, {'r': -round(normal_rate, 9), 's': sample}) as integer) as max_sample from rate group by boundary_id"""))
def a3_velocity_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rates.velocity_profile(rate_samples(spark, sf_dir)), "boundary_id", "n", "min_sample", "max_sample")


@query(sql("boundaries plates", _SAMPLES + """select boundary_id, round(min(normal_rate), 6) + 0.0 as min_normal_rate, round(max(normal_rate), 6) + 0.0 as max_normal_rate, round(avg(normal_rate), 6) + 0.0 as avg_normal_rate,
  round(min(tangential_rate), 6) + 0.0 as min_tangential_rate, round(max(tangential_rate), 6) + 0.0 as max_tangential_rate, round(avg(tangential_rate), 6) + 0.0 as avg_tangential_rate,
  round(max(sqrt(normal_rate*normal_rate + tangential_rate*tangential_rate)), 6) + 0.0 as max_speed, round(avg(sqrt(normal_rate*normal_rate + tangential_rate*tangential_rate)), 6) + 0.0 as mean_speed from rate group by boundary_id"""))
def a4_rate_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rates.rate_statistics(rate_samples(spark, sf_dir)), "boundary_id")


@query(sql("boundaries plates", _SAMPLES + """, k as (select boundary_id, avg(normal_rate) as n, avg(tangential_rate) as t, stddev_pop(normal_rate) as s from rate where normal_rate > 0 group by boundary_id)
select boundary_id, round(coalesce(n, 0), 6) + 0.0 as half_rate, round(coalesce(2 * n, 0), 6) + 0.0 as full_rate, round(coalesce(s, 0), 6) + 0.0 as deviation, round(coalesce(degrees(atan2(abs(t), abs(n))), 0), 4) + 0.0 as obliquity,
  coalesce(abs(t) > 2 * n, false) as mostly_slip, round(case when abs(t) <= 2 * n and n > 1e-5 then abs(t) / n else 0 end, 4) + 0.0 as asymmetry from (select distinct boundary_id from rate) left join k using (boundary_id)"""))
def a5_spreading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The asymmetry is compared where it is not a ratio to next to nothing."""
    found = rates.spreading(rate_samples(spark, sf_dir)).withColumns({"obliquity": F.round("obliquity", 4), "mostly_slip": F.col("asymmetry") > 2})
    found = found.withColumn("asymmetry", F.round(F.when((F.col("asymmetry") <= 2) & (F.col("half_rate") > 1e-5), F.col("asymmetry")).otherwise(0.0), 4))
    return _rounded(found, "boundary_id", "mostly_slip")


@query(sql("boundaries plates", _SAMPLES + """, k as (select boundary_id, max(-normal_rate) as x, avg(-normal_rate) as m, arg_max(arc, sample) - arg_min(arc, sample) as l, count(*) as n, max(0.001 * (1 + sample % 3)) as u from rate where normal_rate < 0 group by boundary_id)
select boundary_id, round(coalesce(x, 0), 6) + 0.0 as max_rate, round(coalesce(m, 0), 6) + 0.0 as mean_rate, round(coalesce(l, 0), 6) + 0.0 as length, coalesce(n, 0) as n, round(u, 6) + 0.0 as max_sigma from (select distinct boundary_id from rate) left join k using (boundary_id)"""))
def a6_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    sigma = F.lit(0.001) * (1 + F.col("sample") % 3)
    return _rounded(rates.convergence(rate_samples(spark, sf_dir).withColumn("normal_sigma", sigma)), "boundary_id", "n")


@query(sql("boundaries plates", _SAMPLES + """, k as (select boundary_id, max(abs(tangential_rate)) as x, avg(abs(tangential_rate)) as m, arg_max(arc, sample) - arg_min(arc, sample) as l, count(*) filter (where tangential_rate > 1e-12) as r, count(*) filter (where tangential_rate < -1e-12) as f from rate where abs(tangential_rate) > 1e-12 group by boundary_id)
select boundary_id, round(coalesce(x, 0), 6) + 0.0 as max_slip, round(coalesce(m, 0), 6) + 0.0 as mean_slip, round(coalesce(l, 0), 6) + 0.0 as length, coalesce(r, 0) as n_right, coalesce(f, 0) as n_left from (select distinct boundary_id from rate) left join k using (boundary_id)"""))
def a7_strike_slip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rates.strike_slip(rate_samples(spark, sf_dir)), "boundary_id", "n_right", "n_left")


def _bent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each boundary with a third vertex a quarter turn north of its second one's meridian."""
    line = F.array(space.latlon_to_unit(F.col("lat0"), F.col("lon0")), space.latlon_to_unit(F.col("lat1"), F.col("lon1")), space.latlon_to_unit(F.col("lat1") / 2 + 30, F.col("lon1")))
    return table(spark, sf_dir, "boundaries").select("boundary_id", line.alias("line"))


_BENT = """with u as (select boundary_id, x.pos, cos(radians(la)) * cos(radians(lo)) as x, cos(radians(la)) * sin(radians(lo)) as y, sin(radians(la)) as z
  from boundaries, lateral (values (0, lat0, lon0), (1, lat1, lon1), (2, lat1 / 2 + 30, lon1)) x(pos, la, lo)),
g as (select *, lead(x) over w as x1, lead(y) over w as y1, lead(z) over w as z1 from u window w as (partition by boundary_id order by pos)),
c as (select *, sqrt(power(x1 - x, 2) + power(y1 - y, 2) + power(z1 - z, 2)) as len from g where x1 is not null),
t as (select *, sum(len) over (partition by boundary_id order by pos) as upto, sum(len) over (partition by boundary_id) as total from c),
n as (select *, greatest(1, cast(round_even(total / 0.07, 0) as integer)) - 1 as k from t),
s as (select boundary_id, pos, x, y, z, x1, y1, z1, len, upto - len as start, upto, unnest(range(greatest(1, k))) as sample, total, greatest(1, k) as k from n),
spot as (select *, (sample + 1) * total / (k + 1) as d from s)
"""


@query(sql("boundaries", _BENT + """select boundary_id, sample::integer as sample, pos as leg, round(x + (x1 - x) * (d - start) / len, 6) + 0.0 as x, round(y + (y1 - y) * (d - start) / len, 6) + 0.0 as y, round(z + (z1 - z) * (d - start) / len, 6) + 0.0 as z
from spot where d > start and d <= upto"""))
def w5_chord_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples about 0.07 apart along the chords, none at a junction."""
    found = rates.samples_by_mode(_bent_lines(spark, sf_dir), "chord", spacing=0.07, ends=False)
    return _rounded(found.select("boundary_id", "sample", "leg", *(F.col("p")[c].alias(c) for c in "xyz")), "boundary_id", "sample", "leg")


@query(sql("boundaries plates", _SAMPLES + """, b as (select boundary_id, plate_left, row_number() over (order by boundary_id) as k, ax, ay, az, bx, by_, bz from g),
pt as (select point_id, cos(radians(lat))*cos(radians(lon)) as x, cos(radians(lat))*sin(radians(lon)) as y, sin(radians(lat)) as z from (select c_custkey as point_id, cast((c_custkey * 137) % 360 - 180 as double) + 0.25 as lon, cast((c_custkey * 61) % 170 - 85 as double) + 0.25 as lat from customer)),
n as (select *, sqrt(power(ay*bz-az*by_,2)+power(az*bx-ax*bz,2)+power(ax*by_-ay*bx,2)) as m, ay*bz-az*by_ as qx, az*bx-ax*bz as qy, ax*by_-ay*bx as qz from g),
d as (select point_id, boundary_id, case when m > 0 and (qy*az-qz*ay)*x+(qz*ax-qx*az)*y+(qx*ay-qy*ax)*z >= 0 and (by_*qz-bz*qy)*x+(bz*qx-bx*qz)*y+(bx*qy-by_*qx)*z >= 0 then abs(asin((x*qx+y*qy+z*qz)/m))
  else least(acos(least(1.0, x*ax+y*ay+z*az)), acos(least(1.0, x*bx+y*by_+z*bz))) end as r from pt, n)
, m as (select point_id, arg_min(boundary_id, {'r': round(degrees(r), 9), 'b': boundary_id}) as boundary_id, round(degrees(min(r)), 4) + 0.0 as degrees from d group by point_id)
select m.*, boundary_type, plate_left, plate_right from m join boundaries using (boundary_id)"""))
def j16_nearest_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the type of the nearest boundary and the plates beside it."""
    b = table(spark, sf_dir, "boundaries")
    found = spatial.nearest_boundary(table(spark, sf_dir, "points"), b.select("boundary_id", "lon0", "lat0", "lon1", "lat1"))
    return found.join(b, "boundary_id").select("point_id", "boundary_id", (F.round("degrees", 4) + 0.0).alias("degrees"), "boundary_type", "plate_left", "plate_right")
