"""Queries on motion segments, rotations and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domain import sql, table
from ..functions import space
from ..operators import log, motion, rates
from ..registry import query
from ..tables import r6

#: Queried ticks: one for each customer, over the range of the segments.
_TICKS = "with ticks as (select distinct c_custkey % 25 as plate_id, 1 + (c_custkey * 7) % (10 + (select max(tick_b) from segments)) as tick from customer)"


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "segments").agg(F.max("tick_b").alias("m"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").join(F.broadcast(last))  # one row
    return c.select((F.col("c_custkey") % 25).alias("plate_id"), (1 + (F.col("c_custkey") * 7) % (10 + F.col("m"))).alias("tick")).distinct()


_RULED = _TICKS + """,
inside as (select t.plate_id, t.tick, s.*exclude(plate_id), row_number() over (partition by t.plate_id, t.tick order by tick_a desc, tick_b, segment_id) as k from ticks t join segments s on s.plate_id = t.plate_id and s.tick_a < t.tick and t.tick <= s.tick_b),
ended as (select t.plate_id, t.tick, s.*exclude(plate_id), row_number() over (partition by t.plate_id, t.tick order by tick_b desc, tick_a desc, segment_id) as k from ticks t join segments s on s.plate_id = t.plate_id and s.tick_b <= t.tick)
"""


@query(sql("segments", _RULED + "select plate_id, tick, segment_id from inside where k = 1"))
def j4_active_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.segment_at(ticks(spark, sf_dir), table(spark, sf_dir, "segments")).where("covered").select("plate_id", "tick", "s.segment_id")


@query(sql("segments", _RULED + "select e.plate_id, e.tick, e.segment_id from ended e anti join inside i on i.plate_id = e.plate_id and i.tick = e.tick where e.k = 1"))
def j5_last_ended_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.segment_at(ticks(spark, sf_dir), table(spark, sf_dir, "segments")).where("not covered").select("plate_id", "tick", "s.segment_id")


def _mul(a: str, b: str) -> str:
    return (f"{a}.w*{b}.x + {a}.x*{b}.w + {a}.y*{b}.z - {a}.z*{b}.y as x, {a}.w*{b}.y - {a}.x*{b}.z + {a}.y*{b}.w + {a}.z*{b}.x as y, "
            f"{a}.w*{b}.z + {a}.x*{b}.y - {a}.y*{b}.x + {a}.z*{b}.w as z, {a}.w*{b}.w - {a}.x*{b}.x - {a}.y*{b}.y - {a}.z*{b}.z as w")  # fmt: skip


#: The segments of a plate follow each other without overlap, so the base is the product of the whole ones before.
_ROTATIONS = f"""with recursive qs as (select *, radians(azimuth / 1e6) as az, radians(elevation / 1e6) as el, radians(angle / 1e6) as an, row_number() over (partition by plate_id order by tick_a) as k from segments),
whole as (select plate_id, segment_id, k, tick_a, tick_b, az, el, an, cos(el)*cos(az)*sin(an/2) as x, cos(el)*sin(az)*sin(an/2) as y, sin(el)*sin(an/2) as z, cos(an/2) as w from qs),
base as (select plate_id, k, segment_id, 0.0::double as x, 0.0::double as y, 0.0::double as z, 1.0::double as w from whole where k = 1
  union all select plate_id, k, segment_id, x / n, y / n, z / n, w / n from (select *, sqrt(x*x + y*y + z*z + w*w) as n from (
    select q.plate_id, q.k, q.segment_id, {_mul('b', 'p')} from base b join whole p on p.plate_id = b.plate_id and p.k = b.k join whole q on q.plate_id = b.plate_id and q.k = b.k + 1))),
{_RULED[5:]},
ruled as (select plate_id, tick, segment_id from inside where k = 1 union all select e.plate_id, e.tick, e.segment_id from ended e anti join inside i on i.plate_id = e.plate_id and i.tick = e.tick where e.k = 1),
part as (select t.plate_id, t.tick, r.segment_id, cos(el)*cos(az)*sin(h) as x, cos(el)*sin(az)*sin(h) as y, sin(el)*sin(h) as z, cos(h) as w
  from ticks t join ruled r using (plate_id, tick) join lateral (select *, an * least(greatest((t.tick - tick_a) / (tick_b - tick_a)::double, 0), 1) / 2 as h from whole w where w.segment_id = r.segment_id) s on true),
rot as (select p.plate_id, p.tick, {_mul('b', 'p')} from part p join base b using (segment_id)
  union all select plate_id, tick, 0, 0, 0, 1 from ticks t anti join ruled r on r.plate_id = t.plate_id and r.tick = t.tick)
"""


@query(sql("segments", _ROTATIONS + "select plate_id, tick, round(x, 6) + 0.0 as x, round(y, 6) + 0.0 as y, round(z, 6) + 0.0 as z, round(w, 6) + 0.0 as w from rot"))
def y1_rotations_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = motion.rotations_at(ticks(spark, sf_dir), table(spark, sf_dir, "segments"))
    return found.select("plate_id", "tick", *(r6(F.col(f"q.{c}")).alias(c) for c in "xyzw"))


@query(sql("segments", """with o as (select plate_id, tick_a + 1 as tick, azimuth, elevation, angle / 8.0 as rate from segments)
select plate_id, tick, round(degrees(radians(rate / 1e6)), 6) + 0.0 as speed from o"""))
def y6_angular_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inside a segment the speed is its angle over its length, whatever came before."""
    s = table(spark, sf_dir, "segments")
    t = s.select("plate_id", (F.col("tick_a") + 1).alias("tick"))
    return motion.angular_velocities(t, s).select("plate_id", "tick", r6(F.degrees(space.norm(F.col("omega")))).alias("speed"))


_ROTATED = """, v as (select boundary_id, plate_left, k, cos(radians(la)) * cos(radians(lo)) as px, cos(radians(la)) * sin(radians(lo)) as py, sin(radians(la)) as pz from boundaries, lateral (values (0, lat0, lon0), (1, lat1, lon1)) u(k, la, lo) where not is_retired),
m as (select v.*, x, y, z, w, 2*(y*pz - z*py) as tx, 2*(z*px - x*pz) as ty, 2*(x*py - y*px) as tz from v join rot r on r.plate_id = v.plate_left)
select boundary_id, k, round(px + w*tx + y*tz - z*ty, 6) + 0.0 as x, round(py + w*ty + z*tx - x*tz, 6) + 0.0 as y, round(pz + w*tz + x*ty - y*tx, 6) + 0.0 as z from m"""
_ONE_TICK = _ROTATIONS.replace(_TICKS[5:], "ticks as (select plate_id, 57::bigint as tick from plates)")


def _at_57(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.rotations_at(table(spark, sf_dir, "plates").select("plate_id", F.lit(57).cast("long").alias("tick")), table(spark, sf_dir, "segments"))


@query(sql("segments boundaries plates", _ONE_TICK + _ROTATED))
def y2_reconstruct_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = log.active(table(spark, sf_dir, "boundaries"))
    line = F.array(space.latlon_to_unit(F.col("lat0"), F.col("lon0")), space.latlon_to_unit(F.col("lat1"), F.col("lon1")))
    done = motion.reconstruct(b.select("boundary_id", "plate_left", line.alias("line")), _at_57(spark, sf_dir), "plate_left", "line")
    return done.select("boundary_id", F.posexplode("line").alias("k", "p")).select("boundary_id", "k", *(r6(F.col(f"p.{c}")).alias(c) for c in "xyz"))


@query(sql("segments boundaries plates points", _ONE_TICK + _ROTATED.replace("boundary_id", "point_id").replace("plate_left", "plate_id").replace("from boundaries, lateral (values (0, lat0, lon0), (1, lat1, lon1)) u(k, la, lo) where not is_retired", "from points, lateral (values (0, lat, lon)) u(k, la, lo) where plate_id is not null")))
def y3_reconstruct_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "points")
    done = motion.reconstruct(p.select("point_id", "plate_id", F.array(space.latlon_to_unit(F.col("lat"), F.col("lon"))).alias("line")), _at_57(spark, sf_dir), "plate_id", "line")
    return done.select("point_id", F.posexplode("line").alias("k", "p")).select("point_id", "k", *(r6(F.col(f"p.{c}")).alias(c) for c in "xyz"))


@query(sql("segments", """with e as (select segment_id, plate_id, 1 as seq, 'Upserted' as t, angle from segments union all select segment_id, plate_id, 2, case when angle % 3 = 0 then 'Retired' else 'Upserted' end, angle + 1 from segments where angle % 2 = 0),
l as (select segment_id, plate_id, arg_max(t, seq) as t, arg_max(angle, seq) as angle from e group by all) select segment_id, plate_id, angle from l where t <> 'Retired'"""))
def a2_motion_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "segments").select(F.lit("k").alias("stream_key"), "segment_id", "plate_id", "angle")
    one = s.select("*", F.lit(1).alias("sequence"), F.lit("Upserted").alias("event_type"))
    two = s.where("angle % 2 = 0").select("stream_key", "segment_id", "plate_id", (F.col("angle") + 1).alias("angle"), F.lit(2).alias("sequence"), F.when(F.col("angle") % 3 == 0, "Retired").otherwise("Upserted").alias("event_type"))
    return log.motion_segments(one.unionByName(two)).select("segment_id", "plate_id", "angle")


_BASE = _ROTATIONS[: _ROTATIONS.index(_RULED[5:])].rstrip().rstrip(",")


def _paths(seeds: str, last: int, more: str = "") -> str:
    """SQL: explicit Euler steps of two ticks along the velocities of the seeds' plates, from tick 0 to before the last."""
    return _BASE + f""",
ax as (select b.x as qx, b.y as qy, b.z as qz, b.w as qw, t.tick, w.plate_id, an / (tick_b - tick_a) as rate, cos(el)*cos(az) as a, cos(el)*sin(az) as b, sin(el) as c
  from whole w join base b using (segment_id) join (select unnest(range(0, {last}, 2)) as tick) t on w.tick_a <= t.tick and t.tick < w.tick_b),
tw as (select *, 2*(qy*c - qz*b) as t1, 2*(qz*a - qx*c) as t2, 2*(qx*b - qy*a) as t3 from ax),
om as (select plate_id, tick, rate*(a + qw*t1 + qy*t3 - qz*t2) as ox, rate*(b + qw*t2 + qz*t1 - qx*t3) as oy, rate*(c + qw*t3 + qx*t2 - qy*t1) as oz from tw),
seed as ({seeds}),
path as (select seed_id, plate_id, 0::bigint as tick, x, y, z, 0.0::double as error from seed
  union all select seed_id, plate_id, tick + 2, x / n, y / n, z / n, error + 0.0002 from (select *, sqrt(x*x + y*y + z*z) as n from (
    select p.seed_id, p.plate_id, p.tick, p.error, p.x + 2*(coalesce(oy, 0)*p.z - coalesce(oz, 0)*p.y) as x, p.y + 2*(coalesce(oz, 0)*p.x - coalesce(ox, 0)*p.z) as y, p.z + 2*(coalesce(ox, 0)*p.y - coalesce(oy, 0)*p.x) as z
    from path p left join om o on o.plate_id = p.plate_id and o.tick = p.tick where p.tick + 2 < {last}))){more}
"""


def path_omegas(spark: SparkSession, sf_dir: str, last: int) -> DataFrame:
    grid = table(spark, sf_dir, "plates").select("plate_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"), F.lit(2).cast("long"))).alias("tick"))
    return motion.angular_velocities(grid, table(spark, sf_dir, "segments"))


def _r4(c: str) -> F.Column:
    return (F.round(c, 4) + F.lit(0.0)).alias(c)


_ROUND = ", ".join(f"round({c}, 4) + 0.0 as {c}" for c in ("x", "y", "z", "error"))


@query(sql("segments points", _paths("select point_id as seed_id, plate_id, cos(radians(lat))*cos(radians(lon)) as x, cos(radians(lat))*sin(radians(lon)) as y, sin(radians(lat)) as z from points where plate_id is not null", 30)
  + f"select seed_id, p.tick, {_ROUND}, round(coalesce(oy, 0)*z - coalesce(oz, 0)*y, 6) + 0.0 as vx, round(coalesce(oz, 0)*x - coalesce(ox, 0)*z, 6) + 0.0 as vy, round(coalesce(ox, 0)*y - coalesce(oy, 0)*x, 6) + 0.0 as vz from path p left join om o on o.plate_id = p.plate_id and o.tick = p.tick"))
def y7_motion_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "points").where("plate_id is not null")
    xyz = space.latlon_to_unit(F.col("lat"), F.col("lon"))
    seeds = p.select(F.col("point_id").alias("seed_id"), "plate_id", *(xyz[c].alias(c) for c in "xyz"), F.lit(0).cast("long").alias("start_tick"), F.lit(30).cast("long").alias("end_tick"))
    found = motion.motion_paths(seeds, path_omegas(spark, sf_dir, 30), 2)
    return found.select("seed_id", "tick", *(_r4(c) for c in ("x", "y", "z", "error")), *(r6(F.col(c)).alias(c) for c in ("vx", "vy", "vz")))


_LINE_SEEDS = """select boundary_id * 1000 + sample * 2 + k as seed_id, boundary_id, sample, side, plate_id, ax + (bx-ax)*sample*0.05/ch as x, ay + (by_-ay)*sample*0.05/ch as y, az + (bz-az)*sample*0.05/ch as z from (
  select *, unnest(range(0, cast(floor((ch + 1e-9) / 0.05) as bigint) + 1)) as sample from (select *, sqrt(power(bx-ax,2)+power(by_-ay,2)+power(bz-az,2)) as ch from (
    select boundary_id, plate_left, plate_right, cos(radians(lat0))*cos(radians(lon0)) as ax, cos(radians(lat0))*sin(radians(lon0)) as ay, sin(radians(lat0)) as az,
      cos(radians(lat1))*cos(radians(lon1)) as bx, cos(radians(lat1))*sin(radians(lon1)) as by_, sin(radians(lat1)) as bz from boundaries))), lateral (values (0, 'left', plate_left), (1, 'right', plate_right)) v(k, side, plate_id)"""


@query(sql("segments boundaries", _paths(_LINE_SEEDS, 10) + f"select s.boundary_id, s.sample, s.side, p.tick, {_ROUND.replace('(', '(p.')}, p.tick * 5.0 as opening from path p join seed s using (seed_id)"))
def y8_flowline_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flowlines of both sides of every boundary, from points every 0.05 along it."""
    line = F.array(space.latlon_to_unit(F.col("lat0"), F.col("lon0")), space.latlon_to_unit(F.col("lat1"), F.col("lon1")))
    samples = rates.sample_by_spacing(table(spark, sf_dir, "boundaries").select("boundary_id", "plate_left", "plate_right", line.alias("line")), 0.05)
    found = motion.flowline_bundle(samples, None, path_omegas(spark, sf_dir, 10), 0, 10, 2)
    return found.select("boundary_id", "sample", "side", "tick", *(_r4(c) for c in ("x", "y", "z", "error", "opening")))


#: Frame links from parts: ten frames with a chain of bases each, ranges of ten ticks, some always valid.
_LINKS = """select 'f' || cast(p_partkey % 40 as string) as frame, p_partkey as position, case when p_partkey % 40 < 4 then 'mantle' else 'f' || cast(p_partkey % 40 % 4 as string) end as base_frame,
  case when p_partkey % 11 = 0 then null else 10 * (p_partkey {div} 40) end as from_tick, case when p_partkey % 11 = 0 then null else 10 * (p_partkey {div} 40) + 9 end as to_tick,
  case when p_partkey % 11 = 0 then null else p_partkey {div} 400 end as sequence_hint, radians((p_partkey % 7) * 3.0) as turn from part"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_LINKS.format(div="div").replace("from part", "from {p}"), p=spark.read.parquet(f"{sf_dir}/part.parquet"))
    return rows.withColumn("q", space.from_axis_angle(space.vec(0, 0, 1), F.col("turn"))).drop("turn")


_FT = "with links as (" + _LINKS.format(div="//") + "), t as (select distinct 'f' || (c_custkey % 40) as frame, c_custkey % 47 as tick from customer),\n"
_ACTIVE = "act as (select t.frame, t.tick, l.base_frame, l.turn, row_number() over (partition by t.frame, t.tick order by sequence_hint is null, sequence_hint, position) as k from {t} t join links l on l.frame = t.frame and (l.from_tick is null or t.tick between l.from_tick and l.to_tick))"


def frame_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.concat(F.lit("f"), (F.col("c_custkey") % 40).cast("string")).alias("frame"), (F.col("c_custkey") % 47).alias("tick")).distinct()


@query(_FT + _ACTIVE.format(t="t") + " select frame, tick, base_frame, round(sin(turn / 2), 6) + 0.0 as z from act where k = 1")
def j7_active_frame_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.active_link(frame_ticks(spark, sf_dir), links(spark, sf_dir)).select("frame", "tick", "base_frame", r6(F.col("q.z")).alias("z"))


@query(_FT + "u as (select frame, tick from t union select 'f' || k, tick from t, (values (0), (1), (2), (3)) v(k)), " + _ACTIVE.format(t="u") + """
, one as (select * from act where k = 1)
select t.frame, t.tick, a.base_frame is not null and (a.base_frame = 'mantle' or b.base_frame is not null) as is_valid,
  case when a.base_frame is not null and (a.base_frame = 'mantle' or b.base_frame is not null) then round(sin((a.turn + coalesce(b.turn, 0)) / 2), 6) + 0.0 end as z
from t left join one a on a.frame = t.frame and a.tick = t.tick left join one b on b.frame = a.base_frame and b.tick = t.tick""")
def j8_frame_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = motion.frame_chains(frame_ticks(spark, sf_dir), links(spark, sf_dir), ["mantle"])
    return c.select("frame", "tick", "is_valid", F.when(F.col("is_valid"), r6(F.col("q.z"))).alias("z"))


@query(_FT + "u as (select frame, tick from t union select 'f' || k, tick from t, (values (0), (1), (2), (3)) v(k)), " + _ACTIVE.format(t="u") + """
, one as (select * from act where k = 1),
c as (select u.frame, u.tick, case when a.base_frame = 'mantle' then a.turn when b.base_frame is not null then a.turn + b.turn end as turn from u left join one a on a.frame = u.frame and a.tick = u.tick left join one b on b.frame = a.base_frame and b.tick = u.tick)
select x.frame as from_frame, 'f0' as to_frame, x.tick, coalesce(x.turn is not null and y.turn is not null, false) as is_valid, round(sin((x.turn - y.turn) / 2), 6) + 0.0 as z
from (select c.* from c join t using (frame, tick)) x left join c y on y.frame = 'f0' and y.tick = x.tick""")
def y14_frame_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = frame_ticks(spark, sf_dir)
    all_ = t.unionByName(t.select(F.lit("f0").alias("frame"), "tick")).distinct()
    chains = motion.frame_chains(all_, links(spark, sf_dir), ["mantle"])
    pairs = t.select(F.col("frame").alias("from_frame"), F.lit("f0").alias("to_frame"), "tick")
    return motion.frame_transform(pairs, chains).select("from_frame", "to_frame", "tick", "is_valid", r6(F.col("q.z")).alias("z"))


@query("with links as (" + _LINKS.format(div="//") + """), l as (select *, row_number() over w as place, case when (lag(base_frame) over w = base_frame) and ((lag(from_tick) over w is null and from_tick is null) or lag(to_tick) over w + 1 = from_tick) then 0 else 1 end as n
  from links where turn > 0 window w as (partition by frame order by sequence_hint nulls last, from_tick nulls first, position)),
i as (select *, sum(n) over (partition by frame order by place) as island from l)
select frame, base_frame, min(from_tick) as from_tick, max(to_tick) as to_tick, count(*) as n_links, round(sin(sum(turn) / 2), 6) + 0.0 as z from i group by frame, base_frame, island""")
def w12_merge_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.merge_links(links(spark, sf_dir)).select("frame", "base_frame", "from_tick", "to_tick", "n_links", r6(F.col("q.z")).alias("z"))


@query("with links as (" + _LINKS.format(div="//") + "), x as (select frame, base_frame, from_tick - frame.len() % 2 as from_tick, to_tick + position % 3 as to_tick, position from links where from_tick is not null), o as (select *, lead(from_tick) over (partition by frame, base_frame order by from_tick, position) as next_from from x) select frame, base_frame, from_tick, to_tick, next_from from o where to_tick >= next_from")
def w13_overlapping_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = links(spark, sf_dir).withColumn("from_tick", F.col("from_tick") - F.length("frame") % 2).withColumn("to_tick", F.col("to_tick") + F.col("position") % 3)
    return motion.overlapping_links(x).select("frame", "base_frame", "from_tick", "to_tick", "next_from")


@query(_FT + "u as (select frame, tick from t union select 'f' || k, tick from t, (values (0), (1), (2), (3)) v(k)), " + _ACTIVE.format(t="u") + """
, one as (select * from act where k = 1),
c as (select u.frame, u.tick, case when a.base_frame = 'mantle' then u.frame || '>mantle' when b.base_frame is not null then u.frame || '>' || a.base_frame || '>mantle' end as way from u left join one a on a.frame = u.frame and a.tick = u.tick left join one b on b.frame = a.base_frame and b.tick = u.tick)
select x.frame as from_frame, 'f0' as to_frame, x.tick, x.way || '>' || y.way as chain from (select c.* from c join t using (frame, tick)) x join c y on y.frame = 'f0' and y.tick = x.tick where x.way is not null and y.way is not null""")
def u4_evaluation_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = frame_ticks(spark, sf_dir)
    all_ = t.unionByName(t.select(F.lit("f0").alias("frame"), "tick")).distinct()
    pairs = t.select(F.col("frame").alias("from_frame"), F.lit("f0").alias("to_frame"), "tick")
    found = motion.evaluation_chains(pairs, motion.frame_chains(all_, links(spark, sf_dir), ["mantle"]))
    return found.select("from_frame", "to_frame", "tick", F.array_join("chain", ">").alias("chain"))


_OMEGAS = _paths("select 1", 32).split("seed as (")[0].rstrip().rstrip(",")


@query(sql("segments plates", _OMEGAS + "\nselect p.plate_id, t.tick, round(coalesce(ox, 0), 6) + 0.0 as x, round(coalesce(oy, 0), 6) + 0.0 as y, round(coalesce(oz, 0), 6) + 0.0 as z from plates p cross join (select unnest(range(0, 31, 2)) as tick) t left join om o on o.plate_id = p.plate_id and o.tick = t.tick"))
def y6_omegas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis and speed of every plate at every second tick up to 30, gaps between segments too."""
    return path_omegas(spark, sf_dir, 30).select("plate_id", "tick", *(r6(F.col(f"omega.{c}")).alias(c) for c in "xyz"))
