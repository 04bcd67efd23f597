"""Queries on plates, boundaries and junctions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domain import sql, table
from ..functions import space
from ..operators import partition, topology
from ..registry import query
from ..tables import cut, r6

_EDGES = """with edges as (select b.* from boundaries b join plates l on l.plate_id = b.plate_left and l.active join plates r on r.plate_id = b.plate_right and r.active where not b.is_retired),
both_ways as (select plate_left as plate_id, plate_right as neighbour, * from edges union all select plate_right, plate_left, * from edges)
"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.adjacency_edges(table(spark, sf_dir, "boundaries"), table(spark, sf_dir, "plates"))


def junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One junction for every three orders; it joins their boundaries, and every fifth one a boundary that is not there."""
    b = table(spark, sf_dir, "boundaries")
    k = F.expr("boundary_id div 3")
    lost = F.when((k % 5 == 0) & (F.col("boundary_id") % 3 == 0), F.array(F.col("boundary_id"), -F.col("boundary_id") - 1)).otherwise(F.array("boundary_id"))
    return b.groupBy(k.alias("junction_id")).agg(F.flatten(F.collect_list(lost)).alias("boundary_ids"))


@query(sql("plates boundaries", _EDGES + "select boundary_id, plate_left, plate_right, boundary_type from edges"))
def j1_adjacency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).select("boundary_id", "plate_left", "plate_right", "boundary_type")


@query(sql("plates boundaries", _EDGES + "select plate_id, neighbour, boundary_type, count(*) as n_boundaries, min(boundary_id) as first_boundary from both_ways group by all"))
def a10_plate_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.plate_adjacency(edges(spark, sf_dir))


@query(sql("plates boundaries", "select boundary_id, plate_left, plate_right from boundaries where not is_retired"))
def y20_boundary_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "boundaries").where("not is_retired").select("boundary_id", "plate_left", "plate_right")


_INCIDENTS = "with inc as (select boundary_id // 3 as junction_id, * from boundaries where not is_retired)\n"


@query(sql("boundaries", _INCIDENTS + "select junction_id, boundary_id, boundary_type from inc"))
def j2_junction_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.junction_incidents(junctions(spark, sf_dir), table(spark, sf_dir, "boundaries")).select("junction_id", "boundary_id", "boundary_type")


@query(sql("boundaries", _INCIDENTS + """, p as (select distinct junction_id, x.plate from inc, lateral (values (plate_left), (plate_right)) x(plate)),
pl as (select junction_id, string_agg(plate, ',' order by plate) as plates, count(*) = 3 as is_triple from p group by junction_id),
d as (select junction_id, count(*) as degree, string_agg(case boundary_type when 'Divergent' then 'R' when 'Transform' then 'F' else 'T' end, '' order by case boundary_type when 'Divergent' then 'R' when 'Transform' then 'F' else 'T' end) as letters from inc group by junction_id)
select d.junction_id, degree, plates, is_triple, case when degree = 3 then case letters when 'FRR' then 'RRF' when 'FFR' then 'RFF' when 'FRT' then 'RFT' else letters end end as class from d join pl using (junction_id)"""))
def a11_junction_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topology.junction_set(topology.junction_incidents(junctions(spark, sf_dir), table(spark, sf_dir, "boundaries")))
    return found.withColumn("plates", F.array_join(F.transform("plates", lambda p: p.cast("string")), ","))


@query(sql("boundaries", _INCIDENTS + """select 'open boundary' as kind, boundary_id as id, count(*) as n from inc group by boundary_id having count(*) <> 2
union all select 'dangling junction', junction_id, count(*) from inc group by junction_id having count(*) = 1"""))
def a12_topology_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "boundaries")
    return topology.diagnostics(topology.junction_incidents(junctions(spark, sf_dir), b), b)


@query(sql("plates boundaries", "select plate_id from plates where active except select plate_left from boundaries where boundary_type = 'Divergent' and lon0 = 10"))
def j9_missing_plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plates without a divergent boundary that begins on the meridian at 10."""
    have = table(spark, sf_dir, "boundaries").where("boundary_type = 'Divergent' and lon0 = 10").select(F.col("plate_left").alias("plate_id"))
    return topology.missing_plates(table(spark, sf_dir, "plates"), have)


@query(sql("plates boundaries", "select plate_id from plates where active except select plate_right from boundaries where lat0 = 0 and lon0 < -120"))
def u2_except_plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "plates").where("active").select("plate_id")
    return a.exceptAll(table(spark, sf_dir, "boundaries").where("lat0 = 0 and lon0 < -120").select(F.col("plate_right").alias("plate_id")).distinct())


@query(sql("boundaries", """with inc as (select boundary_id // 3 as junction_id, * from boundaries where not is_retired),
p as (select distinct junction_id, x.plate from inc, lateral (values (plate_left), (plate_right)) x(plate)),
t as (select junction_id, list(plate order by plate) as ps from p group by junction_id having count(*) = 3),
q as (select junction_id, ps[k] as a, ps[k % 3 + 1] as b from t, (values (1), (2), (3)) v(k)),
v as (select junction_id, (a * a % 11 - b * b % 11) * 0.01 + (a - b) * 0.000001 * (junction_id % 3) as x, ((a * 7) % 13 - (b * 7) % 13) * 0.01 as y, 0.0 as z from q)
select junction_id, round(sum(x), 6) + 0.0 as x, round(sum(y), 6) + 0.0 as y, round(sqrt(sum(x) * sum(x) + sum(y) * sum(y)), 6) + 0.0 as residual, sqrt(sum(x) * sum(x) + sum(y) * sum(y)) < 0.000001 as is_closed from v group by junction_id"""))
def a13_junction_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    triples = topology.junction_set(topology.junction_incidents(junctions(spark, sf_dir), table(spark, sf_dir, "boundaries"))).where("is_triple")
    a, b = F.col("plate_a"), F.col("plate_b")
    pairs = triples.select("junction_id", F.posexplode("plates").alias("k", "plate_a"), "plates").withColumn("plate_b", F.element_at("plates", ((F.col("k") + 1) % 3 + 1).cast("int")))
    x = ((a * a) % 11 - (b * b) % 11) * 0.01 + (a - b) * 0.000001 * (F.col("junction_id") % 3)
    measured = pairs.select("junction_id", "plate_a", "plate_b", space.vec(x, ((a * 7) % 13 - (b * 7) % 13) * 0.01, 0.0).alias("v"))
    c = topology.closure(triples, measured)
    return c.select("junction_id", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"), r6(F.col("residual")).alias("residual"), "is_closed")


def _grid_map(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A map of darts over the customers as a grid of junctions on the sphere: boundaries run east and north between them.

    Rows hold 40 customers, the last one what is left; each cell with four corners is a face, so faces grow with the table.
    """
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"))
    n = c.agg(F.count(F.lit(1)).alias("n"))
    i, j = F.col("k") % 40, F.expr("k div 40")
    at = c.join(F.broadcast(n)).withColumns({"i": i, "j": j, "rows": F.greatest(F.expr("n div 40"), F.lit(1))})  # one row
    at = at.withColumn("position", space.latlon_to_unit(-60 + F.col("j") * 120.0 / F.col("rows"), F.col("i") * 2.0))
    cell = (F.col("i") < 39) & (F.col("k") + 41 < F.col("n"))
    own = F.when(cell, F.col("k")).otherwise(-1)
    east = at.where("i < 39 and k + 1 < n").select((F.col("k") * 2).alias("boundary_id"), F.col("k").alias("start"), (F.col("k") + 1).alias("end"), F.lit(0.0).alias("a0"), F.pi().alias("a1"), own.alias("plate_left"), F.when(F.col("j") > 0, F.col("k") - 40).otherwise(-1).alias("plate_right"))
    north = at.where("k + 40 < n").select((F.col("k") * 2 + 1).alias("boundary_id"), F.col("k").alias("start"), (F.col("k") + 40).alias("end"), (F.pi() / 2).alias("a0"), (-F.pi() / 2).alias("a1"), F.when(F.col("i") > 0, F.col("k") - 1).otherwise(-1).alias("plate_left"), own.alias("plate_right"))
    b = east.unionByName(north)
    angles = b.select("boundary_id", F.explode(F.array(F.struct(F.lit(0).alias("place"), F.col("a0").alias("angle")), F.struct(F.lit(1).alias("place"), F.col("a1").alias("angle")))).alias("x")).select("boundary_id", "x.*")
    return {"boundaries": b, "darts": topology.darts(b.select("boundary_id", "start", "end"), angles), "positions": at.select(F.col("k").alias("junction_id"), "position"), "cells": at.where(cell).select(F.col("k").alias("plate_id"), F.lit(True).alias("active")), "cell_rows": at.where(cell).select("k", "rows")}


_GRID = """with a as (select c_custkey as k, c_custkey % 40 as i, c_custkey // 40 as j, count(*) over () as n, greatest(count(*) over () // 40, 1) as r from customer),
b as (select 2 * k as id, k as s, k + 1 as e, 0.0 as a0, pi() as a1 from a where i < 39 and k + 1 < n union all select 2 * k + 1, k, k + 40, pi() / 2, -pi() / 2 from a where k + 40 < n),
c as (select k, j, r, radians(-60 + j * 120.0 / r) as s, radians(-60 + (j + 1) * 120.0 / r) as t, radians(2.0) as w, radians(i * 2.0) as lo from a where i < 39 and k + 41 < n)
"""


@query(_GRID + """, d as (select 2 * id as dart, id as boundary_id, s as origin, e as target, 2 * id + 1 as twin, a0 as angle from b union all select 2 * id + 1, id, e, s, 2 * id, a1 from b),
o as (select dart, coalesce(lead(dart) over w, first_value(dart) over w) as after from d window w as (partition by origin order by angle desc))
select d.dart, boundary_id, origin, target, twin, o.after as next from d join o on o.dart = d.twin""")
def y17_darts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid_map(spark, sf_dir)["darts"]


@query(_GRID + """select 4 * k as face, cast(4 as bigint) as n, cast(4 as bigint) as n_places, cast(0 as bigint) as first from c
union all select 1, (select 2 * count(*) from b) - 4 * (select count(*) from c), (select 2 * count(*) from b) - 4 * (select count(*) from c), 0""")
def y18_walk_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four darts of each cell, counted from the cell's least dart, and all others around the outside."""
    f = topology.walk_faces(_grid_map(spark, sf_dir)["darts"])
    return f.groupBy("face").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("position").alias("n_places"), F.min("position").alias("first"))


@query(_GRID + """, v as (select k, j, unnest([{'la': s, 'lo': lo}, {'la': s, 'lo': lo + w}, {'la': t, 'lo': lo + w}, {'la': t, 'lo': lo}], recursive := true) from c),
m as (select k, round(sum(cos(la)*cos(lo)), 6) + 0.0 as sum_x, round(sum(cos(la)*sin(lo)), 6) + 0.0 as sum_y, round(sum(sin(la)), 6) + 0.0 as sum_z from v group by k)
select k as plate_id, true as is_outer, 4 as n_vertices, sum_x, sum_y, sum_z, round(2 * atan2(v1, d1) + 2 * atan2(v2, d2), 6) + 0.0 as area from (select k,
    -- triangles (s,0) (s,w) (t,w) and (s,0) (t,w) (t,0): triple products and denominators
    cos(s) * sin(w) * (sin(t) * cos(s) - sin(s) * cos(t)) as v1,
    1 + (cos(s) * cos(s) * cos(w) + sin(s) * sin(s)) + cos(t - s) + (cos(s) * cos(t) * cos(w) + sin(s) * sin(t)) as d1,
    cos(t) * sin(w) * (sin(t) * cos(s) - sin(s) * cos(t)) as v2,
    1 + (cos(s) * cos(t) * cos(w) + sin(s) * sin(t)) + (cos(t) * cos(t) * cos(w) + sin(t) * sin(t)) + cos(t - s) as d2 from c) join m using (k)""")
def y19_polygonize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons of the grid's faces: every cell has one outer ring, the outside is dropped."""
    m = _grid_map(spark, sf_dir)
    p = topology.polygonize(m["darts"], m["positions"], m["boundaries"])
    total = lambda c: r6(F.aggregate("ring", F.lit(0.0), lambda s, v: s + v[c])).alias(f"sum_{c}")
    return p.select("plate_id", "is_outer", F.size("ring").alias("n_vertices"), total("x"), total("y"), total("z"), r6(F.col("area")).alias("area"))


@query(_GRID + "select count(*) as n_faces, cast(0 as bigint) as n_holes, cast(0 as bigint) as n_missing, 'ok' as status, true as near_band from c")
def y21_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict partition, quality and coverage of the grid's polygons; their area is near that of the bands that they cover."""
    m = _grid_map(spark, sf_dir)
    p = cut(topology.polygonize(m["darts"], m["positions"], m["boundaries"]))
    none = m["boundaries"].where("boundary_id < 0").select("boundary_id")
    row = topology.partition_status(p, m["cells"], none).join(F.broadcast(topology.quality(p, 1e-12)))  # tables of one row
    rows = m["cells"].agg((F.max("plate_id") + 42).alias("n")).withColumn("r", F.expr("n div 40"))
    lat = lambda j: F.radians(-60 + j * 120.0 / F.col("r"))
    last = F.greatest(F.col("n") % 40 - 1, F.lit(0))
    band = F.radians(F.lit(78.0)) * (F.sin(lat(F.col("r") - 1)) + F.sin(F.radians(F.lit(60.0)))) + F.radians(2.0 * last) * (F.sin(lat(F.col("r"))) - F.sin(lat(F.col("r") - 1)))
    return row.join(F.broadcast(rows)).select("n_faces", "n_holes", "n_missing", "status", (F.abs(F.col("area") / band - 1) < 0.02).alias("near_band"))


@query(sql("boundaries", """with v as (select radians(lat0) as a, radians(lon0) as b, radians(lat1) as c, radians(lon1) as d from boundaries),
e as (select avg(sqrt(power(cos(a)*cos(b)-cos(c)*cos(d),2)+power(cos(a)*sin(b)-cos(c)*sin(d),2)+power(sin(a)-sin(c),2))) as m from v)
select round(m, 6) + 0.0 as mean_chord, 1.0::double as density, round(least(greatest(m * 2e-2, 1e-12), 1e-6) * 1e9, 6) + 0.0 as epsilon_e9 from e"""))
def a18_density_epsilon(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "boundaries")
    line = F.array(space.latlon_to_unit(F.col("lat0"), F.col("lon0")), space.latlon_to_unit(F.col("lat1"), F.col("lon1")))
    found = partition.density_epsilon(b.select("boundary_id", line.alias("line")))
    return found.select(r6(F.col("mean_chord")).alias("mean_chord"), "density", r6(F.col("epsilon") * 1e9).alias("epsilon_e9"))


#: Tolerances of the four levels, and by how much ends are moved, in units of 1e-10.
_MOVED = "case h when 0 then 50 when 1 then 500 when 2 then 5000 when 3 then 50000 else 3 * (h % 3) end"


def _torn_ends(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The grid map, and the ends of its boundaries moved off their junctions along x: most hardly, some by more than a tolerance."""
    m = _grid_map(spark, sf_dir)
    both = F.explode(F.array(*(F.struct(F.lit(k).alias("place"), F.col(c).alias("junction_id")) for k, c in enumerate(("start", "end")))))
    ends = m["boundaries"].select("boundary_id", both.alias("e")).select("boundary_id", "e.*").join(m["positions"], "junction_id")
    ends = ends.withColumn("h", (F.col("boundary_id") * 7 + F.col("place") * 3) % 101)
    at = F.struct((F.col("position.x") + F.expr(_MOVED) * 1e-10).alias("x"), F.col("position.y").alias("y"), F.col("position.z").alias("z"))
    return m, ends.select("boundary_id", "place", at.alias("position"))


def _map_of(snapped: DataFrame, boundaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Darts and positions of snapped ends."""
    side = lambda k: F.max(F.when(F.col("place") == k, F.col("junction_id")))
    lines = snapped.groupBy("boundary_id").agg(side(0).alias("start"), side(1).alias("end"))
    angle = F.explode(F.array(F.struct(F.lit(0).alias("place"), F.col("a0").alias("angle")), F.struct(F.lit(1).alias("place"), F.col("a1").alias("angle"))))
    return topology.darts(lines, boundaries.select("boundary_id", angle.alias("x")).select("boundary_id", "x.*")), snapped.select("junction_id", "position").distinct()


_TORN = _GRID + f""", t as (select id, 0 as place, s as k from b union all select id, 1, e from b),
t2 as (select *, (id * 7 + place * 3) % 101 as h from t),
t3 as (select id, place, k, {_MOVED} as d, lv.level, lv.eps from t2, (values (0, 10), (1, 100), (2, 1000), (3, 10000)) lv(level, eps)),
t4 as (select *, case when d - lag(d) over w <= eps then 0 else 1 end as apart from t3 window w as (partition by level, k order by d, id, place)),
t5 as (select *, sum(apart) over (partition by level, k order by d, id, place) as part from t4),
torn as (select level, id, place, k, min(2 * id + place) over (partition by level, k, part) as junction, count(*) over (partition by level, k, part) as degree from t5)
"""


@query(_TORN + "select id as boundary_id, place, level, junction from torn")
def y21_snapped_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which ends join with each tolerance, from 1e-9 to 1e-6: all four maps in one pass."""
    _, ends = _torn_ends(spark, sf_dir)
    level = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.lit(e).alias("eps")) for k, e in enumerate(partition.tolerances(1e-9)))))
    found = partition.snap_ends(ends.select("*", level.alias("l")).select("boundary_id", "place", "position", "l.*"), F.col("eps"), ("level",))
    return found.select("boundary_id", "place", "level", F.col("junction_id").alias("junction"))


@query(_TORN + """, corner as (select k as cell, x.* from c, lateral (values
  (0, 2 * k, 0, 2 * k + 1, 0), (1, 2 * k, 1, 2 * k + 3, 0), (2, 2 * k + 3, 1, 2 * k + 80, 1), (3, 2 * k + 1, 1, 2 * k + 80, 0)) x(corner, b1, p1, b2, p2)),
whole as (select u.level, cell, bool_and(u.junction = v.junction) as whole from corner join torn u on u.id = b1 and u.place = p1 join torn v on v.id = b2 and v.place = p2 and v.level = u.level group by all),
counts as (select level, count(*) filter (where not whole) as n_missing, count(*) as n_plates from whole group by level),
f as (select level, count(distinct id) filter (where degree = 1) as n_open, count(*) filter (where degree = 1) as n_non_manifold from torn group by level),
s as (select level, n_plates, n_missing, n_open, n_non_manifold, case when n_missing + n_open + n_non_manifold > 0 then 'error' else 'ok' end as strict,
  case when n_missing = n_plates then 'error' when n_missing + n_open + n_non_manifold > 0 then 'warning' else 'ok' end as lenient from counts join f using (level))
select *, level = (select min(level) from s where lenient <> 'error') as chosen from s""")
def y21_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partition at each tolerance that the default policy tries, with its status; the first that is no error is chosen."""
    m, ends = _torn_ends(spark, sf_dir)
    level = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.lit(e).alias("eps")) for k, e in enumerate(partition.tolerances(1e-9)))))
    each = lambda df: df.select("*", level.alias("_l")).select("*", "_l.*").drop("_l").withColumn("boundary_id", F.col("boundary_id") * 4 + F.col("level"))
    snapped = cut(partition.snap_ends(each(ends), F.col("eps"), ("level",)))
    maps = cut(each(m["boundaries"]))
    darts, positions = _map_of(snapped, maps)
    polygons = topology.polygonize(darts, positions, maps, ("level",))
    rows = cut(partition.statuses(polygons, m["cells"], partition.faults(snapped, ("level",)), "level"))
    first = rows.where("lenient <> 'error'").agg(F.min("level").alias("_first"))
    return rows.join(F.broadcast(first)).withColumn("chosen", F.coalesce(F.col("level") == F.col("_first"), F.lit(False))).drop("_first")  # one row


@query(_TORN.replace("with a as", "with recursive a as", 1) + """, line as (select id, min(junction) as u, max(junction) as v from torn where level = 0 group by id),
step as (select u, v from line union select v, u from line),
main(node) as (select min(u) from step union select v from main join step on node = u),
rest(start, node) as (select u, u from step where u not in (select node from main) union select start, v from rest join step on node = u),
label as (select node, (select min(node) from main) as piece from main union all select node, min(start) from rest group by node)
select piece, count(distinct node) as n_junctions, count(distinct id) as n_boundaries, 2 - count(distinct node) + count(distinct id) as n_faces, cast(2 as bigint) as euler
from label join line on node in (u, v) group by piece""")
def a9_partition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The torn map's pieces with V - E + F, its faces walked; a piece on a sphere has 2."""
    m, ends = _torn_ends(spark, sf_dir)
    snapped = cut(partition.snap_ends(ends, F.lit(1e-9)))
    darts = cut(_map_of(snapped, m["boundaries"])[0])
    faces = topology.walk_faces(darts).join(darts.select("dart", F.col("origin").alias("junction_id")), "dart").select("face", "junction_id")
    return partition.pieces(snapped, faces)


def _island_map(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The grid with an island in every fifth cell, in every tenth another one on it, and two rings around the north pole.

    Sides are great circles, and a cell's south side can bulge further north than a low cell is high. So the islands' corners lie
    between the cell's corners in their plane: what lies inside there does so on the sphere, however many rows there are.
    """
    m = _grid_map(spark, sf_dir)
    grid = m["boundaries"].select("boundary_id", "start", "end", "a0", "a1", *(F.when(F.col(c) >= 0, F.col(c)).alias(c) for c in ("plate_left", "plate_right")))
    # The corners of a ring eastward along its south, and for each side the directions at its start and end.
    turn = [(0.0, math.pi), (math.pi / 2, -math.pi / 2), (math.pi, 0.0), (-math.pi / 2, math.pi / 2)]
    cell = m["cell_rows"]
    lat = lambda f: F.radians(-60 + (F.expr("k div 40") + f) * 120.0 / F.col("rows"))
    lon = lambda f: F.radians((F.col("k") % 40 + f) * 2.0)
    mixed = lambda of, at, f: of(at(0)) * (1.0 - f) + of(at(1)) * f
    flat = lambda n, e: space.vec(mixed(F.cos, lat, n) * mixed(F.cos, lon, e), mixed(F.cos, lat, n) * mixed(F.sin, lon, e), mixed(F.sin, lat, n))
    islands = [(5, 0, 0.25, 1_000_000 + F.col("k") % 3, F.col("k")), (10, 4, 0.4, F.col("k"), 1_000_000 + F.col("k") % 3)]
    lines, spots = [], []
    for every, first, inset, left, right in islands:
        own = cell.where(F.col("k") % every == 0)
        corners = [(inset, inset), (inset, 1 - inset), (1 - inset, 1 - inset), (1 - inset, inset)]
        for s in range(4):
            at = F.col("k") * 8 + 1_000_000_000 + first
            lines.append(own.select((at + s).alias("boundary_id"), (at + s).alias("start"), (at + (s + 1) % 4).alias("end"), F.lit(turn[s][0]).alias("a0"), F.lit(turn[s][1]).alias("a1"), left.cast("long").alias("plate_left"), right.cast("long").alias("plate_right")))
            spots.append(own.select((at + s).alias("junction_id"), space.let(flat(*corners[s]), space.normalize).alias("position")))
    polar = spark.range(8).select(F.col("id"), F.expr("id div 4").alias("ring"), (F.col("id") % 4).alias("s"))
    at = 2_000_000_000 + F.col("ring") * 4
    lines.append(polar.select((at + F.col("s")).alias("boundary_id"), (at + F.col("s")).alias("start"), (at + (F.col("s") + 1) % 4).alias("end"), F.lit(0.0).alias("a0"), F.pi().alias("a1"), (2_000_000 + F.col("ring")).alias("plate_left"), F.when(F.col("ring") == 1, F.lit(2_000_000).cast("long")).alias("plate_right")))
    spots.append(polar.select((at + F.col("s")).alias("junction_id"), space.latlon_to_unit(75.0 + 10.0 * F.col("ring"), 90.0 * F.col("s") + 45.0).alias("position")))
    b = cut(reduce(DataFrame.unionByName, lines, grid))
    angles = b.select("boundary_id", F.explode(F.array(F.struct(F.lit(0).alias("place"), F.col("a0").alias("angle")), F.struct(F.lit(1).alias("place"), F.col("a1").alias("angle")))).alias("x")).select("boundary_id", "x.*")
    return {"boundaries": b, "darts": topology.darts(b.select("boundary_id", "start", "end"), angles), "positions": reduce(DataFrame.unionByName, spots, m["positions"])}


@query(_GRID + """select 4 * k as face, k as plate_id, true as is_outer, 4 * k as outer_face from c
union all select 2000000000 + 16 * k, 1000000 + k % 3, true, 2000000000 + 16 * k from c where k % 5 = 0
union all select 2000000001 + 16 * k, k, false, 4 * k from c where k % 5 = 0
union all select 2000000008 + 16 * k, k, true, 2000000008 + 16 * k from c where k % 10 = 0
union all select 2000000009 + 16 * k, 1000000 + k % 3, false, 2000000000 + 16 * k from c where k % 10 = 0
union all values (4000000000, 2000000, true, 4000000000), (4000000008, 2000001, true, 4000000008), (4000000009, 2000000, false, 4000000000)""")
def y19_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of plates with holes, of plates of many outer rings, of islands on islands, and around a pole."""
    m = _island_map(spark, sf_dir)
    return topology.polygonize(m["darts"], m["positions"], m["boundaries"]).select("face", "plate_id", "is_outer", F.col("outer").alias("outer_face"))
