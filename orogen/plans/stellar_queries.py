"""Queries on bodies and insolation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domain import sql, table
from ..operators import stellar
from ..registry import query
from ..tables import r6

_M = "2e30::double"


@query(sql("bodies", f"select body_id, round(2 * pi() * sqrt(a_m*a_m*a_m / (6.6743e-11 * {_M})) / 86400, 6) + 0.0 as period_days, round(a_m * (1 - ecc) / 1e6, 6) + 0.0 as periapsis, round(a_m * (1 + ecc) / 1e6, 6) + 0.0 as apoapsis, round(sqrt(6.6743e-11 * {_M} * (2 / (a_m * (1 - ecc)) - 1 / a_m)) / 1000, 6) + 0.0 as speed, round(a_m * (1 - ecc) * power(mass_kg / (3 * {_M}), 1/3.0) / 1e6, 6) + 0.0 as hill from bodies"))
def f25_orbits(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "bodies")
    a, e, m = F.col("a_m"), F.col("ecc"), F.lit(2e30)
    return b.select("body_id", r6(stellar.period(a, m) / 86400).alias("period_days"), r6(a * (1 - e) / 1e6).alias("periapsis"), r6(a * (1 + e) / 1e6).alias("apoapsis"), r6(stellar.vis_viva(a, a * (1 - e), m) / 1000).alias("speed"), r6(stellar.hill_radius(a, e, F.col("mass_kg"), m) / 1e6).alias("hill"))


@query(sql("bodies", "select body_id, t, true as solved from bodies, (values (0.0), (86400.0), (864000.0)) v(t)"))
def y29_ephemeris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions solve Kepler's equation: residual under 1e-9, and x, y lie at distance r."""
    b = table(spark, sf_dir, "bodies").withColumn("parent_mass", F.lit(2e30))
    e = stellar.ephemeris(b, [0.0, 86400.0, 864000.0])
    residual = F.abs(F.col("anomaly") - F.col("ecc") * F.sin("anomaly") - F.col("mean"))
    off = F.abs(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2) / F.col("r") - 1)
    return e.select("body_id", "t", ((residual < 1e-9) & (off < 1e-9)).alias("solved"))


@query(sql("points", """with d as (select lat, day, asin(sin(radians(23.44)) * sin(2 * pi() * day / 365.25)) as dec from points, (values (0.0), (80.0), (172.0), (266.0), (355.0)) v(day)),
h as (select *, acos(greatest(least(-tan(radians(lat)) * tan(dec), 1.0), -1.0)) as h from d)
select lat, day, round(avg(24 / pi() * h), 6) + 0.0 as hours, round(avg(1361.0 / pi() * (h * sin(radians(lat)) * sin(dec) + cos(radians(lat)) * cos(dec) * sin(h))), 6) + 0.0 as flux from h group by lat, day"""))
def y30_insolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "points").withColumn("day", F.explode(F.array(*(F.lit(x) for x in (0.0, 80.0, 172.0, 266.0, 355.0)))))
    p = p.withColumn("dec", stellar.declination(F.col("day"), F.lit(23.44)))
    return p.groupBy("lat", "day").agg(r6(F.avg(stellar.day_length_hours(F.col("lat"), F.col("dec")))).alias("hours"), r6(F.avg(stellar.daily_mean_flux(F.lit(1361.0), F.col("lat"), F.col("dec")))).alias("flux"))


@query(sql("bodies", "select body_id, body_type from bodies where body_type = 'planet'"))
def p13_bodies_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "bodies").where("body_type = 'planet'").select("body_id", "body_type")


_TREE = """with recursive t as (select system_id, body_id, case when body_id % 13 = 5 then -1 when body_id % 17 = 3 then body_id + 20 when body_id < 10 then null else parent_id end as parent_id from bodies),
ids as (select distinct system_id, body_id from t),
walk as (select system_id, body_id, parent_id as at, 1 as n from t where parent_id is not null union all select w.system_id, w.body_id, p.parent_id, w.n + 1 from walk w join t p on p.system_id = w.system_id and p.body_id = w.at where p.parent_id is not null and w.n < 300)
select t.system_id, t.body_id, 'missing parent' as fault from t left join ids on ids.system_id = t.system_id and ids.body_id = t.parent_id where t.parent_id is not null and ids.body_id is null
union all select distinct system_id, body_id, 'cycle' from walk where n = 300"""


@query(sql("bodies", _TREE))
def y31_body_tree_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body trees with planted faults: missing parents, and pointers upward that make cycles (J19)."""
    k = F.col("body_id")
    parent = F.when(k % 13 == 5, F.lit(-1)).when(k % 17 == 3, k + 20).when(k < 10, None).otherwise(F.col("parent_id"))
    return stellar.tree_faults(table(spark, sf_dir, "bodies").select("system_id", "body_id", parent.alias("parent_id")))


@query(sql("bodies", """with e as (select system_id, body_id, parent_id, mass_kg, a_m, 'BodyAdded' as t, 1 as s from bodies union all select system_id, body_id, null, null, a_m * 2, 'OrbitChanged', 2 from bodies where body_id % 3 = 0 union all select system_id, body_id, null, null, null, 'BodyRemoved', 3 from bodies where body_id % 7 = 0)
select system_id, body_id, max(parent_id) as parent_id, max(mass_kg) as mass_kg, arg_max(a_m, s) as a_m from e group by all having arg_max(t, s) filter (where t <> 'OrbitChanged') = 'BodyAdded'"""))
def y35_materialize_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "bodies").select("system_id", "body_id", "parent_id", "mass_kg", "a_m")
    none = lambda c: F.lit(None).cast("double" if c != "parent_id" else "long").alias(c)
    added = b.select("*", F.lit("BodyAdded").alias("event_type"), F.lit(1).alias("sequence"))
    moved = b.where("body_id % 3 = 0").select("system_id", "body_id", none("parent_id"), none("mass_kg"), (F.col("a_m") * 2).alias("a_m"), F.lit("OrbitChanged").alias("event_type"), F.lit(2).alias("sequence"))
    gone = b.where("body_id % 7 = 0").select("system_id", "body_id", none("parent_id"), none("mass_kg"), none("a_m"), F.lit("BodyRemoved").alias("event_type"), F.lit(3).alias("sequence"))
    return stellar.bodies_at(added.unionByName(moved).unionByName(gone), 10)
