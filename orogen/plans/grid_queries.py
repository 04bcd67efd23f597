"""Queries on velocity grids and raster cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domain import sql, table
from ..operators import grid
from ..registry import query
from ..tables import r6

_STRAIN = """with f as (select j, i, ve, vn, radians(-90 + (j + 0.5) * 10.0) as lat, pi() / 18 as h from velocity),
g as (select c.j, c.i, c.ve, c.vn, c.lat, (e.ve - w.ve) / (2 * c.h) as vi, (e.vn - w.vn) / (2 * c.h) as ni,
    (coalesce(n.ve, c.ve) - coalesce(s.ve, c.ve)) / ((case when n.ve is null or s.ve is null then 1 else 2 end) * c.h) as vj, (coalesce(n.vn, c.vn) - coalesce(s.vn, c.vn)) / ((case when n.vn is null or s.vn is null then 1 else 2 end) * c.h) as nj
  from f c join f e on e.j = c.j and e.i = (c.i + 1) % 36 join f w on w.j = c.j and w.i = (c.i + 35) % 36 left join f n on n.i = c.i and n.j = c.j + 1 left join f s on s.i = c.i and s.j = c.j - 1),
t as (select j, i, vi / cos(lat) - vn * tan(lat) as eee, nj as enn, 0.5 * (vj + ni / cos(lat) + ve * tan(lat)) as een, ni / cos(lat) - vj + ve * tan(lat) as vorticity from g)
"""
_R = lambda *names: ", ".join(f"round({n}, 6) + 0.0 as {n}" for n in names)


@query(sql("velocity", _STRAIN + f"select j, i, {_R('eee', 'enn', 'een')} from t"))
def y12_strain_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = grid.strain_rate(table(spark, sf_dir, "velocity"), 18, 36)
    return s.select("j", "i", *(r6(F.col(c)).alias(c) for c in ("eee", "enn", "een")))


@query(sql("velocity", _STRAIN + "select j, i, round(eee + enn, 6) + 0.0 as dilatation, round(vorticity, 6) + 0.0 as vorticity, round(sqrt(0.5 * (eee*eee + enn*enn) + een*een), 6) + 0.0 as second_invariant, round(greatest(eee + enn, 0), 6) + 0.0 as divergence, round(greatest(-(eee + enn), 0), 6) + 0.0 as convergence from t"))
def y13_deformation_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = grid.strain_rate(table(spark, sf_dir, "velocity"), 18, 36)
    return s.select("j", "i", *(r6(F.col(c)).alias(c) for c in ("dilatation", "vorticity", "second_invariant", "divergence", "convergence")))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "cells").withColumn("sequence_id", F.lit("a"))


_TICKS = "q as (select distinct o_orderkey % 90 as tick from orders)"
_AROUND = f"with {_TICKS}, fr as (select distinct tick as f from cells), ar as (select q.tick, max(f) filter (where f <= q.tick) as b, min(f) filter (where f >= q.tick) as a from q, fr group by q.tick)\n"


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.lit("a").alias("sequence_id"), (F.col("o_orderkey") % 90).alias("tick")).distinct()


@query(sql("cells", _AROUND + "select tick, b as before, a as after from ar"))
def j12_frames_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.frames_around(ticks(spark, sf_dir), cells(spark, sf_dir).select("sequence_id", "tick").distinct()).drop("sequence_id")


def _raster(w: str) -> str:
    return _AROUND + f""", r as (select tick, coalesce(b, a) as b, coalesce(a, b) as a from ar), w as (select *, {w} as w from (select *, case when a = b then 0.0 else (tick - b) / (a - b)::double end as u from r)),
k as (select distinct r, c from cells), j as (select w.tick, k.r, k.c, w.w, x.value as v0, y.value as v1, x.r is not null or y.r is not null as has from w, k left join cells x on x.tick = w.b and x.r = k.r and x.c = k.c left join cells y on y.tick = w.a and y.r = k.r and y.c = k.c)
select tick, r, c, round(case when w = 0 then v0 when w = 1 then v1 else coalesce(v0 + (v1 - v0) * w, v0, v1) end, 4) + 0.0 as value from j where has"""


@query(sql("cells", _raster("u")))
def y22_raster_at_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.raster_at(cells(spark, sf_dir), ticks(spark, sf_dir)).select("tick", "r", "c", (F.round("value", 4) + 0.0).alias("value"))


@query(sql("cells", _raster("case when u > 0.5 then 1.0 else 0.0 end")))
def y22_raster_at_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.raster_at(cells(spark, sf_dir), ticks(spark, sf_dir), "nearest").select("tick", "r", "c", (F.round("value", 4) + 0.0).alias("value"))


@query(sql("cells", "select tick, count(*) as n from cells where tick between 20 and 50 group by tick"))
def y23_raster_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).where(F.col("tick").between(20, 50)).groupBy("tick").agg(F.count(F.lit(1)).alias("n"))


WORLD, SHIFTED, BOX = (-180.0, -90.0, 180.0, 90.0), (-175.0, -90.0, 185.0, 90.0), (-95.0, -40.0, 75.0, 35.0)


@query(sql("cells", "select tick, r, c, case when -180 + c * 10 between -95 and 75 and 90 - r * 10 between -40 and 35 then round(value, 4) + 0.0 end as value from cells"))
def y24_raster_mask_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.mask_bounds(cells(spark, sf_dir), 36, 18, WORLD, BOX).select("tick", "r", "c", (F.round("value", 4) + 0.0).alias("value"))


@query(sql("cells", "select tick, r - 5 as r, c - 8 as c, round(value, 4) + 0.0 as value from cells where r between 5 and 12 and c between 8 and 25"))
def y26_raster_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.crop(cells(spark, sf_dir), 36, 18, WORLD, BOX).select("tick", "r", "c", (F.round("value", 4) + 0.0).alias("value"))


@query(sql("cells", """with s as (select tick, r // 2 as r, c // 2 as c, value, r % 2 as a, c % 2 as b from cells)
select tick, r::integer as r, c::integer as c, round(case when count(value) = 4 then avg(value) else max(value) filter (where a = 1 and b = 1) end, 4) + 0.0 as value from s group by tick, r, c"""))
def y27_raster_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = grid.resample(cells(spark, sf_dir), 36, 18, 18, 9)
    return half.select("tick", "r", "c", (F.round("value", 4) + 0.0).alias("value"))


_ZONES = "with z as (select distinct c_custkey % 18 as r, c_custkey % 36 as c, c_custkey % 12 as plate_id from customer)"


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select((k % 18).alias("r"), (k % 36).alias("c"), (k % 12).alias("plate_id")).distinct()


@query(sql("cells", _ZONES + " select tick, plate_id, count(value) as n, round(avg(value), 4) + 0.0 as mean, round(min(value), 4) + 0.0 as min, round(max(value), 4) + 0.0 as max from cells join z using (r, c) group by all"))
def y28_zonal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = grid.zonal_stats(cells(spark, sf_dir), zones(spark, sf_dir))
    return z.select("tick", "plate_id", "n", *((F.round(c, 4) + 0.0).alias(c) for c in ("mean", "min", "max")))


@query("select p_partkey, least(x0, x1, x2, x3) as west, least(y0, y1, y2, y3) as south, greatest(x0, x1, x2, x3) as east, greatest(y0, y1, y2, y3) as north from (select p_partkey, x0, x0 + 2.0 * w as x1, x0 + 0.5 * h as x2, x0 + 2.0 * w + 0.5 * h as x3, y0, y0 + 0.25 * w as y1, y0 - 1.0 * h as y2, y0 + 0.25 * w - 1.0 * h as y3 from (select p_partkey, p_size as w, p_size % 7 + 1 as h, cast(p_partkey % 90 as double) as x0, cast(p_partkey % 45 as double) as y0 from part))")
def f24_bounds_from_geotransform(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    geo = [(F.col("p_partkey") % 90).cast("double"), F.lit(2.0), F.lit(0.5), (F.col("p_partkey") % 45).cast("double"), F.lit(0.25), F.lit(-1.0)]
    b = grid.bounds_of(geo, F.col("p_size"), F.col("p_size") % 7 + 1)
    return p.select("p_partkey", *(x.alias(n) for x, n in zip(b, ("west", "south", "east", "north"))))
