"""Domain tables as views over the given tables, with the same arithmetic in Spark SQL and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TOPOLOGY = """
select event_id as sequence, {tick} as tick, 's' || cast(user_id % 4 as string) as stream_key, 'e' || cast(event_id as string) as event_id,
  case user_id % 3
    when 0 then case when event_type = 'purchase' then 'PlateRetired' else 'PlateCreated' end
    when 1 then case event_type when 'click' then 'BoundaryTypeChanged' when 'view' then 'BoundaryGeometryUpdated'
                                when 'purchase' then 'BoundaryRetired' else 'BoundaryCreated' end
    else case event_type when 'view' then 'JunctionUpdated' when 'error' then 'JunctionUpdated'
                         when 'purchase' then 'JunctionRetired' else 'JunctionCreated' end end as event_type,
  case when user_id % 3 = 0 then 'p' || cast(user_id as string) end as plate_id,
  case when user_id % 3 = 1 then 'b' || cast(user_id as string) end as boundary_id,
  case when user_id % 3 = 2 then 'j' || cast(user_id as string) end as junction_id,
  case when user_id % 3 = 1 and event_type in ('signup', 'error') then 'p' || cast(3 * ((3 * user_id) % 4 + 4 * (event_id % (case when event_id % 3 = 0 then 12 else 2 end))) as string) end as plate_id_left,
  case when user_id % 3 = 1 and event_type in ('signup', 'error') then 'p' || cast(3 * ((3 * user_id) % 4 + 4 * ((event_id + 5) % (case when event_id % 3 = 0 then 12 else 2 end))) as string) end as plate_id_right,
  case when user_id % 3 = 1 and event_type in ('signup', 'error', 'click')
       then case cast(floor(value) as bigint) % 3 when 0 then 'Divergent' when 1 then 'Convergent' else 'Transform' end end as boundary_type,
  case when user_id % 3 = 1 and event_type in ('signup', 'error', 'view') then event_id % 360 end as geometry_seed,
  case when user_id % 3 = 2 and event_type in ('signup', 'click', 'view') then event_id % 12 end as incidence_seed,
  case when user_id % 3 = 2 and event_type in ('signup', 'click', 'error') then cast(event_id % 5 as double) end as radius,
  case when event_type = 'purchase' and event_id % 5 > 0 then 'reason' || cast(event_id % 5 as string) end as reason
from events
"""
_PLATES = "select cast(n_nationkey as bigint) as plate_id, n_regionkey > 0 as active from nation"
_BOUNDARIES = """
select o_orderkey as boundary_id, o_custkey % 25 as plate_left, (o_custkey % 25 + 1 + o_orderkey % 24) % 25 as plate_right,
  case cast(substring(o_orderpriority, 1, 1) as bigint) % 3 when 0 then 'Divergent' when 1 then 'Convergent' else 'Transform' end as boundary_type,
  o_orderstatus = 'F' as is_retired,
  cast((o_orderkey * 37) % 340 - 170 as double) as lon0, cast((o_orderkey * 53) % 140 - 70 as double) as lat0,
  cast((o_orderkey * 37) % 340 - 170 + 1 + o_orderkey % 9 as double) as lon1, cast((o_orderkey * 53) % 140 - 70 + o_orderkey % 7 - 3 as double) as lat1
from orders
"""
_SEGMENTS = """
select 'g' || lpad(cast(p_partkey as string), 12, '0') as segment_id, p_partkey % 25 as plate_id,
  10 * {seg} as tick_a, 10 * {seg} + 8 as tick_b,
  cast((p_size * 7000000) % 180000000 as integer) as azimuth, cast((p_partkey * 1300000) % 90000000 as integer) as elevation,
  cast(100000 + (p_partkey * 1000) % 900000 as integer) as angle
from part
"""
_POINTS = """
select c_custkey as point_id, cast((c_custkey * 137) % 360 - 180 as double) + 0.25 as lon, cast((c_custkey * 61) % 170 - 85 as double) + 0.25 as lat,
  case when c_custkey % 3 = 0 then c_custkey % 25 end as plate_id, c_acctbal as weight
from customer
"""
_CELLS = """
select cast(l_linenumber as bigint) * 10 as tick, l_suppkey % 18 as r, l_partkey % 36 as c,
  case when count(*) % 7 = 0 then null else max(l_extendedprice) end as value, count(*) as n
from lineitem group by l_linenumber, l_suppkey % 18, l_partkey % 36
"""
_VELOCITY = """
select l_suppkey % 18 as j, l_partkey % 36 as i, avg(l_extendedprice) * 0.000001 as ve, avg(l_quantity) * 0.001 as vn
from lineitem group by l_suppkey % 18, l_partkey % 36
"""
_BODIES = """
select s_suppkey as body_id, s_suppkey % 10 as system_id,
  case when s_suppkey < 10 then null else s_suppkey - 10 * (1 + s_suppkey % 3 % (case when s_suppkey < 20 then 1 when s_suppkey < 30 then 2 else 3 end)) end as parent_id,
  case when s_suppkey < 10 then 'star' when s_suppkey < 50 then 'planet' else 'moon' end as body_type,
  1e24 * (1 + s_suppkey % 9) as mass_kg, 1e9 * (1 + s_suppkey % 40) as a_m, (s_suppkey % 8) / 10.0 as ecc,
  (s_suppkey % 6) / 10.0 as m0, s_acctbal as tilt
from supplier
"""
_DIALECT = {
    "spark": {"tick": "(unix_micros(cast(ts as timestamp)) - 1704067200000000) div 3600000000 - (event_id % 7) * 5", "seg": "(p_partkey div 25)"},
    "duckdb": {"tick": "(epoch_us(ts) - 1704067200000000) // 3600000000 - (event_id % 7) * 5", "seg": "(p_partkey // 25)"},
}
VIEWS = {
    "topology": (_TOPOLOGY, "events"), "plates": (_PLATES, "nation"), "boundaries": (_BOUNDARIES, "orders"), "segments": (_SEGMENTS, "part"),
    "points": (_POINTS, "customer"), "cells": (_CELLS, "lineitem"), "velocity": (_VELOCITY, "lineitem"), "bodies": (_BODIES, "supplier"),
}


def table(spark: SparkSession, sf_dir: str, name: str, rows: DataFrame | None = None) -> DataFrame:
    """A domain table; the driver's table is read (or `rows` in its place, a stream too), nothing is cached."""
    text, source = VIEWS[name]
    path = f"{sf_dir}/{source}.parquet"
    return spark.sql(text.format(**_DIALECT["spark"]).replace(f"from {source}", "from {src}"), src=spark.read.parquet(path) if rows is None else rows)


def topology_events(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """The topology log in the library's schema: geometry, location and boundary_ids as nested values."""
    t = table(spark, sf_dir, "topology", rows)
    point = lambda k: F.struct((F.col("geometry_seed") + k).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    base = F.expr("(3 * (cast(substring(junction_id, 2) as bigint) + 3)) % 4")
    bid = lambda k: F.concat(F.lit("b"), (3 * (base + 4 * ((F.col("incidence_seed") + k) % 12)) + 1).cast("string"))
    seeded = F.col("incidence_seed").isNotNull()
    return t.select(
        "stream_key", "sequence", "tick", "event_id", "event_type", "plate_id", "boundary_id", "junction_id", "plate_id_left", "plate_id_right", "boundary_type", "reason",
        F.when(F.col("geometry_seed").isNotNull(), F.struct(F.lit("Polyline3").alias("kind"), F.array(point(0), point(1)).alias("coords"))).alias("geometry"),
        F.when(seeded, F.array(bid(0), bid(1), bid(4))).otherwise(F.when(F.col("event_type").startswith("Junction"), F.array().cast("array<string>"))).alias("boundary_ids"),
        F.when(F.col("radius").isNotNull(), F.struct(F.lit(1.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(0.0).alias("nz"), F.col("radius").alias("radius"))).alias("location"),
    )


def sql(names: str, body: str) -> str:
    """DuckDB text: the named domain tables as common table expressions, then the query."""
    parts = [f"{n} as ({VIEWS[n][0].format(**_DIALECT['duckdb'])})" for n in names.split()]
    more = body.lstrip()
    if more.lower().startswith("with recursive"):
        return f"with recursive {', '.join(parts)}, {more[14:]}"
    if more.lower().startswith("with"):
        return f"with {', '.join(parts)}, {more[4:]}"
    return f"with {', '.join(parts)} {more}"
