"""Queries on requests, keys and records for exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domain import sql, table, topology_events
from ..functions import ids
from ..operators import log, motion, requests
from ..registry import query

#: A request for each order: the type goes round the six, parts are missing by divisibility of the key.
_REQUESTS = """select o_orderkey as request_id, case o_orderkey % 6 when 0 then 'Reconstruct' when 1 then 'QueryPlateId' when 2 then 'QueryVelocity' when 3 then 'BoundaryAnalytics' when 4 then 'MotionPath' else 'Flowline' end as query_type,
  case when o_orderkey % 5 > 0 then 'mantle' end as frame, case o_orderkey % 7 when 0 then null when 1 then '' else 'm' || cast(o_orderkey % 7 as string) end as kinematics_model,
  case when o_orderkey % 11 > 0 then 0.001 end as partition_tolerance, case when o_orderkey % 4 > 0 then 16 end as boundary_sampling, case when o_orderkey % 8 > 3 then 'Euler' end as integration_policy from orders"""


@query(f"""with q as ({_REQUESTS}), m as (select request_id, 'frame' as part from q where query_type <> 'QueryPlateId' and frame is null
  union all select request_id, 'kinematics_model' from q where coalesce(kinematics_model, '') = '' union all select request_id, 'partition_tolerance' from q where partition_tolerance is null
  union all select request_id, 'boundary_sampling' from q where query_type = 'BoundaryAnalytics' and boundary_sampling is null union all select request_id, 'integration_policy' from q where query_type in ('MotionPath', 'Flowline') and integration_policy is null),
l as (select request_id, string_agg(part, ',' order by part) as errors from m group by request_id)
select request_id, query_type, coalesce(errors, '') as errors, errors is null as is_valid from q left join l using (request_id)""")
def p12_policy_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_REQUESTS.replace("from orders", "from {o}"), o=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return requests.policy_check(rows).select("request_id", "query_type", F.array_join("errors", ",").alias("errors"), "is_valid")


@query(f"with q as ({_REQUESTS}) select request_id, left(sha256(concat(query_type, chr(10), coalesce(frame, ''), chr(10), coalesce(kinematics_model, ''))), 16) as key from q")
def f22_policy_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_REQUESTS.replace("from orders", "from {o}"), o=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return rows.select("request_id", ids.short_hash(F.col("query_type"), F.col("frame"), F.col("kinematics_model")).alias("key"))


@query(sql("boundaries", """select boundary_id, sha256('{"kind":"box","plate":' || plate_left || ',"name":"' || boundary_type || '"}') as hash from boundaries"""))
def f23_region_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = F.struct(F.lit("box").alias("kind"), F.col("plate_left").alias("plate"), F.col("boundary_type").alias("name"))
    return table(spark, sf_dir, "boundaries").select("boundary_id", ids.region_hash(spec).alias("hash"))


@query(sql("segments", """select plate_id, segment_id, '{"plate_id":' || plate_id || ',"segment_id":"' || segment_id || '","tick_a":' || tick_a || ',"tick_b":' || tick_b || ',"azimuth":' || azimuth || ',"elevation":' || elevation || ',"angle":' || angle || '}' as record from segments"""))
def s16_export_motion_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.segment_records(table(spark, sf_dir, "segments"))


@query(sql("topology points", """with h as (select stream_key, max(sequence) as s from topology group by stream_key), src as (select string_agg(stream_key || ':' || s, ',' order by stream_key) as sources from h)
select point_id, 57::bigint as tick, case when plate_id is null then 'none' else 'given' end as method, sources, left(sha256(concat(coalesce(cast(plate_id as varchar), ''), chr(10), '57', chr(10), 'mantle', chr(10), 'fold-1', chr(10), sources)), 16) as key from points, src"""))
def y33_provenance_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = requests.provenance_columns(table(spark, sf_dir, "points"), log.heads(topology_events(spark, sf_dir)), 57, "mantle", "fold-1")
    return told.select("point_id", "tick", "method", "sources", "key")
