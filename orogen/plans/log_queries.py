"""Queries on the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..domain import sql, topology_events
from ..functions import ids
from ..operators import log
from ..registry import query

T, N = 500, 6000
FLAT = ["stream_key", "sequence", "tick", "event_id", "event_type", "plate_id", "boundary_id", "junction_id"]


@query(sql("topology", f"select {', '.join(FLAT)} from topology where tick <= {T}"))
def p1_events_at_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.at_tick(topology_events(spark, sf_dir), T).select(FLAT)


@query(sql("topology", f"select {', '.join(FLAT)} from topology where sequence <= {N}"))
def p2_events_at_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.at_sequence(topology_events(spark, sf_dir), N).select(FLAT)


@query(sql("topology", f"select {', '.join(FLAT)} from topology where sequence >= {N}"))
def p3_events_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.from_sequence(topology_events(spark, sf_dir), N).select(FLAT)


@query(sql("topology", "select stream_key, max(sequence) as sequence, arg_max(tick, sequence) as tick, arg_max(event_id, sequence) as event_id from topology group by stream_key"))
def s4_stream_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.heads(topology_events(spark, sf_dir), "tick", "event_id")


@query(sql("topology", """select * from (select stream_key, sequence, tick, lag(tick) over (partition by stream_key order by sequence) as previous_tick from topology) where tick < previous_tick"""))
def s5_tick_decreases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.tick_decreases(topology_events(spark, sf_dir)).select("stream_key", "sequence", "tick", "previous_tick")


@query(sql("topology", """select a.stream_key, not exists (select 1 from topology x join topology y on x.stream_key = y.stream_key and y.stream_key = a.stream_key and y.sequence > x.sequence and y.tick < x.tick) as is_monotone, a.n from (select stream_key, count(*) as n from topology group by stream_key) a"""))
def s6_stream_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.capabilities(topology_events(spark, sf_dir))


@query(sql("topology", "select stream_key, event_type, cast(floor(tick / 24.0) as bigint) as tick_range, count(*) as n from topology group by all"))
def a21_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.counts(topology_events(spark, sf_dir), 24)


@query(sql("topology", """select stream_key, sequence, tick, greatest_tick from (select *, max(tick) over (partition by stream_key order by sequence rows between unbounded preceding and 1 preceding) as greatest_tick from topology) where tick < greatest_tick"""))
def x3_late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.late(topology_events(spark, sf_dir)).select("stream_key", "sequence", "tick", "greatest_tick")


_STATE = """
with e as (select * from topology where tick <= {t}),
p as (select stream_key, plate_id, arg_max(event_type, sequence) = 'PlateRetired' as is_retired, nullif(arg_max(case when event_type = 'PlateRetired' then coalesce(reason, '') else '' end, sequence), '') as retirement_reason
      from e where event_type like 'Plate%' group by all having count(*) filter (where event_type = 'PlateCreated') > 0),
b as (select stream_key, boundary_id,
        arg_max(plate_id_left, sequence) filter (where event_type = 'BoundaryCreated') as plate_id_left,
        arg_max(plate_id_right, sequence) filter (where event_type = 'BoundaryCreated') as plate_id_right,
        arg_max(boundary_type, sequence) filter (where event_type in ('BoundaryCreated', 'BoundaryTypeChanged')) as boundary_type,
        arg_max(geometry_seed, sequence) filter (where event_type in ('BoundaryCreated', 'BoundaryGeometryUpdated')) as geometry_seed,
        arg_max(event_type, sequence) filter (where event_type in ('BoundaryCreated', 'BoundaryRetired')) = 'BoundaryRetired' as is_retired,
        nullif(arg_max(case when event_type = 'BoundaryRetired' then coalesce(reason, '') else '' end, sequence) filter (where event_type in ('BoundaryCreated', 'BoundaryRetired')), '') as retirement_reason
      from e where event_type like 'Boundary%' group by all having count(*) filter (where event_type = 'BoundaryCreated') > 0),
j as (select stream_key, junction_id,
        arg_max(incidence_seed, sequence) filter (where incidence_seed is not null) as incidence_seed,
        arg_max(radius, sequence) filter (where radius is not null) as radius,
        arg_max(event_type, sequence) filter (where event_type in ('JunctionCreated', 'JunctionRetired')) = 'JunctionRetired' as is_retired
      from e where event_type like 'Junction%' group by all having count(*) filter (where event_type = 'JunctionCreated') > 0),
inc as (select j.*, 'b' || cast(3 * ((3 * (cast(substring(junction_id, 2) as bigint) + 3)) % 4 + 4 * ((incidence_seed + k) % 12)) + 1 as varchar) as boundary_id
        from j, (values (0), (1), (4)) v(k))
"""


def _state(body: str, t: int = T) -> str:
    return sql("topology", _STATE.format(t=t) + body)


@query(_state("select * from p"))
def a1_plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.plates(log.at_tick(topology_events(spark, sf_dir), T))


@query(_state("select * from b"))
def a1_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = log.boundaries(log.at_tick(topology_events(spark, sf_dir), T))
    return state.withColumn("geometry_seed", F.col("geometry.coords")[0]["x"].cast("long")).drop("geometry")


@query(_state("select stream_key, junction_id, is_retired, radius, string_agg(boundary_id, ',' order by boundary_id) as boundary_ids from inc group by all"))
def a1_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = log.junctions(log.at_tick(topology_events(spark, sf_dir), T))
    return state.select("stream_key", "junction_id", "is_retired", F.col("location.radius").alias("radius"), F.array_join(F.array_sort("boundary_ids"), ",").alias("boundary_ids"))


@query(_state("""select b.boundary_type, count(*) as n from b join p l on l.stream_key = b.stream_key and l.plate_id = b.plate_id_left and not l.is_retired
  join p r on r.stream_key = b.stream_key and r.plate_id = b.plate_id_right and not r.is_retired where not b.is_retired group by b.boundary_type"""))
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active boundaries between active plates at a tick, counted by type (J1 over A1)."""
    events = log.at_tick(topology_events(spark, sf_dir), T)
    alive = log.active(log.plates(events)).select("stream_key", "plate_id")
    b = log.active(log.boundaries(events))
    side = lambda c: alive.withColumnRenamed("plate_id", c)
    return b.join(side("plate_id_left"), ["stream_key", "plate_id_left"]).join(side("plate_id_right"), ["stream_key", "plate_id_right"]).groupBy("boundary_type").agg(F.count(F.lit(1)).alias("n"))


@query(_state("select * from p where not is_retired"))
def p4_active_plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.active(log.plates(log.at_tick(topology_events(spark, sf_dir), T)))


@query(_state("""select distinct * from (
  select b.stream_key, b.boundary_id as owner, x.ref, case when p.plate_id is null then 'missing' when p.is_retired then 'retired' end as why
  from b, lateral (values (b.plate_id_left), (b.plate_id_right)) x(ref) left join p on p.stream_key = b.stream_key and p.plate_id = x.ref where not b.is_retired
  union all
  select inc.stream_key, inc.junction_id, inc.boundary_id, case when b.boundary_id is null then 'missing' when b.is_retired then 'retired' end
  from inc left join b on b.stream_key = inc.stream_key and b.boundary_id = inc.boundary_id where not inc.is_retired) where why is not null"""))
def j10_dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = log.at_tick(topology_events(spark, sf_dir), T)
    return log.dangling(log.boundaries(e), log.plates(e), log.junctions(e))


_BEFORE = """
with refs as (select distinct stream_key, sequence, boundary_id as owner, ref from topology, lateral (values (plate_id_left), (plate_id_right)) v(ref) where event_type = 'BoundaryCreated'),
life as (select stream_key, plate_id, sequence, case when event_type = 'PlateCreated' then 'active' else 'retired' end as state from topology where plate_id is not null),
before as (select r.stream_key, r.sequence, r.owner, r.ref, coalesce(arg_max(l.state, l.sequence), 'missing') as before
  from refs r left join life l on l.stream_key = r.stream_key and l.plate_id = r.ref and l.sequence < r.sequence group by all)
"""


@query(sql("topology", _BEFORE + "select * from before"))
def j11_reference_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.references_before(topology_events(spark, sf_dir))


@query(sql("topology", _BEFORE + """,
marks as (select stream_key, sequence, coalesce(plate_id, boundary_id, junction_id) as entity, event_type,
    case when event_type like '%Created' then 'active' when event_type like '%Retired' then 'retired' end as mark from topology),
life2 as (select *, coalesce(last_value(mark ignore nulls) over (partition by stream_key, entity order by sequence rows between unbounded preceding and 1 preceding), 'missing') as before from marks),
jv as (select stream_key, junction_id, sequence as from_seq, lead(sequence) over w as to_seq, last_value(incidence_seed ignore nulls) over w as seed,
    last_value(case when event_type = 'JunctionRetired' then true when event_type = 'JunctionCreated' then false end ignore nulls) over w as gone
    from topology where event_type like 'Junction%' window w as (partition by stream_key, junction_id order by sequence)),
live as (select jv.*, 'b' || cast(3 * ((3 * (cast(substring(junction_id, 2) as bigint) + 3)) % 4 + 4 * ((seed + k) % 12)) + 1 as varchar) as boundary_id from jv, (values (0), (1), (4)) v(k) where not gone)
select stream_key, sequence, 'BoundarySeparatesTwoPlates' as rule, boundary_id as entity, 'equal' as detail from topology where event_type = 'BoundaryCreated' and plate_id_left = plate_id_right
union all select stream_key, sequence, 'BoundarySeparatesTwoPlates', owner, ref || ' ' || before from before where before <> 'active'
union all select stream_key, sequence, 'LifecycleOrdering', entity, before from life2 where event_type not like '%Created' and before <> 'active'
union all select distinct t.stream_key, t.sequence, 'FR-016', t.boundary_id, l.junction_id from topology t join live l on l.stream_key = t.stream_key and l.boundary_id = t.boundary_id
  and l.from_seq < t.sequence and (l.to_seq is null or t.sequence < l.to_seq) where t.event_type = 'BoundaryRetired'
union all select stream_key, sequence, 'JunctionGeometry', junction_id, 'location or boundaries' from topology where event_type = 'JunctionCreated' and radius <= 0"""))
def y32_invariant_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.invariant_report(topology_events(spark, sf_dir))


@query(sql("topology", "select stream_key, event_id, -1 + row_number() over (partition by stream_key order by event_type, tick, event_id) as sequence from topology"))
def w1_assign_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = topology_events(spark, sf_dir).select("stream_key", "event_id", F.col("event_type").alias("kind"), F.col("tick").alias("order_key"), F.col("event_id").alias("asset"))
    return log.assign_sequences(plans).select("stream_key", "event_id", F.col("sequence").cast("long").alias("sequence"))


@query()
def w3_hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.build_chain(topology_events(spark, sf_dir))


@query(sql("topology", """with f as (select stream_key, sequence, sequence % 97 = 5 as tampered, sequence % 89 = 7 as cut from topology)
select stream_key, sequence, cut as bad_link, tampered or cut as bad_hash from f where tampered or cut"""))
def w2_chain_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain with faults: some payloads are changed after it was built, some links point at no row."""
    events = topology_events(spark, sf_dir)
    payload = F.when(F.col("sequence") % 97 == 5, F.concat(log.payload_text(), F.lit("!"))).otherwise(log.payload_text())
    chained = log.build_chain(events).join(events.select("stream_key", "sequence", payload.alias("payload")), ["stream_key", "sequence"])
    return log.chain_faults(chained.withColumn("previous_hash", F.when(F.col("sequence") % 89 == 7, F.lit("cut")).otherwise(F.col("previous_hash"))))


@query(_state("select * from p", 100_000))
def j18_snapshot_plus_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot by sequence and the events after it, folded; equal to the fold of the whole log."""
    events = topology_events(spark, sf_dir)
    before = log.at_sequence(events, N)
    return log.plates_from_snapshot(log.plates(before), log.heads(before).withColumnRenamed("sequence", "last_sequence"), events)


@query(sql("topology", f"""with t(snapshot_tick) as (values (100), (200), (300)),
l as (select t.snapshot_tick, e.stream_key, max(e.sequence) filter (where e.tick <= t.snapshot_tick) as last_sequence from t, topology e group by all),
i as (select l.stream_key, l.snapshot_tick, l.last_sequence, min(e.tick) as min_skipped_tick from l left join topology e on e.stream_key = l.stream_key and e.sequence <= l.last_sequence and e.tick > l.snapshot_tick group by all),
g as (select * from i where snapshot_tick <= 300 and (min_skipped_tick is null or min_skipped_tick > 300))
select stream_key, max(snapshot_tick)::bigint as snapshot_tick, arg_max(last_sequence, snapshot_tick) as last_sequence, arg_max(min_skipped_tick, snapshot_tick) as min_skipped_tick from g group by stream_key"""))
def s8_latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = topology_events(spark, sf_dir)
    index = log.snapshot_index(events, 100).unionByName(log.snapshot_index(events, 200)).unionByName(log.snapshot_index(events, 300))
    return log.usable_snapshots(index, 300)


@query(sql("topology", """with d as (select stream_key, floor(sequence / 1000) as bucket, count(*) as n, min(sequence) as f, max(sequence) as l, sha256(string_agg(sequence || ':' || event_id, chr(10) order by sequence)) as d from topology group by all),
e as (select stream_key, floor(bucket / 1000) as bucket, sum(n) as n, min(f) as f, max(l) as l, sha256(string_agg(d, chr(10) order by bucket)) as d from d group by stream_key, floor(bucket / 1000))
select stream_key, sum(n)::bigint as n_events, min(f) as first_sequence, max(l) as last_sequence, sha256(string_agg(d, chr(10) order by bucket)) as digest from e group by stream_key"""))
def s12_ingest_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.ingest_audit(topology_events(spark, sf_dir))


_H = "sha256(stream_key || chr(10) || event_id || chr(10) || cast(sequence as varchar))"


@query(sql("topology", f"""select stream_key, sequence, substring(h, 1, 16) as short_hash, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-4' || substring(h, 14, 3) || '-' ||
  substring('89ab', 1 + cast('0x' || substring(h, 17, 1) as integer) % 4, 1) || substring(h, 18, 3) || '-' || substring(h, 21, 12) as stable_id from (select *, {_H} as h from topology)"""))
def s13_stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.col(c) for c in ("stream_key", "event_id", "sequence")]
    return topology_events(spark, sf_dir).select("stream_key", "sequence", ids.short_hash(*parts).alias("short_hash"), ids.stable_id(*parts).alias("stable_id"))


@query("""select event_id, 'v' || user_id || ':main:L' || (event_id % 3) || ':' || event_type || ':M' || (event_id % 9) as stream_key, cast(event_id % 3 as integer) as level, 'M' || (event_id % 9) as model from events""")
def f21_stream_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    key = ids.stream_key(F.concat(F.lit("v"), F.col("user_id")), F.lit("main"), F.col("event_id") % 3, F.col("event_type"), (F.col("event_id") % 9).cast("string"))
    parsed = ids.parsed_stream_key(F.col("stream_key"))
    return e.select("event_id", key.alias("stream_key")).select("event_id", "stream_key", parsed["level"].alias("level"), parsed["model"].alias("model"))


@query(sql("topology", """with w as (select stream_key, tick // 50 * 50 as window_start, event_type from topology where tick >= 0) select stream_key, window_start, count(*) as n, count(distinct event_type) as n_types from w group by all"""))
def x8_tick_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows over integer ticks; floor(tick / w) needs no timestamp."""
    e = log.from_sequence(topology_events(spark, sf_dir), 0).where("tick >= 0")
    return e.groupBy("stream_key", (F.expr("tick div 50") * 50).alias("window_start")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("n_types"))


@query("""with s as (select user_id, ts, sum(case when gap > 3600 or gap is null then 1 else 0 end) over (partition by user_id order by ts, event_id) as k from
  (select *, epoch_us(ts - lag(ts) over (partition by user_id order by ts, event_id)) / 1000000.0 as gap from (select *, ts as t from events)))
select user_id, min(ts) as session_start, count(*) as n from s group by user_id, k""")
def x8_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wall-clock sessions: a gap of over an hour begins another."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = (F.col("t") - F.lag("t").over(w)) / 1e6
    marked = e.withColumn("k", F.sum(F.when(F.coalesce(gap > 3600, F.lit(True)), 1).otherwise(0)).over(w))
    return marked.groupBy("user_id", "k").agg(F.min("ts").alias("session_start"), F.count(F.lit(1)).alias("n")).drop("k")


@query(sql("topology", "select stream_key, bool_and(ok) as sorted from (select stream_key, coalesce(sequence > lag(sequence) over (partition by stream_key order by tick, sequence), true) as ok from topology) group by stream_key"))
def o2_canonically_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.is_sorted(topology_events(spark, sf_dir), "stream_key", "tick", "sequence")


@query(sql("topology", f"select {', '.join(FLAT)} from topology where sequence > {N} order by sequence limit 50"))
def o3_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One keyset page: the filter is pushed down, the order is needed for the page only."""
    return topology_events(spark, sf_dir).where(F.col("sequence") > N).orderBy("sequence").limit(50).select(FLAT)


@query(sql("topology", """with k as (select *, row_number() over (partition by stream_key order by sequence desc, tick desc, event_id) as place, max(sequence) over (partition by stream_key) as newest from topology)
select stream_key, event_id, sequence from k where place > 20 and newest - sequence > 3000"""))
def a20_retention_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans.products import retention_candidates

    rows = topology_events(spark, sf_dir).select("stream_key", "event_id", "sequence", "tick")
    return retention_candidates(rows, "stream_key", "event_id", keep=20, sequence_age=3000).select("stream_key", "event_id", "sequence")


@query(sql("topology", "select distinct stream_key, coalesce(plate_id, boundary_id, junction_id) as entity from topology"))
def u1_distinct_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology_events(spark, sf_dir).select("stream_key", F.coalesce("plate_id", "boundary_id", "junction_id").alias("entity")).distinct()
