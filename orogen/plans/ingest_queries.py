"""Queries on logs, snapshots, manifests, assets, raster files and products that are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domain import sql, table, topology_events
from ..operators import grid, log, motion, rates, requests, topology
from ..registry import query
from ..sources import datasets
from ..tables import cut, new_folder, r6
from . import products
from .grid_queries import SHIFTED, cells
from .log_queries import _STATE, N, T
from .measure_queries import _AT, _OMEGA, _xyz, at, omegas
from .motion_queries import _ACTIVE, _FT, _ONE_TICK, _ROTATED, _at_57, _mul, links
from .plate_queries import _GRID, _grid_map
from .space_queries import rings

FLAT = ["stream_key", "sequence", "tick", "event_id", "event_type"]


def written_log(spark: SparkSession, sf_dir: str) -> str:
    """The topology log with its hash chain, written by stream; every 89th link is broken."""
    events = topology_events(spark, sf_dir)
    chained = log.build_chain(events).withColumn("previous_hash", F.when(F.col("sequence") % 89 == 7, F.lit("cut")).otherwise(F.col("previous_hash")))
    path = new_folder(spark, "log")
    chained.join(events.select("stream_key", "sequence", "event_type"), ["stream_key", "sequence"]).write.partitionBy("stream_key").parquet(path)
    return path


@query(sql("topology", f"with e as (select * from topology where stream_key = 's1' and sequence >= {N}) select stream_key, sequence, event_id, not (sequence % 89 = 7 and sequence > (select min(sequence) from e)) as linked from e"))
def s1_read_topology_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream from a sequence on, its links checked as it is read; the files of other streams are not opened."""
    schema = "stream_key string, sequence long, tick long, event_id string, event_type string, previous_hash string, hash string"
    return log.read_events(spark, written_log(spark, sf_dir), schema, "s1", N, check_links=True).select("stream_key", "sequence", "event_id", "linked")


@query(sql("segments", "select 'k' || plate_id % 3 as stream_key, segment_id, tick_a, angle from segments where plate_id % 3 = 2 and cast(substring(segment_id, 2) as bigint) >= 700"))
def s2_read_kinematics_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "segments")
    events = s.select(F.concat(F.lit("k"), (F.col("plate_id") % 3).cast("string")).alias("stream_key"), F.substring("segment_id", 2, 12).cast("long").alias("sequence"), "segment_id", "plate_id", "tick_a", "tick_b", "angle")
    path = new_folder(spark, "kinematics")
    events.write.partitionBy("stream_key").parquet(path)
    return log.read_events(spark, path, events.schema, "k2", 700).select("stream_key", "segment_id", "tick_a", "angle")


@query(sql("topology", "select stream_key, max(sequence) as sequence, count(*) as n, true as refused from topology group by stream_key"))
def s3_append_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stream in two batches with the expected head; a batch that names another head is refused."""
    events, path = topology_events(spark, sf_dir).select(FLAT), new_folder(spark, "appended")
    refused = {}
    for stream in ("s0", "s1", "s2", "s3"):
        own = events.where(F.col("stream_key") == stream)
        first, rest = log.at_sequence(own, N), own.where(F.col("sequence") > N)
        log.checked_append(first, path, None)
        try:
            log.checked_append(rest, path, -5)
            refused[stream] = False
        except ValueError:
            refused[stream] = True
        log.checked_append(rest, path, first.agg(F.max("sequence")).first()[0])
    told = F.element_at(F.create_map(*(F.lit(x) for kv in refused.items() for x in kv)), F.col("stream_key"))
    kept = log.committed(spark, path, events.schema, ["s0", "s1", "s2", "s3"])
    return kept.groupBy("stream_key").agg(F.max("sequence").alias("sequence"), F.count(F.lit(1)).alias("n")).withColumn("refused", told)


@query(sql("topology", f"select {', '.join(FLAT)} from topology where tick <= 200"))
def x5_scan_until_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events up to a tick; of a log in buckets of 500 sequences those that lie after it are not opened."""
    events, path = topology_events(spark, sf_dir).select(FLAT), new_folder(spark, "indexed")
    log.write_indexed(events, path, 500)
    return log.scan_until_tick(spark, path, events.schema, 200)


def _at_sequence(body: str, n: int) -> str:
    return sql("topology", _STATE.replace("tick <= {t}", "sequence <= {t}").format(t=n) + body)


@query(_at_sequence("select 'Plate' as kind, stream_key, plate_id as entity, is_retired from p union all select 'Boundary', stream_key, boundary_id, is_retired from b union all select 'Junction', stream_key, junction_id, is_retired from j", N))
def s7_write_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three entity tables of a snapshot, written and read."""
    path = new_folder(spark, "snapshot")
    log.write_snapshot(log.at_sequence(topology_events(spark, sf_dir), N), path, T)
    found = log.read_snapshot(spark, path, T)
    rows = [found[kind].select(F.lit(kind).alias("kind"), "stream_key", F.col(key).alias("entity"), "is_retired") for kind, key in log.KINDS.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _with_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, path = topology_events(spark, sf_dir), new_folder(spark, "snapshot")
    log.write_snapshot(log.at_sequence(events, N), path, T)
    return log.snapshot_plus_tail(log.read_snapshot(spark, path, T), events)


@query(_at_sequence("select * from b", 2**62))
def j18_boundaries_from_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.boundaries(_with_tail(spark, sf_dir)).withColumn("geometry_seed", F.col("geometry.coords")[0]["x"].cast("long")).drop("geometry")


@query(_at_sequence("select stream_key, junction_id, is_retired, radius, string_agg(boundary_id, ',' order by boundary_id) as boundary_ids from inc group by all", 2**62))
def j18_junctions_from_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = log.junctions(_with_tail(spark, sf_dir))
    return j.select("stream_key", "junction_id", "is_retired", F.col("location.radius").alias("radius"), F.array_join(F.array_sort("boundary_ids"), ",").alias("boundary_ids"))


@query("""with m as (select s_suppkey as s, coalesce(case when s_suppkey % 7 > 0 then 'd' || s_suppkey end, 'b' || s_suppkey) as dataset from supplier)
select dataset, 'dataset.id.missing' as code, 'datasetId' as path from m where s % 7 = 0 union all select dataset, 'body.frame.missing', 'bodyFrame' from m where s % 5 = 0
union all select dataset, 'body.frame.radius', 'bodyFrame.radius' from m where s % 5 > 0 and s % 3 < 2 union all select dataset, 'time.unit.missing', 'timeMapping.tickUnit' from m where s % 4 = 0
union all select dataset, 'asset.id.twice', 'featureSets' from m where s % 6 = 0 union all select dataset, 'asset.path.missing', 'featureSets' from m where s % 8 = 0""")
def s9_manifest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest for each supplier, with parts missing by divisibility, as JSON lines."""
    k, path = F.col("s_suppkey"), new_folder(spark, "manifests")
    asset = lambda name, file: F.struct(name.alias("assetId"), file.alias("relativePath"), F.lit("json").alias("format"))
    frame = F.when(k % 5 > 0, F.struct(F.lit("sphere").alias("shape"), ((k % 3 - 1) * 1000.0).alias("radius"), F.lit("m").alias("unit"), F.lit("deg").alias("angularConvention")))
    sets = F.array(asset(F.lit("a1"), F.lit("p1")), asset(F.when(k % 6 == 0, "a1").otherwise("a2"), F.when(k % 8 > 0, F.lit("p2"))))
    none = F.array().cast("array<struct<assetId:string,relativePath:string,format:string>>")
    whole = F.struct(F.when(k % 7 > 0, F.concat(F.lit("d"), k)).alias("datasetId"), F.concat(F.lit("b"), k).alias("bodyId"), frame.alias("bodyFrame"), F.struct(F.when(k % 4 > 0, F.lit("Ma")).alias("tickUnit")).alias("timeMapping"), sets.alias("featureSets"), none.alias("rasterSequences"), none.alias("motionModels"))
    spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.to_json(whole)).write.text(path)
    read = datasets.read_json(spark, path, datasets.MANIFEST, one_per_line=True).withColumn("file", F.coalesce("datasetId", "bodyId"))
    return datasets.manifest_errors(read).select(F.col("file").alias("dataset"), "code", "path")


def topology_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An asset for every twenty boundaries, with their plates; every fiftieth boundary names a plate that its asset has not."""
    b, path = table(spark, sf_dir, "boundaries"), new_folder(spark, "assets")
    key = lambda c: F.concat(F.lit("p"), F.lpad(F.col(c).cast("string"), 2, "0"))
    right = F.when(F.col("boundary_id") % 50 == 7, "px").otherwise(key("plate_right"))
    line = F.array(F.array("lon0", "lat0"), F.array("lon1", "lat1"))
    one = F.struct(F.concat(F.lit("b"), F.lpad(F.col("boundary_id").cast("string"), 9, "0")).alias("boundaryKey"), key("plate_left").alias("leftPlateKey"), right.alias("rightPlateKey"), F.col("boundary_type").alias("boundaryType"), line.alias("polyline"))
    plates = F.array_distinct(F.flatten(F.collect_list(F.array(key("plate_left"), key("plate_right")))))
    assets = b.groupBy(F.expr("boundary_id div 20").alias("k")).agg(F.collect_list(one).alias("boundaries"), plates.alias("p"))
    whole = F.struct(F.concat(F.lit("topology-v1/"), "k").alias("schema"), F.transform("p", lambda x: F.struct(x.alias("plateKey"))).alias("plates"), "boundaries")
    assets.select(F.to_json(whole)).write.text(path)
    return datasets.read_json(spark, path, datasets.TOPOLOGY, one_per_line=True).withColumn("file", F.col("schema"))


_ASSETS = """with b as (select *, 'topology-v1/' || boundary_id // 20 as asset, 'p' || lpad(cast(plate_left as varchar), 2, '0') as l, 'p' || lpad(cast(plate_right as varchar), 2, '0') as r from boundaries),
plans as (select distinct asset, 0 as kind, x.k as order_key, 'PlateCreated' as event_type from b, lateral (values (l), (r)) x(k) union all select asset, 1, 'b' || lpad(cast(boundary_id as varchar), 9, '0'), 'BoundaryCreated' from b)
"""


@query(sql("boundaries", _ASSETS + "select asset, event_type, order_key, -1 + row_number() over (partition by asset order by kind, order_key) as sequence from plans"))
def s10_topology_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = datasets.topology_plans(topology_assets(spark, sf_dir)).withColumn("stream_key", F.col("asset"))
    return log.assign_sequences(plans).select("asset", "event_type", "order_key", F.col("sequence").cast("long").alias("sequence"))


@query(sql("boundaries", "select 'topology-v1/' || boundary_id // 20 as asset, 'b' || lpad(cast(boundary_id as varchar), 9, '0') as order_key, 'px' as key from boundaries where boundary_id % 50 = 7"))
def s10_unknown_plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.unknown_plates(datasets.topology_plans(topology_assets(spark, sf_dir))).select("asset", "order_key", "key")


def segment_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A motion model for each plate; segments of parts by thirteen end where they begin."""
    s, path = table(spark, sf_dir, "segments"), new_folder(spark, "models")
    k = F.substring("segment_id", 2, 12).cast("long")
    one = F.struct(F.col("tick_a").alias("tickA"), F.when(k % 13 == 0, F.col("tick_a")).otherwise(F.col("tick_b")).alias("tickB"), F.col("azimuth").alias("axisAzimuthMicroDeg"), F.col("elevation").alias("axisElevationMicroDeg"), F.col("angle").alias("angleMicroDeg"), F.col("segment_id").alias("segmentId"))
    # One asset holds up to a hundred segments of a plate.
    by = s.groupBy("plate_id", F.expr("tick_a div 1000").alias("part")).agg(F.collect_list(one).alias("segments"))
    plate = F.struct(F.concat(F.lit("p"), "plate_id").alias("plateKey"), "segments")
    by.select(F.to_json(F.struct(F.lit("segments-v1").alias("schema"), F.concat(F.lit("m"), "plate_id").alias("modelId"), F.array(plate).alias("plates")))).write.text(path)
    return datasets.read_json(spark, path, datasets.SEGMENTS, one_per_line=True).withColumn("file", F.col("modelId"))


@query(sql("segments", "select 'm' || plate_id as model, 'p' || plate_id as plate_key, segment_id, tick_a, case when cast(substring(segment_id, 2) as bigint) % 13 = 0 then tick_a else tick_b end as tick_b, angle, cast(substring(segment_id, 2) as bigint) % 13 > 0 as is_valid from segments"))
def s11_segment_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = datasets.segment_plans(segment_assets(spark, sf_dir))
    return plans.select(F.col("modelId").alias("model"), F.col("plateKey").alias("plate_key"), "segment_id", "tick_a", "tick_b", "angle", "is_valid")


@query(sql("boundaries segments", _ASSETS + """, every as (select kind, order_key, asset from plans union all select 2, segment_id, 'm' || plate_id from segments where cast(substring(segment_id, 2) as bigint) % 13 > 0)
select kind, order_key, asset, -1 + row_number() over (order by kind, order_key, asset) as sequence from every"""))
def u3_plans_of_all_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event plans of all topology and motion assets in one stream."""
    topo = datasets.topology_plans(topology_assets(spark, sf_dir)).select("kind", "order_key", "asset")
    moves = datasets.segment_plans(segment_assets(spark, sf_dir)).where("is_valid").select(F.lit(2).alias("kind"), F.col("segment_id").alias("order_key"), F.col("file").alias("asset"))
    return log.assign_sequences(topo.unionByName(moves).withColumn("stream_key", F.lit("one"))).select("kind", "order_key", "asset", F.col("sequence").cast("long").alias("sequence"))


@query(sql("cells", "select tick, r, c, round(value, 4) + 0.0 as value from cells"))
def s14_raster_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames in folders that are named by their ticks, read as one sequence."""
    path = new_folder(spark, "frames")
    cells(spark, sf_dir).select(F.format_string("tick%06d", "tick").alias("frame"), "r", "c", "value").write.partitionBy("frame").parquet(path)
    read = datasets.read_cells(spark, path, "r long, c long, value double", datasets.FRAME_TICK)
    return read.select("tick", "r", "c", (F.round("value", 4) + 0.0).alias("value"))


@query(sql("cells", """with k as (select unnest(range(5, 76, 15)) as tick), f as (select distinct tick as f from cells), ar as (select k.tick, max(f) filter (where f <= k.tick) as b, min(f) filter (where f >= k.tick) as a from k, f group by k.tick),
w as (select tick, coalesce(b, a) as b, coalesce(a, b) as a, case when a = b or a is null or b is null then 0.0 else (tick - b) / (a - b)::double end as w from ar), rc as (select distinct r, c from cells),
j as (select w.tick, rc.r, rc.c, w.w, x.value as v0, y.value as v1, x.r is not null or y.r is not null as has from w, rc left join cells x on x.tick = w.b and x.r = rc.r and x.c = rc.c left join cells y on y.tick = w.a and y.r = rc.r and y.c = rc.c)
select tick, r, c, round(case when w = 0 then v0 when w = 1 then v1 else coalesce(v0 + (v1 - v0) * w, v0, v1) end, 4) + 0.0 as value from j where has"""))
def s15_exported_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated frames from tick 5 to 75 in steps of 15, written and read again."""
    path = new_folder(spark, "export")
    datasets.export_raster(cells(spark, sf_dir), 5, 75, 15, path)
    read = datasets.read_cells(spark, path, "r long, c long, value double", datasets.FRAME_TICK)
    return read.select("tick", "r", "c", (F.round("value", 4) + 0.0).alias("value"))


def _speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import space

    return rates.speed_statistics(at(spark, sf_dir).join(omegas(spark, sf_dir), "plate_id").withColumn("v", space.linear_velocity(F.col("omega"), F.col("p"))), "plate_id")


def _made_twice(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A product for each of two generators, asked for twice; the folder and the last answer."""
    folder, head = new_folder(spark, "products"), topology_events(spark, sf_dir).agg(F.max("sequence")).first()[0]
    found = None
    for generator in ("speeds", "speeds", "ages", "speeds", "ages"):
        found = products.reuse_or_compute(spark, folder, generator, "topology", head, generator, "1", {"by": "plate"}, lambda: _speeds(spark, sf_dir))
    return folder, found


@query(sql("points plates", f"with {_AT}, {_OMEGA}, v as (select plate_id, sqrt(power(oy*z - oz*y, 2) + power(oz*x - ox*z, 2) + power(ox*y - oy*x, 2)) as s from pt join om using (plate_id)) select plate_id, count(*) as n, round(avg(s), 6) + 0.0 as mean_speed from v group by plate_id"))
def s17_reused_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made_twice(spark, sf_dir)[1].select("plate_id", "n", r6(F.col("mean_speed")).alias("mean_speed"))


@query(sql("topology", "select product, reused, n, (select max(sequence) from topology) as last_sequence from (values ('speeds', false, 1::bigint), ('speeds', true, 2::bigint), ('ages', false, 1::bigint), ('ages', true, 1::bigint)) v(product, reused, n)"))
def s18_product_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = products.read_audit(spark, _made_twice(spark, sf_dir)[0])
    return audit.groupBy("product", "reused", "last_sequence").agg(F.count(F.lit(1)).alias("n"))


@query(sql("topology", f"with i as (select stream_key, 'product-' || stream_key as product, max(sequence) as last_sequence from topology where sequence <= {N} group by stream_key union all select stream_key, 'fresh-' || stream_key, max(sequence) from topology group by stream_key), h as (select stream_key, max(sequence) as changed_at from topology group by stream_key) select product, last_sequence, changed_at from i join h using (stream_key) where changed_at > last_sequence"))
def x9_stale_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = topology_events(spark, sf_dir)
    made = lambda rows, name: log.heads(rows).select("stream_key", F.concat(F.lit(f"{name}-"), "stream_key").alias("product"), F.col("sequence").alias("last_sequence"))
    index = made(log.at_sequence(events, N), "product").unionByName(made(events, "fresh"))
    return products.stale_products(index, events).select("product", "last_sequence", "changed_at")


@query(sql("segments boundaries plates points topology", f"""select a.*, tick, method, sources, key from (
{_ONE_TICK + _ROTATED.replace("boundary_id", "point_id").replace("plate_left", "plate_id").replace("from boundaries, lateral (values (0, lat0, lon0), (1, lat1, lon1)) u(k, la, lo) where not is_retired", "from points, lateral (values (0, lat, lon)) u(k, la, lo) where plate_id is not null")}
union all select point_id, 0, round(cos(radians(lat)) * cos(radians(lon)), 6) + 0.0, round(cos(radians(lat)) * sin(radians(lon)), 6) + 0.0, round(sin(radians(lat)), 6) + 0.0 from points where plate_id is null) a join (
with h as (select stream_key, max(sequence) as s from topology group by stream_key), src as (select string_agg(stream_key || ':' || s, ',' order by stream_key) as sources from h)
select point_id, 57::bigint as tick, case when plate_id is null then 'none' else 'given' end as method, sources, left(sha256(concat(coalesce(cast(plate_id as varchar), ''), chr(10), '57', chr(10), 'mantle', chr(10), 'fold-1', chr(10), sources)), 16) as key from points, src) b using (point_id)"""))
def y4_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer to a request in one table: features at their places of a tick, and what they come from."""
    from ..functions import space

    p = table(spark, sf_dir, "points").select("point_id", "plate_id", F.array(space.latlon_to_unit(F.col("lat"), F.col("lon"))).alias("line"))
    told = requests.reconstruct(p, _at_57(spark, sf_dir).select("plate_id", "q"), log.heads(topology_events(spark, sf_dir)), 57, "mantle", "fold-1")
    flat = told.select("point_id", F.posexplode("line").alias("k", "p"), "tick", "method", "sources", "key")
    return flat.select("point_id", "k", *_xyz("p"), "tick", "method", "sources", "key")


@query("""with l as (select 'f' || cast(p_partkey % 40 as varchar) as frame, case when p_partkey % 40 < 4 then 'mantle' when p_partkey % 40 = 39 then 'lost' when p_partkey % 40 = 37 then 'f38' when p_partkey % 40 = 38 then 'f37' else 'f' || cast(p_partkey % 40 % 4 as varchar) end as base_frame,
  10 * (p_partkey // 40) as from_tick, 10 * (p_partkey // 40) + case when p_partkey % 40 = 20 then 12 else 9 end as to_tick from part),
o as (select frame, base_frame, to_tick, lead(from_tick) over (partition by frame, base_frame order by from_tick) as after from l)
select distinct frame, 'overlap' as fault from o where to_tick >= after union select distinct frame, 'unknown base' from l where base_frame = 'lost' union select distinct frame, 'cycle' from l where frame in ('f37', 'f38')""")
def y16_definition_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with planted faults: ranges that overlap, a base that is defined nowhere, two frames that stand on each other."""
    k = F.col("p_partkey")
    name = lambda x: F.concat(F.lit("f"), x.cast("string"))
    base = F.when(k % 40 < 4, "mantle").when(k % 40 == 39, "lost").when(k % 40 == 37, "f38").when(k % 40 == 38, "f37").otherwise(name(k % 40 % 4))
    start = F.expr("10 * (p_partkey div 40)")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(name(k % 40).alias("frame"), k.alias("position"), base.alias("base_frame"), start.alias("from_tick"), (start + F.when(k % 40 == 20, 12).otherwise(9)).alias("to_tick"))
    return motion.definition_faults(rows, ["mantle"])


#: The table `part` is read further on, so the step of that name has another.
_TURNED = _ONE_TICK.replace("57::bigint", "45::bigint").replace("part as (", "piece as (").replace("from part p join base", "from piece p join base") + ", fz as (select tick, 0.0 as x, 0.0 as y, -sin(turn / 2) as z, cos(turn / 2) as w from ({chain})), seen as (select r.plate_id, r.tick, " + _mul("f", "r") + " from rot r join fz f using (tick))\n"
_CHAIN_OF_F5 = _FT + "u as (select 'f5' as frame, 45 as tick union select 'f1', 45), " + _ACTIVE.format(t="u") + """, one as (select * from act where k = 1)
select a.tick::bigint as tick, a.turn + b.turn as turn from one a join one b on b.frame = a.base_frame where a.frame = 'f5' and b.base_frame = 'mantle'"""


@query(sql("segments plates", _TURNED.replace("{chain}", _CHAIN_OF_F5) + "select plate_id, tick, round(x, 6) + 0.0 as x, round(y, 6) + 0.0 as y, round(z, 6) + 0.0 as z, round(w, 6) + 0.0 as w from seen"))
def y15_rotations_in_custom_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every plate at tick 45 as seen from a frame that its links define."""
    ticks = table(spark, sf_dir, "plates").select("plate_id", F.lit(45).cast("long").alias("tick"))
    turned = motion.rotations_at(ticks, table(spark, sf_dir, "segments"))
    chains = motion.frame_chains(spark.createDataFrame([("f5", 45)], "frame string, tick long"), links(spark, sf_dir), ["mantle"])
    return motion.rotations_in_custom_frame(turned, chains, "f5").select("plate_id", "tick", *_xyz("q", "xyzw"))


@query(_GRID + "select 1::bigint as face, (select 2 * count(*) from b) - 4 * (select count(*) from c) as n")
def a17_outside_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The face around the grid, whose winding is the other way."""
    from ..functions import space

    m = _grid_map(spark, sf_dir)
    faces = topology.walk_faces(m["darts"]).join(m["darts"].select("dart", "origin"), "dart").join(m["positions"].select(F.col("junction_id").alias("origin"), F.col("position").alias("xyz")), "origin")
    found = cut(faces.groupBy("face").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "xyz"))), lambda x: x["xyz"]).alias("ring")))
    outside = topology.outside_face(found.withColumn("area", space.spherical_ring_area(F.col("ring"))))
    return found.join(outside, "face").select("face", F.size("ring").cast("long").alias("n"))


@query("select cast(0 as bigint) as n_empty, count(*) as n_missing, false as covers, 'error' as strict, 'warning' as lenient from nation")
def a19_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of the grid's polygons and of plates that have none: strict policy fails, the lenient one warns (Y21)."""
    m = _grid_map(spark, sf_dir)
    p = cut(topology.polygonize(m["darts"], m["positions"], m["boundaries"]))
    lost = spark.read.parquet(f"{sf_dir}/nation.parquet").select((-10 - F.col("n_nationkey")).cast("long").alias("plate_id"), F.lit(True).alias("active"))
    plates, none = m["cells"].unionByName(lost), m["boundaries"].where("boundary_id < 0").select("boundary_id")
    row = topology.coverage(p, plates, 1e-6)
    for policy in ("strict", "lenient"):
        row = row.join(F.broadcast(topology.partition_status(p, plates, none, policy).select(F.col("status").alias(policy))))  # tables of one row
    return row.select("n_empty", "n_missing", "covers", "strict", "lenient")


@query(sql("boundaries cells", """with g as (select boundary_id as ring_id, plate_left as plate_id, boundary_id % 3 = 0 as is_hole, lon0 as w, lat0 as s, lon0 + 6 as e, lat0 + 4 as n, 10 * (1 + boundary_id % 7) as tick from boundaries),
k as (select distinct tick, r, c, -175 + (c + 0.52) * 10 as lon, 90 - (r + 0.52) * 10 as lat from cells),
met as (select k.tick, k.r, k.c, g.plate_id, count(*) filter (where not is_hole) as o, count(*) filter (where is_hole) as h from k join g on g.tick = k.tick and lon > w and lon < e and lat > s and lat < n group by all),
i as (select distinct tick, r, c from met where o > 0 and h = 0)
select x.tick, x.r, x.c, case when i.r is not null then round(value, 4) + 0.0 end as value from cells x left join i on i.tick = x.tick and i.r = x.r and i.c = x.c"""))
def y25_raster_mask_by_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings that hold at one tick each mask the frame of that tick."""
    own = rings(spark, sf_dir).withColumn("tick", 10 * (1 + F.col("ring_id") % 7))
    masked = grid.mask_plates_by_tick(cells(spark, sf_dir), own, 36, 18, SHIFTED, at=0.52)
    return masked.select("tick", "r", "c", (F.round("value", 4) + 0.0).alias("value"))
