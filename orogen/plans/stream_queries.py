"""Queries that read the log as a stream: in several files, one a batch, until all is read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domain import sql, topology_events
from ..operators import log
from ..registry import ORACLE, query
from ..streaming import logs
from ..tables import new_folder
from .ingest_queries import FLAT
from .log_queries import _STATE

BATCHES = 3

#: Rows of one file of a batch.
FILE_ROWS = 2**18


def arriving(spark: SparkSession, sf_dir: str, times: int = 1, end: str | None = None, order: str = "event_id") -> DataFrame:
    """The events as a stream of BATCHES parts in order of event_id, or of ts (all of them `times` over), one part a batch.

    A part is written as files of about FILE_ROWS rows, all parts as equally many, so that tasks stay as small as they
    are when the table grows. With `end` a file of one row of that time, and no other value, comes last.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.col("event_id") if order == "event_id" else F.unix_micros(F.col(order).cast("timestamp"))
    first, last = events.agg(F.min(at), F.max(at)).first()
    first, width = first or 0, -(-((last or 0) + 1 - (first or 0)) // BATCHES)
    part = F.coalesce(F.floor((at - first) / width).cast("int"), F.lit(0))  # nulls come first
    sizes = dict(events.groupBy(part).count().collect())  # a row for each part
    files = max([-(-n // FILE_ROWS) for n in sizes.values()], default=1)
    path = new_folder(spark, "arriving")
    written = 0
    for again in range(times):
        for k in range(BATCHES):  # files are taken in order of their age
            events.where(part == k).repartition(files, "event_id").write.mode("append").parquet(path)
            written += files
            for missing in range(written - len(spark.read.schema(events.schema).parquet(path).inputFiles())):  # a task without rows wrote none
                events.limit(0).coalesce(1).write.mode("append").parquet(path)
    if end:
        last_row = spark.range(1).select(*((F.lit(end) if c == "ts" else F.lit(None)).cast(t).alias(c) for c, t in events.dtypes))
        last_row.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(path)


def _table(spark: SparkSession, sf_dir: str, fold: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    events, path = _stream(spark, sf_dir), new_folder(spark, key)
    logs.maintained_table(events, fold, path, new_folder(spark, "checkpoint"))
    return logs.current(spark, path, fold(events).schema, key)


def _stream(spark: SparkSession, sf_dir: str, times: int = 1) -> DataFrame:
    return topology_events(spark, sf_dir, arriving(spark, sf_dir, times))


def _whole(body: str) -> str:
    return sql("topology", _STATE.replace("tick <= {t}", "sequence <= {t}").format(t=2**62) + body)


def _kept(spark: SparkSession, sf_dir: str, report: bool = False) -> tuple[str, DataFrame]:
    events, path = _stream(spark, sf_dir), new_folder(spark, "state")
    logs.maintained(events, path, new_folder(spark, "checkpoint"), report)
    return path, events


@query(_whole("select * from p"))
def x1_plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, log.plates, "plate_id")


@query(_whole("select * from b"))
def x1_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, log.boundaries, "boundary_id").withColumn("geometry_seed", F.col("geometry.coords")[0]["x"].cast("long")).drop("geometry")


@query(_whole("select stream_key, junction_id, is_retired, radius, string_agg(boundary_id, ',' order by boundary_id) as boundary_ids from inc group by all"))
def x1_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _table(spark, sf_dir, log.junctions, "junction_id")
    return j.select("stream_key", "junction_id", "is_retired", F.col("location.radius").alias("radius"), F.array_join(F.array_sort("boundary_ids"), ",").alias("boundary_ids"))


@query(sql("topology", "select stream_key, max(sequence) as sequence, arg_max(tick, sequence) as tick from topology group by stream_key"))
def x2_stream_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads after each batch in update mode; the last of each stream."""
    path = new_folder(spark, "heads")
    heads = logs.stream_heads(_stream(spark, sf_dir))
    query = heads.writeStream.outputMode("update").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}"))
    query.option("checkpointLocation", new_folder(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    told = spark.read.schema(heads.schema).parquet(path)
    return told.groupBy("stream_key").agg(F.max("sequence").alias("sequence"), F.max_by("tick", "sequence").alias("tick"))


@query(ORACLE["x3_late_events"])
def x3_stream_late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late events as they arrive, against the greatest tick that is each stream's state."""
    return logs.appended(logs.late_events(_stream(spark, sf_dir)), new_folder(spark, "late"), new_folder(spark, "checkpoint"))


@query(ORACLE["x8_sessions"])
def x8_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions on event time, of events that arrive in parts in order of it, so none is late.

    A last row long after all others lets the watermark close every session; its own stays open.
    """
    events = arriving(spark, sf_dir, end="9999-01-01", order="ts").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    # A gap of just an hour does not part two events, the window's end does: one microsecond more.
    found = logs.sessions(events, "user_id", "ts", "3600 seconds 1 microsecond", "2 hours")
    told = logs.appended(found, new_folder(spark, "sessions"), new_folder(spark, "checkpoint"))
    return told.select("user_id", F.col("session_start").cast(dict(spark.read.parquet(f"{sf_dir}/events.parquet").dtypes)["ts"]).alias("session_start"), "n")


@query(ORACLE["y32_invariant_report"])
def x4_stream_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the rules as batches arrive."""
    path, _ = _kept(spark, sf_dir, report=True)
    schema = "stream_key string, sequence long, rule string, entity string, detail string"
    return spark.read.schema(schema).parquet(f"{path}/report").drop("batch")


@query(sql("topology", "select stream_key, count(*) as n, max(sequence) as head, count(*) as refused from topology group by stream_key"))
def x6_appended_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events arrive twice; the second time they are behind the head and refused."""
    events, path = _stream(spark, sf_dir, times=2).select(FLAT), new_folder(spark, "once")
    logs.append_once(events, path, new_folder(spark, "checkpoint"))
    read = lambda name: spark.read.schema(events.schema).parquet(f"{path}/{name}")
    refused = read("refused").groupBy("stream_key").agg(F.count(F.lit(1)).alias("refused"))
    return read("log").groupBy("stream_key").agg(F.count(F.lit(1)).alias("n"), F.max("sequence").alias("head")).join(refused, "stream_key")


@query("select event_type, count(*) as n, min(event_id) as first, max(event_id) as last from events group by event_type")
def x7_deduplicated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive twice count once; the watermark's delay is longer than the log, so none is late."""
    events = arriving(spark, sf_dir, times=2).select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    ts = F.col("ts").cast("timestamp")
    days = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.date_diff(F.max(ts), F.min(ts))).first()[0] or 0
    once = logs.appended(logs.deduplicated(events, "ts", f"{days + 2} days"), new_folder(spark, "unique"), new_folder(spark, "checkpoint"))
    return once.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query(sql("topology", "select stream_key, (tick // 50 - k) * 50 as window_start, count(*) as n from topology, (values (0), (1)) v(k) where tick >= 50 group by all"))
def x8_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 100 ticks that begin every 50."""
    e = topology_events(spark, sf_dir).where("tick >= 50")
    return logs.sliding_windows(e, 100, 50)
