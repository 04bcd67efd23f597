"""Dataset manifests and the JSON assets that become events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, space

_ASSETS = "array<struct<assetId:string,relativePath:string,format:string>>"
MANIFEST = f"datasetId string, bodyId string, bodyFrame struct<shape:string,radius:double,unit:string,angularConvention:string>, timeMapping struct<tickUnit:string>, featureSets {_ASSETS}, rasterSequences {_ASSETS}, motionModels {_ASSETS}"
TOPOLOGY = "schema string, plates array<struct<plateKey:string,plateId:string>>, boundaries array<struct<boundaryKey:string,boundaryId:string,leftPlateKey:string,rightPlateKey:string,boundaryType:string,polyline:array<array<double>>,tick:long>>"
SEGMENTS = "schema string, modelId string, plates array<struct<plateKey:string,plateId:string,segments:array<struct<tickA:long,tickB:long,axisAzimuthMicroDeg:int,axisElevationMicroDeg:int,angleMicroDeg:int,segmentId:string>>>>"


def read_json(spark: SparkSession, path: str, schema: str, one_per_line: bool = False) -> DataFrame:
    """JSON documents, one in each file or one on each line, with the file's name."""
    return spark.read.schema(schema).json(path, multiLine=not one_per_line).withColumn("file", F.input_file_name())


def manifest_errors(manifests: DataFrame) -> DataFrame:
    """file, code, path, message in order of (code, path, message) within a file."""
    error = lambda bad, code, path, message: F.when(bad, F.struct(F.lit(code).alias("code"), F.lit(path).alias("path"), F.lit(message).alias("message")))
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    rules = [
        error(blank("datasetId"), "dataset.id.missing", "datasetId", "a dataset needs an id"),
        error(blank("bodyId"), "body.id.missing", "bodyId", "a dataset needs a body"),
        error(F.col("bodyFrame").isNull(), "body.frame.missing", "bodyFrame", "a dataset needs a body frame"),
        error(F.col("bodyFrame.radius") <= 0, "body.frame.radius", "bodyFrame.radius", "the radius must be positive"),
        error(F.col("timeMapping.tickUnit").isNull(), "time.unit.missing", "timeMapping.tickUnit", "a dataset needs a tick unit"),
    ]
    for part in ("featureSets", "rasterSequences", "motionModels"):
        names = F.transform(part, lambda a: a["assetId"])
        rules.append(error(F.size(F.array_distinct(names)) < F.size(names), "asset.id.twice", part, "an asset id is used twice"))
        rules.append(error(F.exists(part, lambda a: a["relativePath"].isNull()), "asset.path.missing", part, "an asset needs a path"))
    return manifests.select("file", F.explode(F.array_sort(F.array_compact(F.array(*rules)))).alias("e")).select("file", "e.*")


def topology_plans(assets: DataFrame) -> DataFrame:
    """Event plans of topology assets: plates (kind 0) before boundaries (kind 1), lines as unit points."""
    plates = assets.select("file", F.explode("plates").alias("p")).select(F.lit(0).alias("kind"), F.col("p.plateKey").alias("order_key"), F.col("file").alias("asset"), F.lit("PlateCreated").alias("event_type"), F.coalesce("p.plateId", ids.stable_id(F.col("file"), F.col("p.plateKey"))).alias("plate_id"), F.lit(None).cast("string").alias("left_key"), F.lit(None).cast("string").alias("right_key"), F.lit(None).cast("array<struct<x:double,y:double,z:double>>").alias("line"))
    line = F.transform("b.polyline", lambda c: space.latlon_to_unit(c[1], c[0]))
    boundaries = assets.select("file", F.explode("boundaries").alias("b")).select(F.lit(1).alias("kind"), F.col("b.boundaryKey").alias("order_key"), F.col("file").alias("asset"), F.lit("BoundaryCreated").alias("event_type"), F.lit(None).cast("string").alias("plate_id"), F.col("b.leftPlateKey").alias("left_key"), F.col("b.rightPlateKey").alias("right_key"), line.alias("line"))
    return plates.unionByName(boundaries)


def unknown_plates(plans: DataFrame) -> DataFrame:
    """References of boundaries to plate keys that their asset does not have."""
    known = plans.where("kind = 0").select("asset", F.col("order_key").alias("key"))
    refs = plans.where("kind = 1").select("asset", "order_key", F.explode(F.array("left_key", "right_key")).alias("key"))
    return refs.join(known, ["asset", "key"], "left_anti")


def segment_plans(assets: DataFrame) -> DataFrame:
    """Segments of motion models, with a flag where tick_b > tick_a >= 0 does not hold."""
    rows = assets.select("file", "modelId", F.explode("plates").alias("p")).select("file", "modelId", "p.plateKey", F.posexplode("p.segments").alias("k", "s"))
    ok = (F.col("s.tickB") > F.col("s.tickA")) & (F.col("s.tickA") >= 0)
    return rows.select("file", "modelId", "plateKey", F.coalesce("s.segmentId", ids.stable_id(F.col("file"), F.col("plateKey"), F.col("k"))).alias("segment_id"), F.col("s.tickA").alias("tick_a"), F.col("s.tickB").alias("tick_b"), F.col("s.axisAzimuthMicroDeg").alias("azimuth"), F.col("s.axisElevationMicroDeg").alias("elevation"), F.col("s.angleMicroDeg").alias("angle"), ok.alias("is_valid"))


def read_cells(spark: SparkSession, path: str, schema: str = "r int, c int, value double", pattern: str | None = None) -> DataFrame:
    """Raster cells of Parquet files; the tick is the last run of digits in the file's name, or what the pattern's group finds in its path."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    tick = F.regexp_extract(name, r"(\d+)\D*$", 1) if pattern is None else F.regexp_extract(F.input_file_name(), pattern, 1)
    return spark.read.schema(schema).parquet(path).withColumn("tick", tick.cast("long"))


#: The folder of a frame, and how its tick is read from a path.
FRAME, FRAME_TICK = "frame=tick%06d", r"frame=tick(\d+)/"


def export_raster(cells: DataFrame, start: int, end: int, step: int, path: str, method: str = "linear") -> None:
    """Frames of a raster sequence at start, start + step, ... up to end, each in a folder named by its tick."""
    from ..operators import grid

    if step <= 0 or end < start:
        raise ValueError("a step must be positive, and the end not before the start")
    k = cells.sparkSession.range(start, end + 1, step).select(F.col("id").alias("tick"))
    ticks = cells.select("sequence_id").distinct().join(F.broadcast(k))  # as many as the export has frames
    frames = grid.raster_at(cells, ticks, method).select(F.format_string("tick%06d", "tick").alias("frame"), "r", "c", "value")
    frames.write.mode("overwrite").partitionBy("frame").parquet(path)


def export_ticks(frames: DataFrame, path: str) -> None:
    frames.write.mode("overwrite").partitionBy("tick").parquet(path)
