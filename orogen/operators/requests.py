"""Requests on plate data: which of their required parts are missing, and what their answers come from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids

#: The parts that each type of query needs.
ALWAYS = ("kinematics_model", "partition_tolerance")
REQUIRED = {
    "Reconstruct": ("frame",),
    "QueryPlateId": (),
    "QueryVelocity": ("frame",),
    "BoundaryAnalytics": ("frame", "boundary_sampling"),
    "MotionPath": ("frame", "integration_policy"),
    "Flowline": ("frame", "integration_policy"),
}


def policy_check(requests: DataFrame) -> DataFrame:
    """Add errors, the missing parts' names in order, and is_valid. An empty model counts as missing; unknown types need what all need."""
    needs = {p: [t for t, parts in REQUIRED.items() if p in parts] for p in ("frame", "boundary_sampling", "integration_policy")}
    absent = {p: F.col("query_type").isin(types) & F.col(p).isNull() for p, types in needs.items()}
    absent["kinematics_model"] = F.coalesce("kinematics_model", F.lit("")) == ""
    absent["partition_tolerance"] = F.col("partition_tolerance").isNull()
    errors = F.array_sort(F.array_compact(F.array(*(F.when(absent[p], F.lit(p)) for p in absent))))
    return requests.withColumn("errors", errors).withColumn("is_valid", F.size("errors") == 0)


def reconstruct(features: DataFrame, rotations: DataFrame, heads: DataFrame, tick: int, frame: str, solver: str) -> DataFrame:
    """An answer to a reconstruction request: features (plate_id, line) turned to the tick, with where the answer comes from.

    Features without a plate are kept as they are, with method `none`.
    """
    from . import motion

    turned = motion.reconstruct(features, rotations, "plate_id", "line").unionByName(features.where("plate_id is null"))
    return provenance_columns(turned, heads, tick, frame, solver)


def provenance_columns(answers: DataFrame, heads: DataFrame, tick: int, frame: str, solver: str) -> DataFrame:
    """Add tick, frame, solver, sources and key to answers with a plate_id.

    sources names each stream read (heads: stream_key, sequence; those of one request) with its last sequence; key is
    the same for answers on one plate from the same sources. method tells whether the plate was known.
    """
    each = F.array_sort(F.collect_list(F.concat_ws(":", "stream_key", F.col("sequence").cast("string"))))
    sources = heads.agg(F.array_join(each, ",").alias("sources"))
    rows = answers.join(F.broadcast(sources))  # one row
    rows = rows.withColumns({"tick": F.lit(tick).cast("long"), "frame": F.lit(frame), "solver": F.lit(solver), "method": F.when(F.col("plate_id").isNull(), "none").otherwise("given")})
    return rows.withColumn("key", ids.short_hash(*(F.col(c) for c in ("plate_id", "tick", "frame", "solver", "sources"))))
