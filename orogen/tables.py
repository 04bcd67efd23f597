"""Rounding for comparison, and cutting lineage by files that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in spark.checkpoint.dir, which all executors share."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows written to a folder of their own and read again: later plans begin at the files, with the files' sizes.

    A checkpoint would keep the size that the plan before it was taken to have; in a loop of joins these estimates are
    multiplied in each round, until the planner is busy with numbers of millions of digits.
    """
    folder = new_folder(df.sparkSession, "cut")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def r6(c: Column) -> Column:
    """Six decimals, never minus zero."""
    return F.round(c, 6) + F.lit(0.0)
