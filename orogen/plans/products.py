"""Derived products: reuse by fingerprint, audit rows, retention, and marking stale ones."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AUDIT = "product string, fingerprint string, source string, last_sequence long, generator string, version string, params string, created double, seconds double, reused boolean"


def fingerprint(source: str, last_sequence: int, generator: str, version: str, params: dict[str, str]) -> str:
    text = "\n".join([source, str(last_sequence), generator, version, *(f"{k}={params[k]}" for k in sorted(params))])
    return hashlib.sha256(text.encode()).hexdigest()


def reuse_or_compute(spark: SparkSession, folder: str, product: str, source: str, last_sequence: int, generator: str, version: str, params: dict[str, str], make: Callable[[], DataFrame]) -> DataFrame:
    """The product of this fingerprint: read if it was written before, else computed and written. Each use adds an audit row."""
    key = fingerprint(source, last_sequence, generator, version, params)
    path, began, reused = f"{folder}/{product}/fingerprint={key}", time.time(), True
    try:
        found = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        make().write.mode("overwrite").parquet(path)
        found, reused = spark.read.parquet(path), False
    row = (product, key, source, last_sequence, generator, version, str(sorted(params.items())), began, time.time() - began, reused)
    spark.createDataFrame([row], AUDIT).write.mode("append").parquet(f"{folder}/audit")
    return found


def read_audit(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each use of a product under the folder."""
    return spark.read.schema(AUDIT).parquet(f"{folder}/audit")


def retention_candidates(products: DataFrame, group: str, key: str, keep: int, sequence_age: int | None = None, tick_age: int | None = None) -> DataFrame:
    """All but each group's newest (sequence, then tick, then key) that are older than the ages given; null ages ask nothing."""
    age = F.struct((-F.col("sequence")).alias("s"), (-F.col("tick")).alias("t"), F.col(key).alias("k"))
    # Only the newest few of each group are ranked; all others are told by the last of these.
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("sequence"), F.desc("tick"), key))
    newest_rows = products.withColumn("_place", place).where(F.col("_place") <= keep)
    last = newest_rows.groupBy(group).agg(F.max(age).alias("_last"), F.count(F.lit(1)).alias("_kept")).where(F.col("_kept") == keep)
    rows = products.join(last, group).where(age > F.col("_last")).drop("_last", "_kept") if keep > 0 else products
    newest = products.groupBy(group).agg(F.max("sequence").alias("_s"), F.max("tick").alias("_t"))
    old = F.lit(sequence_age is None and tick_age is None)
    if sequence_age is not None:
        old = old | (F.col("_s") - F.col("sequence") > sequence_age)
    if tick_age is not None:
        old = old | (F.col("_t") - F.col("tick") > tick_age)
    return rows.join(newest, group).where(old).drop("_s", "_t")


def stale_products(index: DataFrame, changes: DataFrame) -> DataFrame:
    """Products whose stream changed after the sequence that they were made at."""
    heads = changes.groupBy("stream_key").agg(F.max("sequence").alias("changed_at"))
    return index.join(heads, "stream_key").where(F.col("changed_at") > F.col("last_sequence"))
