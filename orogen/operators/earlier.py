"""What came before a row in its group, by buckets of the order, so that no task sorts a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sequence numbers, or ticks, of a bucket.
WIDTH = 100_000


def bucket_of(column: str, width: int = WIDTH) -> Column:
    """Rises with the column; one number for each `width` of it."""
    return F.floor(F.col(column) / width).cast("long")


def with_earlier(rows: DataFrame, by: list[str], order: list[str], bucket: Column, name: str, value: Column, kind: str = "last") -> DataFrame:
    """Add the last non-null value, or the greatest (`kind` max), of the rows before each one in its group; null if none.

    The bucket has to rise with the order. Nulls in `by` are a group of their own. Rows look back within their bucket; what the buckets before it end
    with is carried on over a table of one row for each group and bucket.
    """
    keyed = rows.withColumns({"_bucket": bucket, "_value": value})
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    inside, across = before(*by, "_bucket").orderBy(*order), before(*by).orderBy("_bucket")
    if kind == "max":
        own, end, carried = F.max("_value").over(inside), F.max("_value"), F.max("_end").over(across)
        found = F.greatest("_own", "_carried")
    else:
        own = F.last("_value", ignorenulls=True).over(inside)
        end = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order)))
        carried = F.last("_end", ignorenulls=True).over(across)
        found = F.coalesce("_own", "_carried")
    keys = [*by, "_bucket"]
    ends = keyed.groupBy(*keys).agg(end.alias("_end")).select(*(F.col(c).alias(f"_key{k}") for k, c in enumerate(keys)), carried.alias("_carried"))
    same = [F.col(c).eqNullSafe(F.col(f"_key{k}")) for k, c in enumerate(keys)]
    met = keyed.withColumn("_own", own).join(ends, same).withColumn(name, found)
    return met.drop("_bucket", "_value", "_own", "_carried", *(f"_key{k}" for k in range(len(keys))))


def with_place(rows: DataFrame, by: list[str], order: list[str], bucket: list[Column], name: str) -> DataFrame:
    """Number the rows of each group from 1 in order. Bucket columns rise with the order, compared one after another."""
    keys = [f"_bucket{k}" for k in range(len(bucket))]
    keyed = rows.withColumns(dict(zip(keys, bucket)))
    counts = keyed.groupBy(*by, *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*by, *keys).orderBy(*order)
    return keyed.withColumn("_at", F.row_number().over(within)).join(starts, [*by, *keys]).withColumn(name, F.col("_start") + F.col("_at")).drop(*keys, "_at", "_start")
