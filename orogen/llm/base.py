"""Reading tables, keeping intermediate tables, and numbering rows without one big sort."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BATCH_ROWS, BATCH_BYTES = 250, "4m"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only a local session that names none gets a new temporary one."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Paths of the tables kept so far, for temporary().
_KEPT: list[str] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that are kept inside are deleted at the end, when what was made of them has been written."""
    first = len(_KEPT)
    try:
        yield
    finally:
        delete(spark, _KEPT[first:])
        del _KEPT[first:]


def delete(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        at = hadoop.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def keep(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write a table to the shared folder and read it again.

    This cuts the lineage: what is lost with an executor is read from the shared folder, not computed anew.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    _KEPT.append(path)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(spark.read.parquet(path).schema if partition_by else df.schema).parquet(path)


def in_small_batches(docs: DataFrame) -> DataFrame:
    """The same table; the session hands Python workers batches of so many rows and bytes at most.

    Texts can be long: the usual batch of 10,000 rows can be larger than a worker's memory. The bounds are the
    same for all operators, so none changes how another's lazy result runs.
    """
    conf = docs.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return docs


def map_batches(docs: DataFrame, columns: list[str], each: Callable[[Iterator[list[list]]], Iterator[list]], schema: str) -> DataFrame:
    """Rows through Python, batch by batch: `each` gets lists of the columns' values and gives lists of the schema's.

    Values are Python's own, so that integers stay whole beside nulls.
    """
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in each([c.to_pylist() for c in b.columns] for b in batches):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, target)], schema=target)

    return in_small_batches(docs).select(columns).mapInArrow(run, schema)


def crc32_of_id(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def letters_a_to_z_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(df: DataFrame, group: list[str], order: list[str], name: str, salts: int = 256) -> DataFrame:
    """Number the rows of each group from 0, without gaps.

    A group may hold most rows, so each is split by a hash of its order columns into salted parts. The
    parts are counted (a small table: groups times salts), the counts run up to each part's first number,
    and each part numbers its own rows. The numbers follow (salt, order), not order alone.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salted.groupBy(*group, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy(*group, "_salt").orderBy(*order)
    return (
        salted.withColumn("_at", F.row_number().over(within).cast("long") - 1)
        .join(starts, [*group, "_salt"])
        .withColumn(name, F.col("_first") + F.col("_at"))
        .drop("_salt", "_at", "_first")
    )


def join_counted(rows: DataFrame, table: DataFrame, key: str, total: int, count: str = "n", hot: int = 10_000) -> DataFrame:
    """Inner join of rows with a table that has one row for each key and the number of rows that have it.

    Keys with over a `hot`-th part of all rows, of which there are fewer than `hot`, are broadcast; so no task gets
    all rows of a common key. The rest are joined by a shuffle.
    """
    much = max(1000, total // hot)
    few, many = table.where(F.col(count) <= much), table.where(F.col(count) > much)
    return rows.join(F.broadcast(many), key).unionByName(rows.join(few, key))
