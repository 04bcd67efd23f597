"""Choices among ties, and tables of pairs of any size."""

from pyspark.sql import functions as F

from orogen.operators import motion
from orogen.plans.basic_queries import w11_first_and_last


def test_ties_go_to_the_least_key(spark, tmp_path):
    rows = [(k, k % 2, None if k < 2 else float(k % 6 // 2)) for k in range(120)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double").orderBy(F.desc("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    assert {tuple(r) for r in w11_first_and_last(spark, str(tmp_path)).collect()} == {(0, 4, 6), (1, 5, 7)}
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/up/customer.parquet")
    assert {tuple(r) for r in w11_first_and_last(spark, f"{tmp_path}/up").collect()} == {(0, 4, 6), (1, 5, 7)}


def test_plates_meet_more_ticks_than_a_stated_list_holds(spark):
    plates = spark.createDataFrame([(1,), (2,)], "plate_id long")
    found = motion.plate_ticks(plates, spark.range(30_000).select((F.col("id") % 10_001).cast("int").alias("tick")))
    assert dict(found.dtypes)["tick"] == "bigint" and found.count() == found.distinct().count() == 2 * 10_001
    assert motion.plate_ticks(plates, spark.range(0).select(F.col("id").alias("tick"))).count() == 0
