"""Faces of long and short cycles."""

from pyspark.sql import functions as F

from orogen.operators import topology


def test_a_long_cycle_is_walked(spark):
    """Sizes that the planner guessed were multiplied in each round, so a cycle of thousands of darts never ended."""
    n = 9001
    place = spark.range(n).select((F.col("id") * 7 % n).alias("k"), "id")  # dart 2k + 1 is followed by that of k + 7
    darts = place.select((F.col("k") * 2 + 1).alias("dart"), ((F.col("k") + 7) % n * 2 + 1).alias("next"))
    short = spark.range(3000).select((F.col("id") * 2 + 100_000).alias("dart"), (F.when(F.col("id") % 3 == 2, F.col("id") - 2).otherwise(F.col("id") + 1) * 2 + 100_000).alias("next"))
    alone = spark.createDataFrame([(0, 0), (2, 4), (4, 2)], "dart long, next long")
    found = {r["dart"]: (r["face"], r["position"], r["n"]) for r in topology.walk_faces(darts.unionByName(short).unionByName(alone)).collect()}
    assert len(found) == n + 3003
    assert all(found[(7 * i % n) * 2 + 1] == (1, i, n) for i in range(n))
    assert all(found[100_000 + 2 * i] == (100_000 + 2 * (i - i % 3), i % 3, 3) for i in range(3000))
    assert (found[0], found[2], found[4]) == ((0, 0, 1), (2, 0, 2), (2, 1, 2))


def test_darts_on_no_cycle_have_no_row(spark):
    darts = spark.createDataFrame([(1, 2), (2, 1), (3, 9), (5, 6), (6, 7), (7, 6)], "dart long, next long")
    assert sorted(r["dart"] for r in topology.walk_faces(darts).collect()) == [1, 2, 6, 7]
    assert topology.walk_faces(darts.where("dart < 0")).collect() == []
