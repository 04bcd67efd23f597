"""Samples along lines in every mode against plain Python, and summaries of boundaries without samples."""

import math
import random

import pytest
from pyspark.sql import functions as F

from orogen.functions import space
from orogen.operators import rates

XYZ = "struct<x:double,y:double,z:double>"


def unit(r):
    v = [r.gauss(0, 1) for _ in range(3)]
    n = math.hypot(*v)
    return tuple(x / n for x in v)


def angle(a, b):
    return math.atan2(math.hypot(*(a[i - 2] * b[i - 1] - a[i - 1] * b[i - 2] for i in range(3))), sum(x * y for x, y in zip(a, b)))


def between(a, b, t, mode):
    if mode == "chord":
        return tuple(x + (y - x) * t for x, y in zip(a, b))
    w = angle(a, b)
    return tuple((math.sin((1 - t) * w) * x + math.sin(t * w) * y) / math.sin(w) for x, y in zip(a, b)) if w > 1e-12 else a


def plain(line, mode, count, spacing, ends):
    lengths = [angle(a, b) if mode == "arc" else math.dist(a, b) for a, b in zip(line, line[1:])]
    total = sum(lengths)
    if not total:
        return [line[0]]
    between_ends = max(1, round(total / spacing)) if count is None else None
    n = count if count is not None else between_ends + 1 if ends else max(1, between_ends - 1)
    out = []
    for i in range(n):
        s = i * total / (n - 1) if ends else (i + 1) * total / (n + 1)
        for k, length in enumerate(lengths):
            if s <= length + 1e-12 or k == len(lengths) - 1:
                out.append(between(line[k], line[k + 1], min(1, s / length) if length else 0, mode))
                break
            s -= length
    return out


@pytest.mark.parametrize("mode", ["arc", "chord"])
@pytest.mark.parametrize("ends", [True, False])
@pytest.mark.parametrize(("count", "spacing"), [(2, None), (7, None), (None, 0.11), (None, 50.0)])
def test_equal_spacing(spark, mode, ends, count, spacing):
    r = random.Random(6)
    lines = {k: [unit(r) for _ in range(2 + k % 4)] for k in range(12)} | {20: [(1.0, 0.0, 0.0)] * 3}
    table = spark.createDataFrame([(k, i, p) for k, line in lines.items() for i, p in enumerate(line)], f"boundary_id long, pos int, p {XYZ}")
    got = {}
    for row in rates.samples_by_mode(table, mode, count, spacing, ends).orderBy("boundary_id", "sample").collect():
        assert row["sample"] == len(got.setdefault(row["boundary_id"], []))
        got[row["boundary_id"]].append(tuple(row["p"]))
    for k, line in lines.items():
        want = plain(line, mode, count, spacing, ends)
        assert len(got[k]) == len(want) and all(math.dist(a, b) < 1e-9 for a, b in zip(got[k], want)), k


def test_vertices_only(spark):
    lines = {1: 2, 2: 5, 3: 1}
    table = spark.createDataFrame([(k, i, (float(i), 0.0, 0.0)) for k, n in lines.items() for i in range(n)], f"boundary_id long, pos int, p {XYZ}")
    take = lambda ends: sorted((r["boundary_id"], r["sample"], r["p"]["x"], r["leg"]) for r in rates.samples_by_mode(table, "vertices", ends=ends).collect())
    assert take(True) == [(1, 0, 0.0, 0), (1, 1, 1.0, 0), *((2, i, float(i), min(i, 3)) for i in range(5)), (3, 0, 0.0, 0)]
    assert take(False) == [(1, 0, 0.0, 0), (1, 1, 1.0, 0), (2, 0, 1.0, 1), (2, 1, 2.0, 2), (2, 2, 3.0, 3), (3, 0, 0.0, 0)]


def test_summaries_of_boundaries_without_such_samples(spark):
    rows = [(1, 0, 0.0, 0.5, 0.1, 0.2), (1, 1, 0.3, 0.7, -0.3, 0.1), (2, 0, 0.0, -0.4, 0.0, 0.3), (2, 1, 0.6, -0.2, 0.0, 0.9)]
    s = spark.createDataFrame(rows, "boundary_id long, sample int, arc double, normal_rate double, tangential_rate double, normal_sigma double")
    opening = {r["boundary_id"]: r for r in rates.spreading(s).collect()}
    assert opening[1]["asymmetry"] == pytest.approx(0.1 / 0.6) and tuple(opening[2])[1:] == (0, 0, 0, 0, 0)
    closing = {r["boundary_id"]: r for r in rates.convergence(s).collect()}
    assert tuple(closing[1])[1:] == (0, 0, 0, 0, None) and tuple(closing[2])[1:] == pytest.approx((0.4, 0.3, 0.6, 2, 0.9))
    slip = {r["boundary_id"]: r for r in rates.strike_slip(s).collect()}
    assert tuple(slip[1])[1:] == pytest.approx((0.3, 0.2, 0.3, 1, 1)) and tuple(slip[2])[1:] == (0, 0, 0, 0, 0)
    assert rates.convergence(s.drop("normal_sigma")).where("max_sigma is not null").count() == 0


def test_lines_are_sampled_where_they_lie(spark):
    r = random.Random(9)
    table = {1: [unit(r), unit(r)], 2: [unit(r) for _ in range(700)], 3: [(0.0, 1.0, 0.0)] * 3, 4: [(0.0, 0.0, 1.0)], 5: [(1.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)]}
    lines = spark.createDataFrame(list(table.items()), f"boundary_id long, line array<{XYZ}>")
    vertices = lines.select("boundary_id", F.posexplode("line").alias("pos", "p"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for sample in (lambda t: rates.sample_along(t, 5), lambda t: rates.samples_by_mode(t, "chord", spacing=0.3, ends=False), lambda t: rates.samples_by_mode(t, "arc", 6)):
        assert not any(step in plan(sample(lines)) for step in ("Exchange", "Window", "Aggregate", "Sort"))
        assert sorted(map(str, sample(lines).collect())) == sorted(map(str, sample(vertices).collect()))
    got = rates.sample_along(lines, 5).orderBy("boundary_id", "sample").collect()
    assert [(s["boundary_id"], s["sample"]) for s in got] == [(k, i) for k in (1, 2, 3, 5) for i in range(1 if k == 3 else 5)]
    for s in got:  # the long line's running lengths, and points at vertices and between
        want = plain(table[s["boundary_id"]], "arc", 5, None, True)[s["sample"]]
        assert math.dist(s["p"], want) < 1e-9


def test_summaries_move_no_samples_and_tasks_follow_the_boundaries(spark, monkeypatch):
    monkeypatch.setattr(rates, "ROWS", 100)
    lines = spark.range(90).select(F.col("id").alias("boundary_id"), F.array(space.latlon_to_unit(F.lit(1.0), F.col("id")), space.latlon_to_unit(F.lit(2.0), F.col("id"))).alias("line"), (F.col("id") % 3).alias("plate_left"), ((F.col("id") + 1) % 3).alias("plate_right"))
    omegas = spark.range(3).select(F.col("id").alias("plate_id"), space.vec(F.col("id") * 0.1, F.lit(0.2), F.lit(0.0)).alias("omega"))
    found = rates.rate_statistics(rates.boundary_velocities(rates.sample_along(rates.gathered(lines, 5), 5), None, omegas))
    assert rates.gathered(lines, 5).rdd.getNumPartitions() == 5  # 450 samples
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and found.count() == 90


def test_spreading_where_a_rate_is_nearly_zero_equals_its_sql(spark, tmp_path):
    """Boundary 193307 has an opening sample only by the sign of a rounding, which has to be the SQL's."""
    import duckdb

    import __spark_entry__

    con = duckdb.connect()
    for t in ("orders", "nation"):
        more = "where o_orderkey = 43307" if t == "orders" else ""
        shift = "* replace (o_orderkey + 150000 as o_orderkey, o_custkey + 15000 as o_custkey)" if t == "orders" else "*"
        con.execute(f"copy (select {shift} from '/root/testdata/sf0.1/{t}.parquet' {more}) to '{tmp_path}/{t}.parquet' (format parquet)")
        con.execute(f"create view {t} as from '{tmp_path}/{t}.parquet'")
    want = con.execute(f"select boundary_id, obliquity, half_rate from ({__spark_entry__.oracle_sql()['a5_spreading']})").fetchall()
    got = __spark_entry__.queries()["a5_spreading"](spark, str(tmp_path)).select("boundary_id", "obliquity", "half_rate").collect()
    assert [tuple(x) for x in got] == want and want[0][0] == 193307
