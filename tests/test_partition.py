"""Snapping, holes, pieces and tolerances against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from orogen.functions import space
from orogen.operators import cells, partition, topology
from orogen.operators.components import components
from orogen.plans import plate_queries

XYZ = "struct<x:double,y:double,z:double>"


def unit(lat, lon):
    a, b = math.radians(lat), math.radians(lon)
    return (math.cos(a) * math.cos(b), math.cos(a) * math.sin(b), math.sin(a))


def joined(links):
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {v: find(v) for v in root}


def test_components_have_their_least_node(spark):
    r = random.Random(2)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(70)] + [(2000, 2000 + k) for k in range(1, 60)] + [(5, 5)]
    table = spark.createDataFrame([*links, *links[:9], (None, 3)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(table).collect()}
    assert got == joined([(a, b) for a, b in links if a != b])
    assert components(table.where("false")).count() == 0
    # Graphs with the same nodes are told apart by a column.
    two = table.withColumn("g", F.lit("x")).unionByName(spark.createDataFrame([(5, 7, "y"), (7, 300, "y")], "a long, b long, g string"))
    found = components(two, by=("g",)).collect()
    assert {r["node"]: r["label"] for r in found if r["g"] == "x"} == got and {r["node"]: r["label"] for r in found if r["g"] == "y"} == {5: 5, 7: 5, 300: 5}


@pytest.mark.parametrize(("segments", "factor"), [(51, 1e-4), (50, 5e-4), (21, 5e-4), (20, 1e-3), (11, 1e-3), (10, 5e-3), (6, 5e-3), (5, 1e-2), (3, 1e-2), (2, 2e-2), (1, 2e-2)])
def test_tolerance_by_density(spark, segments, factor):
    chord = 1e-5
    lines = spark.createDataFrame([(k, [(i * chord, 0.0, 0.0) for i in range(segments + 1)]) for k in range(3)], f"boundary_id long, line array<{XYZ}>")
    row = partition.density_epsilon(lines).first()
    assert row["density"] == segments and math.isclose(row["mean_chord"], chord) and math.isclose(row["epsilon"], min(1e-6, max(1e-12, chord * factor)))


def test_tolerance_without_segments(spark):
    lines = spark.createDataFrame([(1, [(1.0, 0.0, 0.0)]), (2, []), (3, None)], f"boundary_id long, line array<{XYZ}>")
    assert partition.density_epsilon(lines).first()["epsilon"] == 1e-9 and partition.density_epsilon(lines.where("false")).first()["epsilon"] == 1e-9
    # Boundaries without a segment count in the density: 12 segments over 4 boundaries.
    more = lines.unionByName(spark.createDataFrame([(4, [(i * 1e-5, 0.0, 0.0) for i in range(13)])], lines.schema))
    assert math.isclose(partition.density_epsilon(more).first()["epsilon"], 1e-5 * 1e-2)
    assert partition.tolerances(2e-9) == pytest.approx([2e-9, 2e-8, 2e-7, 1e-6], rel=1e-9) and partition.tolerances(1e-6) == [1e-6] * 4


def test_snapped_ends_equal_all_pairs(spark):
    r, eps = random.Random(4), 1e-3
    base = [tuple(r.uniform(-1, 1) for _ in range(3)) for _ in range(25)]
    ends = [(k, place, tuple(c + r.choice([0, 0, 4e-4, -9e-4, 2e-3]) for c in r.choice(base))) for k in range(150) for place in (0, 1)] + [(900, 0, (0.0, -0.0, 0.5)), (901, 1, (-0.0, 0.0, 0.5))]
    table = spark.createDataFrame(ends, f"boundary_id long, place int, position {XYZ}")
    for e in (eps, 0.0):
        got = {(x["boundary_id"], x["place"]): x["junction_id"] for x in partition.snap_ends(table, F.lit(e)).collect()}
        near = [(2 * a[0] + a[1], 2 * b[0] + b[1]) for a in ends for b in ends if math.dist(a[2], b[2]) <= e]
        want = joined(near)
        assert got == {(k, p): want[2 * k + p] for k, p, _ in ends} and (e == 0 or len(set(got.values())) < 150)
    both = table.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("level"))
    two = partition.snap_ends(both, F.when(F.col("level") == 1, 0.0).otherwise(eps), ("level",))
    assert two.groupBy("level").agg(F.countDistinct("junction_id").alias("n")).where("n > 0").count() == 2
    assert partition.snap_ends(table.where("false"), F.lit(eps)).count() == 0


def test_spots_are_dealt_to_few_cells_and_maps_keep_apart(spark, monkeypatch):
    r = random.Random(8)
    spots = [(k, *(r.uniform(-1, 1) for _ in range(3))) for k in range(2000)]
    met = []
    monkeypatch.setattr(partition, "components", lambda links, *a, **k: met.append(links) or components(links, *a, **k))
    ends = [(k, 0, tuple(p)) for k, *p in spots]
    # Ends close to each other on both sides of cells of any side, and a chain of which only neighbours are near.
    ends += [(3000 + k, 0, (0.5 + k * 1e-6 / 3, -0.5 - k * 1e-6 / 3, (k % 2) * 1e-7)) for k in range(60)] + [(4000 + k, 0, (-1e-9 * k, 0.0, 0.3)) for k in range(-4, 5)]
    table = spark.createDataFrame(ends, f"boundary_id long, place int, position {XYZ}")
    levels = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.lit(e).alias("eps")) for k, e in enumerate((1e-9, 3e-7, 1e-6)))))
    both = table.select("*", levels.alias("l")).select("boundary_id", "place", "position", "l.*")
    got = {(x["level"], x["boundary_id"]): x["junction_id"] for x in partition.snap_ends(both, F.col("eps"), ("level",)).collect()}
    want = {}
    for k, e in enumerate((1e-9, 3e-7, 1e-6)):
        near = joined([(2 * a[0], 2 * b[0]) for n, a in enumerate(ends) for b in ends[n:] if (a[2][0] - b[2][0]) ** 2 + (a[2][1] - b[2][1]) ** 2 + (a[2][2] - b[2][2]) ** 2 <= e * e])
        want |= {(k, b): near[2 * b] for b, *_ in ends}
    assert got == want
    # A link is told once, in the cell sides that spots reach: not from all cells around them.
    told = met[0].groupBy("level", "a", "b").count()
    assert told.where("a <= b").isEmpty() and told.where("count > 8").isEmpty()
    dealt = partition.reached(spark.createDataFrame(spots, "spot long, _x double, _y double, _z double").withColumn("_eps", F.lit(1e-3))).count()
    assert len(spots) <= dealt <= 2.5 * len(spots)


RINGS = {
    "quarter": ([(0, 0), (0, 90), (90, 0)], [(40, 40)], [(-40, 40), (10, -20), (-30, -130)]),
    "polar": ([(60, k) for k in range(0, 360, 45)], [(90, 0), (75, 17), (-0.0 + 62, 22)], [(50, 10), (0, 180), (-90, 0), (-75, 197)]),
    "date line": ([(-10, 170), (-10, -170), (10, -170), (10, 170)], [(0, 180), (5, 175), (-3, -172)], [(0, 0), (0, 165), (20, 180), (5, -5)]),
    "most of the sphere": ([(60, -k) for k in range(0, 360, 45)], [(0, 0), (-90, 0), (30, 200)], [(90, 0), (80, 100)]),
    "concave": ([(0, 0), (0, 30), (20, 30), (20, 20), (8, 20), (8, 10), (20, 10), (20, 0)], [(4, 15), (15, 5), (15, 25)], [(15, 15), (25, 15), (-2, 15)]),
    "south": ([(-80, -k) for k in range(0, 360, 60)], [(-90, 0), (-85, 20)], [(-70, 0), (90, 0)]),
}


@pytest.mark.parametrize("name", RINGS)
def test_points_in_rings_of_any_place_and_size(spark, name):
    ring, inside, outside = RINGS[name]
    rows = [(unit(*p), [unit(*v) for v in ring[k:] + ring[:k]], p in inside) for p in inside + outside for k in range(len(ring))]
    table = spark.createDataFrame(rows, f"p {XYZ}, ring array<{XYZ}>, want boolean")
    assert table.where(partition.in_spherical_ring(F.col("p"), F.col("ring")) != F.col("want")).count() == 0
    assert table.select(partition.in_spherical_ring(F.col("p"), F.slice("ring", 1, 2)).alias("x")).where("x").count() == 0


def square(lat, lon, half, hole=False):
    ring = [(lat - half, lon - half), (lat - half, lon + half), (lat + half, lon + half), (lat + half, lon - half)]
    return [unit(*v) for v in (ring[::-1] if hole else ring)]


def test_holes_go_to_their_smallest_outer_ring(spark):
    rings = [
        (1, 10, square(0, 0, 20)), (2, 10, square(0, 0, 12, True)), (3, 10, square(0, 0, 8)), (4, 10, square(0, 0, 4, True)),  # rings in rings
        (5, 10, square(0, 179, 9)), (6, 10, square(1, -178, 3, True)),  # over the date line
        (7, 20, square(40, 40, 5)), (8, 20, square(-40, 40, 3, True)),  # an orphan
        (9, 30, square(30, -60, 4, True)), (10, 30, square(30, -60, 2, True)),  # only holes: the largest is taken for the outer one
        (11, 40, [unit(70, k) for k in range(0, 360, 60)]), (12, 40, [unit(80, -k) for k in range(0, 360, 60)]),  # around the pole
    ]
    table = spark.createDataFrame(rings, f"face long, plate_id long, ring array<{XYZ}>").withColumn("area", space.spherical_ring_area(F.col("ring")))
    got = {r["face"]: (r["is_hole"], r["outer"], r["is_orphan"]) for r in partition.assign_rings(table).collect()}
    assert {f: (h, o) for f, (h, o, _) in got.items()} == {
        1: (False, 1), 2: (True, 1), 3: (False, 3), 4: (True, 3), 5: (False, 5), 6: (True, 5), 7: (False, 7), 8: (True, 7),
        9: (False, 9), 10: (True, 9), 11: (False, 11), 12: (True, 11),
    }
    assert {f for f, x in got.items() if x[2]} >= {8} and not {2, 4, 6, 12} & {f for f, x in got.items() if x[2]}
    assert partition.assign_rings(table.where("false")).count() == 0


def test_cells_of_many_sizes_lose_no_pair(spark):
    r = random.Random(8)
    boxes = [(k, x := r.uniform(-180, 170), y := r.uniform(-90, 80), x + (w := 10 ** r.uniform(-4, 2)), y + w * r.random()) for k in range(300)]
    points = [(k, r.uniform(-180, 180), r.uniform(-90, 90)) for k in range(400)] + [(1000 + k, b[1], b[4]) for k, b in enumerate(boxes)]
    things = cells.dealt(spark.createDataFrame(boxes, "id long, w double, s double, e double, n double"), [F.col("w"), F.col("s")], [F.col("e"), F.col("n")], 512.0)
    assert things.groupBy("id").count().where("count > 4").count() == 0
    at = cells.probes(spark.createDataFrame(points, "p long, x double, y double"), [F.col("x"), F.col("y")], 512.0, things)
    got = {(m["p"], m["id"]) for m in at.join(things, cells.keys(2)).where("x between w and e and y between s and n").collect()}
    assert got == {(p, b[0]) for p, x, y in points for b in boxes if b[1] <= x <= b[3] and b[2] <= y <= b[4]}


def test_faults_and_statuses(spark):
    ends = [(1, 0, 5), (1, 1, 6), (2, 0, 6), (2, 1, 5), (3, 0, 5), (3, 1, 9), (4, 0, 6), (4, 1, 6)]
    table = spark.createDataFrame(ends, "boundary_id long, place int, junction_id long").withColumn("level", F.lit(0))
    found = partition.faults(table, ("level",))
    assert {(r["kind"], r["id"]) for r in found.collect()} == {("open boundary", 3), ("open boundary", 4), ("non-manifold junction", 9)}
    plates = spark.createDataFrame([(1, True), (2, True), (3, False)], "plate_id long, active boolean")
    polygons = spark.createDataFrame([(1, 0), (1, 0), (7, 1)], "plate_id long, level int")
    rows = {r["level"]: r for r in partition.statuses(polygons, plates, found.unionByName(found.withColumn("level", F.lit(1))), "level").collect()}
    assert (rows[0]["n_missing"], rows[0]["strict"], rows[0]["lenient"]) == (1, "error", "warning") and (rows[1]["n_missing"], rows[1]["lenient"]) == (2, "error")


def test_the_outside_face_is_chosen_before_faulty_faces_go(spark):
    """Two squares side by side and a dangling boundary outside: the outside face has several plates and leaves, the squares stay."""
    at = {0: (0, 0), 1: (0, 10), 2: (0, 20), 3: (10, 0), 4: (10, 10), 5: (10, 20), 6: (-5, 0)}
    lines = [(0, 0, 1, 7, 0), (1, 1, 2, 8, 0), (2, 0, 3, 0, 7), (3, 1, 4, 7, 8), (4, 2, 5, 8, 0), (5, 3, 4, 0, 7), (6, 4, 5, 0, 8), (7, 6, 0, 3, 4)]
    angle = {0: 0.0, 1: 0.0, 2: math.pi / 2, 3: math.pi / 2, 4: math.pi / 2, 5: 0.0, 6: 0.0, 7: math.pi / 2}
    b = spark.createDataFrame(lines, "boundary_id long, start long, end long, plate_left long, plate_right long")
    angles = spark.createDataFrame([(k, p, a - math.pi * p) for k, a in angle.items() for p in (0, 1)], "boundary_id long, place int, angle double")
    fixed = b.withColumns({"plate_left": F.when(F.col("boundary_id") == 3, 7).otherwise(F.col("plate_left")), "plate_right": F.col("plate_right")})
    positions = spark.createDataFrame([(k, unit(*v)) for k, v in at.items()], f"junction_id long, position {XYZ}")
    got = topology.polygonize(topology.darts(b.select("boundary_id", "start", "end"), angles), positions, fixed)
    assert {r["plate_id"] for r in got.collect()} == {7, 8}


def test_islands_lie_inside_cells_that_are_lower_than_their_sides_bulge(spark, tmp_path, monkeypatch):
    """With 900,000 customers, 60 times those of sf0.1, a cell is 0.005 degrees high, and its sides bulge by up to 0.004."""
    spark.range(900_000).withColumnRenamed("id", "c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    monkeypatch.setattr(plate_queries, "cut", lambda df: df)  # only positions are asked for
    m = plate_queries._island_map(spark, str(tmp_path))
    cells_ = [40 * j + 10 for j in range(250, 22_500, 1500)]
    corners = {k: ([k, k + 1, k + 41, k + 40], *([1_000_000_000 + 8 * k + first + s for s in range(4)] for first in (0, 4))) for k in cells_}
    wanted = [v for rings in corners.values() for ring in rings for v in ring]
    at = {r["junction_id"]: r["position"] for r in m["positions"].where(F.col("junction_id").isin(wanted)).collect()}
    pairs = [(k, n, at[v], [at[w] for w in around]) for k, rings in corners.items() for n, (around, ring) in enumerate(zip(rings, rings[1:])) for v in ring]
    found = spark.createDataFrame(pairs, f"k long, island int, p {XYZ}, ring array<{XYZ}>").where(~partition.in_spherical_ring(F.col("p"), F.col("ring"))).select("k", "island").distinct()
    assert found.collect() == []
