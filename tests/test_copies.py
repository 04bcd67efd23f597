"""Joins in space meet points at one place and rings or lines of one shape once, however many copies there are."""

import pytest

from orogen.operators import spatial

SQUARE = [(0.0, 0.0), (6.0, 0.0), (6.0, 4.0), (0.0, 4.0)]


@pytest.fixture()
def met(monkeypatch):
    """Numbers of pairs that the joins of points and rings found."""
    seen, own = [], spatial.candidates

    def counted(*args):
        pairs = own(*args)
        seen.append(pairs.count())
        return pairs

    monkeypatch.setattr(spatial, "candidates", counted)
    return seen


def _rings(spark, n):
    """n copies of a ring of plate 3, one of plate 5, and plate 1's with a hole of the same shape."""
    rows = [(3, k, False, SQUARE) for k in range(n)] + [(5, n, False, SQUARE), (1, n + 1, False, SQUARE), (1, n + 2, True, SQUARE)]
    return spark.createDataFrame(rows, "plate_id long, ring_id long, is_hole boolean, ring array<struct<x: double, y: double>>")


def _points(spark, n):
    rows = [(k, 1.0, 1.0, None) for k in range(n)] + [(n, 9.0, 1.0, None), (n + 1, 1.0, 1.0, 7), (n + 2, None, 1.0, None), (n + 3, 0.0, 0.0, None)]
    return spark.createDataFrame(rows, "point_id long, lon double, lat double, plate_id long")


def test_copies_of_lines_are_measured_once(spark, monkeypatch):
    seen, own = [], spatial.within_reach

    def counted(points, lines, reach):
        seen.append((points.count(), lines.count()))
        return own(points, lines, reach)

    monkeypatch.setattr(spatial, "within_reach", counted)
    lines = spark.createDataFrame([(k, 0.0, 0.0, 4.0, 0.0) for k in range(9, 49)] + [(3, 0.0, 3.0, 4.0, 3.0)], "boundary_id long, lon0 double, lat0 double, lon1 double, lat1 double")
    points = spark.createDataFrame([(k, 1.0, 1.0) for k in range(50)] + [(50, 1.0, 2.5), (51, None, 1.0)], "point_id long, lon double, lat double")
    found = {r["point_id"]: (r["boundary_id"], round(r["degrees"], 6)) for r in spatial.nearest_boundary(points, lines).collect()}
    assert {k: found[k] for k in range(50)} == {k: (9, 1.0) for k in range(50)} and found[50][0] == 3 and 51 not in found
    assert seen[0] == (3, 2)


def test_copies_are_assigned_once(spark, met):
    found = {r["point_id"]: r["plate_id"] for r in spatial.assign_plate(_points(spark, 50), _rings(spark, 40)).collect()}
    assert found == {**{k: 3 for k in range(50)}, 50: None, 51: 7, 52: None, 53: 3}
    assert met == [8]


def test_copies_of_holes_meet_outers_of_one_shape_once(spark, met):
    ring = "ring_id long, ring array<struct<x: double, y: double>>"
    small = [(x / 2 + 1, y / 2 + 1) for x, y in SQUARE]
    outers = spark.createDataFrame([(k, SQUARE) for k in range(9, 49)], ring)
    holes = spark.createDataFrame([(k, small) for k in range(100, 150)] + [(7, [(x + 90, y) for x, y in small])], ring)
    found = {r["hole"]: r["outer"] for r in spatial.assign_holes(outers, holes).collect()}
    assert found == {**{k: 9 for k in range(100, 150)}, 7: None}
    assert met == [1]


def test_copies_are_queried_once(spark, met):
    rows = {r["point_id"]: (r["plate"], r["n_candidates"], r["confidence"]) for r in spatial.plate_query(_points(spark, 50), _rings(spark, 40)).collect()}
    assert rows == {**{k: (3, 2, "Uncertain") for k in (*range(50), 51)}, 50: (None, 0, "Unassigned"), 52: (None, 0, "Unassigned"), 53: (3, 2, "Boundary")}
    assert met == [8]
