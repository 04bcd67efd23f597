"""Nearest boundaries where an arc lies nearer to a pole than both of its ends."""

import pytest

from orogen.operators import spatial

ARCS = "boundary_id long, lon0 double, lat0 double, lon1 double, lat1 double"


@pytest.mark.parametrize("side", [1, -1])
def test_an_arc_is_found_from_beyond_the_latitudes_of_its_ends(spark, side):
    """The arc rises from 60 to 66.1 degrees; a second boundary is farther, but its ends are near."""
    arcs = spark.createDataFrame([(1, -40.0, 60.0 * side, 40.0, 60.0 * side), (2, 0.0, 75.4 * side, 1.0, 75.5 * side)], ARCS)
    points = spark.createDataFrame([(7, 0.0, 70.5 * side)], "point_id long, lon double, lat double")
    (found,) = spatial.nearest_boundary(points, arcs).collect()
    assert found["boundary_id"] == 1 and found["degrees"] == pytest.approx(4.362, abs=0.01)
