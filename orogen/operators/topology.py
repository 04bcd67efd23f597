"""Plates, boundaries and junctions as tables: adjacency, incidence, diagnostics, half-edges, faces and polygons.

Columns: plates(plate_id, active); boundaries(boundary_id, plate_left, plate_right, boundary_type, is_retired);
ends(boundary_id, junction_id, place) with place 0 at a boundary's start and 1 at its end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import space
from ..tables import cut
from . import partition


def adjacency_edges(boundaries: DataFrame, plates: DataFrame) -> DataFrame:
    """Each active boundary between two active plates. The planner broadcasts the plates where they are small."""
    alive = plates.where("active").select("plate_id")
    b = boundaries.where("not is_retired")
    side = lambda c: alive.withColumnRenamed("plate_id", c)
    return b.join(side("plate_left"), "plate_left", "left_semi").join(side("plate_right"), "plate_right", "left_semi")


def neighbours(edges: DataFrame) -> DataFrame:
    """plate_id, neighbour, boundary_id, boundary_type in both directions."""
    one = edges.select(F.col("plate_left").alias("plate_id"), F.col("plate_right").alias("neighbour"), "boundary_id", "boundary_type")
    two = edges.select(F.col("plate_right").alias("plate_id"), F.col("plate_left").alias("neighbour"), "boundary_id", "boundary_type")
    return one.unionByName(two)


def plate_adjacency(edges: DataFrame) -> DataFrame:
    """Each pair of neighbours once for each direction, with its boundaries counted by type; isolated plates are left out.

    The ordered list of one plate is this table sorted by (neighbour); plates of any number of boundaries stay rows.
    """
    return neighbours(edges).groupBy("plate_id", "neighbour", "boundary_type").agg(F.count(F.lit(1)).alias("n_boundaries"), F.min("boundary_id").alias("first_boundary"))


def junction_incidents(junctions: DataFrame, boundaries: DataFrame) -> DataFrame:
    """One row for each existing active boundary at each junction (columns junction_id, boundary_ids)."""
    rows = junctions.select("junction_id", F.explode("boundary_ids").alias("boundary_id")).distinct()
    return rows.join(boundaries.where("not is_retired"), "boundary_id")


def junction_class(letters: Column) -> Column:
    """R, F, T classes of a triple from its sorted letters; two ridges and a transform (FRR) keep their own label."""
    label = F.create_map(*(F.lit(x) for pair in {"RRR": "RRR", "FRR": "RRF", "FFR": "RFF", "RRT": "RRT", "RTT": "RTT", "FRT": "RFT", "FFF": "FFF", "FFT": "FFT", "FTT": "FTT", "TTT": "TTT"}.items() for x in pair))
    return F.element_at(label, letters)


def junction_set(incidents: DataFrame) -> DataFrame:
    """Per junction: degree, distinct plates in order, whether it is a triple, and the triple's class."""
    letter = F.when(F.col("boundary_type") == "Divergent", "R").when(F.col("boundary_type") == "Transform", "F").otherwise("T")
    plates = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("plate_left", "plate_right"))))).alias("plates")
    rows = incidents.groupBy("junction_id").agg(F.count(F.lit(1)).alias("degree"), plates, F.array_join(F.array_sort(F.collect_list(letter)), "").alias("_letters"))
    triple = F.size("plates") == 3
    return rows.select("junction_id", "degree", "plates", triple.alias("is_triple"), F.when(F.col("degree") == 3, junction_class(F.col("_letters"))).alias("class"))


def diagnostics(incidents: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Open boundaries (not two junctions) and dangling junctions (one boundary), as rows (kind, id, n)."""
    per = boundaries.where("not is_retired").select("boundary_id").join(incidents.groupBy("boundary_id").agg(F.count(F.lit(1)).alias("n")), "boundary_id", "left")
    open_ = per.select(F.lit("open boundary").alias("kind"), F.col("boundary_id").alias("id"), F.coalesce("n", F.lit(0)).cast("long").alias("n")).where("n <> 2")
    loose = incidents.groupBy("junction_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    return open_.unionByName(loose.select(F.lit("dangling junction").alias("kind"), F.col("junction_id").alias("id"), "n"))


def closure(triples: DataFrame, velocities: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """v_AB + v_BC + v_CA at junctions with three plates.

    triples(junction_id, plates, position); velocities(plate_a, plate_b, junction_id, v): measured pair
    velocities. Differences of plate velocities close by themselves; then this is a numeric self-check.
    """
    pairs = triples.where(F.size("plates") == 3).select("junction_id", F.posexplode("plates").alias("k", "plate_a"), "plates")
    pairs = pairs.withColumn("plate_b", F.element_at("plates", ((F.col("k") + 1) % 3 + 1).cast("int")))
    v = pairs.join(velocities, ["junction_id", "plate_a", "plate_b"])
    sums = v.groupBy("junction_id").agg(*(F.sum(f"v.{c}").alias(c) for c in "xyz"), F.count(F.lit(1)).alias("n"))
    size = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    return sums.where("n = 3").withColumn("residual", size).withColumn("is_closed", F.col("residual") < tolerance)


def missing_plates(plates: DataFrame, polygons: DataFrame) -> DataFrame:
    return plates.where("active").select("plate_id").join(polygons.select("plate_id"), "plate_id", "left_anti")


def match_ends(incidents: DataFrame, positions: DataFrame, first_vertex: DataFrame) -> DataFrame:
    """start and end junction of boundaries with exactly two; the nearer one to the first vertex is the start."""
    rows = incidents.select("boundary_id", "junction_id").join(positions.select("junction_id", "position"), "junction_id").join(first_vertex.select("boundary_id", "first"), "boundary_id")
    off = space.great_circle_angle(F.col("position"), F.col("first"))
    ends = rows.groupBy("boundary_id").agg(F.min(F.struct(off.alias("d"), "junction_id")).alias("s"), F.max(F.struct(off.alias("d"), "junction_id")).alias("e"), F.count(F.lit(1)).alias("n"))
    return ends.where("n = 2").select("boundary_id", F.col("s.junction_id").alias("start"), F.col("e.junction_id").alias("end"))


def darts(boundary_ends: DataFrame, angles: DataFrame) -> DataFrame:
    """dart, boundary_id, origin, target, twin, next.

    boundary_ends(boundary_id, start, end), angles(boundary_id, place, angle): the direction of the boundary
    in the tangent plane of its start (place 0) or end (place 1). Darts are 2b and 2b + 1. The next of a dart
    is the successor of its twin in clockwise order around the dart's target, so that a face lies left of its darts.
    """
    d = boundary_ends.select("boundary_id", F.explode(F.array(F.struct(F.lit(0).alias("place"), F.col("start").alias("origin"), F.col("end").alias("target")), F.struct(F.lit(1).alias("place"), F.col("end").alias("origin"), F.col("start").alias("target")))).alias("d")).select("boundary_id", "d.*")
    d = d.withColumn("dart", F.col("boundary_id") * 2 + F.col("place")).withColumn("twin", F.col("boundary_id") * 2 + 1 - F.col("place"))
    ranked = d.join(angles, ["boundary_id", "place"]).withColumn("_a", F.round(F.col("angle") / 1e-12))
    w = Window.partitionBy("origin").orderBy(F.desc("_a"), "boundary_id", "place")
    around = ranked.select("dart", F.coalesce(F.lead("dart").over(w), F.first("dart").over(w)).alias("after"))
    return d.join(around.select(F.col("dart").alias("twin"), F.col("after").alias("next")), "twin").select("dart", "boundary_id", "origin", "target", "twin", "next")


def walk_faces(darts_: DataFrame) -> DataFrame:
    """dart, face (the least dart of its cycle), position (steps from it), n (darts of the cycle).

    Pointer doubling: each dart knows the least one of the `width` darts from it on, how many steps on that one is met
    first and last and, once it is met twice, the cycle's length. A width of two lengths shows this to all darts of a
    cycle, which then leave: short cycles after few rounds, the longest after log2 of twice its length. Darts that are on
    no cycle have no row.
    """
    zero = F.lit(0).cast("long")
    state = cut(darts_.select("dart", F.col("next").alias("to"), F.col("dart").alias("face"), zero.alias("first"), zero.alias("last"), F.lit(None).cast("long").alias("n")))
    total, width, found = state.count(), 1, []
    while True:
        other = state.select(F.col("dart").alias("to"), *(F.col(c).alias(f"{c}2") for c in ("to", "face", "first", "last", "n")))
        theirs, same = F.col("face2") < F.col("face"), F.col("face2") == F.col("face")
        state = cut(state.join(other, "to").select(
            "dart", F.col("to2").alias("to"), F.least("face", "face2").alias("face"),
            F.when(theirs, F.col("first2") + width).otherwise(F.col("first")).alias("first"),
            F.when(theirs | same, F.col("last2") + width).otherwise(F.col("last")).alias("last"),
            F.when(theirs, F.col("n2")).when(same, F.least("n", "n2", F.col("first2") + width - F.col("last"))).otherwise(F.col("n")).alias("n"),
        ))
        width *= 2
        ready = F.coalesce(F.col("n") * 2 <= width, F.lit(False))
        n_ready, n_rows = state.agg(F.count_if(ready), F.count(F.lit(1))).first()
        if n_ready or not found:
            found.append(state.where(ready))
        if n_ready == n_rows or width >= 2 * total:
            break
        state = state.where(~ready)
    return reduce(DataFrame.unionByName, found).select("dart", "face", ((F.col("n") - F.col("first")) % F.col("n")).alias("position"), "n")


def polygonize(darts_: DataFrame, positions: DataFrame, boundaries: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """face, plate_id, ring (open, of unit points), area, is_outer, outer, is_orphan: faces whose darts agree on the plate, but for the outside face.

    A dart has its boundary's left plate when it runs forward, the right one backward. The outside face is the
    one with the greatest absolute area, the first on ties. Holes name the outer ring that they lie in
    (partition.assign_rings). Boundaries without a plate on a side leave no polygon there. Several maps at once, with
    boundary and junction ids of their own, are told apart by the boundaries' columns `also`.
    """
    faces = walk_faces(darts_).join(darts_.select("dart", "boundary_id", "origin"), "dart").join(positions.select(F.col("junction_id").alias("origin"), "position").withColumnRenamed("position", "xyz"), "origin")
    side = F.when(F.col("dart") % 2 == 0, F.col("plate_left")).otherwise(F.col("plate_right"))
    rows = faces.join(boundaries.select("boundary_id", "plate_left", "plate_right", *also), "boundary_id").withColumn("plate_id", side)
    agree = F.when(F.count("plate_id") == F.count(F.lit(1)), F.min("plate_id") == F.max("plate_id"))
    rings = rows.groupBy("face", *also).agg(F.min("plate_id").alias("plate_id"), agree.alias("_agree"), F.transform(F.array_sort(F.collect_list(F.struct("position", "xyz"))), lambda x: x["xyz"]).alias("ring"))
    rings = cut(rings.withColumn("area", space.spherical_ring_area(F.col("ring"))))
    own = rings.join(outside_face(rings, also), ["face", *also], "left_anti").where("_agree").drop("_agree")
    found = partition.assign_rings(own, also)
    return own.join(found.select("face", *also, (~F.col("is_hole")).alias("is_outer"), "outer", "is_orphan"), ["face", *also])


def outside_face(rings: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each map): the face with the greatest absolute area, the least id on ties."""
    return rings.groupBy(*also).agg(F.max(F.struct(F.abs("area").alias("a"), (-F.col("face")).alias("f"))).alias("m")).select((-F.col("m.f")).alias("face"), *also)


def quality(polygons: DataFrame, sliver: float) -> DataFrame:
    """Min, max, population variance of areas, slivers, holes and faces."""
    a = F.abs("area")
    return polygons.agg(F.min(a).alias("min_area"), F.max(a).alias("max_area"), F.var_pop(a).alias("area_variance"), F.count_if(a < sliver).alias("n_slivers"), F.count_if(~F.col("is_outer")).alias("n_holes"), F.count(F.lit(1)).alias("n_faces"))


def coverage(polygons: DataFrame, plates: DataFrame, off: float) -> DataFrame:
    """Total area against the sphere's, polygons without area, plates without polygon."""
    lost = missing_plates(plates, polygons).agg(F.count(F.lit(1)).alias("n_missing"))
    total = polygons.agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("area"), F.count_if(F.abs("area") < 1e-15).alias("n_empty"))
    return total.join(F.broadcast(lost)).withColumn("covers", F.abs(F.col("area") - 4 * F.pi()) < off)  # two tables of one row


def partition_status(polygons: DataFrame, plates: DataFrame, faults: DataFrame, policy: str = "strict") -> DataFrame:
    """One row: status and counts. Strict: any diagnostic or missing plate is an error; lenient: an error only without any plate."""
    lost = missing_plates(plates, polygons).agg(F.count(F.lit(1)).alias("n_missing"))
    bad = faults.agg(F.count(F.lit(1)).alias("n_faults"))
    got = polygons.agg(F.countDistinct("plate_id").alias("n_plates"), F.sum("area").alias("area"))
    row = got.join(F.broadcast(lost)).join(F.broadcast(bad))  # tables of one row
    wrong = (F.col("n_missing") > 0) | (F.col("n_faults") > 0)
    error = wrong if policy == "strict" else F.col("n_plates") == 0
    return row.withColumn("status", F.when(error, "error").when(wrong, "warning").otherwise("ok"))
