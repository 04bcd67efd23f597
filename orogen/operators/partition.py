"""The partition of the sphere into plates: ends snapped with a tolerance, holes in their outer rings, pieces, and policies.

ends(boundary_id, place, position, and the columns `also`): place 0 at a boundary's start and 1 at its end, positions
unit vectors. Several maps at once, such as those of several tolerances or ticks, are told apart by the columns `also`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import space
from ..tables import cut
from . import cells
from .components import components

# Tolerance without boundaries, least and greatest tolerance, and factors of the mean segment for maps with
# more than so many segments a boundary.
NORMAL, LEAST, MOST = 1e-9, 1e-12, 1e-6
FACTORS = [(50.0, 1e-4), (20.0, 5e-4), (10.0, 1e-3), (5.0, 5e-3), (2.0, 1e-2), (0.0, 2e-2)]


def density_epsilon(lines: DataFrame) -> DataFrame:
    """mean_chord, density, epsilon (one row) of lines(boundary_id, line): the mean chord by a factor of segments for each boundary.

    All boundaries count, also those without a segment; without any segment the tolerance is the normal one.
    """
    chords = F.transform(F.slice("line", 2, F.greatest(F.size("line") - 1, F.lit(0))), lambda q, k: space.norm(space.vec_sub(q, F.get("line", k))))
    per = lines.select(F.coalesce(F.when(F.size("line") > 1, F.aggregate(chords, F.lit(0.0), lambda s, x: s + x)), F.lit(0.0)).alias("length"), F.greatest(F.coalesce(F.size("line"), F.lit(0)) - 1, F.lit(0)).alias("n"))
    s = per.agg(F.sum("length").alias("length"), F.coalesce(F.sum("n"), F.lit(0)).alias("segments"), F.count(F.lit(1)).alias("boundaries"))
    s = s.withColumns({"mean_chord": F.when(F.col("segments") > 0, F.col("length") / F.col("segments")), "density": F.when(F.col("boundaries") > 0, F.col("segments") / F.col("boundaries"))})
    factor = reduce(lambda c, f: c.when(F.col("density") > f[0], f[1]), FACTORS[1:-1], F.when(F.col("density") > FACTORS[0][0], FACTORS[0][1])).otherwise(FACTORS[-1][1])
    return s.select("mean_chord", "density", F.when(F.col("mean_chord").isNull(), NORMAL).otherwise(space.clamp(F.col("mean_chord") * factor, LEAST, MOST)).alias("epsilon"))


def tolerances(epsilon: float) -> list[float]:
    """A tolerance and those that are tried after it: ten and a hundred times as much, and the greatest."""
    return [min(e, MOST) for e in (epsilon, 10 * epsilon, 100 * epsilon, MOST)]


def snap_ends(ends: DataFrame, epsilon: Column, also: tuple[str, ...] = ()) -> DataFrame:
    """boundary_id, place, junction_id, position (and `also`): ends within the tolerance of each other, or of ends between, are one junction.

    epsilon: a number or a column of the ends, one for each map. Equal positions are one spot before any two are
    compared. Spots meet in the cells that they reach, and linked spots are joined by components, all maps in one pass.
    A junction has the id and the position of its least end.
    """
    own = ends.select("boundary_id", "place", "position", epsilon.alias("_eps"), *also).withColumn("_end", F.col("boundary_id") * 2 + F.col("place"))
    xyz = [F.col("position")[c] + 0.0 for c in "xyz"]  # -0.0 and 0.0 are one place
    own = own.withColumns({f"_{c}": x for c, x in zip("xyz", xyz)})
    by = ["_x", "_y", "_z", *also]
    spots = cut(own.groupBy(*by).agg(F.min("_end").alias("spot"), F.first("_eps").alias("_eps")))
    found = components(_links(spots, also), by=also).select(*also, F.col("node").alias("spot"), F.col("label").alias("_label"))
    joined = spots.drop("_eps").join(found, [*also, "spot"], "left").withColumn("junction_id", F.coalesce("_label", "spot"))
    place = joined.where("spot = junction_id").select(*also, "junction_id", F.struct(*(F.col(f"_{c}").alias(c) for c in "xyz")).alias("_at"))
    placed = joined.join(place, [*also, "junction_id"]).select(*by, "junction_id", "_at")
    return own.join(placed, by).select("boundary_id", "place", "junction_id", F.col("_at").alias("position"), *also)


#: The side of a spot's cells, in tolerances.
SIDE = 4


def reached(spots: DataFrame) -> DataFrame:
    """The spots (_x, _y, _z, _eps) once for each cell that their box from themselves to one tolerance further along each axis reaches.

    Of two spots within the tolerance both reach the cell of their greater coordinates. Cells are SIDE tolerances wide,
    so a spot is in (1 + 1 / SIDE)^3 cells on average, and in 8 at most. Boxes are a little larger, against rounding.
    """
    side, reach = F.col("_eps") * SIDE, F.col("_eps") * 1.001 + 1e-15
    cell = lambda x: F.floor(x / side).cast("long")
    rows = spots.where("_eps > 0")
    for c in "xyz":
        rows = rows.withColumn(f"_i{c}", F.explode(F.sequence(cell(F.col(f"_{c}")), cell(F.col(f"_{c}") + reach))))
    return rows


def _links(spots: DataFrame, also: tuple[str, ...]) -> DataFrame:
    """a, b (and `also`): spots of one map within its tolerance, a > b."""
    celled = reached(spots)
    keys = [*also, "_ix", "_iy", "_iz"]
    near = celled.select(*keys, F.col("spot").alias("a"), *(F.col(f"_{c}").alias(f"_a{c}") for c in "xyz"))
    off = reduce(lambda x, y: x + y, ((F.col(f"_a{c}") - F.col(f"_{c}")) ** 2 for c in "xyz"))
    return near.join(celled, keys).where((F.col("a") > F.col("spot")) & (off <= F.col("_eps") ** 2)).select(*also, "a", F.col("spot").alias("b"))


def faults(snapped: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """kind, id (and `also`): open boundaries, with an end alone at its junction, and junctions with one end.

    A boundary whose ends have become one junction is open as well: it joins one junction, not two.
    """
    degree = snapped.groupBy(*also, "junction_id").agg(F.count(F.lit(1)).alias("_n"))
    ends = snapped.join(degree, [*also, "junction_id"])
    open_ = ends.groupBy(*also, "boundary_id").agg(F.min("_n").alias("_least"), F.countDistinct("junction_id").alias("_two")).where("_least = 1 or _two < 2")
    loose = degree.where("_n = 1")
    return open_.select(F.lit("open boundary").alias("kind"), F.col("boundary_id").alias("id"), *also).unionByName(loose.select(F.lit("non-manifold junction").alias("kind"), F.col("junction_id").alias("id"), *also))


def pieces(snapped: DataFrame, faces: DataFrame) -> DataFrame:
    """piece (its least junction), n_junctions, n_boundaries, n_faces and V - E + F, which is 2 for a piece drawn on a sphere.

    faces(face, junction_id): the junctions that each face runs through.
    """
    two = snapped.groupBy("boundary_id").agg(F.min("junction_id").alias("a"), F.max("junction_id").alias("b"))
    label = cut(components(two.select("a", "b")))
    at = snapped.select("boundary_id", "junction_id").join(label.select(F.col("node").alias("junction_id"), "label"), "junction_id", "left").withColumn("piece", F.coalesce("label", "junction_id"))
    size = at.groupBy("piece").agg(F.countDistinct("junction_id").alias("n_junctions"), F.countDistinct("boundary_id").alias("n_boundaries"))
    around = faces.join(at.select("junction_id", "piece").distinct(), "junction_id").groupBy("piece").agg(F.countDistinct("face").alias("n_faces"))
    return size.join(around, "piece").withColumn("euler", F.col("n_junctions") - F.col("n_boundaries") + F.col("n_faces"))


def in_spherical_ring(p: Column, ring: Column) -> Column:
    """Whether a unit point lies left of an open ring of unit points, on a sphere: of any size, over poles and the date line.

    The arc from the point to a place on the ring's first edge arrives there from the left or from the right; each of the
    other edges that it crosses changes the side. On the ring itself the answer is either.
    """
    first, second = F.get(ring, 0), F.get(ring, 1)
    goal = space.normalize(space.vec_add(space.vec_scale(first, F.lit(0.61)), space.vec_scale(second, F.lit(0.39))))  # no place of symmetry
    ends = F.slice(ring, 2, F.size(ring) - 1)
    rest = F.zip_with(ends, F.concat(F.slice(ends, 2, F.size(ring)), F.array(first)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def body(at: Column) -> Column:
        crossed = F.size(F.filter(rest, lambda e: _cross(p, at, e["a"], e["b"])))
        left = space.dot(space.cross(first, second), p) > 0
        return left != (crossed % 2 == 1)

    return F.coalesce(F.when(F.size(ring) >= 3, space.let(goal, body)), F.lit(False))


def _cross(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether the arcs ab and cd, each shorter than half way round, cross."""
    ab, cd = space.cross(a, b), space.cross(c, d)
    acb, bda, cbd, dac = -space.dot(ab, c), space.dot(ab, d), -space.dot(cd, b), space.dot(cd, a)
    return (acb * bda > 0) & (acb * cbd > 0) & (acb * dac > 0)


def assign_rings(rings: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """face, plate_id, is_hole, outer, is_orphan (and `also`) of rings(face, plate_id, ring, area).

    Rings of positive area are outer ones, others holes. A hole belongs to the smallest outer ring of its plate that has
    the hole's first vertex inside, whatever else lies between; one that none has is an orphan and goes to the plate's
    largest outer ring. A plate that has only holes has the largest of these as its outer ring. Ties go to the least face.

    Outer rings are dealt to cells of their size around them, holes look into one cell of each size.
    """
    by = [*also, "plate_id"]
    best = rings.groupBy(*by).agg(F.max(F.struct((F.col("area") > 0).alias("o"), F.abs("area").alias("a"), (-F.col("face")).alias("f"))).alias("_m")).withColumn("_largest", -F.col("_m.f")).drop("_m")
    rows = cut(rings.join(best, by).withColumn("is_hole", (F.col("area") <= 0) & (F.col("face") != F.col("_largest"))).select("face", "plate_id", "ring", "area", "is_hole", "_largest", *also))
    mean = space.vec(*(space.ring_mean(F.col("ring"), c) for c in "xyz"))
    outers = rows.where("not is_hole").withColumn("_c", space.normalize(mean))
    outers = outers.withColumn("_r", F.array_max(F.transform("ring", lambda v: space.great_circle_angle(F.col("_c"), v))))
    # A ring around half of the sphere or more may hold anything.
    small = (F.col("area") < 6.0) & (F.col("_r") < 1.5) & (F.col("area") > 0)
    reach = F.when(small, 2 * F.sin(F.col("_r") / 2) + 1e-12).otherwise(F.lit(2.0))
    centre = {c: F.when(small, F.col("_c")[c]).otherwise(F.lit(0.0)) for c in "xyz"}
    dealt = cut(cells.dealt(outers, [centre[c] - reach for c in "xyz"], [centre[c] + reach for c in "xyz"], 4.0).select("face", "ring", "area", *by, *cells.keys(3)))
    first = F.get("ring", 0)
    holes = cells.probes(rows.where("is_hole").select(F.col("face").alias("hole"), first.alias("_p"), *by), [F.col("_p")[c] for c in "xyz"], 4.0, dealt)
    met = holes.join(dealt, [*by, *cells.keys(3)]).where(in_spherical_ring(F.col("_p"), F.col("ring")))
    home = met.groupBy(*also, "hole").agg(F.min(F.struct(F.abs("area").alias("a"), "face")).alias("_m")).select(*also, F.col("hole").alias("face"), F.col("_m.face").alias("_home"))
    out = rows.join(home, [*also, "face"], "left")
    orphan = F.col("is_hole") & F.col("_home").isNull()
    outer = F.when(F.col("is_hole"), F.coalesce("_home", "_largest")).otherwise(F.col("face"))
    return out.select("face", "plate_id", "is_hole", outer.alias("outer"), orphan.alias("is_orphan"), *also)


def statuses(polygons: DataFrame, plates: DataFrame, faults_: DataFrame, also: str) -> DataFrame:
    """One row for each map: counts, and its status under the strict and the lenient policy.

    Strict: any fault or plate without a polygon is an error. Lenient: only if no plate has one; else a warning.
    The maps are those of the faults and polygons; plates are the same for all.
    """
    wanted = plates.where("active").select("plate_id")
    total = wanted.agg(F.count(F.lit(1)).alias("n_plates"))
    got = polygons.join(wanted, "plate_id", "left_semi").groupBy(also).agg(F.countDistinct("plate_id").alias("_got"))
    bad = faults_.groupBy(also).agg(F.count_if(F.col("kind") == "open boundary").alias("n_open"), F.count_if(F.col("kind") != "open boundary").alias("n_non_manifold"))
    rows = got.join(bad, also, "full").join(F.broadcast(total))  # one row
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("_got", "n_open", "n_non_manifold")}
    rows = rows.withColumns(zero).withColumn("n_missing", F.col("n_plates") - F.col("_got"))
    wrong = (F.col("n_missing") > 0) | (F.col("n_open") > 0) | (F.col("n_non_manifold") > 0)
    lenient = F.when((F.col("_got") == 0) & (F.col("n_plates") > 0), "error").when(wrong, "warning").otherwise("ok")
    return rows.select(also, "n_plates", "n_missing", "n_open", "n_non_manifold", F.when(wrong, "error").otherwise("ok").alias("strict"), lenient.alias("lenient"))
