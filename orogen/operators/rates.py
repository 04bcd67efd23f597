"""Sampling along boundaries, velocities there, and summaries of rates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import space


def arc_lengths(vertices: DataFrame) -> DataFrame:
    """Running great-circle length at each vertex (boundary_id, pos, p)."""
    w = Window.partitionBy("boundary_id").orderBy("pos")
    step = F.coalesce(space.great_circle_angle(F.lag("p").over(w), F.col("p")), F.lit(0.0))
    return vertices.withColumn("_step", step).withColumn("arc", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def as_lines(rows: DataFrame) -> DataFrame:
    """Lines (boundary_id, line) as they are, vertices (boundary_id, pos, p) gathered into lines."""
    if "line" in rows.columns:
        return rows
    ordered = F.array_sort(F.collect_list(F.struct("pos", "p")))
    return rows.groupBy("boundary_id").agg(F.transform(ordered, lambda v: v["p"]).alias("line"))


def _legs(lines: DataFrame, length: Callable[[Column, Column], Column]) -> DataFrame:
    """The lines' columns but `line`, and pos, p, q, _length, _from, _to, _total of each leg; made line by line, nothing is shuffled."""
    before = lambda sums, i: F.coalesce(F.get(sums, i), F.lit(0.0))

    def own(line: Column) -> Column:
        pairs = F.transform(F.slice(line, 2, F.size(line) - 1), lambda q, k: F.struct(F.get(line, k).alias("p"), q.alias("q")))
        return F.transform(pairs, lambda v: F.struct(v.alias("at"), length(v["p"], v["q"]).alias("length")))

    def sums(legs: Column) -> Column:
        """Running sums in log2 of the legs rounds: round j adds the sum that ends 2^j places before."""
        rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(legs))).cast("int"))
        return F.aggregate(rounds, F.transform(legs, lambda v: v["length"]), lambda to, j: F.transform(to, lambda x, i: x + before(to, i - F.pow(F.lit(2.0), j).cast("int"))))

    def parts(v: Column) -> Column:
        return F.transform(v["legs"], lambda x, k: F.struct(
            x["at"]["p"].alias("p"), x["at"]["q"].alias("q"), x["length"].alias("_length"), before(v["to"], k - 1).alias("_from"), F.get(v["to"], k).alias("_to"), F.element_at(v["to"], -1).alias("_total")))

    # let: the line and what is made of it are worked out once, not anew at each use.
    made = space.let(F.col("line"), lambda line: space.let(own(line), lambda o: space.let(F.struct(o.alias("legs"), sums(o).alias("to")), parts)))
    keep = [c for c in lines.columns if c != "line"]
    return lines.where(F.size("line") > 1).select(*keep, F.posexplode(made).alias("pos", "_leg")).select(*keep, "pos", "_leg.*")


def sample_along(vertices: DataFrame, n: int) -> DataFrame:
    """boundary_id, sample, p, arc, tangent: n equally spaced points from the first vertex to the last (at i * length / (n - 1)).

    vertices(boundary_id, pos, p), or lines(boundary_id, line), which keep their other columns and are sampled where they
    lie. A sample at a vertex is on the leg before it. Lines without length have one sample.
    """
    lines = as_lines(vertices)
    legs = _legs(lines, space.great_circle_angle)
    # The samples that can fall on a leg, one more at each side; the condition below decides.
    step, within = F.col("_total") / (n - 1), F.col("_total") > 0
    low = F.when(within, F.greatest(F.floor(F.col("_from") / step) - 1, F.lit(0))).otherwise(F.lit(0))
    high = F.when(within, F.least(F.floor(F.col("_to") / step) + 1, F.lit(n - 1))).otherwise(F.lit(0))
    spread = legs.select("*", F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("sample")).withColumn("arc", F.col("sample") * F.col("_total") / (n - 1))
    begun = ((F.col("pos") == 0) & ((F.col("sample") == 0) | (F.col("arc") > 0))) | (F.col("arc") > F.col("_from") + 1e-15)
    on = spread.where(begun & ((F.col("arc") <= F.col("_to") + 1e-15) | (F.col("_to") == F.col("_total"))))
    t = F.when(F.col("_to") > F.col("_from"), (F.col("arc") - F.col("_from")) / (F.col("_to") - F.col("_from"))).otherwise(0.0)
    more = [c for c in lines.columns if c not in ("boundary_id", "line")]
    placed = on.withColumn("_t", t).withColumns(dict(zip(("_a", "_b"), space.slerp_weights(F.col("_length"), F.col("_t")))))
    tangent = space.normalize(space.vec_sub(F.col("q"), F.col("p"))).alias("tangent")
    return placed.select("boundary_id", *more, "sample", space.weighted(F.col("p"), F.col("_a"), F.col("q"), F.col("_b")).alias("p"), "arc", tangent)


def samples_by_mode(vertices: DataFrame, mode: str = "arc", count: int | None = None, spacing: float | None = None, ends: bool = True) -> DataFrame:
    """boundary_id, sample, p, leg (the vertex before it) of lines of two or more vertices.

    vertices(boundary_id, pos, p), or lines(boundary_id, line), which are sampled where they lie.
    mode: "arc" and "chord" space samples equally by great-circle or straight length, and put them on the arc or on the
    chord; "vertices" takes the vertices. count: samples of each line; without it, `spacing` gives them: as many
    intervals as fit best, one at least. With `ends` both ends are samples; without (a buffer around junctions) all lie
    between them, and lines of two vertices keep both where the vertices are taken. Lines without length have one
    sample, their first vertex. A sample at a vertex is on the leg before it.
    """
    lines = as_lines(vertices)
    if mode == "vertices":
        spots = lines.select("boundary_id", (F.size("line") - 1).alias("_last"), F.posexplode("line").alias("pos", "p"))
        taken = spots if ends else spots.where("_last <= 1 or (pos > 0 and pos < _last)")
        first = F.lit(0) if ends else F.when(F.col("_last") > 1, 1).otherwise(0)
        return taken.select("boundary_id", (F.col("pos") - first).cast("int").alias("sample"), "p", F.greatest(F.least("pos", F.col("_last") - 1), F.lit(0)).cast("int").alias("leg"))
    legs = _legs(lines.select("boundary_id", "line"), space.great_circle_angle if mode == "arc" else lambda p, q: space.norm(space.vec_sub(q, p)))
    intervals = F.greatest(F.lit(1), F.bround(F.col("_total") / F.lit(spacing)).cast("int")) if count is None else None
    n = F.lit(max(2 if ends else 1, count)) if count is not None else intervals + 1 if ends else F.greatest(F.lit(1), intervals - 1)
    legs = legs.withColumn("_n", F.when(F.col("_total") > 0, n).otherwise(1))
    # Sample i lies at first + i * step; those that may fall on a leg, one more at each side, are tried.
    step = F.col("_total") / (F.col("_n") - 1 if ends else F.col("_n") + 1)
    legs = legs.withColumns({"_step": F.when((F.col("_total") > 0) & (F.col("_n") > 1 if ends else F.lit(True)), step).otherwise(1.0), "_first": F.lit(0.0)})
    legs = legs if ends else legs.withColumn("_first", F.when(F.col("_total") > 0, F.col("_step")).otherwise(0.0))
    at = lambda c, more: F.least(F.greatest(F.floor((F.col(c) - F.col("_first")) / F.col("_step")) + more, F.lit(0)), F.col("_n") - 1).cast("int")
    tried = legs.select("*", F.explode(F.sequence(at("_from", -1), at("_to", 1))).alias("sample")).withColumn("_s", F.least(F.col("_first") + F.col("sample") * F.col("_step"), F.col("_total")))
    begun = (F.col("pos") == 0) | (F.col("_s") > F.col("_from") + 1e-15)
    on = tried.where(begun & ((F.col("_s") <= F.col("_to") + 1e-15) | (F.col("_to") == F.col("_total"))))
    t = F.when(F.col("_length") > 0, space.clamp((F.col("_s") - F.col("_from")) / F.col("_length"), 0.0, 1.0)).otherwise(0.0)
    place = space.slerp(F.col("p"), F.col("q"), t) if mode == "arc" else space.vec_add(F.col("p"), space.vec_scale(space.vec_sub(F.col("q"), F.col("p")), t))
    return on.select("boundary_id", "sample", place.alias("p"), F.col("pos").cast("int").alias("leg"))


def sample_by_spacing(vertices: DataFrame, spacing: float) -> DataFrame:
    """boundary_id, sample, p: the first vertex, then a point every `spacing` along the chords; all vertices if it is 0.

    vertices(boundary_id, pos, p), or lines(boundary_id, line), which keep their other columns and are sampled where they
    lie. A point that falls on a vertex up to 1e-9 counts, so a line's end can be its last sample.
    """
    lines = as_lines(vertices)
    keep = [c for c in lines.columns if c != "line"]
    if spacing <= 0:
        return lines.select(*keep, F.posexplode("line").alias("sample", "p")).withColumn("sample", F.col("sample").cast("long"))
    legs = _legs(lines, lambda p, q: space.norm(space.vec_sub(q, p)))
    after = F.when(F.col("pos") == 0, F.lit(0)).otherwise(F.floor((F.col("_from") + 1e-9) / spacing) + 1)
    until = F.when((F.col("pos") == 0) | (F.col("_length") > 0), F.floor((F.col("_to") + 1e-9) / spacing)).otherwise(-1)
    on = legs.withColumns({"_after": after, "_until": until}).where("_until >= _after").select("*", F.explode(F.sequence("_after", "_until")).alias("sample"))
    t = F.when((F.col("sample") > 0) & (F.col("_length") > 0), (F.col("sample") * spacing - F.col("_from")) / F.col("_length")).otherwise(0.0)
    spots = on.withColumn("_t", t).select(*keep, "sample", space.vec_add(F.col("p"), space.vec_scale(space.vec_sub(F.col("q"), F.col("p")), F.col("_t"))).alias("p"))
    return spots.unionByName(lines.where(F.size("line") == 1).select(*keep, F.lit(0).cast("long").alias("sample"), F.get("line", F.lit(0)).alias("p")))


def boundary_omegas(boundaries: DataFrame, omegas: DataFrame) -> DataFrame:
    """Add omega_left and omega_right of rows with plate_left and plate_right. The planner broadcasts omegas where they are few."""
    side = lambda c, o: omegas.select(F.col("plate_id").alias(c), F.col("omega").alias(o))
    return boundaries.join(side("plate_left", "omega_left"), "plate_left").join(side("plate_right", "omega_right"), "plate_right")


def divergent(samples: DataFrame) -> DataFrame:
    return samples.where("normal_rate > 0")


def convergent(samples: DataFrame) -> DataFrame:
    return samples.where("normal_rate < 0")


def slipping(samples: DataFrame, off: float = 1e-12) -> DataFrame:
    return samples.where(F.abs("tangential_rate") > off)


def speed_statistics(samples: DataFrame, *by: str) -> DataFrame:
    """n, mean, least and greatest speed and population deviation of velocities v by group."""
    s = samples.withColumn("_s", space.norm(F.col("v")))
    return s.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_s").alias("mean_speed"), F.min("_s").alias("min_speed"), F.max("_s").alias("max_speed"), F.stddev_pop("_s").alias("deviation"))


def boundary_velocities(samples: DataFrame, boundaries: DataFrame | None, omegas: DataFrame) -> DataFrame:
    """v_right - v_left at the samples, with its parts along the tangent and the boundary's normal.

    boundaries(boundary_id, plate_left, plate_right), none if the samples have these columns; omegas(plate_id, omega) of
    one tick. Omegas of decimals are subtracted as such, so equal motions leave no rounding behind.
    """
    rows = boundary_omegas(samples if boundaries is None else samples.join(boundaries, "boundary_id"), omegas)
    rows = rows.withColumn("v", space.linear_velocity(space.vec_sub(F.col("omega_right"), F.col("omega_left")), F.col("p")))
    rows = rows.withColumn("normal", space.boundary_normal(F.col("p"), F.col("tangent"), F.col("plate_left"), F.col("plate_right")))
    # The rate along the normal is divided by its length last: a sum that is zero is not rounded away from it before.
    across = space.cross(F.col("p"), F.col("tangent"))
    long = space.norm(across)
    along = F.when(long > 0, F.when(F.col("plate_left") > F.col("plate_right"), -1.0).otherwise(1.0) * space.dot(F.col("v"), across) / long).otherwise(0.0)
    return rows.withColumn("tangential_rate", space.dot(F.col("v"), F.col("tangent"))).withColumn("normal_rate", along).drop("omega_left", "omega_right")


def velocity_profile(samples: DataFrame) -> DataFrame:
    """Extremes with the first sample that has them (rates that are equal to 1e-9 tie), and means."""
    least = F.min(F.struct(F.round("normal_rate", 9).alias("r"), "sample", "normal_rate")).alias("lo")
    most = F.min(F.struct((-F.round("normal_rate", 9)).alias("r"), "sample", (-F.col("normal_rate")).alias("m"))).alias("hi")
    s = samples.groupBy("boundary_id").agg(F.count(F.lit(1)).alias("n"), least, most, F.avg("normal_rate").alias("mean_normal"), F.avg(F.abs("tangential_rate")).alias("mean_slip"))
    return s.select("boundary_id", "n", F.col("lo.normal_rate").alias("min_normal"), (-F.col("hi.m")).alias("max_normal"), F.col("lo.sample").alias("min_sample"), F.col("hi.sample").alias("max_sample"), "mean_normal", "mean_slip")


#: Samples of a task that summarises whole boundaries.
ROWS = 1 << 20


def gathered(lines: DataFrame, n: int) -> DataFrame:
    """Lines dealt to as many tasks as their n samples each need, by boundary_id: summaries of their samples move none of them."""
    tasks = -(-lines.count() * n // ROWS)
    return lines.repartition(max(1, tasks), "boundary_id")


def rate_statistics(samples: DataFrame) -> DataFrame:
    speed = F.sqrt(F.col("normal_rate") ** 2 + F.col("tangential_rate") ** 2)
    return samples.groupBy("boundary_id").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("normal_rate", "tangential_rate") for f in (F.min, F.max, F.avg)), F.max(speed).alias("max_speed"), F.avg(speed).alias("mean_speed"))


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def spreading(samples: DataFrame) -> DataFrame:
    """Of the divergent samples of each boundary: half and full rate, asymmetry (slip over opening), obliquity in degrees, population deviation.

    All are 0 for a boundary without divergent samples.
    """
    opening = F.col("normal_rate") > 0
    n, t = F.avg(F.when(opening, F.col("normal_rate"))), F.avg(F.when(opening, F.col("tangential_rate")))
    return samples.groupBy("boundary_id").agg(
        _or_zero(n).alias("half_rate"), _or_zero(2 * n).alias("full_rate"), _or_zero(F.abs(t) / n).alias("asymmetry"),
        _or_zero(space.obliquity_deg(t, n)).alias("obliquity"), _or_zero(F.stddev_pop(F.when(opening, F.col("normal_rate")))).alias("deviation"),
    )


def _length_of(which: Column) -> Column:
    """From the first to the last of some samples along the boundary."""
    at = F.when(which, F.col("sample"))
    return _or_zero(F.max_by("arc", at) - F.min_by("arc", at)).alias("length")


def convergence(samples: DataFrame) -> DataFrame:
    """Of the convergent samples of each boundary: greatest and mean rate, length, number, greatest uncertainty.

    The uncertainty is that of the samples' normal_sigma, null where there is none; the rest is 0 without convergent samples.
    """
    closing = F.col("normal_rate") < 0
    rate = F.when(closing, -F.col("normal_rate"))
    sigma = F.max(F.when(closing, F.col("normal_sigma"))) if "normal_sigma" in samples.columns else F.lit(None).cast("double")
    return samples.groupBy("boundary_id").agg(
        _or_zero(F.max(rate)).alias("max_rate"), _or_zero(F.avg(rate)).alias("mean_rate"), _length_of(closing), F.count_if(closing).alias("n"), sigma.alias("max_sigma")
    )


def strike_slip(samples: DataFrame, off: float = 1e-12) -> DataFrame:
    """Of the slipping samples of each boundary: greatest and mean slip, length, numbers to the right and left; 0 without any."""
    t = F.col("tangential_rate")
    slip = F.when(F.abs(t) > off, F.abs(t))
    return samples.groupBy("boundary_id").agg(
        _or_zero(F.max(slip)).alias("max_slip"), _or_zero(F.avg(slip)).alias("mean_slip"), _length_of(F.abs(t) > off), F.count_if(t > off).alias("n_right"), F.count_if(t < -off).alias("n_left")
    )


def without_net_rotation(rotations: DataFrame, net: DataFrame) -> DataFrame:
    """Rotations with the net one of their tick undone (net: tick, q): what is left moves against the mantle. Ticks without a net rotation stay."""
    undo = net.select("tick", space.quat_inverse(F.col("q")).alias("_undo"))
    rows = rotations.join(undo, "tick", "left")
    return rows.withColumn("q", F.when(F.col("_undo").isNull(), F.col("q")).otherwise(space.quat_multiply(F.col("_undo"), F.col("q")))).drop("_undo")


def net_rotation(rotations: DataFrame, weight: Column) -> DataFrame:
    """Weighted mean quaternion of each tick, signs aligned with the first plate's; plates without weight are skipped. Columns tick, plate_id, q."""
    rows = rotations.withColumn("_w", weight).where("_w > 0")
    first = rows.groupBy("tick").agg(F.min_by("q", "plate_id").alias("_f"))
    rows = rows.join(first, "tick")
    d = sum(F.col(f"q.{c}") * F.col(f"_f.{c}") for c in "xyzw")
    s = F.when(d < 0, -F.col("_w")).otherwise(F.col("_w"))
    sums = rows.groupBy("tick").agg(*(F.sum(F.col(f"q.{c}") * s).alias(c) for c in "xyzw"))
    return sums.select("tick", space.quat_normalize(space.quat(*(F.col(c) for c in "xyzw"))).alias("q"))
