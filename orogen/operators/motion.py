"""Motion segments, rotations, velocities, frames and paths.

segments(segment_id, plate_id, tick_a, tick_b, azimuth, elevation, angle) with micro-degrees;
queries(plate_id, tick, ...); a rotation is a quaternion column q.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import space
from ..tables import cut
from . import cells
from .earlier import with_earlier

_IDENTITY = (0.0, 0.0, 0.0, 1.0)


def segment_at(ticks: DataFrame, segments: DataFrame) -> DataFrame:
    """Add `s`, the segment that rules each (plate_id, tick), null before the first, and whether it covers the tick.

    A segment covers tick_a < t <= tick_b; of several the latest tick_a, then the least tick_b, then the id.
    Where none covers the tick, the one that ended last rules (greatest tick_b <= t, then latest tick_a, least id).
    Covering segments meet their ticks by plate and bucket of ticks; a bucket is twice as wide as a segment on
    average, so segments are sent to 1.5 buckets on average. Ended ones are looked back for, also by buckets.
    """
    keyed, valid = ticks.select("plate_id", "tick").distinct(), segments.where("tick_b > tick_a")
    width = max(1, int(2 * (valid.agg(F.avg(F.col("tick_b") - F.col("tick_a"))).first()[0] or 1)))
    row, at = F.struct(*segments.columns), lambda c: F.floor(c / width).cast("long")
    dealt = valid.withColumn("_bucket", F.explode(F.sequence(at(F.col("tick_a") + 1), at(F.col("tick_b")))))
    met = keyed.withColumn("_bucket", at(F.col("tick"))).join(dealt, ["plate_id", "_bucket"]).where("tick_a < tick and tick <= tick_b")
    order = F.struct((-F.col("tick_a")).alias("a"), F.col("tick_b").alias("b"), F.col("segment_id").alias("i"))
    inside = met.groupBy("plate_id", "tick").agg(F.min_by(row, order).alias("_inside"))
    # Of those that end together one counts; an end comes before a query of the same tick.
    ends = valid.groupBy("plate_id", F.col("tick_b").alias("tick")).agg(F.min_by(row, F.struct((-F.col("tick_a")).alias("a"), F.col("segment_id").alias("i"))).alias("_row"))
    both = ends.select("plate_id", "tick", F.lit(0).alias("_kind"), "_row").unionByName(keyed.select("plate_id", "tick", F.lit(1).alias("_kind"), F.lit(None).cast(ends.schema["_row"].dataType).alias("_row")))
    ended = with_earlier(both, ["plate_id"], ["tick", "_kind"], F.floor(F.col("tick") / (64 * width)).cast("long"), "_ended", F.col("_row")).where("_kind = 1")
    found = ended.select("plate_id", "tick", "_ended").join(inside, ["plate_id", "tick"], "left")
    return ticks.join(found.select("plate_id", "tick", F.coalesce("_inside", "_ended").alias("s"), F.col("_inside").isNotNull().alias("covered")), ["plate_id", "tick"], "left")


def _part(s: Column, tick: Column) -> Column:
    f = (tick - s["tick_a"]) / (s["tick_b"] - s["tick_a"])
    return space.stage_rotation(s["azimuth"], s["elevation"], s["angle"], f)


#: Segments of a stretch of a plate's ticks whose chain is followed in one task.
CHAIN = 4096


def base_rotations(segments: DataFrame) -> DataFrame:
    """segment_id, base: each segment's absolute rotation at its tick_a, following the segment that rules there.

    Each segment points at its ruler, which starts before it. Stretches of some CHAIN segments of a plate are followed
    inside first, after which all of a stretch point out of it, at few segments. Among these pointers and products are
    doubled until all chains have ended, and one join brings the result to all.
    """
    starts = segments.where("tick_b > tick_a").select("segment_id", "plate_id", F.when(F.col("tick_a") > 0, F.col("tick_a")).otherwise(-1).alias("tick"))
    spans = starts.groupBy("plate_id").agg(((F.max("tick") - F.min("tick") + 1) / F.count(F.lit(1))).alias("each"))
    width = max(1, int(CHAIN * (spans.agg(F.min("each")).first()[0] or 1)))
    ruled = segment_at(starts, segments)
    q = F.when(F.col("s").isNull(), space.quat(*_IDENTITY)).otherwise(_part(F.col("s"), F.col("tick")))
    own = ruled.select("plate_id", F.floor(F.col("tick") / width).cast("long").alias("_stretch"), "segment_id", F.col("s.segment_id").alias("to"), q.alias("q"))
    kind = segments.schema["segment_id"].dataType.simpleString()
    flat = own.select("plate_id", "_stretch", "segment_id", "to", "q.*").groupBy("plate_id", "_stretch").applyInArrow(_out_of_stretch, f"segment_id {kind}, to {kind}, x double, y double, z double, w double")
    links = cut(flat.select("segment_id", "to", F.struct(*"xyzw").alias("q")))
    product = F.when(F.col("q2").isNull(), F.col("q")).otherwise(space.quat_normalize(space.quat_multiply(F.col("q2"), F.col("q"))))
    gates = cut(links.join(links.select(F.col("to").alias("segment_id")).distinct(), "segment_id", "left_semi"))
    while not gates.where("to is not null").isEmpty():
        other = gates.select(F.col("segment_id").alias("to"), F.col("to").alias("to2"), F.col("q").alias("q2"))
        gates = cut(gates.join(other, "to", "left").select("segment_id", F.col("to2").alias("to"), product.alias("q")))
    ends = gates.select(F.col("segment_id").alias("to"), F.col("q").alias("q2"))
    return links.join(ends, "to", "left").select("segment_id", product.alias("base"))


def _out_of_stretch(rows: pa.Table) -> pa.Table:
    """Pointers and products of a stretch, doubled until all pointers leave it."""
    ids, to = rows["segment_id"].combine_chunks(), rows["to"].combine_chunks()
    at = np.array(pc.fill_null(pc.index_in(to, value_set=ids), -1))
    q, end = np.stack([rows[c].to_numpy() for c in "xyzw"], axis=1), np.arange(len(at))
    for _ in range(len(at).bit_length()):
        i = np.flatnonzero(at >= 0)
        if not len(i):
            break
        (ax, ay, az, aw), (bx, by, bz, bw) = q[at[i]].T, q[i].T
        m = np.stack([aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz], axis=1)
        n = np.sqrt((m * m).sum(axis=1))[:, None]
        made, last, after = np.where(n > 0, m / np.where(n > 0, n, 1.0), _IDENTITY), end[at[i]], at[at[i]]
        q[i], end[i], at[i] = made, last, after
    return pa.table({"segment_id": ids, "to": to.take(pa.array(end)), **{c: pa.array(np.ascontiguousarray(q[:, k])) for k, c in enumerate("xyzw")}})


def rotations_at(ticks: DataFrame, segments: DataFrame) -> DataFrame:
    """Add q, the absolute rotation of each (plate_id, tick): base times the ruling segment's part; identity where none rules or tick <= 0."""
    ruled = segment_at(ticks, segments).withColumn("segment_id", F.when(F.col("tick") > 0, F.col("s.segment_id")))
    rows = ruled.join(base_rotations(segments), "segment_id", "left")
    q = space.quat_normalize(space.let(_part(F.col("s"), F.col("tick")), lambda p: space.quat_multiply(F.col("base"), p)))
    return rows.withColumn("q", F.when(F.col("segment_id").isNull(), space.quat(*_IDENTITY)).otherwise(q)).drop("segment_id", "s", "base", "covered")


def angular_velocities(ticks: DataFrame, segments: DataFrame) -> DataFrame:
    """Add omega = axis * angle of R(t + 1) R(t)⁻¹ for each (plate_id, tick)."""
    both = ticks.withColumn("_k", F.explode(F.array(F.lit(0), F.lit(1)))).withColumnRenamed("tick", "_t").withColumn("tick", F.col("_t") + F.col("_k"))
    keys = [c for c in ticks.columns if c != "tick"]
    turned = rotations_at(both, segments).groupBy(*keys, F.col("_t").alias("tick")).agg(F.first(F.when(F.col("_k") == 0, F.col("q")), ignorenulls=True).alias("q0"), F.first(F.when(F.col("_k") == 1, F.col("q")), ignorenulls=True).alias("q1"))
    step = space.let(space.quat_inverse(F.col("q0")), lambda i: space.quat_multiply(F.col("q1"), i))
    axis = space.let(space.rotation_axis(F.col("d")), lambda a: space.vec_scale(a, space.rotation_angle(F.col("d"))))
    return turned.withColumn("d", step).withColumn("omega", F.when(space.is_identity(F.col("d")), space.vec(0, 0, 0)).otherwise(axis)).drop("q0", "q1", "d")


def reconstruct(shapes: DataFrame, rotations: DataFrame, plate: str, line: str) -> DataFrame:
    """Turn an array of points by its plate's rotation (columns plate_id, q); shapes without a plate are dropped."""
    turned = rotations.select(F.col("plate_id").alias(plate), "q")
    return shapes.where(F.col(plate).isNotNull()).join(turned, plate).withColumn(line, space.rotate_line(F.col(line), F.col("q"))).drop("q")


def active_link(ticks: DataFrame, links: DataFrame) -> DataFrame:
    """The link of each (frame, tick): its range contains the tick or is null; least hint (null last), then position.

    Ranges are dealt to cells of ticks of their own size, ticks look into one cell of each size, so a tick meets the
    links near it and not all of its frame. Links without a range meet every tick of the frame, as they hold for it.
    """
    own = ticks.select("frame", "tick").distinct()
    ranged = links.where("from_tick is not null and to_tick >= from_tick")
    dealt = cells.dealt(ranged, [F.col("from_tick").cast("double")], [F.col("to_tick").cast("double")], 2.0**cells.MOST_LEVELS)
    near = cells.probes(own, [F.col("tick").cast("double")], 2.0**cells.MOST_LEVELS, dealt).join(dealt, ["frame", *cells.keys(1)]).where("tick between from_tick and to_tick").drop(*cells.keys(1))
    met = near.unionByName(own.join(links.where("from_tick is null"), "frame"))
    best = F.min(F.struct(F.col("sequence_hint").isNull().alias("n"), "sequence_hint", "position", "base_frame", "q")).alias("l")
    return met.groupBy("frame", "tick").agg(best).select("frame", "tick", F.col("l.base_frame").alias("base_frame"), F.col("l.q").alias("q"))


def frame_chains(ticks: DataFrame, links: DataFrame, roots: list[str]) -> DataFrame:
    """frame, tick, q to the root, via (the bases on the way) and is_valid: links are followed until a root; missing links and cycles are invalid.

    The link of every frame that can be reached is found tick by tick first; then each (frame, tick) points at
    its base, and pointers and products are doubled until none moves: about log2 of the longest chain rounds. A
    chain that is still open when twice as many links were followed as there are frames goes round.
    """
    here, seen = ticks.select("frame", "tick").distinct(), None
    found = None
    while True:
        rows = cut(active_link(here.where(~F.col("frame").isin(roots)), links))
        found = rows if found is None else found.unionByName(rows)
        seen = here if seen is None else cut(seen.unionByName(here))
        here = cut(rows.select(F.col("base_frame").alias("frame"), "tick").distinct().join(seen, ["frame", "tick"], "left_anti"))
        if here.isEmpty():
            break
    step = found.select("frame", "tick", F.col("base_frame").alias("to"), "q")
    state = cut(
        seen.join(step, ["frame", "tick"], "left").select(
            "frame", "tick", F.when(~F.col("frame").isin(roots), F.col("to")).alias("to"), F.coalesce("q", space.quat(*_IDENTITY)).alias("q"),
            F.when(F.col("to").isNull(), F.array().cast("array<string>")).otherwise(F.array("to")).alias("via"), (F.col("to").isNotNull() | F.col("frame").isin(roots)).alias("is_valid"),
        )
    )
    rounds, most = 0, max(1, seen.select("frame").distinct().count())
    while 2**rounds <= 2 * most and not state.where("to is not null").isEmpty():
        other = state.select(F.col("frame").alias("to"), "tick", F.col("to").alias("to2"), F.col("q").alias("q2"), F.col("via").alias("via2"), F.col("is_valid").alias("v2"))
        state = cut(
            state.join(other, ["to", "tick"], "left").select(
                "frame", "tick", F.col("to2").alias("to"), F.when(F.col("q2").isNull(), F.col("q")).otherwise(space.compose(F.col("q"), F.col("q2"))).alias("q"),
                F.concat("via", F.coalesce("via2", F.array().cast("array<string>"))).alias("via"), (F.col("is_valid") & F.coalesce("v2", F.lit(True))).alias("is_valid"),
            )
        )
        rounds += 1
    own = ticks.select("frame", "tick").distinct()
    return own.join(state, ["frame", "tick"]).select("frame", "tick", "q", "via", (F.col("is_valid") & F.col("to").isNull()).alias("is_valid"))


def frame_transform(pairs: DataFrame, chains: DataFrame) -> DataFrame:
    """pairs(from_frame, to_frame, tick): from-to-root composed with the inverse of to-to-root."""
    a = chains.select(F.col("frame").alias("from_frame"), "tick", F.col("q").alias("qa"), F.col("is_valid").alias("va"))
    b = chains.select(F.col("frame").alias("to_frame"), "tick", F.col("q").alias("qb"), F.col("is_valid").alias("vb"))
    rows = pairs.join(a, ["from_frame", "tick"], "left").join(b, ["to_frame", "tick"], "left")
    valid = F.coalesce(F.col("va") & F.col("vb"), F.lit(False))
    return rows.select("from_frame", "to_frame", "tick", F.when(valid, space.compose(F.col("qa"), space.quat_inverse(F.col("qb")))).alias("q"), valid.alias("is_valid"))


def evaluation_chains(pairs: DataFrame, chains: DataFrame) -> DataFrame:
    """pairs(from_frame, to_frame, tick) with the frames that a transform goes through: from the first to its root, then from the second to its own."""
    side = lambda f, v: chains.where("is_valid").select(F.col("frame").alias(f), "tick", F.concat(F.array("frame"), "via").alias(v))
    return pairs.join(side("from_frame", "_a"), ["from_frame", "tick"]).join(side("to_frame", "_b"), ["to_frame", "tick"]).select("from_frame", "to_frame", "tick", F.concat("_a", "_b").alias("chain"))


def merge_links(links: DataFrame) -> DataFrame:
    """Drop identity links, then merge neighbours (by hint, start) of one frame and base when both are always valid or ranges touch."""
    w = Window.partitionBy("frame").orderBy(F.asc_nulls_last("sequence_hint"), "from_tick", "position")
    before = lambda c: F.lag(c).over(w)
    touch = (before("base_frame") == F.col("base_frame")) & ((before("from_tick").isNull() & F.col("from_tick").isNull()) | (before("to_tick") + 1 == F.col("from_tick")))
    rows = links.where(~space.is_identity(F.col("q"))).withColumn("_place", F.row_number().over(w)).withColumn("_new", F.when(F.coalesce(touch, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("_island", F.sum("_new").over(w))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_place", "q"))), lambda x: x["q"])
    merged = rows.groupBy("frame", "base_frame", "_island").agg(F.min("from_tick").alias("from_tick"), F.max("to_tick").alias("to_tick"), F.count(F.lit(1)).alias("n_links"), ordered.alias("qs"))
    return merged.withColumn("q", F.aggregate("qs", space.quat(*_IDENTITY), space.compose)).drop("qs", "_island")


def overlapping_links(links: DataFrame) -> DataFrame:
    w = Window.partitionBy("frame", "base_frame").orderBy("from_tick", "position")
    return links.where("from_tick is not null").withColumn("next_from", F.lead("from_tick").over(w)).where("to_tick >= next_from")


#: Samples of a block of seeds that step together.
BLOCK = 1 << 18

_PATHS = "seed_id long, plate_id long, tick long, x double, y double, z double, vx double, vy double, vz double, error double, known boolean"


def motion_paths(seeds: DataFrame, omegas: DataFrame, step: int, direction: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """seed_id, plate_id, tick, x, y, z, vx, vy, vz, error, known of explicit Euler paths; the end point is not a sample.

    seeds(seed_id, plate_id, x, y, z, start_tick, end_tick, and the columns `keep`, which their samples have too);
    omegas(plate_id, tick, omega). The seeds of a plate are dealt to blocks of some BLOCK samples, so a plate of many
    seeds is spread over tasks; this is the only time that they move. A block gets its plate's velocities once, and all
    its seeds step together. Where a plate has no velocity, or is not known, the seed stands still and the sample is not
    `known`; every path runs to its end. Repeated seeds have a path each, seeds without a start or an end none.
    Positions are renormalised; the error grows by 1e-4 a tick. v is the velocity at the sample.
    """
    ahead = (F.col("end_tick") - F.col("start_tick")) * direction
    columns = ["seed_id", "plate_id", "x", "y", "z", "start_tick", "end_tick"]
    own = seeds.select(*columns, *(F.col(c).alias(f"_keep{k}") for k, c in enumerate(keep))).where("start_tick is not null and end_tick is not null").withColumn("_n", F.greatest(F.lit(1), F.ceil(ahead / step)).cast("long"))
    last = F.col("start_tick") + direction * step * (F.col("_n") - 1)
    # One row a plate, in a file: its size is known, so it is sent to the seeds and not they to it.
    plates = cut(own.groupBy(F.col("plate_id").alias("_plate")).agg(
        F.ceil(F.sum("_n") / BLOCK).cast("long").alias("_parts"), F.min(F.least("start_tick", last)).alias("_low"), F.max(F.greatest("start_tick", last)).alias("_high")))
    blocks = own.join(plates.select("_plate", "_parts"), F.col("plate_id").eqNullSafe(F.col("_plate"))).withColumn("_part", F.pmod(F.xxhash64("seed_id", "x", "y", "z"), F.col("_parts"))).drop("_plate", "_parts")
    near = omegas.join(plates, F.col("plate_id") == F.col("_plate")).where("tick between _low and _high")
    table = near.select("_plate", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_block"), "tick", "omega.x", "omega.y", "omega.z")
    names = [f"_keep{k}" for k in range(len(keep))]

    def paths(block: pa.Table, known: pa.Table) -> pa.Table:
        block = block.sort_by([("_n", "descending")])
        known = known.sort_by([(c, "ascending") for c in ("tick", "x", "y", "z")])
        ticks, turns = known["tick"].to_numpy(), np.stack([known[c].to_numpy() for c in "xyz"], axis=1)
        ticks, first = np.unique(ticks, return_index=True)
        turns = turns[first]
        n, t = block["_n"].to_numpy(), block["start_tick"].to_numpy()
        p, error, rows = np.stack([block[c].to_numpy() for c in "xyz"], axis=1), 0.0, []
        for k in range(n.max(initial=0)):
            m = int((n > k).sum())  # seeds whose paths go on come first
            p, t = p[:m], t[:m]
            at = np.minimum(np.searchsorted(ticks, t), max(len(ticks) - 1, 0))
            has = ticks[at] == t if len(ticks) else np.zeros(m, bool)
            w = np.zeros((m, 3))
            w[has] = turns[at[has]]
            v = np.cross(w, p)
            rows.append((np.arange(m), t, p, v, np.full(m, error), has))
            p = p + v * (direction * step)
            length = np.sqrt(p[:, 0] ** 2 + p[:, 1] ** 2 + p[:, 2] ** 2)
            p = p / np.where(length == 0, 1.0, length)[:, None]
            t, error = t + direction * step, error + 1e-4 * abs(step)
        if not rows:
            rows = [(np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros((0, 3)), np.zeros((0, 3)), np.zeros(0), np.zeros(0, bool))]
        i, t, p, v, error, has = (np.concatenate(c) for c in zip(*rows))
        ids = block.select(["seed_id", "plate_id", *names]).take(pa.array(i))
        made = {"tick": t, "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "vx": v[:, 0], "vy": v[:, 1], "vz": v[:, 2], "error": error, "known": has}
        out = {c: ids[c].combine_chunks() for c in ("seed_id", "plate_id")} | {c: pa.array(np.ascontiguousarray(x)) for c, x in made.items()} | {c: ids[c].combine_chunks() for c in names}
        return pa.table(out)

    kept = [f"{c} {blocks.schema[c].dataType.simpleString()}" for c in names]
    blocks = blocks.withColumns({c: F.col(c).cast("long") for c in ("seed_id", "plate_id", "start_tick")} | {c: F.col(c).cast("double") for c in "xyz"})
    found = blocks.groupBy("plate_id", "_part").cogroup(table.groupBy("_plate", "_block")).applyInArrow(paths, ", ".join([_PATHS, *kept]))
    return found.withColumnsRenamed(dict(zip(names, keep)))


def accumulated_opening(samples: DataFrame, rate: Column) -> DataFrame:
    """Running sum of rate times the ticks since the sample before, along each path."""
    w = Window.partitionBy("seed_id").orderBy("tick")
    return samples.withColumn("opening", F.sum(rate * F.abs(F.col("tick") - F.coalesce(F.lag("tick").over(w), F.col("tick")))).over(w.rowsBetween(Window.unboundedPreceding, 0)))


#: Fixed value: the rate of the model `Uniform`; other models have none.
UNIFORM_RATE = 5.0


def flowlines(seeds: DataFrame, omegas: DataFrame, step: int, model: str = "Uniform", direction: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """Paths of seeds that lie on a boundary, with the spreading rate of the model and the opening so far.

    The model's rate does not change along a path, so the opening is the rate times the ticks since its start;
    accumulated_opening() adds up rates that do.
    """
    rate = F.lit(UNIFORM_RATE if model == "Uniform" else 0.0)
    paths = motion_paths(seeds.withColumn("_start", F.col("start_tick").cast("long")), omegas, step, direction, ("_start", *keep))
    return paths.withColumn("rate", rate).withColumn("opening", F.col("rate") * F.abs(F.col("tick") - F.col("_start"))).drop("_start")


def flowline_bundle(samples: DataFrame, boundaries: DataFrame | None, omegas: DataFrame, start: int, end: int, step: int, model: str = "Uniform") -> DataFrame:
    """Flowlines of both sides of boundaries: boundary_id, sample, side and the columns of flowlines() but seed_id.

    samples(boundary_id, sample, p), such as those of sample_by_spacing(); boundaries(boundary_id, plate_left, plate_right),
    none if the samples have these columns.
    """
    sides = F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("plate_left").alias("plate_id")), F.struct(F.lit("right").alias("side"), F.col("plate_right").alias("plate_id")))).alias("s")
    rows = samples if boundaries is None else samples.select("boundary_id", "sample", "p").join(boundaries.select("boundary_id", "plate_left", "plate_right"), "boundary_id")
    seeds = rows.select("boundary_id", "sample", "p", sides).select(F.xxhash64("boundary_id", "sample").alias("seed_id"), "boundary_id", "sample", "p.*", "s.*")
    seeds = seeds.withColumns({"start_tick": F.lit(start).cast("long"), "end_tick": F.lit(end).cast("long")})
    return flowlines(seeds, omegas, step, model, 1 if end >= start else -1, ("boundary_id", "sample", "side")).drop("seed_id")


def kept_samples(samples: DataFrame, keep: Column, **metadata: Column) -> DataFrame:
    """A trajectory sampler: the samples that a condition keeps, with columns of metadata about them."""
    return samples.where(keep).withColumns(metadata)


def velocity_in_frame(points: DataFrame, omegas: DataFrame, anchor: int | None = None) -> DataFrame:
    """Add v, speed and azimuth (radians, null at rest) of points (plate_id, p) seen from an anchor plate.

    omegas(plate_id, omega) of one tick; without an anchor, or where it has no omega, the frame stands still.
    """
    still = F.coalesce(F.first("omega", ignorenulls=True), space.vec(0, 0, 0)).alias("_frame")
    frame = omegas.where(F.lit(False) if anchor is None else F.col("plate_id") == anchor).agg(still)
    seen = omegas.join(F.broadcast(frame)).select("plate_id", space.vec_sub(F.col("omega"), F.col("_frame")).alias("_omega"))  # one row
    rows = points.join(seen, "plate_id").withColumn("v", space.linear_velocity(F.col("_omega"), F.col("p"))).drop("_omega")
    return rows.withColumn("speed", space.norm(F.col("v"))).withColumn("azimuth", F.when(F.col("speed") > space.EPS, space.azimuth(F.col("p"), F.col("v"))))


def velocity_in_custom_frame(points: DataFrame, omegas: DataFrame, chains: DataFrame, frame: str) -> DataFrame:
    """velocity_in_frame() for a frame that is defined by links, tick by tick: it moves with the plate that its chain ends at.

    points(plate_id, tick, p), omegas(plate_id, tick, omega), chains: frame_chains() with roots such as `plate:7`
    and `mantle`. A frame on the mantle stands still; there are no rows at ticks where the frame is not valid.
    """
    anchor = F.regexp_extract(F.element_at("via", -1), r"^plate:(\d+)$", 1)
    own = chains.where((F.col("frame") == frame) & F.col("is_valid")).select("tick", F.when(anchor != "", anchor.cast("long")).alias("_anchor"))
    moving = omegas.select(F.col("plate_id").alias("_anchor"), "tick", F.col("omega").alias("_frame"))
    at = own.join(moving, ["_anchor", "tick"], "left").select("tick", F.coalesce("_frame", space.vec(0, 0, 0)).alias("_frame"))
    seen = omegas.join(at, "tick").select("plate_id", "tick", space.vec_sub(F.col("omega"), F.col("_frame")).alias("_omega"))
    rows = points.join(seen, ["plate_id", "tick"]).withColumn("v", space.linear_velocity(F.col("_omega"), F.col("p"))).drop("_omega")
    return rows.withColumn("speed", space.norm(F.col("v"))).withColumn("azimuth", F.when(F.col("speed") > space.EPS, space.azimuth(F.col("p"), F.col("v"))))


def rotations_in_frame(rotations: DataFrame, anchor: int) -> DataFrame:
    """Each plate's rotation (plate_id, tick, q) as seen from the anchor plate; no rows at ticks without the anchor."""
    own = rotations.where(F.col("plate_id") == anchor).select("tick", space.quat_inverse(F.col("q")).alias("_frame"))
    return rotations.join(own, "tick").withColumn("q", space.compose(F.col("q"), F.col("_frame"))).drop("_frame")


def rotations_in_custom_frame(rotations: DataFrame, chains: DataFrame, frame: str) -> DataFrame:
    """Each plate's rotation as seen from a frame that is defined by links (chains: frame_chains); no rows at ticks where it is not valid."""
    own = chains.where((F.col("frame") == frame) & F.col("is_valid")).select("tick", space.quat_inverse(F.col("q")).alias("_frame"))
    return rotations.join(own, "tick").withColumn("q", space.compose(F.col("q"), F.col("_frame"))).drop("_frame")


def with_polar_wander(rotations: DataFrame, wander: DataFrame) -> DataFrame:
    """Rotations turned on by the whole body's own at their tick (columns tick, q); ticks that it lacks stay as they are."""
    turn = F.coalesce("_wander", space.quat(*_IDENTITY))
    return rotations.join(wander.select("tick", F.col("q").alias("_wander")), "tick", "left").withColumn("q", space.compose(F.col("q"), turn)).drop("_wander")


def segment_records(segments: DataFrame) -> DataFrame:
    """One flat JSON record a segment, for interchange: plate_id, segment_id, record."""
    fields = ["plate_id", "segment_id", "tick_a", "tick_b", "azimuth", "elevation", "angle"]
    return segments.select("plate_id", "segment_id", F.to_json(F.struct(*fields)).alias("record"))


def with_plate(features: DataFrame) -> DataFrame:
    return features.where(F.col("plate_id").isNotNull())


def boundaries_as_features(boundaries: DataFrame) -> DataFrame:
    """Active boundaries as features on their left plate."""
    active = boundaries.where("not is_retired")
    return active.withColumn("feature_id", F.concat(F.lit("boundary:"), F.col("boundary_id").cast("string"))).withColumn("plate_id", F.col("plate_left"))


def canonical_order(rows: DataFrame, *ids: str) -> DataFrame:
    """Ascending ids; for the sink only, as a sort moves all rows."""
    return rows.orderBy(*ids)


def plate_ticks(plates: DataFrame, ticks: DataFrame) -> DataFrame:
    """plate_id, tick: every plate at every different tick, however many there are; all pairs are the result."""
    return plates.select("plate_id").crossJoin(ticks.select(F.col("tick").cast("long").alias("tick")).distinct())


@dataclass(frozen=True)
class VelocityModel:
    """Angular velocities of plates: a function from rows with plate_id and tick to these rows with omega."""

    omegas: Callable[[DataFrame], DataFrame]

    def absolute(self, ticks: DataFrame) -> DataFrame:
        return self.omegas(ticks)

    def relative(self, ticks: DataFrame) -> DataFrame:
        """ticks(plate_id, against, tick): omega of the plate, and relative to the other one."""
        other = self.omegas(ticks.select(F.col("against").alias("plate_id"), "tick").distinct()).select(F.col("plate_id").alias("against"), "tick", F.col("omega").alias("_other"))
        return self.omegas(ticks).join(other, ["against", "tick"]).withColumn("relative", space.vec_sub(F.col("omega"), F.col("_other"))).drop("_other")


_EXCHANGE = "id long, frame string, v struct<x:double,y:double,z:double>"


def velocity_exchange(samples: DataFrame, key: str) -> DataFrame:
    """One JSON record a sample (key, plate_id, v): its id, the name of its frame and the velocity's parts."""
    frame = F.when(F.col("plate_id").isNull(), "mantle").otherwise(F.concat(F.lit("plate:"), F.col("plate_id").cast("string")))
    return samples.select(F.to_json(F.struct(F.col(key).cast("long").alias("id"), frame.alias("frame"), "v")).alias("record"))


def from_exchange(records: DataFrame) -> DataFrame:
    """id, frame, v of records; those that cannot be read are null."""
    return records.select(F.from_json("record", _EXCHANGE).alias("r")).select("r.*")


def canonical_links(links: DataFrame) -> DataFrame:
    """Links without identities, merged where ranges touch (merge_links)."""
    return merge_links(links)


def definition_faults(links: DataFrame, roots: list[str]) -> DataFrame:
    """frame, fault: frames without a name, with links that overlap, whose base is defined nowhere, or on a cycle of bases at any tick.

    Base pointers are doubled as sets of (frame, base) pairs: after log2 of the frames rounds only cycles are left.
    """
    blank = links.where("frame is null or trim(frame) = ''").select("frame", F.lit("no name").alias("fault"))
    over = overlapping_links(links).select("frame", F.lit("overlap").alias("fault"))
    known = links.select(F.col("frame").alias("base_frame")).distinct()
    lost = links.where(~F.col("base_frame").isin(roots)).join(known, "base_frame", "left_anti").select("frame", F.lit("unknown base").alias("fault"))
    pairs = cut(links.where(~F.col("base_frame").isin(roots)).select("frame", F.col("base_frame").alias("to")).distinct())
    for _ in range(max(1, math.ceil(math.log2(max(2, links.select("frame").distinct().count()))) + 1)):
        other = pairs.select(F.col("frame").alias("to"), F.col("to").alias("to2"))
        pairs = cut(pairs.join(other, "to").select("frame", F.col("to2").alias("to")).distinct())
    loop = pairs.select("frame", F.lit("cycle").alias("fault"))
    return blank.unionByName(over).unionByName(lost).unionByName(loop).distinct()
