"""Paths in blocks, look-backs across buckets and hash chains, against plain loops."""

import hashlib
import math

import pytest

from orogen.operators import grid, log, motion

from test_core import created, events

SEEDS = "seed_id long, plate_id long, x double, y double, z double, start_tick long, end_tick long"
OMEGAS = "plate_id long, tick long, omega struct<x:double,y:double,z:double>"


def walk(seed, omegas, step, direction):
    """One seed's samples, step by step."""
    i, plate, x, y, z, t, end = seed
    table, out, error = {k: w for p, k, w in omegas if p == plate}, [], 0.0
    while True:
        a, b, c = table.get(t, (0.0, 0.0, 0.0))
        v = (b * z - c * y, c * x - a * z, a * y - b * x)
        out.append((i, plate, t, x, y, z, *v, error, t in table))
        t += direction * step
        if (t - end) * direction >= 0:
            return out
        x, y, z = (p + q * direction * step for p, q in zip((x, y, z), v))
        n = math.sqrt(x * x + y * y + z * z) or 1.0
        x, y, z, error = x / n, y / n, z / n, error + 1e-4 * step


def same(found, wanted):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3:6])
    found, wanted = sorted((tuple(r) for r in found), key=key), sorted(wanted, key=key)
    assert [(r[0], r[1], r[2], r[10]) for r in found] == [(r[0], r[1], r[2], r[10]) for r in wanted]
    for f, w in zip(found, wanted):
        assert f[3:10] == pytest.approx(w[3:10], abs=1e-12)


@pytest.mark.parametrize("block", [1, 40, 1 << 18])
@pytest.mark.parametrize("direction", [1, -1])
def test_paths_in_blocks_of_any_size_equal_paths_step_by_step(spark, monkeypatch, block, direction):
    monkeypatch.setattr(motion, "BLOCK", block)
    omegas = [(p, t, (0.01 * p, 0.02 * (t % 5), -0.015)) for p in (1, 2) for t in range(0, 24) if t != 8]
    seeds = []
    for i in range(40):  # plate 1 has most seeds; starts, lengths and parities differ; plate 9 and null have no velocities
        plate = [1, 1, 1, 2, 9, None][i % 6]
        a, b = i % 7, 3 + (i * 5) % 19
        start, end = (a, b) if direction == 1 else (b, a)
        seeds.append((i, plate, math.cos(i), math.sin(i), 0.0, start, end))
    seeds.append(seeds[0])  # a repeated seed has a path of its own
    got = motion.motion_paths(spark.createDataFrame(seeds, SEEDS), spark.createDataFrame(omegas, OMEGAS), 2, direction)
    same(got.collect(), [r for s in seeds for r in walk(s, omegas, 2, direction)])


def test_seeds_without_ends_have_no_path_and_empty_tables_give_none(spark):
    some = spark.createDataFrame([(1, 1, 1.0, 0.0, 0.0, None, 4), (2, 1, 1.0, 0.0, 0.0, 0, None), (3, 1, 1.0, 0.0, 0.0, 4, 4)], SEEDS)
    none = spark.createDataFrame([], OMEGAS)
    assert [(r["seed_id"], r["tick"], r["known"]) for r in motion.motion_paths(some, none, 1).collect()] == [(3, 4, False)]
    assert motion.motion_paths(some.limit(0), none, 1).count() == 0


def test_references_look_back_over_buckets_of_the_sequence(spark):
    far = 3 * 100_000 + 7
    rows = [created(0, "a"), created(5, "b"), {"sequence": far, "event_type": "PlateRetired", "plate_id": "a"}]
    rows += [{"sequence": s, "event_type": "BoundaryCreated", "boundary_id": f"x{s}", "plate_id_left": "a", "plate_id_right": "b"} for s in (1, 6, 250_000, far - 1, far + 1, far + 200_000)]
    found = {(r["sequence"], r["ref"]): r["before"] for r in log.references_before(events(spark, *rows)).collect()}
    assert found == {(s, "a"): "active" if s < far else "retired" for s in (1, 6, 250_000, far - 1, far + 1, far + 200_000)} | {
        (s, "b"): "missing" if s < 5 else "active" for s in (1, 6, 250_000, far - 1, far + 1, far + 200_000)}


def test_lifecycle_and_junctions_look_back_over_buckets_of_the_sequence(spark):
    j = lambda s, kind, **more: {"sequence": s, "event_type": f"Junction{kind}", "junction_id": "j", **more}
    gone = lambda s, b: {"sequence": s, "event_type": "BoundaryRetired", "boundary_id": b}
    rows = [j(1, "Created", boundary_ids=["p", "q"]), j(150_000, "Updated"), gone(250_000, "p"), j(350_000, "Updated", boundary_ids=["q", "r"]), gone(450_000, "p"), gone(450_001, "r"), j(550_000, "Retired"), gone(650_000, "q")]
    found = {(r["sequence"], r["boundary_id"]) for r in log.live_junction_faults(events(spark, *rows)).collect()}
    assert found == {(250_000, "p"), (450_001, "r")}
    late = [{"sequence": 700_000, "event_type": "JunctionUpdated", "junction_id": "j"}, {"sequence": 700_001, "event_type": "PlateRetired"}]
    order = {(r["sequence"], r["before"]) for r in log.lifecycle_faults(events(spark, *rows[:7], *late)).collect() if r["sequence"] > 500_000}
    assert order == {(700_000, "retired"), (700_001, "missing")}  # an event that names no entity was not created before


def test_frames_around_look_over_buckets_of_ticks_in_both_directions(spark):
    frames = [(1, t) for t in (-2_500, 0, 10, 5_000)] + [(None, 7)]
    asked = [(1, t) for t in (-9_000, -2_500, -1, 0, 3, 4_999, 5_000, 90_000)] + [(2, 5), (None, 3)]
    found = grid.frames_around(spark.createDataFrame(asked, "sequence_id long, tick long"), spark.createDataFrame(frames, "sequence_id long, tick long")).collect()
    wanted = {(s, t, max((f for q, f in frames if q == s and f <= t), default=None), min((f for q, f in frames if q == s and f >= t), default=None)) for s, t in asked}
    assert {tuple(r) for r in found} == wanted


def test_a_hash_chain_equals_one_made_row_by_row(spark):
    rows = [created(i, f"p{i}", tick=i % 3, stream_key=s) for s in ("a", "b") for i in range(30)]
    e = events(spark, *rows)
    payload = {(r["stream_key"], r["sequence"]): r["p"] for r in e.select("stream_key", "sequence", log.payload_text().alias("p")).collect()}
    found = sorted(log.build_chain(e).collect(), key=lambda r: (r["stream_key"], r["sequence"]))
    assert len(found) == 60
    for r in found:
        last = log.ZERO_HASH if r["sequence"] == 0 else last
        assert r["previous_hash"] == last
        last = hashlib.sha256(f"1\n{r['tick']}\n{last}\n{payload[r['stream_key'], r['sequence']]}".encode()).hexdigest()
        assert r["hash"] == last


@pytest.mark.parametrize("stretch", [1, 7, 4096])
def test_bases_follow_chains_across_stretches(spark, monkeypatch, stretch):
    """Segments that follow each other, with gaps and one inside another, of two plates: a base is the product of what ruled before."""
    monkeypatch.setattr(motion, "CHAIN", stretch)
    rows = [(f"s{p}-{k}", p, 10 * k, 10 * k + (8 if k % 3 else 10), 7_000_000 * k, 1_300_000 * k, 200_000 + 1000 * k) for p, n in ((1, 40), (2, 3)) for k in range(n)]
    rows.append(("inner", 1, 53, 56, 11_000_000, 5_000_000, 900_000))

    def mul(a, b):
        (ax, ay, az, aw), (bx, by, bz, bw) = a, b
        return (aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz)

    def ruler(plate, tick):
        own = [r for r in rows if r[1] == plate]
        inside = [r for r in own if r[2] < tick <= r[3]]
        ended = [r for r in own if r[3] <= tick]
        return min(inside, key=lambda r: (-r[2], r[3], r[0])) if inside else min(ended, key=lambda r: (-r[3], -r[2], r[0])) if ended else None

    def base(r):
        tick = r[2] if r[2] > 0 else -1
        s = ruler(r[1], tick)
        if s is None:
            return (0.0, 0.0, 0.0, 1.0)
        az, el, half = math.radians(s[4] / 1e6), math.radians(s[5] / 1e6), math.radians(s[6] / 1e6) * min(1, (tick - s[2]) / (s[3] - s[2])) / 2
        return mul(base(s), (math.cos(el) * math.cos(az) * math.sin(half), math.cos(el) * math.sin(az) * math.sin(half), math.sin(el) * math.sin(half), math.cos(half)))

    table = spark.createDataFrame(rows, "segment_id string, plate_id long, tick_a long, tick_b long, azimuth int, elevation int, angle int")
    got = {r["segment_id"]: tuple(r["base"]) for r in motion.base_rotations(table).collect()}
    assert set(got) == {r[0] for r in rows}
    for r in rows:
        assert got[r[0]] == pytest.approx(base(r), abs=1e-9), r[0]
