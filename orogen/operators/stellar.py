"""Bodies of planetary systems: orbits, ephemerides, insolation and checks of the parent tree."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import cut

G = 6.6743e-11


def period(a: Column, mass: Column) -> Column:
    return 2 * math.pi * F.sqrt(a * a * a / (G * mass))


def mean_motion(a: Column, mass: Column) -> Column:
    return F.sqrt(G * mass / (a * a * a))


def vis_viva(a: Column, r: Column, mass: Column) -> Column:
    return F.sqrt(G * mass * (2 / r - 1 / a))


def escape_velocity(r: Column, mass: Column) -> Column:
    return F.sqrt(2 * G * mass / r)


def hill_radius(a: Column, e: Column, mass: Column, parent_mass: Column) -> Column:
    return a * (1 - e) * F.pow(mass / (3 * parent_mass), F.lit(1 / 3))


def eccentric_anomaly(mean: Column, e: Column, rounds: int = 50, off: float = 1e-12) -> Column:
    """Kepler's equation by Newton steps, elliptic orbits only."""
    step = lambda x, _: F.when(F.abs(x - e * F.sin(x) - mean) < off, x).otherwise(x - (x - e * F.sin(x) - mean) / (1 - e * F.cos(x)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.when(e > 0.8, F.lit(math.pi)).otherwise(mean), step)


def ephemeris(bodies: DataFrame, times: list[float]) -> DataFrame:
    """body_id, t, x, y, r, vx, vy, true_anomaly of every body at every time (bodies: a_m, ecc, m0, parent_mass).

    Positions and velocities lie in the orbit's plane, x towards the periapsis; the true anomaly is in -pi to pi.
    """
    rows = bodies.withColumn("t", F.explode(F.array(*(F.lit(float(t)) for t in times)))).withColumn("n", mean_motion(F.col("a_m"), F.col("parent_mass")))
    mean = F.pmod(F.col("m0") + F.col("n") * F.col("t"), F.lit(2 * math.pi))
    rows = rows.withColumn("mean", mean).withColumn("anomaly", eccentric_anomaly(F.col("mean"), F.col("ecc")))
    x = F.col("a_m") * (F.cos("anomaly") - F.col("ecc"))
    y = F.col("a_m") * F.sqrt(1 - F.col("ecc") ** 2) * F.sin("anomaly")
    rows = rows.withColumn("x", x).withColumn("y", y).withColumn("r", F.col("a_m") * (1 - F.col("ecc") * F.cos("anomaly")))
    turn = F.col("a_m") * F.col("a_m") * F.col("n") / F.col("r")  # the anomaly's rate times the semi-major axis
    flat = F.sqrt(1 - F.col("ecc") ** 2)
    return rows.withColumns({"vx": -turn * F.sin("anomaly"), "vy": turn * flat * F.cos("anomaly"), "true_anomaly": F.atan2(flat * F.sin("anomaly"), F.cos("anomaly") - F.col("ecc"))})


def declination(day: Column, tilt_deg: Column, year: float = 365.25) -> Column:
    return F.asin(F.sin(F.radians(tilt_deg)) * F.sin(2 * math.pi * day / year))


def sunrise_angle(lat_deg: Column, decl: Column) -> Column:
    return F.acos(F.greatest(F.least(-F.tan(F.radians(lat_deg)) * F.tan(decl), F.lit(1.0)), F.lit(-1.0)))


def day_length_hours(lat_deg: Column, decl: Column) -> Column:
    return 24 / math.pi * sunrise_angle(lat_deg, decl)


def daily_mean_flux(flux: Column, lat_deg: Column, decl: Column) -> Column:
    h, p = sunrise_angle(lat_deg, decl), F.radians(lat_deg)
    return flux / math.pi * (h * F.sin(p) * F.sin(decl) + F.cos(p) * F.cos(decl) * F.sin(h))


def zenith_angle(lat_deg: Column, decl: Column, hour_angle: Column) -> Column:
    p = F.radians(lat_deg)
    return F.acos(F.greatest(F.least(F.sin(p) * F.sin(decl) + F.cos(p) * F.cos(decl) * F.cos(hour_angle), F.lit(1.0)), F.lit(-1.0)))


def time_at_true_anomaly(a: Column, e: Column, m0: Column, mass: Column, anomaly: Column, after: Column) -> Column:
    """The first time from `after` on at which a body has a true anomaly (elliptic orbits)."""
    n = mean_motion(a, mass)
    ecc = F.atan2(F.sqrt(1 - e * e) * F.sin(anomaly), e + F.cos(anomaly))
    wait = F.pmod(ecc - e * F.sin(ecc) - m0 - n * after, F.lit(2 * math.pi))
    return after + wait / n


def tree_faults(bodies: DataFrame) -> DataFrame:
    """system_id, body_id, fault: duplicate ids, missing parents, and bodies whose parents never end (cycles).

    Parent pointers are doubled; bodies that still point at something after log2 of the bodies rounds are on or below a cycle.
    """
    key = ["system_id", "body_id"]
    twice = bodies.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key, F.lit("duplicate id").alias("fault"))
    ids = bodies.select("system_id", F.col("body_id").alias("parent_id")).distinct()
    lost = bodies.where("parent_id is not null").join(ids, ["system_id", "parent_id"], "left_anti").select(*key, F.lit("missing parent").alias("fault"))
    state = cut(bodies.where("parent_id is not null").join(ids, ["system_id", "parent_id"]).select(*key, F.col("parent_id").alias("to")).distinct())
    for _ in range(max(1, math.ceil(math.log2(max(2, bodies.count()))))):
        other = state.select("system_id", F.col("body_id").alias("to"), F.col("to").alias("to2"))
        state = cut(state.join(other, ["system_id", "to"]).select(*key, F.col("to2").alias("to")).distinct())
    return twice.unionByName(lost).unionByName(state.select(*key, F.lit("cycle").alias("fault")).distinct())


def bodies_at(events: DataFrame, sequence: int) -> DataFrame:
    """Bodies from BodyAdded, OrbitChanged and BodyRemoved events up to a sequence."""
    e = events.where(F.col("sequence") <= sequence)
    last = lambda c, *types: F.max_by(F.struct(F.col(c).alias("v")), F.when(F.col("event_type").isin(*types), F.col("sequence")))["v"].alias(c)
    life = F.max_by("event_type", F.when(F.col("event_type") != "OrbitChanged", F.col("sequence"))).alias("_life")
    rows = e.groupBy("system_id", "body_id").agg(last("parent_id", "BodyAdded"), last("mass_kg", "BodyAdded"), last("a_m", "BodyAdded", "OrbitChanged"), life)
    return rows.where("_life = 'BodyAdded'").drop("_life")
