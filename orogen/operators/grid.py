"""Grids and rasters as cell tables: gradients, strain rates, time queries, masks, crops, resampling and zones.

velocity grid (j, i, ve, vn) of n_lat rows and n_lon columns that goes round; cells (tick, r, c, value) with row 0 in the north.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import space
from . import spatial
from .earlier import bucket_of, with_earlier


def latitude(j: Column, n_lat: int) -> Column:
    return -90 + (j + 0.5) * 180.0 / n_lat


def neighbours(grid: DataFrame, fields: list[str], n_lon: int, wraps: bool = True) -> DataFrame:
    """Add <field>_east, _west, _north, _south of the cells beside each; null where there is none.

    A sparse grid has cells without neighbours; on one that wraps, the last column's east is the first.
    """
    shifted = lambda dj, di, name: grid.select((F.col("j") - dj).alias("j"), (F.pmod(F.col("i") - di, F.lit(n_lon)) if wraps else F.col("i") - di).alias("i"), *(F.col(f).alias(f"{f}_{name}") for f in fields))
    rows = grid
    for dj, di, name in ((0, 1, "east"), (0, -1, "west"), (1, 0, "north"), (-1, 0, "south")):
        rows = rows.join(shifted(dj, di, name), ["j", "i"], "left")
    return rows


def gradients(grid: DataFrame, fields: list[str], n_lat: int, n_lon: int, wraps: bool = True) -> DataFrame:
    """d_<field>_di and d_<field>_dj, per radian of longitude and latitude.

    Differences are one-sided at the edges: in latitude always, in longitude where the grid does not go round.
    """
    row, col = Window.partitionBy("j").orderBy("i"), Window.partitionBy("i").orderBy("j")
    every = Window.partitionBy("j").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dlon, dlat = 2 * 3.141592653589793 / n_lon, 3.141592653589793 / n_lat

    def difference(f: str, w, step: float, first: Column | None, last: Column | None) -> Column:
        after, before = F.coalesce(F.lead(f).over(w), *([first] if first is not None else [])), F.coalesce(F.lag(f).over(w), *([last] if last is not None else []))
        steps = F.when(after.isNull() | before.isNull(), 1.0).otherwise(2.0)
        return (F.coalesce(after, f) - F.coalesce(before, f)) / (steps * step)

    out = {}
    for f in fields:
        out[f"d_{f}_di"] = difference(f, row, dlon, F.first(f).over(every) if wraps else None, F.last(f).over(every) if wraps else None)
        out[f"d_{f}_dj"] = difference(f, col, dlat, None, None)
    return grid.withColumns(out)


def strain_rate(grid: DataFrame, n_lat: int, n_lon: int, wraps: bool = True) -> DataFrame:
    """Eee, Enn, Een on the unit sphere with metric terms, and what follows from them: dilatation, vorticity, second invariant."""
    g = gradients(grid, ["ve", "vn"], n_lat, n_lon, wraps)
    lat = F.radians(latitude(F.col("j"), n_lat))
    c, t = F.cos(lat), F.tan(lat)
    ee = F.col("d_ve_di") / c - F.col("vn") * t
    nn = F.col("d_vn_dj")
    en = 0.5 * (F.col("d_ve_dj") + F.col("d_vn_di") / c + F.col("ve") * t)
    vort = F.col("d_vn_di") / c - F.col("d_ve_dj") + F.col("ve") * t
    pole = F.abs(c) < 1e-10
    nan = F.lit(float("nan"))
    rows = g.select("j", "i", *(F.when(pole, nan).otherwise(x).alias(k) for k, x in (("eee", ee), ("enn", nn), ("een", en), ("vorticity", vort))))
    dil = F.col("eee") + F.col("enn")
    return rows.withColumn("dilatation", dil).withColumn("second_invariant", F.sqrt(0.5 * (F.col("eee") ** 2 + F.col("enn") ** 2) + F.col("een") ** 2)).withColumn("divergence", F.greatest(F.col("dilatation"), F.lit(0.0))).withColumn("convergence", F.greatest(-F.col("dilatation"), F.lit(0.0)))


def frames_around(ticks: DataFrame, frames: DataFrame) -> DataFrame:
    """tick, before, after: the frames at or before and at or after each queried tick (columns sequence_id, tick).

    Queries and frames look back together, once in each direction, by buckets of ticks: no task sorts a whole sequence.
    """
    of = lambda rows, kind, frame: rows.select("sequence_id", "tick", (-F.col("tick")).alias("_back"), F.lit(kind).alias("_kind"), frame.cast("long").alias("frame"))
    rows = of(frames, 0, F.col("tick")).unionByName(of(ticks, 1, F.lit(None)))
    for at, name in (("tick", "before"), ("_back", "after")):
        rows = with_earlier(rows, ["sequence_id"], [at, "_kind"], bucket_of(at, 1_000), name, F.col("frame"))
    return rows.where("_kind = 1").select("sequence_id", "tick", "before", "after").distinct()


def raster_at(cells: DataFrame, ticks: DataFrame, method: str = "linear") -> DataFrame:
    """sequence_id, tick, r, c, value, weight, interpolated. Exact frames as they are; outside the range the nearest end.

    Nearest takes the frame before on a tie. Linear falls through to the other frame where one has no data;
    other methods take the frame before.
    """
    around = frames_around(ticks, cells.select("sequence_id", "tick").distinct()).where("before is not null or after is not null")
    b, a = F.coalesce("before", "after"), F.coalesce("after", "before")
    around = around.select("sequence_id", "tick", b.alias("b"), a.alias("a"))
    weight = F.when(F.col("a") == F.col("b"), 0.0).otherwise((F.col("tick") - F.col("b")) / (F.col("a") - F.col("b")))
    if method == "nearest":
        weight = F.when(weight > 0.5, 1.0).otherwise(0.0)
    elif method != "linear":
        weight = F.lit(0.0)
    around = around.withColumn("weight", weight)
    ends = around.select("sequence_id", "tick", "weight", F.explode(F.array_distinct(F.array(F.struct(F.col("b").alias("f"), F.lit(0).alias("k")), F.struct(F.col("a").alias("f"), F.lit(1).alias("k"))))).alias("e")).select("sequence_id", F.col("tick").alias("t"), "weight", F.col("e.f").alias("tick"), F.col("e.k").alias("k"))
    met = cells.join(ends, ["sequence_id", "tick"]).groupBy("sequence_id", F.col("t").alias("tick"), "weight", "r", "c").agg(F.max(F.when(F.col("k") == 0, F.col("value"))).alias("v0"), F.max(F.when(F.col("k") == 1, F.col("value"))).alias("v1"))
    v0, v1, w = F.col("v0"), F.col("v1"), F.col("weight")
    value = F.when(w == 0, v0).when(w == 1, v1).otherwise(F.coalesce(v0 + (v1 - v0) * w, v0, v1))
    return met.select("sequence_id", "tick", "r", "c", value.alias("value"), "weight", ((w > 0) & (w < 1)).alias("interpolated"))


def cell_lon(c: Column, width: int, west: float, east: float, at: float = 0.5) -> Column:
    return west + (c + at) * (east - west) / width


def cell_lat(r: Column, height: int, south: float, north: float, at: float = 0.5) -> Column:
    return north - (r + at) * (north - south) / height


def mask_bounds(cells: DataFrame, width: int, height: int, bounds: tuple[float, float, float, float], box: tuple[float, float, float, float], include: bool = True) -> DataFrame:
    """Cells whose top-left corner is outside (or, excluding, inside) the box lose their value. Bounds are west, south, east, north."""
    lon, lat = cell_lon(F.col("c"), width, bounds[0], bounds[2], 0.0), cell_lat(F.col("r"), height, bounds[1], bounds[3], 0.0)
    inside = space.in_bbox(lon, lat, *box)
    return cells.withColumn("value", F.when(inside if include else ~inside, F.col("value")))


def mask_plates(cells: DataFrame, rings: DataFrame, width: int, height: int, bounds: tuple[float, float, float, float], plates: list[int] | None = None, at: float = 0.5) -> DataFrame:
    """Cells keep their value where their centre (or another share of the cell) is in an outer ring of a plate and in none of its holes.

    Each place of the raster is looked up once, whatever the number of ticks.
    """
    own = rings if plates is None else rings.where(F.col("plate_id").isin(plates))
    places = cells.select("r", "c").distinct().withColumn("point_id", F.col("r").cast("long") * width + F.col("c"))
    places = places.withColumn("lon", cell_lon(F.col("c"), width, bounds[0], bounds[2], at)).withColumn("lat", cell_lat(F.col("r"), height, bounds[1], bounds[3], at))
    inside = places.join(spatial.containing(places, own).select("point_id").distinct(), "point_id", "left_semi").select("r", "c", F.lit(True).alias("_in"))
    return cells.join(inside, ["r", "c"], "left").withColumn("value", F.when(F.col("_in"), F.col("value"))).drop("_in")


def mask_plates_by_tick(cells: DataFrame, rings: DataFrame, width: int, height: int, bounds: tuple[float, float, float, float], at: float = 0.5) -> DataFrame:
    """mask_plates() with the rings of each cell's own tick (rings have a column tick)."""
    places = cells.select("tick", "r", "c").distinct().withColumn("point_id", F.col("r").cast("long") * width + F.col("c"))
    places = places.withColumn("lon", cell_lon(F.col("c"), width, bounds[0], bounds[2], at)).withColumn("lat", cell_lat(F.col("r"), height, bounds[1], bounds[3], at))
    inside = places.join(spatial.containing(places, rings, also=("tick",)).select("point_id", "tick").distinct(), ["point_id", "tick"], "left_semi").select("tick", "r", "c", F.lit(True).alias("_in"))
    return cells.join(inside, ["tick", "r", "c"], "left").withColumn("value", F.when(F.col("_in"), F.col("value"))).drop("_in")


def crop(cells: DataFrame, width: int, height: int, bounds: tuple[float, float, float, float], box: tuple[float, float, float, float]) -> DataFrame:
    """The pixel window of a box, rows and columns counted anew from its corner."""
    import math

    west, south, east, north = bounds
    dx, dy = (east - west) / width, (north - south) / height
    c0, c1 = max(0, math.floor((box[0] - west) / dx)), min(width, math.ceil((box[2] - west) / dx))
    r0, r1 = max(0, math.floor((north - box[3]) / dy)), min(height, math.ceil((north - box[1]) / dy))
    if c0 >= c1 or r0 >= r1:
        raise ValueError("the box and the raster do not meet")
    return cells.where(F.col("r").between(r0, r1 - 1) & F.col("c").between(c0, c1 - 1)).withColumn("r", F.col("r") - r0).withColumn("c", F.col("c") - c0)


def resample(cells: DataFrame, width: int, height: int, new_width: int, new_height: int, method: str = "bilinear") -> DataFrame:
    """tick, r, c, value on the new grid by cell centres; bilinear with a missing corner is nearest.

    The new grid is of a stated size. Each of its cells names its four sources, which are joined by equality.
    """
    spark = cells.sparkSession
    k = spark.range(new_width * new_height)
    r, c = F.expr(f"cast(id div {new_width} as int)"), (F.col("id") % new_width).cast("int")
    x = F.greatest(F.least((c + 0.5) * width / new_width - 0.5, F.lit(width - 1.0)), F.lit(0.0))
    y = F.greatest(F.least((r + 0.5) * height / new_height - 0.5, F.lit(height - 1.0)), F.lit(0.0))
    grid = k.select(r.alias("nr"), c.alias("nc"), x.alias("x"), y.alias("y"))
    near = (F.floor(F.col("x") + 0.5) == F.col("sc")) & (F.floor(F.col("y") + 0.5) == F.col("sr"))
    corner = lambda dr, dc: F.struct(F.least(F.floor("y") + dr, F.lit(height - 1)).alias("sr"), F.least(F.floor("x") + dc, F.lit(width - 1)).alias("sc"), ((F.lit(1.0) - dr + (2 * dr - 1) * (F.col("y") - F.floor("y"))) * (F.lit(1.0) - dc + (2 * dc - 1) * (F.col("x") - F.floor("x")))).alias("w"))
    sources = grid.withColumn("s", F.explode(F.array(corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1)))).select("nr", "nc", "x", "y", "s.*")
    met = cells.join(sources, (cells["r"] == F.col("sr")) & (cells["c"] == F.col("sc")))
    sums = met.groupBy("tick", "nr", "nc").agg(F.sum(F.col("value") * F.col("w")).alias("b"), F.count("value").alias("n"), F.max(F.when(near, F.col("value"))).alias("near"))
    value = F.when(F.col("n") == 4, F.col("b")).otherwise(F.col("near")) if method == "bilinear" else F.col("near")
    return sums.select("tick", F.col("nr").alias("r"), F.col("nc").alias("c"), value.alias("value"))


def zones_in(cells: DataFrame, rings: DataFrame, width: int, height: int, bounds: tuple[float, float, float, float], at: float = 0.5) -> DataFrame:
    """r, c, plate_id: the plates whose polygons hold a place of each cell, for zonal_stats()."""
    places = cells.select("r", "c").distinct().withColumn("point_id", F.col("r").cast("long") * width + F.col("c"))
    places = places.withColumn("lon", cell_lon(F.col("c"), width, bounds[0], bounds[2], at)).withColumn("lat", cell_lat(F.col("r"), height, bounds[1], bounds[3], at))
    return places.join(spatial.containing(places, rings), "point_id").select("r", "c", "plate_id")


def zonal_stats(cells: DataFrame, zones: DataFrame) -> DataFrame:
    """count, mean, min, max of the values of each plate; zones(r, c, plate_id)."""
    return cells.join(zones, ["r", "c"]).groupBy("tick", "plate_id").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))


def bounds_of(geo: list[Column], width: Column, height: Column) -> list[Column]:
    """west, south, east, north of an affine geotransform: the box of its four corners."""
    x = [geo[0] + geo[1] * i + geo[2] * j for i in (F.lit(0), width) for j in (F.lit(0), height)]
    y = [geo[3] + geo[4] * i + geo[5] * j for i in (F.lit(0), width) for j in (F.lit(0), height)]
    return [F.least(*x), F.least(*y), F.greatest(*x), F.greatest(*y)]


def value_at(points: DataFrame, cells: DataFrame, width: int, height: int, bounds: tuple[float, float, float, float]) -> DataFrame:
    """Points (lon, lat) with the cell (r, c) that they are in, clamped to the raster's edge, and its values."""
    west, south, east, north = bounds
    clamped = lambda x, most: F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(most)).cast("long")
    at = points.withColumn("r", clamped((north - F.col("lat")) * height / (north - south), height - 1)).withColumn("c", clamped((F.col("lon") - west) * width / (east - west), width - 1))
    return at.join(cells, ["r", "c"])


def global_grid(spark: SparkSession, resolution: float, registration: str = "pixel") -> DataFrame:
    """j, i, lat, lon of a global grid: centres of pixels, or gridlines with both poles (the last meridian is the first)."""
    n_lon, n_lat, off = int(360 / resolution), int(180 / resolution), 0.5 if registration == "pixel" else 0.0
    rows = n_lat + (registration != "pixel")
    k = spark.range(rows * n_lon)
    j, i = F.expr(f"id div {n_lon}"), F.col("id") % n_lon
    return k.select(j.alias("j"), i.alias("i"), (-90 + (j + off) * resolution).alias("lat"), (-180 + (i + off) * resolution).alias("lon"))


def sample_field(nodes: DataFrame, rings: DataFrame, omegas: DataFrame) -> DataFrame:
    """Nodes (j, i, lat, lon) with plate_id, the velocity's parts east and north, and speed; null where no plate is.

    Plates come from polygons, velocities from the plates' omegas.
    """
    named = nodes.withColumn("point_id", F.col("j") * 1_000_000 + F.col("i")).withColumn("plate_id", F.lit(None).cast("long"))
    own = spatial.assign_plate(named, rings).join(omegas.select("plate_id", "omega"), "plate_id", "left")
    p = space.latlon_to_unit(F.col("lat"), F.col("lon"))
    rows = own.withColumn("p", p).withColumn("v", F.when(F.col("omega").isNotNull(), space.linear_velocity(F.col("omega"), F.col("p"))))
    return rows.select("j", "i", "lat", "lon", "plate_id", space.dot(F.col("v"), space.east(F.col("p"))).alias("east"), space.dot(F.col("v"), space.north(F.col("p"))).alias("north"), space.norm(F.col("v")).alias("speed"))
