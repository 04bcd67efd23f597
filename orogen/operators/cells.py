"""Joins of points with extended things by cells of many sizes: each thing in the few cells of about its own size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sides of cells are the root's, halved up to so many times.
MOST_LEVELS = 30


def dealt(things: DataFrame, low: list[Column], high: list[Column], root: float) -> DataFrame:
    """The things once for each cell of their box: columns _level, _c0, _c1 and so on.

    The level is the deepest one whose cells are as wide as the box, so a thing has two cells along each axis at
    most, and a small thing meets only points near it, however large others are. A box wider than the root has
    the root's own cells.
    """
    width = F.greatest(*(h - lo for lo, h in zip(low, high))) if len(low) > 1 else high[0] - low[0]
    level = F.greatest(F.lit(0), F.least(F.lit(MOST_LEVELS), F.floor(F.log2(F.lit(root) / F.greatest(width, F.lit(root * 2.0**-MOST_LEVELS)))))).cast("int")
    rows = things.withColumn("_level", level)
    for k, (lo, h) in enumerate(zip(low, high)):
        rows = rows.withColumn(f"_c{k}", F.explode(F.sequence(_cell(lo, root), _cell(h, root))))
    return rows


def probes(points: DataFrame, at: list[Column], root: float, things: DataFrame) -> DataFrame:
    """The points once for each level that the dealt things have: MOST_LEVELS + 1 at most, and few as a rule."""
    levels = sorted(r[0] for r in things.select("_level").distinct().collect())
    rows = points.withColumn("_level", F.explode(F.array(*(F.lit(x) for x in levels)).cast("array<int>")))
    return reduce(lambda df, kc: df.withColumn(f"_c{kc[0]}", _cell(kc[1], root)), enumerate(at), rows)


def _cell(x: Column, root: float) -> Column:
    return F.floor(x * F.pow(F.lit(2.0), F.col("_level")) / root).cast("long")


def keys(axes: int) -> list[str]:
    return ["_level", *(f"_c{k}" for k in range(axes))]
