"""Classes and colours of faces: lakes, avalanche exposure and danger, slope, aspect, height, land cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAKE_SLOPE = 1e-2
STEEP = 30.0
# Colours of the eight aspect classes from north, clockwise, and of the danger levels 1 to 4.
ASPECT_COLOURS = ((0.0, 0.0, 1.0), (0.0, 0.5, 1.0), (0.0, 1.0, 0.5), (0.5, 1.0, 0.0), (1.0, 0.5, 0.0), (1.0, 0.0, 0.0), (1.0, 0.0, 0.5), (0.5, 0.0, 1.0))
DANGER = ("green", "yellow", "red", "black")


def is_lake(slope: Column) -> Column:
    return slope < LAKE_SLOPE


def in_sector(degrees: Column, lo: Column, hi: Column) -> Column:
    """Strictly between two bearings in degrees, through north where lo > hi."""
    return F.when(lo > hi, (degrees > lo) | (degrees < hi)).otherwise((degrees > lo) & (degrees < hi))


def bearing(aspect: Column) -> Column:
    return F.pmod(F.degrees(aspect), F.lit(360.0))


def exposed(rows: DataFrame, heights: list[tuple[float, float]], sectors: list[tuple[float, float]]) -> DataFrame:
    """Adds exposed: steep (30 degrees or more), highest or lowest corner in a height interval, aspect in a sector."""
    top, low = F.greatest("z0", "z1", "z2"), F.least("z0", "z1", "z2")
    high = F.lit(False)
    for a, b in heights:
        high = high | top.between(a, b) | low.between(a, b)
    turned = F.lit(False)
    for a, b in sectors:
        turned = turned | in_sector(bearing(F.col("aspect")), F.lit(a), F.lit(b))
    return rows.withColumn("exposed", (F.degrees("slope") >= STEEP) & high & turned)


def danger(rows: DataFrame, problems: DataFrame) -> DataFrame:
    """mesh_id, fid, level, colour: the level of the last problem that a face is exposed to, 0 without one.

    problems: problem_ord, level, expositions and heights as arrays of (lo, hi); a handful of rows, sent to all tasks.
    """
    mean = (F.col("z0") + F.col("z1") + F.col("z2")) / 3
    b = bearing(F.col("aspect"))
    high = F.exists("heights", lambda h: (mean > h["lo"]) & (mean < h["hi"]))
    turned = F.exists("expositions", lambda e: in_sector(b, e["lo"], e["hi"]))
    steep = rows.where(F.degrees("slope") > STEEP)
    hit = steep.join(F.broadcast(problems), high & turned).groupBy("mesh_id", "fid").agg(F.max_by("level", "problem_ord").alias("level"))
    out = rows.select("mesh_id", "fid").join(hit, ["mesh_id", "fid"], "left").withColumn("level", F.coalesce("level", F.lit(0)))
    return out.withColumn("colour", F.when(F.col("level") > 0, F.get(F.array(*map(F.lit, DANGER)), F.col("level") - 1)))


def decode_heights(fill: Column, h1: Column, h2: Column) -> Column:
    """Height intervals of a warning: 1 above h1, 2 below h1, 3 outside h2..h1, 4 between; 20000 stands for no bound."""
    def span(a: Column, b: Column) -> Column:
        return F.struct(a.cast("double").alias("lo"), b.cast("double").alias("hi"))

    top, zero = F.lit(20000.0), F.lit(0.0)
    return F.when(fill == 1, F.array(span(h1, top))).when(fill == 2, F.array(span(zero, h1))).when(fill == 3, F.array(span(h1, top), span(zero, h2))).when(fill == 4, F.array(span(h2, h1)))


def height_grey(vertex: DataFrame) -> DataFrame:
    """mesh_id, vid, grey: from 0.5 at a mesh's lowest vertex to 1 at its highest; 0.5 on flat meshes."""
    mesh = Window.partitionBy("mesh_id")
    low, high = F.min("z").over(mesh), F.max("z").over(mesh)
    return vertex.select("mesh_id", "vid", (F.coalesce(F.try_divide(F.col("z") - low, 2 * (high - low)), F.lit(0.0)) + 0.5).alias("grey"))


def slope_colour(slope: Column) -> Column:
    return F.when(F.degrees(slope) > STEEP, "red").when(slope < 0.05, "blue").otherwise("white")


def dark_slope(slope: Column, keep: Column) -> Column:
    return F.when(F.degrees(slope) >= 55.0, "darkgrey").otherwise(keep)


def aspect_class(aspect: Column) -> Column:
    """0 for north, then clockwise in steps of 45 degrees, each centred on its bearing."""
    return (F.floor(F.pmod(F.degrees(aspect) + 22.5, F.lit(360.0)) / 45.0) % 8).cast("int")


def restricted(code: Column, keep: list[int]) -> Column:
    """A land-cover code if it is asked for, else 0."""
    return F.when(code.isin(keep), code).otherwise(0)
