"""Rasters: one row with its extents and row-major values; node (i, j) lies at x_min + j dx, y_max - i dy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cells(raster: DataFrame) -> DataFrame:
    """raster_id, i, j, x, y, z: a row for each node."""
    rows = raster.select("raster_id", "n_cols", "x_min", "y_max", "dx", "dy", F.posexplode("vals").alias("p", "z"))
    i, j = F.floor(F.col("p") / F.col("n_cols")).cast("int"), F.col("p") % F.col("n_cols")
    return rows.select("raster_id", i.alias("i"), j.alias("j"), (F.col("x_min") + j * F.col("dx")).alias("x"), (F.col("y_max") - i * F.col("dy")).alias("y"), "z")


def x_max() -> Column:
    return F.col("x_min") + (F.col("n_cols") - 1) * F.col("dx")


def y_min() -> Column:
    return F.col("y_max") - (F.col("n_rows") - 1) * F.col("dy")


def exterior(raster: DataFrame) -> DataFrame:
    """raster_id, k, x, y: corners counter-clockwise from the lower left."""
    at = [(F.col("x_min"), y_min()), (x_max(), y_min()), (x_max(), F.col("y_max")), (F.col("x_min"), F.col("y_max"))]
    corners = F.array(*(F.struct(F.lit(k).alias("k"), x.alias("x"), y.alias("y")) for k, (x, y) in enumerate(at)))
    return raster.select("raster_id", F.inline(corners))


def indices(x: Column, y: Column) -> tuple[Column, Column]:
    """(i, j) of the node at or above and left of a point, clamped to the raster."""
    i = F.least(F.greatest(((F.col("y_max") - y) / F.col("dy")).cast("int"), F.lit(0)), F.col("n_rows") - 1)
    j = F.least(F.greatest(((x - F.col("x_min")) / F.col("dx")).cast("int"), F.lit(0)), F.col("n_cols") - 1)
    return i, j


def value(i: Column, j: Column) -> Column:
    return F.get(F.col("vals"), i * F.col("n_cols") + j)


def bilinear(x: Column, y: Column) -> Column:
    """Value interpolated in the point's cell, extrapolated outside; the last row and column use themselves as neighbours."""
    i, j = indices(x, y)
    i1, j1 = F.least(i + 1, F.col("n_rows") - 1), F.least(j + 1, F.col("n_cols") - 1)
    u = (x - F.col("x_min")) / F.col("dx") - j
    v = (F.col("y_max") - y) / F.col("dy") - i
    return (1 - v) * ((1 - u) * value(i, j) + u * value(i, j1)) + v * ((1 - u) * value(i1, j) + u * value(i1, j1))


def contains(x: Column, y: Column) -> Column:
    """Strictly inside, by more than 1e-10 of the cell's diagonal."""
    eps = 1e-10 * F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    return (x > F.col("x_min") + eps) & (x < x_max() - eps) & (y > y_min() + eps) & (y < F.col("y_max") - eps)


def crop_window(x0: Column, y0: Column, x1: Column, y1: Column) -> dict[str, Column]:
    """Rows [i0, i1) and columns [j0, j1) that cover a bounding box, clipped to the raster."""
    def clip(v: Column, most: Column) -> Column:
        return F.least(F.greatest(v.cast("int"), F.lit(0)), most)

    return {
        "i0": clip(F.floor((F.col("y_max") - y1) / F.col("dy")), F.col("n_rows")),
        "i1": clip(F.ceil((F.col("y_max") - y0) / F.col("dy")) + 1, F.col("n_rows")),
        "j0": clip(F.floor((x0 - F.col("x_min")) / F.col("dx")), F.col("n_cols")),
        "j1": clip(F.ceil((x1 - F.col("x_min")) / F.col("dx")) + 1, F.col("n_cols")),
    }


def crop(raster: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Rasters cut to a bounding box; those that it misses are left out."""
    w = crop_window(*map(F.lit, (x0, y0, x1, y1)))
    rows = raster.select("*", *(c.alias(k) for k, c in w.items())).where((F.col("i1") > F.col("i0")) & (F.col("j1") > F.col("j0")))
    line = F.transform(F.sequence(F.col("i0"), F.col("i1") - 1), lambda i: F.slice("vals", i * F.col("n_cols") + F.col("j0") + 1, F.col("j1") - F.col("j0")))
    rows = rows.withColumn("vals", F.flatten(line))
    rows = rows.withColumn("x_min", F.col("x_min") + F.col("j0") * F.col("dx")).withColumn("y_max", F.col("y_max") - F.col("i0") * F.col("dy"))
    return rows.withColumn("n_rows", F.col("i1") - F.col("i0")).withColumn("n_cols", F.col("j1") - F.col("j0")).drop("i0", "i1", "j0", "j1")


def located(points: DataFrame, raster: DataFrame, cell: float) -> DataFrame:
    """points' and raster's columns for each point and each raster whose rectangle holds it, edges included.

    They meet by an equi-join on the grid cells that a rectangle covers; cell should be about a raster's size.
    """
    def at(v: Column) -> Column:
        return F.floor(v / cell)

    near = raster.withColumn("gx", F.explode(F.sequence(at(F.col("x_min")), at(x_max())))).withColumn("gy", F.explode(F.sequence(at(y_min()), at(F.col("y_max")))))
    p = points.withColumns({"gx": at(F.col("x")), "gy": at(F.col("y"))})
    holds = F.col("x").between(F.col("x_min"), x_max()) & F.col("y").between(y_min(), F.col("y_max"))
    return p.join(near, ["gx", "gy"]).where(holds).drop("gx", "gy")


def selected(raster: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Rasters whose rectangle intersects a bounding box and does more than touch it."""
    return raster.where((x_max() > x0) & (F.col("x_min") < x1) & (F.col("y_max") > y0) & (y_min() < y1))


def pixel(x0: Column, y1: Column, dx: Column, dy: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """(column, row) of the pixel that holds a point, truncated."""
    return ((x - x0) / dx).cast("int"), ((y1 - y) / dy).cast("int")
