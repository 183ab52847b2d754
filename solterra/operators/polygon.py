"""Polygons: rings in one array column (schemas.POLYGON) or as edges (schemas.EDGE)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edges(polygon: DataFrame) -> DataFrame:
    """poly_id, part, hole, k, x0, y0, x1, y1: each ring's edges, the last back to the first point."""
    rings = polygon.select("poly_id", F.explode("rings").alias("r")).select("poly_id", "r.part", "r.hole", "r.pts")
    p = F.col("pts")
    each = F.transform(p, lambda a, k: F.struct(k.alias("k"), a["x"].alias("x0"), a["y"].alias("y0"), F.get(p, (k + 1) % F.size(p))["x"].alias("x1"), F.get(p, (k + 1) % F.size(p))["y"].alias("y1")))
    return rings.select("poly_id", "part", "hole", F.inline(each))


def signed_area(pts: Column) -> Column:
    """Positive for counter-clockwise rings."""
    each = F.transform(pts, lambda a, k: a["x"] * F.get(pts, (k + 1) % F.size(pts))["y"] - F.get(pts, (k + 1) % F.size(pts))["x"] * a["y"])
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / 2


def oriented(polygon: DataFrame) -> DataFrame:
    """Outer rings counter-clockwise, holes clockwise."""
    def turned(r: Column) -> Column:
        wrong = (signed_area(r["pts"]) < 0) != r["hole"]
        return F.struct(r["part"].alias("part"), r["hole"].alias("hole"), F.when(wrong, F.reverse(r["pts"])).otherwise(r["pts"]).alias("pts"))

    return polygon.withColumn("rings", F.transform("rings", turned))


def bounds(polygon: DataFrame) -> DataFrame:
    """poly_id, xa, ya, xz, yz."""
    e = edges(polygon)
    return e.groupBy("poly_id").agg(F.min("x0").alias("xa"), F.min("y0").alias("ya"), F.max("x0").alias("xz"), F.max("y0").alias("yz"))


def containing(points: DataFrame, polygon: DataFrame, cell: float, boundary: bool = False) -> DataFrame:
    """pid, poly_id: polygons that hold a point, in any of their parts. Points on an outer edge or corner are held if boundary is
    true, those on a hole's edge always. Candidates meet by an equi-join on the grid cells of the polygon's
    box; the test counts the edges of a part that a ray to the right crosses."""
    box = bounds(polygon)
    cells = box.withColumn("gx", F.explode(F.sequence(F.floor(F.col("xa") / cell), F.floor(F.col("xz") / cell)))).withColumn("gy", F.explode(F.sequence(F.floor(F.col("ya") / cell), F.floor(F.col("yz") / cell))))
    at = points.select("pid", "x", "y").withColumns({"gx": F.floor(F.col("x") / cell), "gy": F.floor(F.col("y") / cell)})
    near = at.join(cells, ["gx", "gy"]).where(F.col("x").between(F.col("xa"), F.col("xz")) & F.col("y").between(F.col("ya"), F.col("yz"))).select("pid", "x", "y", "poly_id")
    x, y, x0, y0, x1, y1 = map(F.col, ("x", "y", "x0", "y0", "x1", "y1"))
    side = (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)
    on = (side == 0) & x.between(F.least(x0, x1), F.greatest(x0, x1)) & y.between(F.least(y0, y1), F.greatest(y0, y1))
    crosses = ((y0 > y) != (y1 > y)) & ((side > 0) == (y1 > y0))
    met = near.join(edges(polygon), "poly_id").select("pid", "poly_id", "part", "hole", on.alias("on"), crosses.alias("crosses")).where("on OR crosses")
    hit = met.groupBy("pid", "poly_id", "part").agg(F.count_if("crosses").alias("n"), F.bool_or(F.col("on") & ~F.col("hole")).alias("outer"), F.bool_or(F.col("on") & F.col("hole")).alias("inner"))
    return hit.where(F.when(F.col("outer"), F.lit(boundary)).otherwise(F.col("inner") | (F.col("n") % 2 == 1))).select("pid", "poly_id").distinct()


def first_match(points: DataFrame, polygon: DataFrame, order: str, cell: float, required: bool = False) -> DataFrame:
    """points' pid and the first polygon, by a column of polygon, that holds it, its edges included; null where none
    does, or an error when the row is read if required."""
    found = containing(points, polygon, cell, boundary=True).join(polygon.select("poly_id", order), "poly_id")
    first = found.groupBy("pid").agg(F.min_by("poly_id", F.struct(order, "poly_id")).alias("poly_id"))
    rows = points.select("pid").join(first, "pid", "left")
    if required:
        rows = rows.withColumn("poly_id", F.coalesce("poly_id", F.raise_error(F.concat(F.lit("no polygon holds point "), F.col("pid").cast("string"))).cast("long")))
    return rows


def from_points(spark, poly_id: int, points) -> DataFrame:
    """A polygon of one ring from x, y, x, y, ... or from pairs; ValueError for other shapes or fewer than three points."""
    import numpy as np

    a = np.asarray(points, dtype=float)
    if a.ndim == 1 and len(a) % 2 == 0:
        a = a.reshape(-1, 2)
    if a.ndim != 2 or a.shape[1] != 2 or len(a) < 3:
        raise ValueError("points have to be an even number of coordinates, or pairs, of three points or more")
    return spark.createDataFrame([(poly_id, [(0, False, [(float(x), float(y)) for x, y in a])])], "poly_id long, rings array<struct<part:int,hole:boolean,pts:array<struct<x:double,y:double>>>>")


def transformed(polygon: DataFrame, source: int, target: int) -> DataFrame:
    """Rings in another coordinate system (EPSG codes, see functions.crs); unchanged if it is the same."""
    from ..functions import crs

    if source == target:
        return polygon

    def moved(p: Column) -> Column:
        x, y = crs.transform(p["x"], p["y"], source, target)
        return F.struct(x.alias("x"), y.alias("y"))

    return polygon.withColumn("rings", F.transform("rings", lambda r: F.struct(r["part"].alias("part"), r["hole"].alias("hole"), F.transform(r["pts"], moved).alias("pts"))))


def clip_to_box(polygon: DataFrame, xa: float, ya: float, xz: float, yz: float) -> DataFrame:
    """Each ring cut to a rectangle by Sutherland and Hodgman's method; rings that vanish are left out."""
    def cut(pts: Column, c: str, bound: float, above: bool) -> Column:
        other = "y" if c == "x" else "x"

        def inside(p: Column) -> Column:
            return p[c] >= bound if above else p[c] <= bound

        def meet(p: Column, q: Column) -> Column:
            t = (bound - p[c]) / F.nullif(q[c] - p[c], F.lit(0.0))
            o = p[other] + t * (q[other] - p[other])
            at = {c: F.lit(float(bound)), other: o}
            return F.struct(at["x"].alias("x"), at["y"].alias("y"))

        def step(q: Column, k: Column) -> Column:
            p = F.get(pts, F.pmod(k - 1, F.size(pts)))
            return F.when(inside(p) & inside(q), F.array(q)).when(inside(q), F.array(meet(p, q), q)).when(inside(p), F.array(meet(p, q))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))

        return F.flatten(F.transform(pts, step))

    def clipped(c: str, bound: float, above: bool):
        return lambda a: cut(a, c, bound, above)

    rings = polygon.select("poly_id", F.explode("rings").alias("r")).select("poly_id", "r.part", "r.hole", "r.pts")
    pts = F.col("pts")
    for side in (("x", xa, True), ("x", xz, False), ("y", ya, True), ("y", yz, False)):
        # a lambda's variable, so that each cut evaluates the one before once
        pts = F.flatten(F.transform(F.array(pts), clipped(*side)))
    rings = rings.select("poly_id", "part", "hole", pts.alias("pts")).groupBy("poly_id", "part", "hole").agg(F.collect_list("pts").alias("pts"))
    rings = rings.select("poly_id", "part", "hole", F.explode("pts").alias("pts")).where(F.size("pts") >= 3)
    return rings.groupBy("poly_id").agg(F.sort_array(F.collect_list(F.struct("part", "hole", "pts"))).alias("rings"))


def from_wkt(rows: DataFrame, wkt: str = "wkt") -> DataFrame:
    """rows' poly_id and rings from POLYGON or MULTIPOLYGON text; the closing point is dropped."""
    body = F.regexp_extract(F.upper(wkt), r"^\s*(?:MULTI)?POLYGON\s*\((.*)\)\s*$", 1)
    parts = F.when(F.upper(wkt).startswith("MULTI"), F.split(body, r"\)\s*\)\s*,\s*\(\s*\(")).otherwise(F.array(body))

    def ring(text: Column) -> Column:
        pts = F.transform(F.split(F.trim(F.regexp_replace(text, "[()]", "")), r"\s*,\s*"), lambda p: F.struct(F.element_at(F.split(p, r"\s+"), 1).cast("double").alias("x"), F.element_at(F.split(p, r"\s+"), 2).cast("double").alias("y")))
        return F.slice(pts, F.lit(1), F.size(pts) - 1)

    each = F.flatten(F.transform(parts, lambda part, n: F.transform(F.split(part, r"\)\s*,\s*\("), lambda t, k: F.struct(n.alias("part"), (k > 0).alias("hole"), ring(t).alias("pts")))))
    return rows.select("poly_id", each.alias("rings"))


def ranked_first(found: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key."""
    return found.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
