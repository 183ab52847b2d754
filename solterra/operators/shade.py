"""Sun or shade of faces. Occluders are found by an equi-join on grid buckets along the ray's ground track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import solar
from .mesh import centers, normals

EPS = 1e-9


def _hits(dx: Column, dy: Column, dz: Column) -> Column:
    """Moeller-Trumbore: the ray from (cx, cy, cz) meets the triangle p0, p1, p2 ahead of its start."""
    e1 = [F.col(f"o{c}1") - F.col(f"o{c}0") for c in "xyz"]
    e2 = [F.col(f"o{c}2") - F.col(f"o{c}0") for c in "xyz"]
    d = (dx, dy, dz)
    p = (d[1] * e2[2] - d[2] * e2[1], d[2] * e2[0] - d[0] * e2[2], d[0] * e2[1] - d[1] * e2[0])
    det = e1[0] * p[0] + e1[1] * p[1] + e1[2] * p[2]
    t = [F.col(f"c{c}") - F.col(f"o{c}0") for c in "xyz"]
    u = F.try_divide(t[0] * p[0] + t[1] * p[1] + t[2] * p[2], det)
    q = (t[1] * e1[2] - t[2] * e1[1], t[2] * e1[0] - t[0] * e1[2], t[0] * e1[1] - t[1] * e1[0])
    v = F.try_divide(d[0] * q[0] + d[1] * q[1] + d[2] * q[2], det)
    far = F.try_divide(e2[0] * q[0] + e2[1] * q[1] + e2[2] * q[2], det)
    return (F.abs(det) > 1e-14) & (u >= -EPS) & (u <= 1 + EPS) & (v >= -EPS) & (u + v <= 1 + EPS) & (far > EPS)


def _back(dx: Column, dy: Column, dz: Column) -> Column:
    """The face, by its own winding, looks away from the sun."""
    return -(F.col("nx") * dx + F.col("ny") * dy + F.col("nz") * dz) > 0


def _occluders(gathered: DataFrame) -> DataFrame:
    return gathered.select("mesh_id", F.col("fid").alias("ofid"), *(F.col(f"{c}{k}").alias(f"o{c}{k}") for k in range(3) for c in "xyz"))


def prepared(gathered: DataFrame) -> DataFrame:
    """Faces with centroid and own-winding normals, as the functions here take them."""
    return centers(normals(gathered, upward=False))


def _struck(rays: DataFrame, gathered: DataFrame, bucket: float) -> DataFrame:
    """The rows of rays(mesh_id, fid, ..., cx, cy, cz, dx, dy, dz) that meet another face of their mesh: columns before cx, distinct.

    Triangles are put into the square buckets that their bounding box covers, rays into those that their ground track
    crosses below the mesh's top; a ray meets only what shares a bucket.
    """
    slack = 1e-6 * bucket
    keys = [c for c in rays.columns if c not in ("cx", "cy", "cz", "dx", "dy", "dz")]
    d = (F.col("dx"), F.col("dy"), F.col("dz"))

    def cell(v: Column) -> Column:
        return F.floor(v / bucket)

    lo = {c: F.least(*(F.col(f"o{c}{k}") for k in range(3))) for c in "xyz"}
    hi = {c: F.greatest(*(F.col(f"o{c}{k}") for k in range(3))) for c in "xyz"}
    occ = _occluders(gathered)
    occ = occ.withColumn("bx", F.explode(F.sequence(cell(lo["x"]), cell(hi["x"])))).withColumn("by", F.explode(F.sequence(cell(lo["y"]), cell(hi["y"]))))
    tops = gathered.groupBy("mesh_id").agg(F.max(F.greatest("z0", "z1", "z2")).alias("top"), *(f(g(*(f"{c}{k}" for k in range(3)))).alias(n) for n, f, g, c in (("xa", F.min, F.least, "x"), ("xz", F.max, F.greatest, "x"), ("ya", F.min, F.least, "y"), ("yz", F.max, F.greatest, "y"))))
    rays = rays.join(tops, "mesh_id").withColumn("flat", F.sqrt(d[0] * d[0] + d[1] * d[1]))
    # ground distance to the mesh's top, and to its edge
    reach = F.when(d[2] > 0, (F.col("top") - F.col("cz")) * F.col("flat") / d[2]).otherwise(F.lit(1e300))
    edge = F.sqrt(F.pow(F.col("xz") - F.col("xa"), 2) + F.pow(F.col("yz") - F.col("ya"), 2))
    rays = rays.withColumn("reach", F.greatest(F.least(reach, edge), F.lit(0.0)) + 1e-6)
    ux, uy = (F.coalesce(F.try_divide(c, F.col("flat")), F.lit(0.0)) for c in d[:2])
    rays = rays.select(*keys, "cx", "cy", "cz", "dx", "dy", "dz", "reach", ux.alias("ux"), uy.alias("uy"))
    rays = rays.withColumns({"ex": F.col("cx") + F.col("reach") * F.col("ux"), "ey": F.col("cy") + F.col("reach") * F.col("uy")})
    # the track in each column of buckets that it crosses, a little longer than it is
    rays = rays.withColumn("bx", F.explode(F.sequence(cell(F.least("cx", "ex") - slack), cell(F.greatest("cx", "ex") + slack))))
    low, high = F.least("cy", "ey"), F.greatest("cy", "ey")

    def height(x: Column) -> Column:
        y = F.col("cy") + (F.least(F.greatest(x, F.least("cx", "ex")), F.greatest("cx", "ex")) - F.col("cx")) * F.try_divide(F.col("uy"), F.col("ux"))
        return F.least(F.greatest(y, low), high)

    enter, leave = height(F.col("bx") * bucket - slack), height((F.col("bx") + 1) * bucket + slack)
    steep = F.abs("ux") < 1e-9
    rays = rays.withColumns({"ya": F.when(steep, low).otherwise(F.least(enter, leave)), "yz": F.when(steep, high).otherwise(F.greatest(enter, leave))})
    rays = rays.select(*keys, "cx", "cy", "cz", "dx", "dy", "dz", "bx", F.explode(F.sequence(cell(F.col("ya") - slack), cell(F.col("yz") + slack))).alias("by"))
    return rays.join(occ, ["mesh_id", "bx", "by"]).where((F.col("fid") != F.col("ofid")) & _hits(*d)).select(*keys).distinct()


def shaded_by_vector(gathered: DataFrame, direction: tuple[float, float, float], bucket: float) -> DataFrame:
    """mesh_id, fid, shaded under one sun vector. Faces turned away are decided before the join.

    bucket: side of the square buckets in which rays meet faces, about twice a face's size.
    """
    faces = prepared(gathered)
    d = tuple(map(F.lit, direction))
    back = F.coalesce(_back(*d), F.lit(False))
    rays = faces.where(~back).select("mesh_id", "fid", "cx", "cy", "cz", *(c.alias(f"d{n}") for n, c in zip("xyz", d)))
    hit = _struck(rays, gathered, bucket).withColumn("hit", F.lit(True))
    return faces.select("mesh_id", "fid", back.alias("back")).join(hit, ["mesh_id", "fid"], "left").select("mesh_id", "fid", (F.col("back") | F.coalesce("hit", F.lit(False))).alias("shaded"))


def shaded_at(gathered: DataFrame, times: DataFrame, lon: Column, lat: Column, bucket: float, **options) -> DataFrame:
    """mesh_id, fid, ts, shaded: each face under its own sun. lon, lat: columns of the centroid (cx, cy) in degrees.

    Below the horizon or turned away is shade; only the rest meets other faces, in buckets as in shaded_by_vector.
    """
    faces = prepared(gathered).withColumns({"lon": lon, "lat": lat, "masl": F.col("cz")})
    suns = solar.positions(faces.select("mesh_id", "fid", "cx", "cy", "cz", "nx", "ny", "nz", "lon", "lat", "masl"), times, **options)
    dx, dy, dz = solar.sun_vector(F.col("azimuth"), F.col("elevation"))
    suns = suns.withColumns({"dx": dx, "dy": dy, "dz": dz})
    suns = suns.withColumn("decided", (F.col("elevation") < 0) | F.coalesce(_back(F.col("dx"), F.col("dy"), F.col("dz")), F.lit(False)))
    hit = _struck(suns.where(~F.col("decided")).select("mesh_id", "fid", "ts", "cx", "cy", "cz", "dx", "dy", "dz"), gathered, bucket).withColumn("hit", F.lit(True))
    return suns.select("mesh_id", "fid", "ts", "decided").join(hit, ["mesh_id", "fid", "ts"], "left").select("mesh_id", "fid", "ts", (F.col("decided") | F.coalesce("hit", F.lit(False))).alias("shaded"))


def time_series(start: Column, end: Column, seconds: int) -> Column:
    """Array of instants from start to end, both included where the step meets it."""
    return F.sequence(start, end, F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds)))
