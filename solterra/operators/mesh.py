"""Meshes: a vertex table (mesh_id, vid, x, y, z) and a face table (mesh_id, fid, v0, v1, v2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid_vertices(raster: DataFrame) -> DataFrame:
    """Every node of each raster, numbered by rows."""
    rows = raster.select("raster_id", "n_cols", "x_min", "y_max", "dx", "dy", F.posexplode("vals").alias("p", "z"))
    i, j = F.floor(F.col("p") / F.col("n_cols")), F.col("p") % F.col("n_cols")
    return rows.select(F.col("raster_id").alias("mesh_id"), F.col("p").cast("long").alias("vid"), (F.col("x_min") + j * F.col("dx")).alias("x"), (F.col("y_max") - i * F.col("dy")).alias("y"), "z")


def grid_faces(raster: DataFrame) -> DataFrame:
    """Two triangles for each cell, cut from its upper left to its lower right corner, counter-clockwise."""
    n = F.col("n_cols")
    rows = raster.where((n > 1) & (F.col("n_rows") > 1)).select("raster_id", "n_cols", F.explode(F.sequence(F.lit(0), (F.col("n_rows") - 1) * (n - 1) - 1)).alias("q"))
    a = (F.floor(F.col("q") / (n - 1)) * n + F.col("q") % (n - 1)).cast("long")
    lower = F.struct((2 * F.col("q")).cast("long").alias("fid"), a.alias("v0"), (a + n).alias("v1"), (a + n + 1).alias("v2"))
    upper = F.struct((2 * F.col("q") + 1).cast("long").alias("fid"), a.alias("v0"), (a + n + 1).alias("v1"), (a + 1).alias("v2"))
    return rows.select(F.col("raster_id").alias("mesh_id"), F.inline(F.array(lower, upper)))


def grid_corners(raster: DataFrame) -> DataFrame:
    """corners of grid_vertices and grid_faces, read from the raster's own values: no join and no shuffle."""
    n = F.col("n_cols")

    def face(q: Column, fid: Column, ids: tuple[Column, ...]) -> Column:
        at = [(v, F.col("x_min") + v % n * F.col("dx"), F.col("y_max") - F.floor(v / n) * F.col("dy"), F.get(F.col("vals"), v.cast("int"))) for v in ids]
        return F.struct(fid.cast("long").alias("fid"), *(v.cast("long").alias(f"v{k}") for k, (v, *_) in enumerate(at)), *(c.alias(f"{name}{k}") for k, (_, *xyz) in enumerate(at) for name, c in zip("xyz", xyz)))

    def cell(q: Column) -> Column:
        a = (F.floor(q / (n - 1)) * n + q % (n - 1)).cast("long")
        return F.array(face(q, 2 * q, (a, a + n, a + n + 1)), face(q, 2 * q + 1, (a, a + n + 1, a + 1)))

    rows = raster.where((n > 1) & (F.col("n_rows") > 1))
    return rows.select(F.col("raster_id").alias("mesh_id"), F.inline(F.flatten(F.transform(F.sequence(F.lit(0), (F.col("n_rows") - 1) * (n - 1) - 1), cell))))


def corners(vertex: DataFrame, face: DataFrame) -> DataFrame:
    """face's columns and x0 .. z2: vertices gathered by one join on (mesh_id, vid) and one regrouping by face."""
    rest = [c for c in face.columns if c not in ("mesh_id", "fid")]
    at = face.select("mesh_id", "fid", *rest, F.posexplode(F.array("v0", "v1", "v2")).alias("corner", "vid"))
    got = at.join(vertex.select("mesh_id", "vid", "x", "y", "z"), ["mesh_id", "vid"])
    each = [F.max(F.when(F.col("corner") == k, F.col(c))).alias(f"{c}{k}") for k in range(3) for c in "xyz"]
    return got.groupBy("mesh_id", "fid").agg(*(F.first(c).alias(c) for c in rest), *each)


def _cross() -> tuple[Column, Column, Column]:
    ux, uy, uz = (F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz")
    vx, vy, vz = (F.col(f"{c}2") - F.col(f"{c}0") for c in "xyz")
    return uy * vz - uz * vy, uz * vx - ux * vz, ux * vy - uy * vx


def normals(gathered: DataFrame, upward: bool = True) -> DataFrame:
    """Adds nx, ny, nz: unit normals, turned up (or by the face's own winding); null for faces without area."""
    cx, cy, cz = _cross()
    rows = gathered.select("*", cx.alias("_x"), cy.alias("_y"), cz.alias("_z"))
    sign = F.when(F.col("_z") < 0, -1.0).otherwise(1.0) if upward else F.lit(1.0)
    norm = F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y") + F.col("_z") * F.col("_z"))
    return rows.select(*gathered.columns, *((F.try_divide(sign * F.col(f"_{c}"), norm) + 0.0).alias(f"n{c}") for c in "xyz"))


def oriented(gathered: DataFrame) -> DataFrame:
    """normals, with the vertices of faces that look down in reverse order."""
    _, _, cz = _cross()
    down = cz < 0
    return normals(gathered).withColumns({"v0": F.when(down, F.col("v2")).otherwise(F.col("v0")), "v2": F.when(down, F.col("v0")).otherwise(F.col("v2"))})


def slope(nx: str = "nx", ny: str = "ny", nz: str = "nz") -> Column:
    return F.atan2(F.sqrt(F.col(nx) * F.col(nx) + F.col(ny) * F.col(ny)), F.col(nz))


def aspect(nx: str = "nx", ny: str = "ny") -> Column:
    return F.atan2(F.col(nx), F.col(ny))


def centers(gathered: DataFrame) -> DataFrame:
    """Adds cx, cy, cz: the mean of the three vertices."""
    return gathered.withColumns({f"c{c}": (F.col(f"{c}0") + F.col(f"{c}1") + F.col(f"{c}2")) / 3 for c in "xyz"})


def point_normals(vertex: DataFrame, faces: DataFrame) -> DataFrame:
    """mesh_id, vid, nx, ny, nz: the faces' unit normals summed at each vertex, to length 1; zeros where they vanish."""
    at = faces.select("mesh_id", "nx", "ny", "nz", F.explode(F.array("v0", "v1", "v2")).alias("vid"))
    total = at.groupBy("mesh_id", "vid").agg(*(F.sum(f"n{c}").alias(f"s{c}") for c in "xyz"))
    rows = vertex.select("mesh_id", "vid").join(total, ["mesh_id", "vid"], "left")
    norm = F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy") + F.col("sz") * F.col("sz"))
    return rows.select("mesh_id", "vid", *(F.when(norm > 1e-16, F.col(f"s{c}") / norm).otherwise(0.0).alias(f"n{c}") for c in "xyz"))


def edges(face: DataFrame) -> DataFrame:
    """mesh_id, a, b: undirected edges, each once."""
    pairs = [(F.col("v0"), F.col("v1")), (F.col("v1"), F.col("v2")), (F.col("v2"), F.col("v0"))]
    each = F.array(*(F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in pairs))
    return face.select("mesh_id", F.inline(each)).distinct()


def characteristic(vertex: DataFrame, face: DataFrame) -> DataFrame:
    """mesh_id, n_vertices, n_edges, n_faces, characteristic (V - E + F)."""
    parts = vertex.groupBy("mesh_id").agg(F.count("*").alias("n_vertices"))
    parts = parts.join(edges(face).groupBy("mesh_id").agg(F.count("*").alias("n_edges")), "mesh_id", "left")
    parts = parts.join(face.groupBy("mesh_id").agg(F.count("*").alias("n_faces")), "mesh_id", "left").fillna(0)
    return parts.withColumn("characteristic", F.col("n_vertices") - F.col("n_edges") + F.col("n_faces"))


def consolidate(vertex: DataFrame, face: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices in use only, renumbered by first appearance in (fid, corner), and the faces with the new numbers."""
    at = face.select("mesh_id", "fid", F.posexplode(F.array("v0", "v1", "v2")).alias("corner", "vid"))
    first = at.groupBy("mesh_id", "vid").agg(F.min(F.struct("fid", "corner")).alias("seen"))
    number = first.select("mesh_id", "vid", (F.row_number().over(Window.partitionBy("mesh_id").orderBy("seen")) - 1).cast("long").alias("new"))
    kept = vertex.join(number, ["mesh_id", "vid"]).select("mesh_id", F.col("new").alias("vid"), "x", "y", "z")
    renamed = at.join(number, ["mesh_id", "vid"]).groupBy("mesh_id", "fid").agg(*(F.max(F.when(F.col("corner") == k, F.col("new"))).alias(f"v{k}") for k in range(3)))
    return kept, renamed


def sub_mesh(vertex: DataFrame, face: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """The faces that a predicate keeps, numbered anew in order, and their vertices, consolidated."""
    kept = face.where(keep)
    order = Window.partitionBy("mesh_id").orderBy("fid")
    return consolidate(vertex, kept.withColumn("fid", (F.row_number().over(order) - 1).cast("long")))


def expand_faces(face: DataFrame, *fields: str) -> DataFrame:
    """A face's fields at each of its three corners."""
    return face.select("mesh_id", "fid", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("corner"), *fields)


def expand_vertices(vertex: DataFrame, face: DataFrame, *fields: str) -> DataFrame:
    """A vertex's fields at each corner where it stands."""
    at = face.select("mesh_id", "fid", F.posexplode(F.array("v0", "v1", "v2")).alias("corner", "vid"))
    return at.join(vertex.select("mesh_id", "vid", *fields), ["mesh_id", "vid"]).select("mesh_id", "fid", "corner", *fields)
