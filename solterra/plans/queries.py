"""The registered queries of the terrain operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs, solar
from ..operators import classify, mesh, polygon, shade
from ..operators import raster as ras
from ..sources import geotiff, shapes
from . import views as v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def r6(c, name: str | None = None):
    out = F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0
    return out.alias(name or c)


def q6(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in cols)


def _mesh(spark, sf):
    r = v.raster(spark, sf)
    return mesh.grid_vertices(r), mesh.grid_faces(r)


def _corners(spark, sf):
    return mesh.grid_corners(v.raster(spark, sf))


def _sloped(spark, sf):
    return mesh.normals(_corners(spark, sf)).withColumns({"slope": mesh.slope(), "aspect": mesh.aspect()})


# rasters
@query(f"WITH {v.VERTEX} SELECT mesh_id AS raster_id, (vid // 8)::INT AS i, (vid % 8)::INT AS j, x, y, {q6('z')} FROM vertex")
def raster_points(spark, sf):
    return ras.cells(v.raster(spark, sf)).select("raster_id", "i", F.col("j").cast("int").alias("j"), "x", "y", r6("z"))


@query(f"WITH {v.VERTEX} SELECT mesh_id AS raster_id, 'EPSG:32633' AS crs, (vid // 8)::INT AS i, (vid % 8)::INT AS j, x, y, {q6('z')} FROM vertex")
def geotiff_points(spark, sf):
    """The rasters as GeoTIFF files, decoded again."""
    r = geotiff.rasters(geotiff.encoded(v.raster(spark, sf), 32633)).withColumn("raster_id", F.col("path").cast("long"))
    return ras.cells(r).join(r.select("raster_id", "crs"), "raster_id").select("raster_id", "crs", "i", F.col("j").cast("int").alias("j"), "x", "y", r6("z"))


@query(f"WITH {v.RASTER} SELECT raster_id, k, CASE WHEN k IN (0, 3) THEN x_min ELSE x_min + 7 END AS x, CASE WHEN k < 2 THEN y_max - (n_rows - 1) ELSE y_max END AS y FROM raster, (VALUES (0), (1), (2), (3)) s(k)")
def raster_exterior(spark, sf):
    return ras.exterior(v.raster(spark, sf))


_AT = f"""WITH {v.RASTER}, {v.POINTS},
loc AS (SELECT p.pid, p.x, p.y, r.*, least(greatest(trunc((y_max - p.y) / dy), 0), n_rows - 1)::INT AS i, least(greatest(trunc((p.x - x_min) / dx), 0), n_cols - 1)::INT AS j
 FROM points p JOIN raster r ON p.x BETWEEN x_min AND x_min + 7 AND p.y BETWEEN y_max - (n_rows - 1) AND y_max)"""


def _at(spark, sf):
    return ras.located(v.points(spark, sf), v.raster(spark, sf), 7.0)


@query(f"{_AT} SELECT pid, raster_id, i, j FROM loc")
def get_indices(spark, sf):
    i, j = ras.indices(F.col("x"), F.col("y"))
    return _at(spark, sf).select("pid", "raster_id", i.alias("i"), j.alias("j"))


@query(f"""{_AT} SELECT pid, raster_id, round((1 - w) * ((1 - u) * vals[i * n_cols + j + 1] + u * vals[i * n_cols + j1 + 1]) + w * ((1 - u) * vals[i1 * n_cols + j + 1] + u * vals[i1 * n_cols + j1 + 1]), 6) + 0.0 AS z
 FROM (SELECT *, least(i + 1, n_rows - 1) AS i1, least(j + 1, n_cols - 1) AS j1, (x - x_min) / dx - j AS u, (y_max - y) / dy - i AS w FROM loc)""")
def bilinear(spark, sf):
    return _at(spark, sf).select("pid", "raster_id", r6(ras.bilinear(F.col("x"), F.col("y")), "z"))


@query(f"{_AT} SELECT pid, raster_id, x > x_min + 1e-10 * sqrt(2.0::DOUBLE) AND x < x_min + 7 - 1e-10 * sqrt(2.0::DOUBLE) AND y > y_max - (n_rows - 1) + 1e-10 * sqrt(2.0::DOUBLE) AND y < y_max - 1e-10 * sqrt(2.0::DOUBLE) AS inside FROM loc")
def raster_contains(spark, sf):
    return _at(spark, sf).select("pid", "raster_id", ras.contains(F.col("x"), F.col("y")).alias("inside"))


_BOX = (10.3, 9.6, 40.2, 30.7)


@query(f"""WITH {v.RASTER}, w AS (SELECT *, least(greatest(floor(y_max - {_BOX[3]}), 0), n_rows)::INT AS i0, least(greatest(ceil(y_max - {_BOX[1]}) + 1, 0), n_rows)::INT AS i1, least(greatest(floor({_BOX[0]} - x_min), 0), n_cols)::INT AS j0, least(greatest(ceil({_BOX[2]} - x_min) + 1, 0), n_cols)::INT AS j1 FROM raster)
SELECT raster_id, i1 - i0 AS n_rows, j1 - j0 AS n_cols, x_min + j0 AS x_min, y_max - i0 AS y_max, round(list_sum(list_transform(range(i0, i1), lambda i: list_sum(vals[i * 8 + j0 + 1 : i * 8 + j1]))), 6) + 0.0 AS total FROM w WHERE i1 > i0 AND j1 > j0""")
def crop(spark, sf):
    rows = ras.crop(v.raster(spark, sf), *_BOX)
    return rows.select("raster_id", "n_rows", "n_cols", "x_min", "y_max", r6(F.aggregate("vals", F.lit(0.0), lambda a, x: a + x), "total"))


@query(f"WITH {v.RASTER} SELECT raster_id FROM raster WHERE x_min + 7 > {_BOX[0]} AND x_min < {_BOX[2]} AND y_max > {_BOX[1]} AND y_max - n_rows + 1 < {_BOX[3]}")
def raster_select(spark, sf):
    return ras.selected(v.raster(spark, sf), *_BOX).select("raster_id")


@query(f"WITH {v.POINTS} SELECT pid, trunc((x - 2.5) / 3.0)::INT AS col, trunc((150.0 - y) / 4.0)::INT AS row FROM points")
def point_pixel(spark, sf):
    col, row = ras.pixel(F.lit(2.5), F.lit(150.0), F.lit(3.0), F.lit(4.0), F.col("x"), F.col("y"))
    return v.points(spark, sf).select("pid", col.alias("col"), row.alias("row"))


# meshes
@query(f"WITH {v.FACE} SELECT * FROM face")
def grid_faces(spark, sf):
    return _mesh(spark, sf)[1]


@query(f"""WITH {v.FACE}, e AS (SELECT DISTINCT mesh_id, least(a, b) AS a, greatest(a, b) AS b FROM (SELECT mesh_id, v0 AS a, v1 AS b FROM face UNION ALL SELECT mesh_id, v1, v2 FROM face UNION ALL SELECT mesh_id, v2, v0 FROM face))
SELECT p.mesh_id, p.n AS n_vertices, q.n AS n_edges, r.n AS n_faces, p.n - q.n + r.n AS characteristic FROM (SELECT mesh_id, count(*) AS n FROM vertex GROUP BY 1) p JOIN (SELECT mesh_id, count(*) AS n FROM e GROUP BY 1) q USING (mesh_id) JOIN (SELECT mesh_id, count(*) AS n FROM face GROUP BY 1) r USING (mesh_id)""")
def mesh_characteristic(spark, sf):
    return mesh.characteristic(*_mesh(spark, sf))


@query(f"WITH {v.CORNERS} SELECT mesh_id, fid, round((x0 + x1 + x2) / 3, 6) + 0.0 AS cx, round((y0 + y1 + y2) / 3, 6) + 0.0 AS cy, round((z0 + z1 + z2) / 3, 6) + 0.0 AS cz FROM corners")
def cell_centers(spark, sf):
    return mesh.centers(_corners(spark, sf)).select("mesh_id", "fid", r6("cx"), r6("cy"), r6("cz"))


@query(f"WITH {v.CORNERS} SELECT mesh_id, fid, {q6('nx', 'ny', 'nz')} FROM normals")
def surface_normals(spark, sf):
    return mesh.normals(_corners(spark, sf)).select("mesh_id", "fid", r6("nx"), r6("ny"), r6("nz"))


@query(f"WITH {v.CORNERS} SELECT mesh_id, fid, CASE WHEN fid % 3 = 0 THEN v2 ELSE v0 END AS a, v1 AS b, CASE WHEN fid % 3 = 0 THEN v0 ELSE v2 END AS c, v0, v2, {q6('nz')} FROM normals")
def orient_tin(spark, sf):
    """Every third face is turned first; orienting turns it back."""
    vertex, face = _mesh(spark, sf)
    turn = F.col("fid") % 3 == 0
    turned = face.select("mesh_id", "fid", F.when(turn, F.col("v2")).otherwise(F.col("v0")).alias("v0"), "v1", F.when(turn, F.col("v0")).otherwise(F.col("v2")).alias("v2"))
    was = turned.select("mesh_id", "fid", F.col("v0").alias("a"), F.col("v1").alias("b"), F.col("v2").alias("c"))
    return mesh.oriented(mesh.corners(vertex, turned)).join(was, ["mesh_id", "fid"]).select("mesh_id", "fid", "a", "b", "c", "v0", "v2", r6("nz"))


@query(f"""WITH {v.CORNERS}, s AS (SELECT mesh_id, vid, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM (SELECT mesh_id, unnest([v0, v1, v2]) AS vid, nx, ny, nz FROM normals) GROUP BY ALL)
SELECT mesh_id, vid, round(nx / n, 6) + 0.0 AS nx, round(ny / n, 6) + 0.0 AS ny, round(nz / n, 6) + 0.0 AS nz FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS n FROM s)""")
def point_normals(spark, sf):
    vertex, face = _mesh(spark, sf)
    return mesh.point_normals(vertex, mesh.normals(mesh.corners(vertex, face))).select("mesh_id", "vid", r6("nx"), r6("ny"), r6("nz"))


@query(f"WITH {v.CORNERS} SELECT mesh_id, fid, {q6('slope')} FROM sloped")
def slopes(spark, sf):
    return _sloped(spark, sf).select("mesh_id", "fid", r6("slope"))


@query(f"WITH {v.CORNERS} SELECT mesh_id, fid, {q6('aspect')} FROM sloped")
def aspects(spark, sf):
    return _sloped(spark, sf).select("mesh_id", "fid", r6("aspect"))


@query(f"""WITH {v.FACE}, kept AS (SELECT mesh_id, row_number() OVER (PARTITION BY mesh_id ORDER BY fid) - 1 AS fid, v0, v1, v2 FROM face WHERE fid % 5 = 0),
seen_at AS (SELECT mesh_id, fid, unnest([0, 1, 2]) AS corner, unnest([v0, v1, v2]) AS vid FROM kept),
first AS (SELECT mesh_id, vid, min(fid * 3 + corner) AS seen FROM seen_at GROUP BY ALL),
num AS (SELECT mesh_id, vid, row_number() OVER (PARTITION BY mesh_id ORDER BY seen) - 1 AS new FROM first)
SELECT mesh_id, fid, max(new) FILTER (WHERE corner = 0) AS v0, max(new) FILTER (WHERE corner = 1) AS v1, max(new) FILTER (WHERE corner = 2) AS v2 FROM seen_at JOIN num USING (mesh_id, vid) GROUP BY ALL""")
def sub_mesh(spark, sf):
    return mesh.sub_mesh(*_mesh(spark, sf), F.col("fid") % 5 == 0)[1]


@query(f"""WITH {v.FACE}, kept AS (SELECT mesh_id, fid, v0, v1, v2 FROM face WHERE fid % 7 < 2),
seen_at AS (SELECT mesh_id, fid, unnest([0, 1, 2]) AS corner, unnest([v0, v1, v2]) AS vid FROM kept),
first AS (SELECT mesh_id, vid, min(fid * 3 + corner) AS seen FROM seen_at GROUP BY ALL)
SELECT mesh_id, row_number() OVER (PARTITION BY mesh_id ORDER BY seen) - 1 AS vid, x, y, {q6('z')} FROM first JOIN vertex USING (mesh_id, vid)""")
def consolidate(spark, sf):
    vertex, face = _mesh(spark, sf)
    return mesh.consolidate(vertex, face.where(F.col("fid") % 7 < 2))[0].select("mesh_id", "vid", "x", "y", r6("z"))


@query(f"WITH {v.FACE} SELECT mesh_id, fid, corner::INT AS corner, {q6('z')} FROM (SELECT mesh_id, fid, unnest([0, 1, 2]) AS corner, unnest([v0, v1, v2]) AS vid FROM face) JOIN vertex USING (mesh_id, vid)")
def vertex_expand(spark, sf):
    vertex, face = _mesh(spark, sf)
    return mesh.expand_vertices(vertex, face, "z").select("mesh_id", "fid", "corner", r6("z"))


@query(f"WITH {v.CORNERS} SELECT mesh_id, fid, unnest([0, 1, 2])::INT AS corner, {q6('slope')} FROM sloped")
def face_expand(spark, sf):
    return mesh.expand_faces(_sloped(spark, sf), "slope").select("mesh_id", "fid", "corner", r6("slope"))


# classes and colours
@query(f"WITH {v.CORNERS} SELECT mesh_id, fid, round(slope, 6) + 0.0 AS slope, round(aspect, 6) + 0.0 AS aspect, slope < 0.01 AS lake FROM sloped")
def lakes(spark, sf):
    return _sloped(spark, sf).select("mesh_id", "fid", r6("slope"), r6("aspect"), classify.is_lake(F.col("slope")).alias("lake"))


_B = "(degrees(aspect) + CASE WHEN degrees(aspect) < 0 THEN 360 ELSE 0 END)"


@query(f"""WITH {v.CORNERS} SELECT mesh_id, fid, degrees(slope) >= 30 AND (hi BETWEEN 0.1 AND 0.4 OR lo BETWEEN 0.1 AND 0.4) AND ({_B} > 300 OR {_B} < 60 OR ({_B} > 100 AND {_B} < 150)) AS exposed
FROM (SELECT *, greatest(z0, z1, z2) AS hi, least(z0, z1, z2) AS lo FROM sloped)""")
def avalanche_exposure(spark, sf):
    return classify.exposed(_sloped(spark, sf), [(0.1, 0.4)], [(300.0, 60.0), (100.0, 150.0)]).select("mesh_id", "fid", "exposed")


@query(f"""WITH {v.CORNERS}, m AS (SELECT mesh_id, fid, degrees(slope) > 30 AS steep, {_B} AS b, (z0 + z1 + z2) / 3 AS mean FROM sloped),
l AS (SELECT mesh_id, fid, CASE WHEN steep AND mean > -9 AND mean < 0.1 AND (b > 350 OR b < 80) THEN 4 WHEN steep AND mean > 0 AND mean < 9 AND b > 40 AND b < 200 THEN 2 WHEN steep AND mean > -9 AND mean < 9 AND b > 180 AND b < 270 THEN 3 ELSE 0 END AS level FROM m)
SELECT mesh_id, fid, level, CASE level WHEN 2 THEN 'yellow' WHEN 3 THEN 'red' WHEN 4 THEN 'black' END AS colour FROM l""")
def avalanche_color(spark, sf):
    problems = spark.createDataFrame([(1, 3, [(180.0, 270.0)], [(-9.0, 9.0)]), (2, 2, [(40.0, 200.0)], [(0.0, 9.0)]), (3, 4, [(350.0, 80.0)], [(-9.0, 0.1)])], "problem_ord int, level int, expositions array<struct<lo:double,hi:double>>, heights array<struct<lo:double,hi:double>>")
    return classify.danger(_sloped(spark, sf), problems)


@query("SELECT event_id, list_sum(list_transform(h, lambda x: x[2] - x[1])) AS span FROM (SELECT event_id, CASE event_id % 5 WHEN 1 THEN [[a, 20000]] WHEN 2 THEN [[0, a]] WHEN 3 THEN [[a, 20000], [0, b]] WHEN 4 THEN [[b, a]] END AS h FROM (SELECT event_id, (event_id % 2000 + 500)::DOUBLE AS a, (event_id % 400)::DOUBLE AS b FROM events))")
def decode_heights(spark, sf):
    e = v.table(spark, sf, "events").select("event_id", (F.col("event_id") % 2000 + 500).alias("a"), (F.col("event_id") % 400).alias("b"))
    h = classify.decode_heights(F.col("event_id") % 5, F.col("a"), F.col("b"))
    return e.select("event_id", h.alias("h")).select("event_id", F.aggregate("h", F.lit(0.0), lambda a, x: a + x["hi"] - x["lo"]).alias("span"))


@query(f"WITH {v.VERTEX} SELECT mesh_id, vid, round(coalesce((z - lo) / nullif(2 * (hi - lo), 0), 0) + 0.5, 6) + 0.0 AS grey FROM vertex JOIN (SELECT mesh_id, min(z) AS lo, max(z) AS hi FROM vertex GROUP BY 1) USING (mesh_id)")
def color_height(spark, sf):
    return classify.height_grey(_mesh(spark, sf)[0]).select("mesh_id", "vid", r6("grey"))


@query(f"WITH {v.CORNERS} SELECT mesh_id, fid, CASE WHEN degrees(slope) > 30 THEN 'red' WHEN slope < 0.05 THEN 'blue' ELSE 'white' END AS colour FROM sloped")
def color_slope(spark, sf):
    return _sloped(spark, sf).select("mesh_id", "fid", classify.slope_colour(F.col("slope")).alias("colour"))


@query(f"WITH {v.CORNERS} SELECT mesh_id, fid, CASE WHEN degrees(slope) >= 55 THEN 'darkgrey' ELSE 'white' END AS colour FROM sloped")
def slope_dark(spark, sf):
    return _sloped(spark, sf).select("mesh_id", "fid", classify.dark_slope(F.col("slope"), F.lit("white")).alias("colour"))


@query(f"WITH {v.CORNERS} SELECT mesh_id, fid, (floor((({_B} + 22.5) % 360) / 45) % 8)::INT AS class FROM sloped")
def color_aspect(spark, sf):
    return _sloped(spark, sf).select("mesh_id", "fid", classify.aspect_class(F.col("aspect")).alias("class"))


@query(f"WITH {v.FACE} SELECT mesh_id, fid, label, round(label * 25 / 255.0, 6) + 0.0 AS red, label > 7 AS water FROM face JOIN raster ON raster_id = mesh_id")
def land_cover_color(spark, sf):
    """Codes meet a small dimension of colours."""
    r = v.raster(spark, sf)
    dim = spark.createDataFrame([(k, k * 25 / 255.0, k > 7) for k in range(10)], "label int, red double, water boolean")
    code = r.select(F.col("raster_id").alias("mesh_id"), "label")
    return mesh.grid_faces(r).join(code, "mesh_id").join(F.broadcast(dim), "label").select("mesh_id", "fid", "label", r6("red"), "water")


@query("SELECT vec_id AS raster_id, CASE WHEN label IN (1, 3, 5) THEN label ELSE 0 END AS code FROM embeddings")
def land_cover_filter(spark, sf):
    return v.raster(spark, sf).select("raster_id", classify.restricted(F.col("label"), [1, 3, 5]).alias("code"))


@query(f"WITH {v.FACE} SELECT label, count(*) AS n_faces, count(DISTINCT mesh_id) AS n_meshes FROM face JOIN raster ON raster_id = mesh_id GROUP BY 1")
def scene_groups(spark, sf):
    r = v.raster(spark, sf)
    return mesh.grid_faces(r).join(r.select(F.col("raster_id").alias("mesh_id"), "label"), "mesh_id").groupBy("label").agg(F.count("*").alias("n_faces"), F.count_distinct("mesh_id").alias("n_meshes"))


# polygons
@query(f"WITH {v.POLYGON_EDGES} SELECT poly_id, hole, k, x0, y0, x1, y1 FROM edge")
def polygon_edges(spark, sf):
    return polygon.edges(v.polygons(spark, sf)).select("poly_id", "hole", "k", "x0", "y0", "x1", "y1")


@query("""SELECT r_regionkey::BIGINT AS poly_id, hole, abs(area) AS area, CASE WHEN hole THEN -1 ELSE 1 END AS turn FROM region, (VALUES (false, 100.0::DOUBLE), (true, 4.0::DOUBLE)) h(hole, area)""")
def wkb_polygons(spark, sf):
    """A square with a hole for each region, as WKB, read and turned to the usual orientation."""
    import struct

    def ring(half, k):
        at = [(-half, -half), (-half, half), (half, half), (half, -half), (-half, -half)]
        return struct.pack("<I10d", 5, *(c + k for p in at for c in p)).hex()

    text = [(k, struct.pack("<BII", 1, 3, 2).hex() + ring(5.0, k) + ring(1.0, k)) for k in range(5)]
    wkb = F.unhex(F.element_at(F.create_map(*(F.lit(x) for kt in text for x in kt)), F.col("r_regionkey")))
    rows = v.table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("poly_id"), wkb.alias("wkb"))
    rings = polygon.oriented(shapes.from_wkb(rows)).select("poly_id", F.explode("rings").alias("r"))
    area = polygon.signed_area(F.col("r.pts"))
    return rings.select("poly_id", F.col("r.hole").alias("hole"), F.abs(area).alias("area"), F.signum(area).cast("int").alias("turn"))


def _inside(compare: str) -> str:
    """Points whose larger distance from a square's centre along an axis is less than its half side, and not so for its hole."""
    far = "greatest(abs(points.x - {0}.x), abs(points.y - {0}.y))"
    return f"WITH {v.POINTS}, {v.POLYGON_EDGES}, hit AS (SELECT pid, o.poly_id FROM points, ring o JOIN ring h USING (poly_id) WHERE NOT o.hole AND h.hole AND {far.format('o')} {compare} o.half AND {far.format('h')} >= h.half)"


@query(f"{_inside('<')} SELECT * FROM hit")
def point_in_polygon(spark, sf):
    return polygon.containing(v.points(spark, sf), v.polygons(spark, sf), 10.0)


@query(f"{_inside('<=')} SELECT points.pid, coalesce(min(poly_id), -1)::BIGINT AS poly_id FROM points LEFT JOIN hit USING (pid) GROUP BY 1")
def land_cover_first_match(spark, sf):
    found = polygon.first_match(v.points(spark, sf), v.polygons(spark, sf).withColumn("ord", F.col("poly_id")), "ord", 10.0)
    return found.select("pid", F.coalesce("poly_id", F.lit(-1)).alias("poly_id"))


@query(f"WITH {v.POLYGON_EDGES} SELECT poly_id, hole, round(CASE WHEN xz > xa AND yz > ya THEN (xz - xa) * (yz - ya) ELSE 0 END, 6) + 0.0 AS area FROM (SELECT poly_id, hole, greatest(min(x0), 15) AS xa, least(max(x0), 95) AS xz, greatest(min(y0), 12) AS ya, least(max(y0), 70) AS yz FROM edge GROUP BY ALL) WHERE xz >= xa AND yz >= ya")
def polygon_clip(spark, sf):
    rings = polygon.clip_to_box(v.polygons(spark, sf), 15.0, 12.0, 95.0, 70.0).select("poly_id", F.explode("rings").alias("r"))
    return rings.select("poly_id", F.col("r.hole").alias("hole"), r6(F.abs(polygon.signed_area(F.col("r.pts"))), "area"))


# coordinates and sun
@query()
def utm_round_trip(spark, sf):
    o = v.observers(spark, sf).select("oid", (F.col("lon") % 3 + 15).alias("lon"), "lat")
    x, y = crs.to_utm(F.col("lon"), F.col("lat"), 32633)
    o = o.select("oid", "lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = crs.from_utm(F.col("x"), F.col("y"), 32633)
    return o.select("oid", r6("x"), r6("y"), r6(lon - F.col("lon"), "dlon"), r6(lat - F.col("lat"), "dlat"))


@query("SELECT DISTINCT epoch(date_trunc('second', ts)) / 86400.0::DOUBLE + 2440587.5 AS jd FROM events")
def julian_day(spark, sf):
    return v.table(spark, sf, "events").select(solar.julian_day(F.col("ts")).alias("jd")).distinct()


@query("SELECT o_orderkey, round(CASE WHEN y >= 1955 AND y < 2010 THEN [31.1, 33.2, 35.7, 40.2, 45.5, 50.5, 54.3, 56.9, 60.8, 63.8, 64.7][(floor((y - 1955) / 5) + 1)::INT]::DOUBLE ELSE -20 + 32 * ((y - 1820) / 20.0::DOUBLE) * ((y - 1820) / 20.0::DOUBLE) END, 6) + 0.0 AS dt FROM (SELECT o_orderkey, (1900 + o_orderkey % 150)::INT AS y FROM orders)")
def delta_t(spark, sf):
    return v.table(spark, sf, "orders").select("o_orderkey", r6(solar.delta_t((1900 + F.col("o_orderkey") % 150).cast("int")), "dt"))


@query()
def solar_position(spark, sf):
    return solar.positions(v.observers(spark, sf), v.times(spark, sf)).select("oid", "ts", r6("azimuth"), r6("elevation"))


@query("SELECT c_custkey, round(e + (820.0 / 1010) * (283.0 / (273 + 11)) * 1.02 / (60 * tan(radians(e + 10.3 / (e + 5.11)))), 6) + 0.0 AS corrected FROM (SELECT c_custkey, (c_custkey % 90)::DOUBLE AS e FROM customer)")
def solar_refraction(spark, sf):
    e = (F.col("c_custkey") % 90).cast("double")
    return v.table(spark, sf, "customer").select("c_custkey", r6(solar.refraction(e, F.lit(820.0), F.lit(11.0)), "corrected"))


@query("SELECT c_custkey, round(degrees(acos(cos(z) * cos(w) + sin(w) * sin(z) * cos(radians(a - 180 + 10)))), 6) + 0.0 AS incidence FROM (SELECT c_custkey, radians((c_custkey % 90)::DOUBLE) AS z, radians((c_custkey % 45)::DOUBLE) AS w, (c_custkey % 360)::DOUBLE AS a FROM customer)")
def incidence(spark, sf):
    k = F.col("c_custkey")
    return v.table(spark, sf, "customer").select("c_custkey", r6(solar.incidence((k % 90).cast("double"), (k % 360).cast("double"), (k % 45).cast("double"), F.lit(-10.0)), "incidence"))


_SUN = solar.vector_of(200.0, 20.0)
_RAY = f"""d AS (SELECT {_SUN[0]!r}::DOUBLE AS dx, {_SUN[1]!r}::DOUBLE AS dy, {_SUN[2]!r}::DOUBLE AS dz),
own AS (SELECT *, (x0 + x1 + x2) / 3 AS cx, (y0 + y1 + y2) / 3 AS cy, (z0 + z1 + z2) / 3 AS cz, c_x * dx + c_y * dy + c_z * dz < 0 AS back FROM crossed, d),
p AS (SELECT a.mesh_id, a.fid, a.dx, a.dy, a.dz, b.x1 - b.x0 AS e1x, b.y1 - b.y0 AS e1y, b.z1 - b.z0 AS e1z, b.x2 - b.x0 AS e2x, b.y2 - b.y0 AS e2y, b.z2 - b.z0 AS e2z, a.cx - b.x0 AS tx, a.cy - b.y0 AS ty, a.cz - b.z0 AS tz FROM own a JOIN corners b ON a.mesh_id = b.mesh_id AND a.fid <> b.fid WHERE NOT a.back),
q AS (SELECT *, dy * e2z - dz * e2y AS px, dz * e2x - dx * e2z AS py, dx * e2y - dy * e2x AS pz, ty * e1z - tz * e1y AS qx, tz * e1x - tx * e1z AS qy, tx * e1y - ty * e1x AS qz FROM p),
s AS (SELECT *, e1x * px + e1y * py + e1z * pz AS det FROM q),
hit AS (SELECT DISTINCT mesh_id, fid FROM s WHERE abs(det) > 1e-14 AND (tx * px + ty * py + tz * pz) / det BETWEEN -1e-9 AND 1 + 1e-9 AND (dx * qx + dy * qy + dz * qz) / det >= -1e-9 AND (tx * px + ty * py + tz * pz + dx * qx + dy * qy + dz * qz) / det <= 1 + 1e-9 AND (e2x * qx + e2y * qy + e2z * qz) / det > 1e-9)"""
_SHADE = f"WITH {v.CORNERS}, {_RAY} SELECT own.mesh_id, own.fid, back OR hit.fid IS NOT NULL AS shaded FROM own LEFT JOIN hit ON own.mesh_id = hit.mesh_id AND own.fid = hit.fid"


@query(_SHADE)
def shade_vector(spark, sf):
    return shade.shaded_by_vector(_corners(spark, sf), _SUN, 2.0)


@query(f"WITH {v.CORNERS} SELECT mesh_id, fid, v0, v1, v2, {q6('x0', 'y0', 'z0', 'x1', 'y1', 'z1', 'x2', 'y2', 'z2')} FROM corners")
def gathered_corners(spark, sf):
    """Of meshes in general: vertices gathered by a join."""
    rows = mesh.corners(*_mesh(spark, sf))
    return rows.select("mesh_id", "fid", "v0", "v1", "v2", *(r6(f"{c}{k}") for k in range(3) for c in "xyz"))


@query()
def shade_time(spark, sf):
    """Three hours of a day over every raster; centroids are placed 0.01 degree apart around (10, 60)."""
    hours = spark.sql("SELECT explode(sequence(timestamp'2024-01-15 10:00:00', timestamp'2024-01-15 12:00:00', interval 1 hour)) AS ts")
    return shade.shaded_at(_corners(spark, sf), hours, 10 + F.col("cx") / 100, 60 + F.col("cy") / 100, 2.0)


@query("SELECT o_orderkey, unnest(generate_series(o_orderdate, o_orderdate + INTERVAL 2 HOUR, INTERVAL 30 MINUTE)) AS ts FROM orders")
def time_series(spark, sf):
    start = F.col("o_orderdate")
    return v.table(spark, sf, "orders").select("o_orderkey", F.explode(shade.time_series(start, start + F.expr("INTERVAL 2 HOUR"), 1800)).alias("ts"))
