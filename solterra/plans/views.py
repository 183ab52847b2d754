"""Terrain tables derived from the driver's tables, as DataFrames and as SQL of the same rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a raster of 8 columns, row-major."""
    v = table(spark, sf_dir, "embeddings")
    return v.select(
        F.col("vec_id").alias("raster_id"), F.floor(F.size("embedding") / 8).cast("int").alias("n_rows"), F.lit(8).alias("n_cols"),
        (7.0 * (F.col("vec_id") % 25)).alias("x_min"), (7.0 * F.floor(F.col("vec_id") / 25) + 7).cast("double").alias("y_max"), F.lit(1.0).alias("dx"), F.lit(1.0).alias("dy"),
        F.transform("embedding", lambda z: 2 * z.cast("double")).alias("vals"), F.col("label").alias("label"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(k.alias("pid"), ((k * 37 % 1750) / 10.0).alias("x"), ((k * 53 % 1400) / 10.0).alias("y"))


def observers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("oid"), (-60.0 + 5 * F.col("n_nationkey")).alias("lat"), (-180.0 + 14 * F.col("n_nationkey")).alias("lon"), (100.0 * F.col("n_regionkey")).alias("masl"))


def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct hours of the events."""
    return table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").alias("ts")).distinct()


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square with a square hole for each region."""
    k = F.col("r_regionkey").cast("double")

    def square(half: float) -> F.Column:
        x, y = 30 * k + 20, 22 * k + 20
        return F.array(*(F.struct((x + a * half).alias("x"), (y + b * half).alias("y")) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))))

    rings = F.array(F.struct(F.lit(0).alias("part"), F.lit(False).alias("hole"), square(22.0).alias("pts")), F.struct(F.lit(0).alias("part"), F.lit(True).alias("hole"), square(9.0).alias("pts")))
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("poly_id"), rings.alias("rings"))


RASTER = """raster AS (SELECT vec_id AS raster_id, (len(embedding) // 8)::INT AS n_rows, 8 AS n_cols, 7.0::DOUBLE * (vec_id % 25) AS x_min, 7.0::DOUBLE * (vec_id // 25) + 7 AS y_max, 1.0::DOUBLE AS dx, 1.0::DOUBLE AS dy, list_transform(embedding, lambda z: 2 * z::DOUBLE) AS vals, label FROM embeddings)"""
VERTEX = RASTER + """,
vertex AS (SELECT raster_id AS mesh_id, vid, x_min + (vid % 8) * dx AS x, y_max - (vid // 8) * dy AS y, vals[vid + 1] AS z FROM (SELECT *, unnest(range(len(vals))) AS vid FROM raster))"""
FACE = VERTEX + """,
quad AS (SELECT raster_id AS mesh_id, q, (q // 7) * 8 + q % 7 AS a FROM (SELECT *, unnest(range((n_rows - 1) * 7)) AS q FROM raster)),
face AS (SELECT mesh_id, 2 * q AS fid, a AS v0, a + 8 AS v1, a + 9 AS v2 FROM quad UNION ALL SELECT mesh_id, 2 * q + 1, a, a + 9, a + 1 FROM quad)"""
CORNERS = FACE + """,
corners AS (SELECT f.mesh_id, fid, v0, v1, v2, x_min + v0 % 8 AS x0, y_max - v0 // 8 AS y0, vals[v0 + 1] AS z0, x_min + v1 % 8 AS x1, y_max - v1 // 8 AS y1, vals[v1 + 1] AS z1, x_min + v2 % 8 AS x2, y_max - v2 // 8 AS y2, vals[v2 + 1] AS z2 FROM face f JOIN raster ON raster_id = f.mesh_id),
crossed AS (SELECT *, (y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0) AS c_x, (z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0) AS c_y, (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) AS c_z FROM corners),
normed AS (SELECT *, CASE WHEN c_z < 0 THEN -1 ELSE 1 END / nullif(sqrt(c_x * c_x + c_y * c_y + c_z * c_z), 0) AS s FROM crossed),
normals AS (SELECT *, s * c_x + 0.0 AS nx, s * c_y + 0.0 AS ny, s * c_z + 0.0 AS nz FROM normed),
sloped AS (SELECT *, atan2(sqrt(nx * nx + ny * ny), nz) AS slope, atan2(nx + 0.0, ny + 0.0) AS aspect FROM normals)"""
POINTS = "points AS (SELECT c_custkey AS pid, (c_custkey * 37 % 1750) / 10.0::DOUBLE AS x, (c_custkey * 53 % 1400) / 10.0::DOUBLE AS y FROM customer)"
POLYGON_EDGES = """ring AS (SELECT r_regionkey::BIGINT AS poly_id, h.hole, h.half, 30.0::DOUBLE * r_regionkey + 20 AS x, 22.0::DOUBLE * r_regionkey + 20 AS y FROM region, (VALUES (false, 22.0::DOUBLE), (true, 9.0::DOUBLE)) h(hole, half)),
edge AS (SELECT poly_id, hole, s.k, x + s.a * half AS x0, y + s.b * half AS y0, x + s.c * half AS x1, y + s.d * half AS y1 FROM ring, (VALUES (0, -1, -1, 1, -1), (1, 1, -1, 1, 1), (2, 1, 1, -1, 1), (3, -1, 1, -1, -1)) s(k, a, b, c, d))"""
