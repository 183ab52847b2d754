"""Golden values, invariants and closed forms for the terrain operators."""

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from solterra import schemas
from solterra.functions import crs, solar
from solterra.operators import classify, mesh, polygon, raster, shade


def one_raster(spark, rows, x_min=0.0, y_max=2.0, step=1.0):
    flat = [float(z) for r in rows for z in r]
    return spark.createDataFrame([(1, len(rows), len(rows[0]), x_min, y_max, step, step, None, flat, None)], schemas.RASTER)


@pytest.fixture(scope="module")
def peak(spark):
    return one_raster(spark, [[0, 0, 0], [0, 1, 0], [0, 0, 0]])


def test_peak_counts(peak):
    row = mesh.characteristic(mesh.grid_vertices(peak), mesh.grid_faces(peak)).first()
    assert (row["n_vertices"], row["n_edges"], row["n_faces"], row["characteristic"]) == (9, 16, 8, 1)


def test_normals_point_up_and_have_length_one(peak):
    rows = mesh.normals(mesh.corners(mesh.grid_vertices(peak), mesh.grid_faces(peak))).collect()
    assert len(rows) == 8
    assert all(r["nz"] > 0 and abs(r["nx"] ** 2 + r["ny"] ** 2 + r["nz"] ** 2 - 1) < 1e-12 for r in rows)


def test_degenerate_face_has_null_normal(spark):
    v = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 1.0, 1.0, 1.0)], schemas.VERTEX)
    f = spark.createDataFrame([(1, 0, 0, 1, 1)], schemas.FACE)
    assert mesh.normals(mesh.corners(v, f)).first()["nz"] is None


def test_sub_mesh_of_two_faces(peak):
    v, f = mesh.sub_mesh(mesh.grid_vertices(peak), mesh.grid_faces(peak), F.col("fid") < 2)
    assert f.count() == 2 and v.count() == 4
    assert {x for r in f.collect() for x in (r["v0"], r["v1"], r["v2"])} == {0, 1, 2, 3}


def test_crop_shape(spark):
    r = one_raster(spark, [[2.0] * 16 for _ in range(24)], y_max=23.0)
    row = raster.crop(r, 0.0, 12.0, 16.0, 23.0).first()
    assert (row["n_rows"], row["n_cols"], row["y_max"], len(row["vals"])) == (12, 16, 23.0, 192)


def test_pixel_lookup(spark):
    rows = spark.createDataFrame([(5.0, 95.0), (15.0, 85.0)], "x double, y double")
    c, r = raster.pixel(F.lit(0.0), F.lit(100.0), F.lit(10.0), F.lit(10.0), F.col("x"), F.col("y"))
    assert [tuple(x) for x in rows.select(c, r).collect()] == [(0, 0), (1, 1)]


def test_bilinear_at_last_row_and_column(peak):
    assert peak.select(raster.bilinear(F.lit(2.0), F.lit(0.0))).first()[0] == 0.0
    assert peak.select(raster.bilinear(F.lit(0.5), F.lit(1.5))).first()[0] == 0.25


def test_sun_golden_case(spark):
    site = spark.createDataFrame([(39.742476, -105.1786, 1830.14)], "lat double, lon double, masl double")
    at = spark.sql("SELECT timestamp'2003-10-17 19:30:30' AS ts")
    r = solar.positions(site, at, dt=67.0).select("azimuth", (90 - solar.refraction(F.col("elevation"), F.lit(820.0), F.lit(11.0))).alias("z")).first()
    assert abs(r["azimuth"] - 194.34024) < 1e-4 and abs(r["z"] - 50.11162) < 1e-4


def test_julian_day(spark):
    assert spark.range(1).select(solar.calendar_julian_day(F.lit(2000), F.lit(1), F.lit(1.5))).first()[0] == 2451545.0


def test_delta_t_modes(spark):
    got = spark.range(1).select(solar.delta_t(F.lit(2019)), solar.delta_t(F.lit(2019), "published")).first()
    assert abs(got[0] - 3148.08) < 1 and abs(got[1] - 106.7) < 1


def test_utm_round_trip_and_known_point(spark):
    p = spark.createDataFrame([(15.0, 0.0), (12.5, 60.2), (16.0, -33.0)], "lon double, lat double")
    x, y = crs.to_utm(F.col("lon"), F.col("lat"), 32633)
    rows = p.select("lon", "lat", x.alias("x"), y.alias("y"))
    a, b = crs.from_utm(F.col("x"), F.col("y"), 32633)
    for r in rows.select("lon", "lat", "x", "y", a.alias("a"), b.alias("b")).collect():
        assert abs(r["a"] - r["lon"]) < 1e-9 and abs(r["b"] - r["lat"]) < 1e-9
    assert abs(rows.first()["x"] - 500000) < 1e-6 and abs(rows.first()["y"]) < 1e-6


def test_shadow_of_a_wall_has_its_length(spark):
    """A wall of height 2 across a plain: under a sun at 45 degrees the shadow is 2 long."""
    rows = [[2.0 if j == 4 else 0.0 for j in range(12)] for _ in range(4)]
    r = one_raster(spark, rows, y_max=3.0)
    g = mesh.corners(mesh.grid_vertices(r), mesh.grid_faces(r))
    sun = solar.vector_of(270.0, 45.0)
    far = mesh.centers(g).select("mesh_id", "fid", "cx")
    got = shade.shaded_by_vector(g, sun, 2.0).join(far, ["mesh_id", "fid"]).collect()
    assert all(x["shaded"] == (4 < x["cx"] < 6) for x in got if x["cx"] > 5)
    assert {(x["fid"], x["shaded"]) for x in got} == {(x["fid"], x["shaded"]) for x in shade.shaded_by_vector(g, sun, 0.7).collect()} == {(x["fid"], x["shaded"]) for x in shade.shaded_by_vector(g, sun, 100.0).collect()}


def test_point_in_polygon_with_hole_and_wkt(spark):
    text = [(1, "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"), (2, "MULTIPOLYGON (((20 0, 22 0, 22 2, 20 2, 20 0)), ((30 0, 31 0, 31 1, 30 1, 30 0)))")]
    p = polygon.from_wkt(spark.createDataFrame(text, "poly_id long, wkt string"))
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 21.0, 1.0), (4, 30.5, 0.5), (5, 50.0, 0.0)], schemas.POINT)
    got = {(r["pid"], r["poly_id"]) for r in polygon.first_match(pts, p.withColumn("ord", F.col("poly_id")), "ord", 3.0).collect()}
    assert got == {(1, 1), (2, None), (3, 2), (4, 2), (5, None)}


def test_aspect_class_wraps(spark):
    a = spark.createDataFrame([(math.radians(d),) for d in (0.0, 179.0, -179.0, 90.0, -10.0)], "a double")
    assert [r[0] for r in a.select(classify.aspect_class(F.col("a"))).collect()] == [0, 4, 4, 2, 0]


@pytest.mark.parametrize("name", ["lakes", "mesh_characteristic", "point_in_polygon"])
def test_registered_queries_run(spark, name):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_corners_of_a_grid_are_those_of_its_mesh(spark):
    r = one_raster(spark, [[float(i * i + 3 * j) for j in range(5)] for i in range(4)], y_max=3.0)
    general = mesh.corners(mesh.grid_vertices(r), mesh.grid_faces(r))
    grid = mesh.grid_corners(r)
    cols = sorted(general.columns)
    assert sorted(map(tuple, grid.select(cols).collect())) == sorted(map(tuple, general.select(cols).collect()))


def test_shade_in_every_direction_does_not_depend_on_the_buckets(spark):
    r = one_raster(spark, [[float((i * 7 + j * j * 3) % 5) for j in range(7)] for i in range(6)], y_max=5.0)
    g = mesh.grid_corners(r)
    for azimuth in (0.0, 45.0, 90.0, 133.0, 180.0, 251.0, 270.0):
        sun = solar.vector_of(azimuth, 25.0)
        each = [sorted(map(tuple, shade.shaded_by_vector(g, sun, b).collect())) for b in (0.6, 50.0)]
        assert each[0] == each[1]


def test_points_lie_in_every_raster_that_holds_them(spark):
    r = one_raster(spark, [[float(j) for j in range(8)] for _ in range(8)], y_max=7.0)
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 7.0, 7.0), (3, 3.5, 2.25), (4, 7.1, 3.0), (5, -0.1, 3.0)], "pid long, x double, y double")
    for cell in (1.0, 7.0, 100.0):
        assert {x["pid"] for x in raster.located(pts, r, cell).collect()} == {1, 2, 3}


def test_clip_cuts_corners(spark):
    p = polygon.from_wkt(spark.createDataFrame([(1, "POLYGON ((0 0, 10 0, 0 10, 0 0))"), (2, "POLYGON ((50 50, 51 50, 50 51, 50 50))")], "poly_id long, wkt string"))
    rows = polygon.clip_to_box(p, 1.0, 1.0, 6.0, 20.0).select("poly_id", F.explode("rings").alias("r")).select("poly_id", F.abs(polygon.signed_area(F.col("r.pts"))).alias("a")).collect()
    assert [(x["poly_id"], round(x["a"], 9)) for x in rows] == [(1, 27.5)]  # 32 less 4.5 beyond x = 6
