"""Files and archives: what is written comes back."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from solterra import schemas
from solterra.operators import mesh, polygon
from solterra.sources import archive, geotiff, shapes


def squeezed(data):
    """LZW as TIFF has it, by the encoder's rule: wider codes once entry 511, 1023 or 2047 is added."""
    codes, table, run, width, new = [(256, 9)], {bytes([k]): k for k in range(256)}, b"", 9, 258
    for k in range(len(data)):
        if run + data[k : k + 1] in table:
            run += data[k : k + 1]
            continue
        codes.append((table[run], width))
        table[run + data[k : k + 1]] = new
        width = 9 + (new >= 511) + (new >= 1023) + (new >= 2047)
        new, run = new + 1, data[k : k + 1]
        if new > 4093:
            codes.append((table[run], width))
            codes.append((256, width))
            table, run, width, new = {bytes([j]): j for j in range(256)}, b"", 9, 258
    if run:
        codes.append((table[run], width))
        width = 9 + (new >= 511) + (new >= 1023) + (new >= 2047)
    codes.append((257, width))
    bits = "".join(f"{c:0{w}b}" for c, w in codes)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def tiff(order, z, compression=1, tile=None, predictor=1):
    """A file in either byte order, with strips of three rows or with tiles."""
    z = z.astype(z.dtype.newbyteorder(order))
    n, m = z.shape
    h, w = tile or (3, m)
    parts = []
    for i in range(0, n, h):
        for j in range(0, m, w):
            p = z[i : i + h, j : j + w]
            if tile:
                p = np.pad(p, ((0, h - p.shape[0]), (0, w - p.shape[1])))
            if predictor == 2:
                p = np.diff(p, axis=1, prepend=np.zeros((len(p), 1), p.dtype)).astype(z.dtype)
            raw = p.tobytes()
            parts.append({1: bytes, 5: squeezed, 8: zlib.compress, 32773: lambda b: b"".join(bytes([len(b[k : k + 100]) - 1]) + b[k : k + 100] for k in range(0, len(b), 100))}[compression](raw))
    at, places = 8, []
    for p in parts:
        places.append(at)
        at += len(p)
    kind = {"u": 1, "i": 2, "f": 3}[z.dtype.kind]
    fields = {256: (4, [m]), 257: (4, [n]), 258: (3, [8 * z.itemsize]), 259: (3, [compression]), 317: (3, [predictor]), 339: (3, [kind]), 33550: (12, [2.0, 3.0, 0.0]), 33922: (12, [0.0, 0.0, 0.0, 100.0, 200.0, 0.0]), 34735: (3, [1, 1, 0, 3, 1024, 0, 1, 1, 1026, 34737, 5, 0, 3072, 0, 1, 32633]), 34737: (2, b"utm|x\0")}
    fields |= {322: (4, [w]), 323: (4, [h]), 324: (4, places), 325: (4, [len(p) for p in parts])} if tile else {273: (4, places), 278: (4, [h]), 279: (4, [len(p) for p in parts])}
    head, tail, rest = b"", b"", at + 2 + 12 * len(fields) + 4
    for tag, (code, values) in sorted(fields.items()):
        packed = values if code == 2 else struct.pack(f"{order}{len(values)}{geotiff.TYPES[code]}", *values)
        head += struct.pack(f"{order}HHI", tag, code, len(values)) + (packed.ljust(4, b"\0") if len(packed) <= 4 else struct.pack(f"{order}I", rest + len(tail)))
        tail += packed if len(packed) > 4 else b""
    return struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, at) + b"".join(parts) + struct.pack(f"{order}H", len(fields)) + head + bytes(4) + tail


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("how", [{}, {"compression": 5}, {"compression": 8, "predictor": 2}, {"compression": 32773}, {"tile": (16, 16), "compression": 8}])
def test_decode(order, how):
    rng = np.random.default_rng(1)
    for dtype in ("u1", "i2", "u4", "f4", "f8"):
        z = rng.integers(0, 100, (37, 41)).astype(dtype)
        if how.get("predictor") == 2 and dtype[0] == "f":
            continue
        data = tiff(order, z, **how)
        assert (geotiff.decode(data) == z).all()
        fields = geotiff.tags(data)[1]
        assert geotiff.extents(fields) == (100.0, 200.0, 2.0, 3.0)
        assert geotiff.geo_keys(fields) == {"GTModelTypeGeoKey": "1", "GTCitationGeoKey": "utm\nx", "ProjectedCSTypeGeoKey": "32633"}


def test_long_lzw():
    data = np.random.default_rng(2).integers(0, 7, 60_000).astype("u1").tobytes()
    assert geotiff._lzw(squeezed(data)) == data


def test_read_files(spark, tmp_path):
    """The upper half 2, the lower 1; cut to a box; in blocks that share a row."""
    z = np.ones((24, 16))
    z[:12] = 2
    (tmp_path / "a.tif").write_bytes(geotiff.encode(z, 0.0, 23.0, 1.0, 1.0, 32633))
    (tmp_path / "b.tif").write_bytes(geotiff.encode(z.astype("f4"), 100.0, 23.0, 1.0, 1.0))
    (tmp_path / "c.txt").write_text("no raster")
    rows = geotiff.read(spark, str(tmp_path)).orderBy("path").collect()
    assert [(r["n_rows"], r["n_cols"], r["x_min"], r["y_max"], r["crs"]) for r in rows] == [(24, 16, 0.0, 23.0, "EPSG:32633"), (24, 16, 100.0, 23.0, None)]
    assert rows[0]["vals"] == z.ravel().tolist() == rows[1]["vals"]
    (cut,) = geotiff.read(spark, str(tmp_path), (0.0, 12.0, 16.0, 23.0)).collect()
    assert (cut["n_rows"], cut["n_cols"], cut["y_max"], set(cut["vals"])) == (12, 16, 23.0, {2.0})
    whole = mesh.grid_corners(geotiff.read(spark, str(tmp_path)))
    parts = mesh.grid_corners(geotiff.read(spark, str(tmp_path), block_rows=5))
    xyz = [f"{c}{k}" for k in range(3) for c in "xyz"]
    assert sorted(map(tuple, whole.select(xyz).collect())) == sorted(map(tuple, parts.select(xyz).collect()))
    assert geotiff.headers(spark, str(tmp_path)).count() == 2
    assert geotiff.coordinate_system(spark, str(tmp_path), (1.0, 1.0, 2.0, 2.0)) == "EPSG:32633"
    with pytest.raises(ValueError):
        geotiff.coordinate_system(spark, str(tmp_path), (50.0, 0.0, 60.0, 9.0))


def test_what_is_no_tiff():
    for data in (b"", b"II", b"GIF89a....", struct.pack("<2sHI", b"II", 41, 8)):
        with pytest.raises(ValueError):
            geotiff.tags(data)
    with pytest.raises(ValueError):
        geotiff.geo_keys({})


def test_polygon_files(spark, tmp_path):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    one = struct.pack("<BII", 1, 3, 1) + struct.pack("<I10d", 5, *(c for p in square for c in p))
    two = struct.pack(">BII", 0, 6, 2) + one + struct.pack(">BII", 0, 1003, 1) + struct.pack(">I15d", 5, *(c for p in square for c in (*p, 9.0)))
    (tmp_path / "a.wkb").write_bytes(two)
    (tmp_path / "b.wkt").write_text("POLYGON ((0 0, 4 0, 4 4, 0 0))\n")
    got = {r["path"].rsplit("/", 1)[1]: r["rings"] for r in shapes.read(spark, str(tmp_path)).collect()}
    assert [(r["part"], r["hole"], [tuple(p) for p in r["pts"]]) for r in got["a.wkb"]] == [(0, False, square[:-1]), (1, False, square[:-1])]
    assert len(got["b.wkt"]) == 1 and len(got["b.wkt"][0]["pts"]) == 3
    with pytest.raises(ValueError):
        shapes.read(spark, str(tmp_path / "x.json"))
    with pytest.raises(ValueError):
        shapes.wkb_rings(struct.pack("<BIdd", 1, 1, 0.0, 0.0))


def test_gml(spark, tmp_path):
    def member(code, ring, hole=""):
        return f'<gml:featureMember><ogr:x fid="1"><ogr:geometryProperty><gml:Polygon srsName="EPSG:4326"><gml:outerBoundaryIs><gml:LinearRing><gml:coordinates>{ring}</gml:coordinates></gml:LinearRing></gml:outerBoundaryIs>{hole}</gml:Polygon></ogr:geometryProperty>\n<ogr:clc18_kode>{code}</ogr:clc18_kode></ogr:x></gml:featureMember>'

    hole = "<gml:innerBoundaryIs><gml:LinearRing><gml:coordinates>1,1 2,1 2,2 1,1</gml:coordinates></gml:LinearRing></gml:innerBoundaryIs>"
    text = '<?xml version="1.0"?><ogr:FeatureCollection>' + member(312, "0,0 4,0\n4,4 0,4 0,0", hole) + member(512, "9,9 10,9 10,10 9,9") + "</ogr:FeatureCollection>"
    (tmp_path / "cover.gml").write_text(text)
    rows = shapes.read_gml(spark, str(tmp_path / "cover.gml"), "clc18_kode").orderBy("ord").collect()
    assert [(r["code"], r["srs"], [(x["hole"], len(x["pts"])) for x in r["rings"]]) for r in rows] == [(312, "EPSG:4326", [(False, 4), (True, 3)]), (512, "EPSG:4326", [(False, 3)])]
    assert [r["code"] for r in shapes.read_gml(spark, str(tmp_path / "cover.gml"), "clc18_kode", (8.0, 8.0, 11.0, 11.0)).collect()] == [512]


def test_edges_of_polygons(spark):
    text = [(1, "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"), (2, "POLYGON ((20 0, 24 4, 20 8, 16 4, 20 0))")]
    p = polygon.from_wkt(spark.createDataFrame(text, "poly_id long, wkt string"))
    outer = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (5.0, 0.0), (10.0, 5.0), (5.0, 10.0), (0.0, 5.0), (22.0, 2.0), (16.0, 4.0), (20.0, 8.0)]
    inner, held, missed = [(4.0, 4.0), (6.0, 5.0), (5.0, 6.0)], [(1.0, 4.0), (9.9, 6.0), (20.0, 4.0), (17.0, 4.0)], [(5.0, 5.0), (11.0, 0.0), (23.0, 2.0), (17.0, 0.0)]
    pts = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(outer + inner + held + missed)], schemas.POINT)
    n = len(outer)
    for cell in (3.0, 100.0):
        assert sorted(r["pid"] for r in polygon.containing(pts, p, cell).collect()) == list(range(n, n + 7))
        assert sorted(r["pid"] for r in polygon.containing(pts, p, cell, boundary=True).collect()) == list(range(n + 7))
    with pytest.raises(Exception, match="no polygon holds point"):
        polygon.first_match(pts, p.withColumn("ord", F.col("poly_id")), "ord", 3.0, required=True).collect()


def test_polygon_from_points_and_transform(spark):
    p = polygon.from_points(spark, 1, [15.0, 60.0, 15.1, 60.0, 15.1, 60.1])
    back = polygon.transformed(polygon.transformed(p, 4326, 32633), 32633, 4326)
    assert np.allclose([(q["x"], q["y"]) for q in back.first()["rings"][0]["pts"]], [(15.0, 60.0), (15.1, 60.0), (15.1, 60.1)])
    for bad in ([1.0, 2.0, 3.0], [[1.0, 2.0, 3.0]] * 4, [0.0, 0.0, 1.0, 1.0]):
        with pytest.raises(ValueError):
            polygon.from_points(spark, 1, bad)


@pytest.fixture
def saved(spark, tmp_path):
    v = spark.createDataFrame([(1, k, x, y, 0.0) for k, (x, y) in enumerate([(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0)])], schemas.VERTEX)
    f = spark.createDataFrame([(1, 0, 0, 1, 2, 7, [0.1, 0.2, 0.3]), (1, 1, 1, 3, 2, 9, [0.4, 0.5, 0.6])], f"{schemas.FACE}, cover_type int, cover_color array<double>")
    covers = spark.createDataFrame([(7, "wood", 1, 2, 3), (8, "sea", 4, 5, 6)], "value int, name string, red int, green int, blue int")
    root = str(tmp_path / "tins")
    archive.save(root, "one", v, f, "EPSG:32633", "2020-01-01", covers, "test")
    return root, v, f


def test_archive(spark, saved):
    root, v, f = saved
    with pytest.raises(FileExistsError):
        archive.save(root, "one", v, f, "EPSG:32633", "2020-01-01")
    archive.save(root, "plain", v, f.drop("cover_type", "cover_color"), "EPSG:32633", "2020-01-02")
    assert {r["uid"]: (r["num_points"], r["num_faces"], r["face_fields"]) for r in archive.content(spark, root).collect()} == {"one": (4, 2, ["cover_type", "cover_color"]), "plain": (4, 2, [])}
    assert [tuple(c) for c in archive.info(spark, root, "one").first()["land_covers"]] == [(7, "wood", 1, 2, 3)]
    vertex, face = archive.read(spark, root, "one")
    assert sorted(map(tuple, vertex.select("vid", "x", "y", "z").collect())) == sorted(map(tuple, v.select("vid", "x", "y", "z").collect()))
    assert {r["mesh_id"] for r in face.collect()} == {"one"}
    kept, faces, color = archive.extract(spark, root, "one", 9)
    assert kept.count() == 3 and [(r["v0"], r["v1"], r["v2"]) for r in faces.collect()] == [(0, 1, 2)] and color == [0.4, 0.5, 0.6]
    for uid, code in (("one", 5), ("plain", 9)):
        with pytest.raises(ValueError):
            archive.extract(spark, root, uid, code)
    archive.delete(spark, root, "one")
    archive.delete(spark, root, "one")
    with pytest.raises(FileNotFoundError):
        archive.read(spark, root, "one")
    with pytest.raises(ValueError):
        archive.delete(spark, root, "../one")
    assert archive.content(spark, root + "/none").count() == 0


def test_shade_archive(spark, tmp_path):
    rows = spark.createDataFrame([(1.5, 0, True), (1.5, 1, False), (10.0, 0, False)], "t double, fid long, shaded boolean").select(F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("ts"), "fid", "shaded")
    root = str(tmp_path)
    archive.save_shade(root, "s", "one", rows)
    with pytest.raises(FileExistsError):
        archive.save_shade(root, "s", "one", rows)
    assert tuple(archive.shade_info(spark, root, "s").first()) == ("one", ["1.5000", "10.0000"])
    archive.save_shade(root, "s", "two", rows.where("fid = 1"), overwrite=True)
    assert tuple(archive.shade_info(spark, root, "s").first()) == ("two", ["1.5000"])


def test_off(spark, saved, tmp_path):
    _, v, f = saved
    archive.write_off(v, f, str(tmp_path / "off"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "off").glob("part-*")))
    assert text.split("\n")[:3] == ["OFF", "4 2 0", "0.0 0.0 0.0"] and text.split("\n")[-3:-1] == ["3 0 1 2", "3 1 3 2"]
