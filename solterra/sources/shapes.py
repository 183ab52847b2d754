"""Polygons from files: WKB, WKT, and GML feature collections with a land-cover code."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import polygon

RINGS = "array<struct<part:int,hole:boolean,pts:array<struct<x:double,y:double>>>>"
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_RINGS = pa.list_(pa.struct([("part", pa.int32()), ("hole", pa.bool_()), ("pts", pa.list_(_POINT))]))


def wkb_rings(data: bytes | None) -> list[dict] | None:
    """Rings of a WKB polygon or multipolygon, the closing point dropped, z and m ignored; ValueError for other shapes."""
    if data is None:
        return None

    def shape(at: int, part: int) -> tuple[int, list[dict], int]:
        order = "<" if data[at] else ">"
        kind, at = struct.unpack_from(f"{order}I", data, at + 1)[0], at + 5
        if kind & 0x20000000:  # a reference system follows
            at += 4
        deep = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000) + (0, 1, 1, 2)[(kind & 0xFFFF) // 1000 % 4]
        kind = (kind & 0xFFFF) % 1000
        n, at = struct.unpack_from(f"{order}I", data, at)[0], at + 4
        if kind == 6:
            rings: list[dict] = []
            for _ in range(n):
                at, more, part = shape(at, part)
                rings += more
            return at, rings, part
        if kind != 3:
            raise ValueError(f"geometry type {kind} is no polygon")
        rings = []
        for k in range(n):
            size, at = struct.unpack_from(f"{order}I", data, at)[0], at + 4
            flat = struct.unpack_from(f"{order}{size * deep}d", data, at)
            at += 8 * size * deep
            pts = [{"x": flat[p * deep], "y": flat[p * deep + 1]} for p in range(size)]
            rings.append({"part": part, "hole": k > 0, "pts": pts[:-1] if len(pts) > 1 and pts[0] == pts[-1] else pts})
        return at, rings, part + 1

    return shape(0, 0)[1]


def from_wkb(rows: DataFrame, wkb: str = "wkb") -> DataFrame:
    """rows' poly_id and rings from binary column wkb (null: null)."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("poly_id"), pa.array([wkb_rings(v.as_py()) for v in b.column("wkb")], _RINGS)], ["poly_id", "rings"])

    return rows.select(F.col("poly_id").cast("long").alias("poly_id"), F.col(wkb).alias("wkb")).mapInArrow(run, f"poly_id long, rings {RINGS}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, poly_id, rings: a polygon for each .wkb or .wkt file under path; ValueError if path names a file of another kind."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if "." in name and not name.lower().endswith((".wkb", ".wkt")):
        raise ValueError(f"{path} is neither a .wkb nor a .wkt file")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{wkb,wkt,WKB,WKT}").load(path).select("path", "content").withColumn("poly_id", F.xxhash64("path"))
    text = F.lower("path").endswith(".wkt")
    rings = polygon.from_wkt(files.where(text).withColumn("wkt", F.trim(F.col("content").cast("string")))).unionByName(from_wkb(files.where(~text), "content"))
    return files.select("path", "poly_id").join(rings, "poly_id")


def read_gml(spark: SparkSession, path: str, code: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """poly_id, code, srs, ord, rings of the polygons of a feature collection, in the order of the file (ord).

    code names the element with the class, without prefix. With a box (x0, y0, x1, y1), those that it misses are left out
    and the others are cut to it. Each feature is one record of Spark's line reader, split at the end of
    its element, so that a file is read in pieces by many tasks.
    """
    lines = spark.read.option("lineSep", "</gml:featureMember>").text(path).select("value", F.monotonically_increasing_id().alias("ord"))
    rows = lines.select("ord", F.regexp_extract("value", rf"<(?:\w+:)?{code}[^>]*>\s*(-?\d+)\s*<", 1).try_cast("int").alias("code"), F.regexp_extract("value", 'srsName="([^"]*)"', 1).alias("srs"), F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)<gml:Polygon\b.*?</gml:Polygon>"), F.lit(0))).alias("part", "shape"))

    def ring(text, hole: bool):
        numbers = F.split(F.trim(F.regexp_replace(F.regexp_extract(text, r"(?s)<gml:coordinates[^>]*>(.*?)</gml:coordinates>", 1), r"[\s,]+", " ")), " ")
        pts = F.transform(F.sequence(F.lit(0), F.floor(F.size(numbers) / 2).cast("int") - 2), lambda k: F.struct(F.get(numbers, 2 * k).cast("double").alias("x"), F.get(numbers, 2 * k + 1).cast("double").alias("y")))
        return F.struct(F.lit(0).alias("part"), F.lit(hole).alias("hole"), pts.alias("pts"))

    def rings(name: str, hole: bool):
        return F.transform(F.regexp_extract_all("shape", F.lit(rf"(?s)<gml:{name}\b.*?</gml:{name}>"), F.lit(0)), lambda t: ring(t, hole))

    rows = rows.where("code IS NOT NULL").select(F.xxhash64("ord", "part").alias("poly_id"), "code", "srs", "ord", "part", F.concat(rings("outerBoundaryIs", False), rings("innerBoundaryIs", True)).alias("rings"))
    if box is None:
        return rows
    return rows.drop("rings").join(polygon.clip_to_box(rows, *box), "poly_id")
