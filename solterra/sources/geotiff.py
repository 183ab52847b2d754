"""GeoTIFF files as raster tables.

Spark's binaryFile source lists and reads the files, so any path that Spark can open will do; each file is decoded
by numpy in the task that read it. Classic and big TIFF, strips and tiles, no compression, LZW, Deflate and PackBits,
horizontal differencing; the first band is taken. A file may have 2 GB at most (Spark's bound on a binary value).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs
from ..operators import raster as ras

# Key names of the GeoTIFF specification (OGC 19-008).
GEO_KEYS = {
    1024: "GTModelTypeGeoKey", 1025: "GTRasterTypeGeoKey", 1026: "GTCitationGeoKey",
    2048: "GeographicTypeGeoKey", 2049: "GeogCitationGeoKey", 2050: "GeogGeodeticDatumGeoKey", 2051: "GeogPrimeMeridianGeoKey",
    2052: "GeogLinearUnitsGeoKey", 2053: "GeogLinearUnitSizeGeoKey", 2054: "GeogAngularUnitsGeoKey", 2055: "GeogAngularUnitSizeGeoKey",
    2056: "GeogEllipsoidGeoKey", 2057: "GeogSemiMajorAxisGeoKey", 2058: "GeogSemiMinorAxisGeoKey", 2059: "GeogInvFlatteningGeoKey",
    2060: "GeogAzimuthUnitsGeoKey", 2061: "GeogPrimeMeridianLongGeoKey",
    3072: "ProjectedCSTypeGeoKey", 3073: "PCSCitationGeoKey", 3074: "ProjectionGeoKey", 3075: "ProjCoordTransGeoKey",
    3076: "ProjLinearUnitsGeoKey", 3077: "ProjLinearUnitSizeGeoKey", 3078: "ProjStdParallel1GeoKey", 3079: "ProjStdParallel2GeoKey",
    3080: "ProjNatOriginLongGeoKey", 3081: "ProjNatOriginLatGeoKey", 3082: "ProjFalseEastingGeoKey", 3083: "ProjFalseNorthingGeoKey",
    3092: "ProjScaleAtNatOriginGeoKey", 4096: "VerticalCSTypeGeoKey", 4097: "VerticalCitationGeoKey", 4098: "VerticalDatumGeoKey", 4099: "VerticalUnitsGeoKey",
}
#: TIFF field types as struct codes; a rational is two whole numbers.
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q"}
WIDTH, LENGTH, BITS, COMPRESSION, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILES, TILE_BYTES, FORMAT = 322, 323, 324, 325, 339
SCALE, TIE_POINT, KEY_DIRECTORY, KEY_DOUBLES, KEY_ASCII = 33550, 33922, 34735, 34736, 34737

HEADER = "path string, n_rows int, n_cols int, x_min double, y_max double, dx double, dy double, info map<string,string>"


def tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and the fields of the first directory."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    magic = struct.unpack_from(f"{order or '<'}H", data, 2)[0] if len(data) >= 8 else 0
    if order is None or magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]
    n = struct.unpack_from(order + ("Q" if big else "H"), data, at)[0]
    at += 8 if big else 2
    found = {}
    for k in range(n):
        place = at + k * (20 if big else 12)
        tag, kind = struct.unpack_from(f"{order}HH", data, place)
        count = struct.unpack_from(order + ("Q" if big else "I"), data, place + 4)[0]
        if kind not in TYPES:
            continue
        size = struct.calcsize(f"<{TYPES[kind]}") * count
        value = place + (12 if big else 8)
        if size > (8 if big else 4):
            value = struct.unpack_from(order + ("Q" if big else "I"), data, value)[0]
        if kind == 2:
            found[tag] = (data[value : value + count].split(b"\0")[0].decode("latin-1"),)
        else:
            flat = struct.unpack_from(f"{order}{TYPES[kind] * count}", data, value)
            found[tag] = tuple(a / b if b else 0.0 for a, b in zip(flat[::2], flat[1::2])) if kind in (5, 10) else flat
    return order, found


def geo_keys(fields: dict[int, tuple]) -> dict[str, str]:
    """Names and values of the key directory; codes 0 and 32767 have names. ValueError without a directory of version 1."""
    directory = fields.get(KEY_DIRECTORY)
    if directory is None or len(directory) < 4 or directory[0] != 1:
        raise ValueError("no GeoTIFF key directory of version 1")
    entries = [directory[k : k + 4] for k in range(4, len(directory) - 3, 4)]
    out = {}
    for key, place, count, value in entries:
        if key == 0:
            continue
        name = GEO_KEYS.get(key, str(key))
        if place == 0:
            out[name] = {0: "undefined", 32767: "user-defined"}.get(value, str(value))
        elif place == KEY_DOUBLES:
            out[name] = repr(float(fields[KEY_DOUBLES][value]))
        elif place == KEY_ASCII:
            out[name] = fields[KEY_ASCII][0][value : value + count].replace("|", "\n").strip()
    if len(out) != directory[3]:
        raise ValueError("the key directory does not hold as many keys as it says")
    return out


def extents(fields: dict[int, tuple]) -> tuple[float, float, float, float]:
    """x_min, y_max, dx, dy from tie point and scale; without them 0, 0, 1, 1."""
    tie, scale = fields.get(TIE_POINT, (0.0,) * 6), fields.get(SCALE, (1.0, 1.0, 0.0))
    return float(tie[3] - tie[0] * scale[0]), float(tie[4] + tie[1] * scale[1]), float(scale[0]), float(scale[1])


def _lzw(data: bytes) -> bytes:
    out, table, last = [], [], b""
    bits = have = at = 0
    width = 9
    while True:
        while have < width:
            if at >= len(data):
                return b"".join(out)
            bits, have, at = (bits << 8) | data[at], have + 8, at + 1
        code = (bits >> (have - width)) & ((1 << width) - 1)
        have -= width
        bits &= (1 << have) - 1
        if code == 257:
            return b"".join(out)
        if code == 256:
            table, last, width = [bytes([k]) for k in range(256)] + [b"", b""], b"", 9
            continue
        now = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + now[:1])
        out.append(now)
        last = now
        width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)


def _packbits(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        else:
            out.append(data[at + 1 : at + 2] * (257 - n) if n > 128 else b"")
            at += 2 if n > 128 else 1
    return b"".join(out)


def decode(data: bytes) -> np.ndarray:
    """The first band as an array of rows."""
    order, f = tags(data)
    n_rows, n_cols, samples = f[LENGTH][0], f[WIDTH][0], f.get(SAMPLES, (1,))[0]
    bits, kind = f.get(BITS, (8,))[0], f.get(FORMAT, (1,))[0]
    if bits not in (8, 16, 32, 64) or kind not in (1, 2, 3):
        raise ValueError(f"samples of {bits} bits and format {kind} are not read")
    dtype = np.dtype(f"{order}{' uif'[kind]}{bits // 8}")
    unpack = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}.get(f.get(COMPRESSION, (1,))[0])
    if unpack is None:
        raise ValueError(f"compression {f[COMPRESSION][0]} is not read")
    predictor = f.get(PREDICTOR, (1,))[0]
    if predictor not in (1, 2):
        raise ValueError(f"predictor {predictor} is not read")
    apart = f.get(PLANAR, (1,))[0] == 2
    deep = 1 if apart else samples
    tiled = TILES in f
    height, width = (f[TILE_LENGTH][0], f[TILE_WIDTH][0]) if tiled else (min(f.get(STRIP_ROWS, (n_rows,))[0], n_rows), n_cols)
    across = -(-n_cols // width)
    out = np.empty((n_rows, n_cols), dtype.newbyteorder("="))
    places, sizes = (f[TILES], f[TILE_BYTES]) if tiled else (f[STRIPS], f[STRIP_BYTES])
    for k in range(across * -(-n_rows // height)):
        i, j = k // across * height, k % across * width
        rows = height if tiled else min(height, n_rows - i)
        part = np.frombuffer(unpack(data[places[k] : places[k] + sizes[k]]), dtype, rows * width * deep).reshape(rows, width, deep)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=dtype.newbyteorder("="))
        out[i : i + rows, j : j + width] = part[: n_rows - i, : n_cols - j, 0]
    return out


def _header(path: str, data: bytes) -> dict:
    _, f = tags(data)
    x_min, y_max, dx, dy = extents(f)
    info = list(geo_keys(f).items()) if KEY_DIRECTORY in f else []
    return {"path": path, "n_rows": f[LENGTH][0], "n_cols": f[WIDTH][0], "x_min": x_min, "y_max": y_max, "dx": dx, "dy": dy, "info": info}


def _decoded(block_rows: int | None, values: bool):
    fields = [("path", pa.string()), ("n_rows", pa.int32()), ("n_cols", pa.int32()), *((c, pa.float64()) for c in ("x_min", "y_max", "dx", "dy")), ("info", pa.map_(pa.string(), pa.string()))]
    schema = pa.schema([*fields, ("block", pa.int32()), ("vals", pa.list_(pa.float64()))] if values else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                data = content.as_py()
                head = _header(path, data)
                if not values:
                    yield pa.RecordBatch.from_pylist([head], schema)
                    continue
                z = decode(data).astype(np.float64)
                step = block_rows or max(len(z), 1)
                for k, lo in enumerate(range(0, max(len(z) - 1, 1), step)):
                    part = z[lo : lo + step + 1]
                    row = head | {"n_rows": len(part), "y_max": head["y_max"] - lo * head["dy"], "block": k}
                    flat = pa.ListArray.from_arrays(pa.array([0, part.size], pa.int32()), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([*(pa.array([row[n]], schema.field(n).type) for n in schema.names[:-1]), flat], schema=schema)

    return run


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{tif,tiff,TIF,TIFF}").load(path).select("path", "content")


def _with_crs(rows: DataFrame) -> DataFrame:
    return rows.withColumn("crs", F.concat(F.lit("EPSG:"), crs.from_geokeys(F.col("info")).cast("string")))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """path, n_rows, n_cols, x_min, y_max, dx, dy, info (keys), crs, raster_id: a row for each file under path; no cell is decoded."""
    return _with_crs(_files(spark, path).mapInArrow(_decoded(None, False), HEADER)).withColumn("raster_id", F.xxhash64("path"))


def rasters(files: DataFrame, block_rows: int | None = None) -> DataFrame:
    """read's rows from a table of path and content."""
    rows = files.select("path", "content").mapInArrow(_decoded(block_rows, True), f"{HEADER}, block int, vals array<double>")
    return _with_crs(rows).withColumn("raster_id", F.xxhash64("path", "block") if block_rows else F.xxhash64("path"))


def read(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, block_rows: int | None = None) -> DataFrame:
    """The files under path as a raster table, with path and block: a row for each file, or for each block_rows
    rows of one, which share their border row with the next. Cut to box (x0, y0, x1, y1) if given; rasters that miss it or only
    touch it are left out. An empty folder gives no rows; a file that is no TIFF raises."""
    rows = rasters(_files(spark, path), block_rows)
    return rows if box is None else ras.crop(ras.selected(rows, *box), *box)


def encode(z: np.ndarray, x_min: float, y_max: float, dx: float, dy: float, epsg: int | None = None) -> bytes:
    """A GeoTIFF file of one Deflate strip."""
    z = np.ascontiguousarray(z, z.dtype.newbyteorder("<"))
    strip = zlib.compress(z.tobytes())
    fields: dict[int, tuple[int, tuple]] = {
        WIDTH: (4, (z.shape[1],)), LENGTH: (4, (z.shape[0],)), BITS: (3, (8 * z.itemsize,)), COMPRESSION: (3, (8,)), STRIPS: (4, (8,)), SAMPLES: (3, (1,)),
        STRIP_ROWS: (4, (z.shape[0],)), STRIP_BYTES: (4, (len(strip),)), FORMAT: (3, ({"u": 1, "i": 2, "f": 3}[z.dtype.kind],)),
        SCALE: (12, (dx, dy, 0.0)), TIE_POINT: (12, (0.0, 0.0, 0.0, x_min, y_max, 0.0)),
    }
    if epsg is not None:
        projected = not 4000 <= epsg < 5000
        fields[KEY_DIRECTORY] = (3, (1, 1, 0, 2, 1024, 0, 1, 1 if projected else 2, 3072 if projected else 2048, 0, 1, epsg))
    directory = 8 + len(strip) + len(strip) % 2
    rest = directory + 2 + 12 * len(fields) + 4
    head, tail = b"", b""
    for tag, (kind, values) in sorted(fields.items()):
        packed = struct.pack(f"<{TYPES[kind] * len(values)}", *values)
        place = packed.ljust(4, b"\0") if len(packed) <= 4 else struct.pack("<I", rest + len(tail))
        if len(packed) > 4:
            tail += packed
        head += struct.pack("<HHI", tag, kind, len(values)) + place
    return struct.pack("<2sHI", b"II", 42, directory) + strip.ljust(directory - 8, b"\0") + struct.pack("<H", len(fields)) + head + bytes(4) + tail


def encoded(raster: DataFrame, epsg: int | None = None) -> DataFrame:
    """path (the raster_id as text) and content: each raster as a file of doubles."""

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            files = [encode(np.array(r["vals"], np.float64).reshape(r["n_rows"], r["n_cols"]), r["x_min"], r["y_max"], r["dx"], r["dy"], epsg) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([str(r["raster_id"]) for r in rows], pa.string()), pa.array(files, pa.binary())], ["path", "content"])

    return raster.select("raster_id", "n_rows", "n_cols", "x_min", "y_max", "dx", "dy", "vals").mapInArrow(run, "path string, content binary")


def coordinate_system(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> str | None:
    """The code of the first file, by path, that meets a box; ValueError if none does."""
    first = ras.selected(headers(spark, path), *box).orderBy("path").select("crs").first()
    if first is None:
        raise ValueError("no raster meets the box")
    return first["crs"]
