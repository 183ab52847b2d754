"""Archives of meshes and of their shade as Parquet folders, one for each uid.

An entry's `meta` is written last: an entry without it was not saved whole and is not listed.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mesh

COVER = "array<struct<value:int,name:string,red:int,green:int,blue:int>>"
META = f"uid string, timestamp string, projection string, num_points long, num_faces long, face_fields array<string>, land_cover_type string, land_covers {COVER}"


def _place(root: str, uid: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", uid):
        raise ValueError(f"{uid!r} is no uid")
    return f"{root.rstrip('/')}/{uid}"


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _exists(spark: SparkSession, path: str) -> bool:
    fs, place = _fs(spark, path)
    return fs.exists(place)


def save(root: str, uid: str, vertex: DataFrame, face: DataFrame, projection: str, timestamp: str, land_covers: DataFrame | None = None, land_cover_type: str | None = None) -> None:
    """Writes a mesh; FileExistsError if the uid is taken. Columns of face beyond the ids are its fields.

    Of land_covers (value, name, red, green, blue) those stay whose value is a cover_type of some face.
    """
    spark, path = vertex.sparkSession, _place(root, uid)
    if _exists(spark, path):
        raise FileExistsError(path)
    vertex.select("vid", "x", "y", "z").write.parquet(f"{path}/vertex")
    face.drop("mesh_id").write.parquet(f"{path}/face")
    v, f = spark.read.parquet(f"{path}/vertex"), spark.read.parquet(f"{path}/face")
    fields = [c for c in f.columns if c not in ("fid", "v0", "v1", "v2")]
    meta = v.agg(F.count("*").alias("num_points")).join(F.broadcast(f.agg(F.count("*").alias("num_faces"))))
    covers = F.lit(None).cast(COVER)
    if land_covers is not None:
        used = f.select(F.col("cover_type").alias("value")).distinct()
        one = land_covers.join(used, "value", "left_semi").agg(F.sort_array(F.collect_list(F.struct(*(F.col(c).cast("int" if c != "name" else "string").alias(c) for c in ("value", "name", "red", "green", "blue"))))).alias("c"))
        covers, meta = F.col("c"), meta.join(F.broadcast(one))
    names = F.array(*map(F.lit, fields)).cast("array<string>")
    meta = meta.select(F.lit(uid).alias("uid"), F.lit(timestamp).alias("timestamp"), F.lit(projection).alias("projection"), "num_points", "num_faces", names.alias("face_fields"), F.lit(land_cover_type).cast("string").alias("land_cover_type"), covers.alias("land_covers"))
    meta.write.parquet(f"{path}/meta")


def read(spark: SparkSession, root: str, uid: str) -> tuple[DataFrame, DataFrame]:
    """vertex and face tables of an entry, with mesh_id = uid; FileNotFoundError without it."""
    path = _place(root, uid)
    if not _exists(spark, f"{path}/meta"):
        raise FileNotFoundError(path)
    return tuple(spark.read.parquet(f"{path}/{t}").withColumn("mesh_id", F.lit(uid)) for t in ("vertex", "face"))


def info(spark: SparkSession, root: str, uid: str) -> DataFrame:
    """One row of META; FileNotFoundError without the entry."""
    path = _place(root, uid)
    if not _exists(spark, f"{path}/meta"):
        raise FileNotFoundError(path)
    return spark.read.schema(META).parquet(f"{path}/meta")


def content(spark: SparkSession, root: str) -> DataFrame:
    """A row of META for each entry; none for an empty or absent root."""
    fs, place = _fs(spark, f"{root.rstrip('/')}/*/meta")
    if not (fs.globStatus(place) or []):
        return spark.createDataFrame([], META)
    return spark.read.schema(META).parquet(f"{root.rstrip('/')}/*/meta")


def extract(spark: SparkSession, root: str, uid: str, code: int) -> tuple[DataFrame, DataFrame, list]:
    """The faces with a cover_type, consolidated, their vertices, and the cover_color of the first of them.

    ValueError if the entry has no cover_type or cover_color, or no such face.
    """
    vertex, face = read(spark, root, uid)
    for field in ("cover_type", "cover_color"):
        if field not in face.columns:
            raise ValueError(f"{uid} has no {field}")
    first = face.where(F.col("cover_type") == code).agg(F.min_by("cover_color", "fid").alias("c"), F.count("*").alias("n")).first()
    if not first["n"]:
        raise ValueError(f"{uid} has no face of type {code}")
    return *mesh.sub_mesh(vertex, face, F.col("cover_type") == code), first["c"]


def delete(spark: SparkSession, root: str, uid: str) -> None:
    """Removes an entry; nothing happens without it."""
    fs, place = _fs(spark, _place(root, uid))
    fs.delete(place, True)


def save_shade(root: str, uid: str, tin_uid: str, shade: DataFrame, overwrite: bool = False) -> None:
    """Writes shade(ts, fid, shaded), a folder for each instant; FileExistsError for a taken uid unless overwrite."""
    spark, path = shade.sparkSession, _place(root, uid)
    if _exists(spark, path):
        if not overwrite:
            raise FileExistsError(path)
        delete(spark, root, uid)
    instant = F.format_string("%.4f", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    shade.select(instant.alias("instant"), "fid", F.col("shaded").cast("int").alias("shaded")).write.partitionBy("instant").parquet(f"{path}/shade")
    spark.range(1).select(F.lit(uid).alias("uid"), F.lit(tin_uid).alias("tin_uid")).write.parquet(f"{path}/meta")


def shade_info(spark: SparkSession, root: str, uid: str) -> DataFrame:
    """tin_uid, instants (sorted as text); FileNotFoundError without the entry."""
    path = _place(root, uid)
    if not _exists(spark, f"{path}/meta"):
        raise FileNotFoundError(path)
    instants = spark.read.schema("fid long, shaded int, instant string").parquet(f"{path}/shade").agg(F.sort_array(F.collect_set("instant")).alias("instants"))
    return spark.read.parquet(f"{path}/meta").select("tin_uid").join(F.broadcast(instants))


def off_lines(vertex: DataFrame, face: DataFrame) -> DataFrame:
    """part, id, value: the lines of an OFF file of one mesh whose ids are gapless; order by part and id and write value as text."""
    counts = vertex.agg(F.count("*").alias("n")).join(F.broadcast(face.agg(F.count("*").alias("m")))).select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("id"), F.concat(F.lit("OFF\n"), F.concat_ws(" ", "n", "m", F.lit(0))).alias("value"))
    v = vertex.select(F.lit(1).alias("part"), F.col("vid").cast("long").alias("id"), F.concat_ws(" ", *(F.col(c).cast("string") for c in "xyz")).alias("value"))
    f = face.select(F.lit(2).alias("part"), F.col("fid").cast("long").alias("id"), F.concat_ws(" ", F.lit(3), "v0", "v1", "v2").alias("value"))
    return counts.unionByName(v).unionByName(f)


def write_off(vertex: DataFrame, face: DataFrame, path: str) -> None:
    """Text files that, in the order of their names, make an OFF file."""
    off_lines(vertex, face).orderBy("part", "id").select("value").write.text(path)
