"""Shared pieces: the shared scratch folder, tables written there, and table readers."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, in every operator whose words are `[^\x20\x09-\x0D]+`.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"

#: Rows of a few whole numbers that go to every task at most.
SENT = 1 << 20

_own_folder: list[str] = []


def _base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="solterra-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return f"file://{_own_folder[0]}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, the folder that driver and executors share.

    Without that setting a cluster is refused; on a single machine (tests) a temporary folder takes its place.
    """
    return f"{_base(spark)}/solterra/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the scratch folder, read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Tables:
    """Written tables of one computation, removed together once its result is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.made = spark, scratch(spark, name), 0
        self.paths: dict[str, list[str]] = {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.made += 1
        path = f"{self.path}/{self.made}-{name}"
        self.paths.setdefault(name, []).append(path)
        df.write.parquet(path)
        # shuffle files are deleted when the driver finds their plans unused: what is written needs them no more
        self.spark._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def spent(self, *names: str) -> None:
        """Removes the tables made so far with these names: what comes after reads tables written from them."""
        for name in names:
            for path in self.paths.pop(name, []):
                remove(self.spark, path)

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """df written elsewhere; the other tables go."""
        df = written(df, name)
        remove(self.spark, self.path)
        return df


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder by Hadoop's file system of its path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def kept(name: str, key, make):
    """make(), which stays with the process until another name or key is asked for: a Python worker serves many tasks, of one
    operator after another, and holds what a single one needs."""
    state = sys.__dict__.setdefault("_solterra_kept", {})
    if state.get("of") != (name, key):
        state.clear()
        state["value"] = make()
        state["of"] = (name, key)
    return state["value"]


def lean(run, stateless: bool = False):
    """run, a function of batches, after which a worker's free memory goes back to the system, as it waits beside the executor.

    With stateless, what kept() holds for another operator goes before.
    """

    def result(batches):
        if stateless:
            sys.__dict__.pop("_solterra_kept", None)
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return result


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores after it: one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text):
    """Column: the words `[^\\x20\\x09-\\x0D]+` of a text (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN, -1), lambda w: w != "")


def most_frequent(df: DataFrame, count: str, limit: int) -> DataFrame:
    """The rows whose count is above a cutoff, at most limit of them: a size that no input changes.

    The cutoff comes from a histogram with eight classes to each doubling, so a few hundred rows reach the driver.
    """
    level = F.floor(F.log2(count) * 8)
    total, cutoff = 0, None
    for r in sorted(df.groupBy(level.alias("l")).count().collect(), key=lambda r: -r["l"]):
        total += r["count"]
        if total > limit:
            break
        cutoff = r["l"]
    return df.where(F.lit(False) if cutoff is None else level >= cutoff)
