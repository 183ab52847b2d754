"""Sharding: global byte-size prefix sums from per-partition totals, cut at equal targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bytes a row takes beside its text.
OVERHEAD = 16


def shard_of(begin, n_shards: int, total: int):
    """Column: floor(begin * n_shards / total), in whole numbers, as a quotient of decimals is rounded before floor."""
    return F.call_function("div", begin.cast("decimal(20,0)") * F.lit(n_shards).cast("decimal(18,0)"), F.lit(max(1, total)).cast("decimal(20,0)")).cast("int")


def shard_by_bytes(docs: DataFrame, n_shards: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: contiguous shards of near equal bytes.

    Rows stand in ascending (doc_id, text_crc32, size), null doc_ids first; wholly equal rows are
    interchangeable. A row whose bytes begin at b of T goes to shard floor(b * n_shards / T), so that
    every shard's size is within one row of T / n_shards. slot counts from 0 in each shard. text_crc32
    is null for a null text, whose size is the overhead alone. Only ids, sizes and checksums are
    shuffled, never texts; the ranged table is written once, so that totals and sums see the same rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"), F.crc32("text").alias("text_crc32"))
    order = ["doc_id", "text_crc32", "size"]
    ranged = written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")

    # one row for each partition: what a driver can hold whatever the table's size
    totals = sorted(ranged.groupBy("part").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect(), key=lambda r: r["part"])
    before, total_b, total_n = [], 0, 0
    for r in totals:
        before.append((r["part"], total_b, total_n))
        total_b, total_n = total_b + r["b"], total_n + r["n"]
    spark = docs.sparkSession
    offsets = spark.createDataFrame(before, "part int, b0 long, n0 long")

    in_part = Window.partitionBy("part").orderBy(*order)
    summed = ranged.withColumn("b", F.sum("size").over(in_part.rowsBetween(Window.unboundedPreceding, -1))).withColumn("n", F.row_number().over(in_part) - 1)
    placed = summed.join(offsets, "part").select("doc_id", "size", "text_crc32", (F.coalesce("b", F.lit(0)) + F.col("b0")).alias("b"), (F.col("n") + F.col("n0")).alias("n"))
    shard = shard_of(F.col("b"), n_shards, total_b)
    placed = written(placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), "n"), "placed")
    first = placed.groupBy("shard").agg(F.min("n").alias("n_first"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("n") - F.col("n_first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
