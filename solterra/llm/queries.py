"""The registered queries of the operators in this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language_id, line_dedup, mixing, pii, quality
from .common import documents
from .ngram_join import ngram_join
from .ngram_sql import SQL as NGRAM_SQL
from .sharding import shard_by_bytes
from .token_counts import token_counts
from .token_output import token_output


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(documents(spark, sf_dir), tokenizer_path(), end_id=2)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir)).drop("th", "class")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "contaminated", "n_items", F.array_join("items", ",").alias("items"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(documents(spark, sf_dir), 40)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.mixing(documents(spark, sf_dir), labelled, {"high": 0.9, "low": 0.1, "toxic": 0.0})


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(documents(spark, sf_dir)))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", F.md5(F.encode("text", "utf-8")).alias("text_md5"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_ngram_join": op2_ngram_join,
    "op3_decontamination": op3_decontamination,
    "op4_sharding": op4_sharding,
    "op5_mixing": op5_mixing,
    "op6_language_id": op6_language_id,
    "op7_quality": op7_quality,
    "op8_pii": op8_pii,
    "op9_line_dedup": op9_line_dedup,
    "op10_token_counts": op10_token_counts,
}
ORACLE_SQL: dict[str, str] = {
    "op2_ngram_join": NGRAM_SQL,
    "op3_decontamination": decontamination.SQL,
    "op9_line_dedup": line_dedup.SQL,
}
