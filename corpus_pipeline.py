"""The corpus pipeline: quality rules, near-duplicate removal, decontamination, mixing, token output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from solterra.llm import decontamination, mixing, quality
from solterra.llm.common import documents, written
from solterra.llm.ngram_join import distinct_documents
from solterra.llm.queries import tokenizer_path
from solterra.llm.token_output import token_output


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Null and empty texts go; each of rows that share a doc_id has its own verdict."""
    return quality.good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id; of wholly repeated rows one."""
    return distinct_documents(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; repeated rows stay or go together."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic tokens are mixed down to nothing; the other domains keep what they have. Rows equal in doc_id and text meet the same fate."""
    labelled = mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.mix(docs, labelled, {"toxic": 0.0})


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, written and read back; a null text has only the end id."""
    return token_output(docs, tokenizer_path(), end_id=2)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token output", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs


#: A classifier and a language reference are fitted on the way, which SQL does not express.
ORACLE_SQL = None
