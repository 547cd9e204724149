"""A training-corpus pipeline: stages over the documents table, each working on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.llm import queries as q
from clauseloom.llm.lines import drop_repeated_lines
from clauseloom.llm.packing import pack_power_of_two
from clauseloom.llm.partenum import jaccard_groups
from clauseloom.llm.quality import score_quality, train_quality
from clauseloom.llm.secrets import redact_secrets


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model rejects go."""
    model = train_quality(docs, q.table(spark, sf_dir, "labels"))
    return score_quality(docs, model, keep=True).where("predicted = 1").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that were met before go, and documents of which nothing else is left."""
    return drop_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id stays of each group that links reach."""
    others = jaccard_groups(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked."""
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as pieces of powers of two, a null text as its end id alone; rows that repeat are packed each."""
    return pack_power_of_two(docs, q.bpe_file(), with_ids=False)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("secret scans", secret_scans),
    ("packing", packing),
]

#: SQL can't express the line model and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; an empty table gives no pieces, and other columns are carried as far as packing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
