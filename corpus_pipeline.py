"""The corpus pipeline: stages that each apply one operator to what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of ``documents``, also extra ones. Null and
empty texts have no words and go in the first stage; null ids are ids like others, but for the second stage.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm import bpe, decontaminate, near_dedup, quality_rules, secrets
from driftwell.llm.common import written
from driftwell.llm.registry import table, vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality_rules.filtered(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five words, similarity 0.8. Of rows that repeat an id one stays, and
    of rows without an id one of each set of shingles that no row with an id has."""
    return near_dedup.filtered(docs, size=5, percent=80)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.filtered(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced inside the texts; n_chars follows."""
    model = secrets.train(secrets.labelled_samples(spark, table(spark, sf_dir, "benchmark")))
    return secrets.redacted(docs, model).withColumn("n_chars", F.length("text").cast("long"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, n_tokens and the hashes of its ids and of the decoded text."""
    return bpe.encode(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("near dedup", dedup_stage),
    ("decontamination", decontaminate_stage),
    ("secrets", secrets_stage),
    ("bpe", bpe_stage),
]
#: Several stages cannot be said in SQL (band hashes aside, the Markov models and the tokenizer).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
