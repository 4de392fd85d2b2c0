"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Every stage keeps the columns of documents; the last adds block, slot and place. Clean documents pass all filters.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, mixing, ngram_join, pii, toxicity
from tessella.llm.common import ensure_checkpoint_dir, held_out, table
from tessella.session import share_package


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the model learns from the labels of rows that are not held out."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.where(~held_out(F.col("doc_id"))))
    return toxicity.score(docs, model, keep_below=toxicity.THRESHOLD)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-duplicate links join, the one with the least doc_id; unlinked documents stay."""
    share_package(spark)
    return ngram_join.distinct_documents(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), clean_only=True)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for the personal data of their texts."""
    share_package(spark)
    return pii.pseudonymise(docs, counts=False)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their place in the mixed order."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", remove_contaminated),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
]

#: Learned scores, keyed permutations and schedules are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
