"""A corpus pipeline over ``documents``: each stage is one operator of the llm folder.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a
DataFrame that is written as Parquet and read again for the next one. All but the last return the
columns of documents; the last adds where each document stands in the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latticeq.llm import decontamination, mixing, neardup, secrets, toxicity
from latticeq.llm.common import scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, trained on the labels of these documents, doesn't reject."""
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.default_categories())
    return toxicity.without_rejected(docs, chain)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingle sets are linked at a Jaccard similarity of 0.8."""
    return neardup.without_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without four fifths or more of any benchmark item's 5-word shingles."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with reported secrets replaced in their texts."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with block, slot and place in the mixture of their sources."""
    return mixing.mix_sources(docs, keep=docs.columns)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix),
]

#: The first stage is a trained classifier, which SQL can't express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
