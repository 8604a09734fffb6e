"""The corpus pipeline: five stages over ``documents``, each one operator's work.

Every stage gets what its predecessor kept, written as Parquet and read again, so a
lost executor repeats part of one stage at most.  All but the last return the columns
of ``documents``, extra ones too, whatever their names.

Null texts count as empty: they are clean, and copies of one another, so one row of them
stays.  Rows without an identifier lose to copies that have one and are never near copies.
Of copies the largest identifier stays, of near copies the least; rows that repeat an
identifier are judged each by its own text; near copies under one identifier are one document and
stay or go together.  Texts of any length are read whole.  An
empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import bagminhash, exact_dedup, queries, secret_scan, toxicity
from quillstone.sources.workspace import materialise, tidy


@tidy
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@tidy
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


@tidy
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the least doc_id stays."""
    return bagminhash.drop_near_copies(docs)


@tidy
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the text."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@tidy
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a training sequence."""
    return queries.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

#: No stage but the second can be said in SQL: classifier, signatures, random tests, tokens.
ORACLE_SQL = None


@tidy
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        # A stage's working tables go once its result is written.
        written = tidy(lambda: materialise(stage(spark, docs, sf_dir), f"pipeline-{name}"))()  # noqa: B023
        docs = written
    return STAGES[-1][1](spark, docs, sf_dir)
