"""Training-data pipeline over ``documents``: each stage works on all that the one before kept.

Stages: toxicity (documents that it rejects go), near-duplicates (one document of each group stays), benchmark
decontamination (documents that hold an item go), personal data (masked in the text), BPE encoding and decoding.
All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from starloom.llm import bpe, decontaminate, near_dedup, pii, queries, toxicity
from starloom.llm.common import table
from starloom.session import delete_folder, scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below TOXIC; learns from the labelled ones among all documents."""
    score = f"toxicity_{uuid.uuid4().hex}"  # a name that no column has
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"), into=score)
    return scored.where(F.col(score) < TOXIC).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near class."""
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; ``n_chars`` follows the text."""
    masked = pii.mask_pii(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE ids (packed, little-endian) and token counts of the documents that are left, with the decoded text."""
    into = f"bpe_{uuid.uuid4().hex}"
    coded = bpe.encode_texts(docs, queries.vocabulary_path(), into=into)
    new = ("n_tokens", "ids", "decoded")  # replace columns of these names
    return coded.select(*[c for c in docs.columns if c not in new], *[F.col(f"{into}.{c}").alias(c) for c in new])


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("bpe", encode),
]

# No SQL: learned scores, hashing, alignment and merges are beyond it; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored as Parquet and read again, then the one before it is deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete_folder(spark, before)
        before = path
    return docs
