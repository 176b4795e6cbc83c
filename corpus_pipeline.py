"""Corpus pipeline: toxicity, quality, near copies, personal data, packing.

Each stage is ``function(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and read again
as the next stage's ``docs``. All but the last return the columns of ``documents``.

Every stage takes null and empty texts as empty, reads very long texts whole, judges repeated rows each by
their own text, keeps null ids, gives an empty table for an empty one, and reads no column but ``doc_id`` and ``text``.
Only the near-copy stage drops rows for being repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexflow.llm import packing, pii, quality, simhash, toxicity
from codexflow.llm.common import read, written
from codexflow.llm.queries import VOCABULARY, marks
from codexflow.session import new_table_path, temporary_tables

THRESHOLD = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the grammar scores under the threshold; learned from the labelled rows of the source tables."""
    model = toxicity.fit(read(spark, sf_dir, "documents"), marks(spark, sf_dir, "toxic", 4, 2))
    return toxicity.keep(docs, model, THRESHOLD)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the discriminant scores at or over the threshold."""
    model = quality.fit(read(spark, sf_dir, "documents"), marks(spark, sf_dir, "quality", 5, 0))
    return quality.keep(docs, model, THRESHOLD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share shingles of five words to a similarity of 0.8, the smallest id stays; of repeated rows one.

    SimHash fingerprints meet by multi-index hashing, the exact similarity is checked; what fingerprints leave apart meets by prefixes.
    """
    return simhash.keep_first(docs)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with entities and the terms that disclose them replaced, and ``n_chars`` of the new text."""
    clean = pii.sanitise(pii.find(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of the packed sequences."""
    return packing.pack(docs, VOCABULARY)


STAGES = [
    ("toxicity", drop_toxic), ("quality", keep_quality), ("near_copies", drop_near_copies),
    ("personal_data", remove_personal_data), ("packing", pack)]
ORACLE_SQL = None  # learned models, fingerprints and packing have no SQL counterpart; tests/llm checks against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_table_path(spark, f"stage-{name}")
        with temporary_tables(spark):  # what a stage wrote on its way goes when its result stands
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}", path)
    return docs
