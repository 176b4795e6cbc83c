"""One query per training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexflow.llm import alignment, bpe, embedding_dedup, language, nearest, packing, pii, quality, secret_scan, simhash, spelling, toxicity, warc
from codexflow.llm.common import held_out, read

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def marks(spark, sf_dir, label, parts, part):
    """(doc_id, label) of the rows one may learn from."""
    return read(spark, sf_dir, "labels").filter(~held_out("doc_id", parts, part)).select("doc_id", F.col(label).alias("label"))


@query
def op1_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, marks(spark, sf_dir, "toxic", 4, 2))
    return toxicity.score(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")


@query
def op2_nearest(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    return nearest.search(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


@query
def op3_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"), VOCABULARY)


@query
def op4_pii(spark, sf_dir):
    return pii.digest(pii.find(read(spark, sf_dir, "documents")))


@query
def op5_secrets(spark, sf_dir):
    return secret_scan.digest(secret_scan.scan(read(spark, sf_dir, "documents")))


@query
def op6_language(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = language.fit(docs.filter(~held_out("doc_id", 3, 1)))
    return language.predict(docs, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


@query
def op7_simhash(spark, sf_dir):
    found = simhash.link(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query
def op8_bpe(spark, sf_dir):
    return bpe.encode(read(spark, sf_dir, "documents"), VOCABULARY, keep_ids=False)


@query
def op9_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, marks(spark, sf_dir, "quality", 5, 0))
    return quality.score(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


@query
def op10_embedding_dedup(spark, sf_dir):
    return embedding_dedup.link(read(spark, sf_dir, "embeddings")).withColumnRenamed("component", "component_id")


@query
def op11_spelling(spark, sf_dir):
    return spelling.variants(read(spark, sf_dir, "documents"))


@query
def op12_warc(spark, sf_dir):
    return warc.checked_records(read(spark, sf_dir, "pages"))


ORACLES["op12_warc"] = """
WITH records AS (
  SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS largest FROM pages),
told AS (SELECT *, strlen(payload) >= 1000 AND largest <> page_id AS again FROM records)
SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN largest END AS refers_to
FROM told"""


@query
def op13_alignment(spark, sf_dir):
    return alignment.align(read(spark, sf_dir, "documents"), VOCABULARY, PIECES)
