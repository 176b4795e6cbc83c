"""Exact and approximate vector search for many questions at once.

No pair of (question, chunk) ever becomes a row: each task multiplies a block of
vectors and emits only its best k per question.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexflow.functions.workers import scan_topk
from codexflow.operators.lexical import BLOCK, SCORE_DIGITS, in_parts, rank
from codexflow.session import cut_lineage


NUMBERS_AT_ONCE = 16_000_000  # components of question vectors, 128 MB, that travel to one scan


def dense_topk(questions: DataFrame, corpus: DataFrame, k: int, block: int = BLOCK, most: int = NUMBERS_AT_ONCE) -> DataFrame:
    """Top k by dot product (unit vectors: the cosine order).

    questions: (qid, qvec[, key]); corpus: (id, vec[, key]). With ``key`` on both
    sides a question sees only rows of its own key, before any scoring.

    The questions travel to the tasks of one corpus scan, where tiles of ``block`` questions
    are multiplied; nothing else moves. Only question vectors of more than ``most`` numbers in
    all need another scan.
    """
    keyed = "key" in corpus.columns
    key = (lambda df: df["key"].cast("string")) if keyed else (lambda df: F.lit(""))
    q = questions.select("qid", "qvec", key(questions).alias("key")).filter("key IS NOT NULL")
    c = corpus.select("id", "vec", key(corpus).alias("key")).filter("key IS NOT NULL")
    result = f"qid {q.schema['qid'].dataType.simpleString()}, id {c.schema['id'].dataType.simpleString()}, score double"
    partial = None
    q = cut_lineage(q, "question-vectors")
    numbers = q.agg(F.sum(F.size("qvec"))).first()[0] or 0
    for part in in_parts(q, numbers, most):
        found = c.mapInPandas(scan_topk(_packed(part.collect()), k, SCORE_DIGITS, block), result)  # ``most`` numbers or about
        partial = found if partial is None else partial.unionByName(found)
    return rank(partial, k, [F.desc("score"), F.asc("id")])


def _packed(rows: list) -> dict:
    by_key: dict[str, tuple[list, list]] = {}
    for row in rows:
        ids, vecs = by_key.setdefault(row["key"], ([], []))
        ids.append(row["qid"])
        vecs.append(row["qvec"])
    return {key: (ids, np.array(vecs, dtype=np.float64)) for key, (ids, vecs) in by_key.items()}


def dense_topk_lsh(
    questions: DataFrame, corpus: DataFrame, k: int, bucket_length: float = 0.5, tables: int = 4, seed: int = 7,
) -> DataFrame:
    """Approximate form: exact scores, but only inside the question's buckets.
    Questions whose buckets hold fewer than k rows are searched exactly.

    Random-projection hashing gives each vector one bucket per table. A bucket
    is the key of the exact keyed search, so a bucket of very many copies is
    scanned in blocks and no pair of it becomes a row.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def features(df, column):
        return df.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))

    c = features(corpus.select("id", "vec"), "vec")
    model = BucketedRandomProjectionLSH(
        inputCol="features", outputCol="hashes", bucketLength=bucket_length, numHashTables=tables, seed=seed).fit(c)

    def bucketed(df):
        rows = model.transform(df).select(*[x for x in df.columns if x != "features"], F.posexplode("hashes").alias("t", "h"))
        bucket = F.get(vector_to_array("h"), F.lit(0)).cast("bigint").cast("string")
        return rows.withColumn("key", F.concat(F.col("t").cast("string"), F.lit(":"), bucket)).drop("h")

    asked = bucketed(features(questions.select("qid", "qvec"), "qvec"))
    requests = asked.select(F.struct("qid", "t").alias("qid"), "qvec", "key").withColumn("qid", F.to_json("qid"))
    found = dense_topk(requests, bucketed(c).select("id", "vec", "key"), k)
    named = asked.select("qid", F.to_json(F.struct("qid", "t")).alias("request")).distinct()
    merged = found.withColumnRenamed("qid", "request").join(named, "request").groupBy("qid", "id").agg(F.max("score").alias("score"))
    best = cut_lineage(rank(merged, k, [F.desc("score"), F.asc("id")]), "bucket-hits")
    full = best.groupBy("qid").count().filter(F.col("count") >= k)
    short = questions.select("qid", "qvec").join(full, "qid", "left_anti")
    exact = dense_topk(short, corpus.select("id", "vec"), k)
    return best.join(full, "qid", "left_semi").unionByName(exact.select(*best.columns))
