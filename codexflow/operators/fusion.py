"""Fusing ranked branches, reranking, and the hybrid retrieval they make up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexflow.functions import fields
from codexflow.functions import fixed_values as V
from codexflow.functions.text import tokens
from codexflow.operators.lexical import rank

Scorer = Callable[[DataFrame], DataFrame]


def union_branches(*branches: DataFrame) -> DataFrame:
    """Earlier branches come first: position = branch order, then rank."""
    tagged = [
        b.select("qid", "id", F.lit(i).alias("branch"), F.col("rank").alias("branch_rank"))
        for i, b in enumerate(branches)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return out


def attach_content(hits: DataFrame, chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Look the hits up in the chunk table; they number at most branches x k per question."""
    return chunks.withColumnRenamed(id_col, "id").join(hits, "id")


def dedupe_by_content(hits: DataFrame) -> DataFrame:
    """One row per (qid, content): first position, payload of the later branch.

    Texts are told apart by their SHA-256, so no text is a shuffle key; a column ``content_hash`` stands for
    it. Columns beside (qid, id, branch, branch_rank) do not pass.
    """
    pos = F.struct("branch", "branch_rank", "id")
    same = F.col("content_hash") if "content_hash" in hits.columns else F.sha2("content", 256)
    fused = hits.withColumn("_same", same).groupBy("qid", "_same").agg(
        F.min(pos).alias("_first"), F.max_by("id", pos).alias("id"))
    ranked = rank(fused, 2**31 - 1, [F.col("_first")]).withColumnRenamed("rank", "fused_rank").drop("_first", "_same")
    return ranked


def fuse_rrf(hits: DataFrame, c: int = V.RRF_K) -> DataFrame:
    """Reciprocal rank fusion (Cormack et al., 2009) over (qid, id)."""
    scored = hits.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (c + F.col("branch_rank"))), 9).alias("score"))
    return rank(scored, 2**31 - 1, [F.desc("score"), F.asc("id")])


def lexical_pair_score(question: Column, content: Column) -> Column:
    """Built-in pair scorer: an exact article hit counts 2, plus the share of
    distinct question terms that occur in the content."""
    q = F.array_distinct(tokens(question))
    covered = F.size(F.array_intersect(q, tokens(content))) / F.greatest(F.size(q), F.lit(1))
    article = fields.question_article(question)
    hit = F.when(fields.names_article(content, article), 2.0).otherwise(0.0)
    return F.round(hit + covered, 6)


def rerank(candidates: DataFrame, questions: DataFrame, top_k: int = V.TOP_K, scorer: Scorer | None = None) -> DataFrame:
    """candidates: (qid, id, content, fused_rank). ``scorer`` maps a frame with
    question and content to one with ``rerank_score`` (for example through
    mapInPandas, one model per worker). A NULL score falls back to fused order,
    behind every scored row.
    """
    pairs = candidates.join(questions.select("qid", "question"), "qid")
    if scorer is None:
        scored = pairs.withColumn("rerank_score", lexical_pair_score(F.col("question"), F.col("content")))
    else:
        scored = scorer(pairs)
    order = [F.desc_nulls_last("rerank_score"), F.asc("fused_rank")]
    return rank(scored, top_k, order).drop("question")


def fused_order(candidates: DataFrame, top_k: int = V.TOP_K) -> DataFrame:
    """Without a scorer: the first top_k in fused order."""
    kept = candidates.filter(F.col("fused_rank") <= top_k)
    return kept.withColumn("rank", F.col("fused_rank")).withColumn("rerank_score", F.lit(None).cast("double"))


def hybrid_retrieve(
    questions: DataFrame, chunks: DataFrame, sparse: DataFrame | None, dense: DataFrame | None, top_k: int = V.TOP_K,
    scorer: Scorer | None = None, id_col: str = "doc_id",
) -> DataFrame:
    """Dense then sparse candidates, deduplicated, reranked to top_k per question.

    Either branch may be missing; the other one then serves alone.
    """
    branches = [b for b in (dense, sparse) if b is not None]
    return rerank(fuse(union_branches(*branches), chunks, id_col), questions, top_k, scorer)


def fuse(hits: DataFrame, chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(qid, id, fused_rank, content): hits without repeats of one text, in fused order.

    Whether two hits are the same text is decided on hashes: those stored with the chunks (``content_hash``), or made
    where the texts lie. The texts themselves join only what remains.
    """
    same = F.col("content_hash") if "content_hash" in chunks.columns else F.sha2("content", 256)
    keys = chunks.select(F.col(id_col).alias("id"), same.alias("content_hash"))
    return dedupe_by_content(keys.join(hits, "id")).join(chunks.select(F.col(id_col).alias("id"), "content"), "id")
