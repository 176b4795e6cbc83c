"""Two-level search: summaries first, then chunks of the same article or page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexflow.functions.text import sub, tokens
from codexflow.operators.dense import dense_topk
from codexflow.operators.lexical import rank
from codexflow.session import cut_lineage

Summarizer = Callable[[DataFrame], DataFrame]


def sentences(text: Column) -> Column:
    """Split after . ! ? followed by whitespace; pieces keep their mark."""
    return F.filter(F.split(sub(text, r"([.!?])\s+", "$1\n"), "\n"), lambda s: F.trim(s) != "")


def extractive_summary(text: Column, keep: int = 3, min_len: int = 4) -> Column:
    """The ``keep`` sentences with most distinct words of ``min_len`` or more
    characters, in their original order."""
    def describe(s, i):
        words = F.filter(F.array_distinct(tokens(s)), lambda w: F.length(w) >= min_len)
        return F.struct((-F.size(words)).alias("neg"), i.alias("pos"), s.alias("s"))

    best = F.slice(F.array_sort(F.transform(sentences(text), describe)), 1, keep)
    ordered = F.array_sort(F.transform(best, lambda b: F.struct(b["pos"].alias("pos"), b["s"].alias("s"))))
    return F.array_join(F.transform(ordered, lambda b: b["s"]), " ")


def summarize(chunks: DataFrame, content: str = "content", summarizer: Summarizer | None = None) -> DataFrame:
    """Summary level of the index: every chunk's best sentences, whatever its length.

    A short text's best sentences are the text itself.
    """
    text = F.col(content)
    marked = chunks.withColumns({"is_summary": F.lit(True), "original_content_length": F.length(text)})
    return marked.withColumn(content, extractive_summary(text)) if summarizer is None else summarizer(marked)


def build_levels(chunks: DataFrame, content: str = "content", summarizer: Summarizer | None = None) -> DataFrame:
    """Both levels in one table, told apart by ``level``."""
    detail = chunks.withColumns({
        "is_summary": F.lit(False), "original_content_length": F.lit(None).cast("int"), "level": F.lit("detailed")})
    return summarize(chunks, content, summarizer).withColumn("level", F.lit("summary")).unionByName(detail)


def index_levels(
    chunks: DataFrame, embedder: Callable[[DataFrame], DataFrame], id_col: str = "chunk_id", content: str = "content",
    summarizer: Summarizer | None = None,
) -> DataFrame:
    """(level, id, vec, article, page): both levels of the chunks, embedded by
    ``embedder`` (adds ``embedding`` to rows with ``text``)."""
    levels = build_levels(chunks.select(id_col, content, "article", "page"), content, summarizer)
    rows = embedder(levels.withColumnRenamed(content, "text"))
    return rows.select("level", F.col(id_col).alias("id"), F.col("embedding").alias("vec"), "article", "page")


def search_levels(questions: DataFrame, index: DataFrame, embedder: Callable[[DataFrame], DataFrame], **options) -> DataFrame:
    """Two-level search of questions (qid, question) over an index of ``index_levels``."""
    asked = embedder(questions.select("qid", F.col("question").alias("text"))).select("qid", F.col("embedding").alias("qvec"))
    level = lambda name: index.filter(F.col("level") == name).drop("level")
    return hier_retrieve(asked, level("summary"), level("detailed"), **options)


def hier_retrieve(
    questions: DataFrame, summaries: DataFrame | None, detailed: DataFrame | None, k_summaries: int = 4, k_chunks: int = 8,
) -> DataFrame | None:
    """questions (qid, qvec); both levels (id, vec, article, page).

    Each of the best summaries asks for chunks of its article, else of its page,
    else for two unfiltered ones. Every such request is a question of its own
    with a filter key, so one keyed top-k serves all of them. Duplicates keep
    their first place; at most ``k_chunks`` rows remain per question.
    The requests (k_summaries per question) are written once, so the three
    branches do not search the summaries again. A missing summary level falls back to plain search with twice the chunks,
    a missing detailed level gives None.
    """
    if detailed is None:
        return None
    if summaries is None:
        return dense_topk(questions, detailed.select("id", "vec"), 2 * k_chunks)
    top = dense_topk(questions, summaries.select("id", "vec"), k_summaries)
    keys = summaries.select("id", F.col("article").cast("string").alias("article"), F.col("page").cast("string").alias("page"))
    asked = top.select("qid", "id", F.col("rank").alias("summary_rank")).join(keys, "id").join(questions, "qid")
    request = cut_lineage(asked.select(
        F.to_json(F.struct("qid", "summary_rank")).alias("rid"), "qid", "summary_rank", "qvec",
        F.when(F.col("article").isNotNull(), F.concat(F.lit("a:"), F.col("article")))
        .when(F.col("page").isNotNull(), F.concat(F.lit("p:"), F.col("page"))).otherwise("*").alias("key")), "requests")

    def branch(prefix, corpus, k):
        wanted = request.filter(F.startswith("key", F.lit(prefix))).select(F.col("rid").alias("qid"), "qvec", "key")
        return dense_topk(wanted, corpus, k)

    def keyed(prefix, column):
        value = F.concat(F.lit(prefix), F.col(column).cast("string"))
        return detailed.select("id", "vec", value.alias("key"))

    found = (
        branch("a:", keyed("a:", "article"), k_chunks // 2)
        .unionByName(branch("p:", keyed("p:", "page"), k_chunks // 2))
        .unionByName(branch("*", detailed.select("id", "vec", F.lit("*").alias("key")), 2)))
    placed = found.select(F.col("qid").alias("rid"), "id", "score", F.col("rank").alias("chunk_rank")).join(
        request.select("rid", "qid", "summary_rank"), "rid")
    place = F.struct("summary_rank", "chunk_rank")
    unique = placed.groupBy("qid", "id").agg(F.min(place).alias("place"), F.max("score").alias("score"))
    return rank(unique, k_chunks, [F.col("place")]).drop("place")
