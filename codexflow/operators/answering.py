"""Grading, answering and checking as batch steps over (question, chunk) rows.

hits: (qid, question, rank, id, content[, article, page, source])
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexflow.functions import fields
from codexflow.functions import fixed_values as V
from codexflow.functions.text import tokens
from codexflow.operators.hierarchy import sentences
from codexflow.session import cut_lineage

Hook = Callable[[DataFrame], DataFrame]


# ------------------------------------------------------------------- grade

def coverage(question: Column, content: Column) -> Column:
    q = F.array_distinct(tokens(question))
    return F.size(F.array_intersect(q, tokens(content))) / F.greatest(F.size(q), F.lit(1))


def grade_chunks(hits: DataFrame, threshold: float = 0.5, grader: Hook | None = None) -> DataFrame:
    """Add ``relevant``. A chunk that names the asked article always passes; a
    NULL verdict (failed grading) counts as not relevant."""
    if grader is not None:
        return grader(hits).withColumn("relevant", F.coalesce("relevant", F.lit(False)))
    article = fields.question_article(F.col("question"))
    named = fields.names_article(F.col("content"), article)
    return hits.withColumn("relevant", named | (coverage(F.col("question"), F.col("content")) >= threshold))


def grade_fallback(graded: DataFrame, keep: int = 3) -> DataFrame:
    """Relevant rows; when a question has none, its first ``keep`` rows."""
    any_relevant = F.max(F.col("relevant").cast("int")).over(Window.partitionBy("qid")) == 1
    return graded.withColumn("_any", any_relevant).filter(
        F.col("relevant") | (~F.col("_any") & (F.col("rank") <= keep))).drop("_any")


def route_grade(questions: DataFrame, kept: DataFrame) -> DataFrame:
    """One row per question, also for those without any document."""
    counts = kept.groupBy("qid").agg(F.count("*").alias("n_docs"))
    out = questions.join(counts, "qid", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
    useful = F.col("n_docs") > 0
    return out.withColumns({
        "grade": F.when(useful, "útil").otherwise("no_útil"),
        "next_step": F.when(useful, "generate").otherwise("no_answer")})


# ------------------------------------------------------------------ answer

def build_context(kept: DataFrame) -> DataFrame:
    """Ordered context per question, with the distinct sources.

    At most top_k chunks per question reach this point, so groups are small.
    """
    docs = F.array_sort(F.collect_list(F.struct("rank", "content", "article", "page")))
    label = lambda d, i: F.concat(
        F.lit("[Doc "), (i + 1).cast("string"), F.lit(" - Art. "), F.coalesce(d["article"].cast("string"), F.lit("N/A")),
        F.lit(" - pág. "), F.coalesce(d["page"].cast("string"), F.lit("?")), F.lit("]:\n"), d["content"])
    return kept.groupBy("qid").agg(docs.alias("_docs"), F.array_sort(F.collect_set("source")).alias("source_docs")).select(
        "qid", F.array_join(F.transform("_docs", label), "\n\n---\n\n").alias("context"),
        F.array_join(F.transform("_docs", lambda d: d["content"]), "\n---\n").alias("evidence"),
        "source_docs")


def answer_sources(kept: DataFrame) -> DataFrame:
    return kept.groupBy("qid").agg(F.array_sort(F.collect_set("source")).alias("source_docs"))


def key_passages(kept: DataFrame, keep: int = 5) -> DataFrame:
    """Sentences that share most distinct terms with the question, in reading order."""
    terms = kept.withColumn("_q", F.array_distinct(tokens(F.col("question"))))
    rows = terms.select("qid", "rank", "_q", F.posexplode(sentences(F.col("content"))).alias("pos", "sentence"))
    overlap = F.size(F.array_intersect("_q", tokens(F.col("sentence"))))
    scored = rows.withColumn("overlap", overlap).filter("overlap > 0")
    best = Window.partitionBy("qid").orderBy(F.desc("overlap"), "rank", "pos")
    return scored.withColumn("passage_rank", F.row_number().over(best)).filter(
        F.col("passage_rank") <= keep).drop("_q")


def extractive_answers(kept: DataFrame, keep: int = 5) -> DataFrame:
    """(qid, answer): the key passages in reading order."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "pos", "sentence")))
    return key_passages(kept, keep).groupBy("qid").agg(
        F.array_join(F.transform(ordered, lambda s: s["sentence"]), "\n").alias("answer"))


def generate(kept: DataFrame, answerer: Hook | None = None) -> DataFrame:
    """(qid, answer). ``answerer`` gets (qid, question, context, passages), one
    row per question, typically through mapInPandas."""
    passages = extractive_answers(kept)
    if answerer is None:
        return passages
    asked = kept.select("qid", "question").distinct()
    full = asked.join(build_context(kept).select("qid", "context"), "qid").join(
        passages.withColumnRenamed("answer", "passages"), "qid", "left")
    return answerer(full)


# ------------------------------------------------------------------ verify

def groundedness(answer: Column, evidence: Column) -> Column:
    words = F.array_distinct(tokens(answer))
    return F.size(F.array_intersect(words, tokens(evidence))) / F.greatest(F.size(words), F.lit(1))


def check_grounded(answers: DataFrame, threshold: float = 0.8, verifier: Hook | None = None) -> DataFrame:
    """answers: (qid, answer, evidence). Adds grade and hallucination_score.

    No evidence: not useful. A NULL verdict (failed check) passes as clean.
    """
    if verifier is not None:
        checked = verifier(answers)
    else:
        checked = answers.withColumn("clean", groundedness(F.col("answer"), F.col("evidence")) >= threshold)
    no_docs, clean = F.col("evidence").isNull(), F.coalesce("clean", F.lit(True))
    return checked.withColumns({
        "grade": F.when(no_docs, "no_útil").when(clean, "útil").otherwise("alucinación"),
        "hallucination_score": F.when(no_docs | clean, 0.0).otherwise(0.9)}).drop("clean")


def answer_once(kept: DataFrame, attempt: int, answerer: Hook | None, verifier: Hook | None, threshold: float) -> DataFrame:
    ctx = build_context(kept).select("qid", "evidence", "source_docs")
    merged = ctx.join(generate(kept, answerer), "qid", "left").withColumn("answer", F.coalesce("answer", F.lit("")))
    return check_grounded(merged, threshold, verifier).withColumn("attempts", F.lit(attempt))


def answer_with_retries(
    kept: DataFrame, answerers: list[Hook | None] | None = None, verifier: Hook | None = None, threshold: float = 0.8,
    max_attempts: int = V.MAX_ATTEMPTS,
) -> DataFrame:
    """Bounded loop, unrolled: only failed questions are answered again, from the
    same documents. The last attempt stands whatever its verdict.

    The retrieved rows and every attempt but the last are written once: later
    steps read them instead of retrieving, or asking a model, a second time.
    """
    answerers = answerers or [None] * max_attempts
    current, done = cut_lineage(kept, "kept"), None
    for attempt in range(1, max_attempts + 1):
        result = answer_once(current, attempt, answerers[attempt - 1], verifier, threshold)
        last = attempt == max_attempts
        result = result if last else cut_lineage(result, "attempt")
        settled = result if last else result.filter("grade = 'útil'")
        done = settled if done is None else done.unionByName(settled)
        if not last:
            current = current.join(result.filter("grade <> 'útil'").select("qid"), "qid", "left_semi")
    return done


def finish(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """One result row per question; questions without documents get the fixed
    no-answer text."""
    out = questions.join(answers, "qid", "left")
    return out.select(
        "qid", F.coalesce("answer", F.lit(V.NO_ANSWER)).alias("answer"),
        F.coalesce("source_docs", F.array().cast("array<string>")).alias("source_docs"),
        F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("grade", F.lit("no_útil")).alias("grade"),
        F.coalesce("hallucination_score", F.lit(0.0)).alias("hallucination_score"))


def answer_questions(
    questions: DataFrame, hits: DataFrame, threshold: float = 0.5, grader: Hook | None = None,
    answerers: list[Hook | None] | None = None, verifier: Hook | None = None,
) -> DataFrame:
    """questions (qid, question), hits (qid, rank, id, content, article, page, source)."""
    asked = hits.join(questions.select("qid", "question"), "qid")
    kept = grade_fallback(grade_chunks(asked, threshold, grader))
    return finish(questions.select("qid"), answer_with_retries(kept, answerers, verifier))


# ----------------------------------------------------------------- context

def select_context(span: Column, retrieved: Column) -> Column:
    """The exact article when found, else what retrieval found for the question."""
    return F.coalesce(span, retrieved)


def context_window(df: DataFrame, chunks: str = "chunks", before: int = 2, after: int = 2) -> DataFrame:
    """Add to each chunk of the array the text of its neighbours in the document.

    The neighbours are in the same row, so nothing is shuffled.
    """
    texts = F.transform(chunks, lambda c: c["content"])

    def around(c, i):
        start = F.greatest(i - before, F.lit(0))
        near = F.slice("_texts", start + 1, i + after - start + 1)
        return F.struct(c["content"].alias("content"), F.array_join(near, "\n").alias("window"))

    return df.withColumn("_texts", texts).withColumn(chunks, F.transform(chunks, around)).drop("_texts")


def chat_history(messages: DataFrame, preview: int = V.PREVIEW_CHARS) -> DataFrame:
    """Messages with a preview and how many their role sent in the conversation.

    The counts are aggregated and joined back, so a conversation that holds very
    many messages is split by AQE and never sorted in one task. Read the result
    ordered by (conv_id, turn).
    """
    counts = messages.groupBy("conv_id", "role").agg(F.count("*").alias("n_role"))
    return messages.withColumn("preview", F.substring("text", 1, preview)).join(counts, ["conv_id", "role"]).select(
        "conv_id", "turn", "role", "text", "preview", "n_role")
