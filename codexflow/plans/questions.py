"""Questions answered straight from documents, without an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexflow.functions import fixed_values as V
from codexflow.functions.text import format_answer, join_broken_paragraphs, strip_front_matter
from codexflow.operators import articles, lexical
from codexflow.operators.answering import select_context
from codexflow.session import cut_lineage
from codexflow.sources.pages import assemble_clean_pages
from codexflow.sources.sketch import marked


KEEP = 3


HITS_AT_ONCE = 1_000_000  # (question, document, rank) rows, some 40 MB, that travel to the texts


def retrieved(questions: DataFrame, docs: DataFrame, keep: int = KEEP, index: lexical.Bm25Index | None = None) -> DataFrame:
    """(qid, retrieved): the whole texts of the ``keep`` best documents by BM25, best first.

    A saved ``index`` over the documents' ids spares building one. Up to ``HITS_AT_ONCE`` hits travel
    to the texts, so only those found are moved.
    """
    best = lexical.topk(index or lexical.build_index(docs), questions, keep)
    best = cut_lineage(best.select("qid", "rank", F.col("id").alias("doc_id")), "retrieved")
    texts = docs.select("doc_id", "text").join(F.broadcast(best) if best.count() <= HITS_AT_ONCE else best, "doc_id")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text")))  # at most ``keep`` rows
    return texts.groupBy("qid").agg(F.array_join(F.transform(ordered, lambda r: r["text"]), "\n\n").alias("retrieved"))


def direct_query(questions: DataFrame, pages: DataFrame, keep: int = KEEP, answerer=None, index: lexical.Bm25Index | None = None) -> DataFrame:
    """(qid, question, article, context, answer, mode). Pages are cleaned, joined
    and mended per document; the asked article, or else the best documents for the
    question, is the context. ``answerer`` adds ``answer`` to the frame; by default
    the context is the answer. ``index``: a saved one over the assembled documents.
    """
    docs = assemble_clean_pages(pages).withColumn("text", join_broken_paragraphs(F.col("text")))
    docs = cut_lineage(docs, "assembled")  # read by the lookup and by retrieval
    return _answer(articles.lookup(questions, docs, F.col("doc_id")), docs, keep, answerer, "pdf_direct", V.NO_PDF_TEXT, index)


def markdown_query(questions: DataFrame, golden: DataFrame, keep: int = KEEP, answerer=None) -> DataFrame:
    """golden: (doc_id, text) of the stored or given Markdown, header block included."""
    docs = golden.withColumn("text", strip_front_matter(F.col("text")))
    found = articles.lookup(questions, docs, F.col("doc_id"), markdown=True)
    return _answer(found, docs, keep, answerer, "markdown_direct", V.NO_DOCUMENTS)


def library_query(questions: DataFrame, docs: DataFrame, manifest: DataFrame, keep: int = KEEP, answerer=None) -> DataFrame:
    """Questions over documents (doc_id, file_hash, name, text), stored copies first.

    Documents with a stored copy answer as Markdown. A question whose article none of
    them names goes to the others; where those are none, retrieval over the stored
    copies stands.
    """
    chosen = cut_lineage(choose_markdown(docs, manifest).select("doc_id", "text", "mode"), "chosen")
    stored, rest = (chosen.filter(F.col("mode") == m).select("doc_id", "text") for m in ("markdown_direct", "pdf_direct_fallback"))
    first = cut_lineage(markdown_query(questions, stored, keep, answerer).select("qid", "article", "found", "context", "answer", "mode"), "stored-answers")
    open_ = questions.join(first.filter("NOT found").select("qid"), "qid", "left_semi")
    second = direct_query(open_, rest.withColumn("page_no", F.lit(1)), keep, answerer).filter("found").select(*first.columns)
    return first.join(second.select("qid"), "qid", "left_anti").unionByName(second)


def _answer(found, docs, keep, answerer, mode, empty_text, index=None):
    found = cut_lineage(found, "spans")
    near = retrieved(found.filter("span IS NULL").select("qid", "question"), docs, keep, index)
    ctx = found.join(near, "qid", "left").withColumns({
        "context": select_context(F.col("span"), F.col("retrieved")), "found": F.col("span").isNotNull()}).drop("span", "retrieved")
    answered = ctx.withColumn("answer", F.col("context")) if answerer is None else answerer(ctx)
    final = F.when(F.coalesce("context", F.lit("")) == "", F.lit(empty_text)).otherwise(format_answer(F.col("answer")))
    return answered.withColumns({"answer": final, "mode": F.lit(mode)})


def choose_markdown(docs: DataFrame, manifest: DataFrame, prefer_golden: bool = True, sketch: DataFrame | None = None) -> DataFrame:
    """Per source: the stored copy when there is one, else the text as given.

    docs: (file_hash, name, text); manifest: (file_hash, body). With the library's ``sketch`` the texts of
    documents that are surely not stored stay where they are.
    """
    stored = manifest.select("file_hash", F.col("body").alias("_body"))
    if sketch is None:
        out = docs.join(stored, "file_hash", "left")
    else:
        told = marked(docs, sketch)
        maybe = told.filter("maybe_stored").drop("maybe_stored").join(stored, "file_hash", "left")
        out = maybe.unionByName(told.filter("NOT maybe_stored").drop("maybe_stored").withColumn("_body", F.lit(None).cast("string")))
    use = F.col("_body").isNotNull() & F.lit(prefer_golden)
    return out.withColumns({
        "text": F.when(use, strip_front_matter(F.col("_body"))).otherwise(F.col("text")),
        "source_label": F.when(use, F.concat("name", F.lit(" (Golden MD)"))).otherwise(F.col("name")),
        "mode": F.when(use, "markdown_direct").otherwise("pdf_direct_fallback")}).drop("_body")
