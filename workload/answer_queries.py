"""Article lookup, grading, answering, checking, chat history."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexflow.functions import fields
from codexflow.functions.text import content_hash
from codexflow.operators import answering as A
from codexflow.operators import articles as R
from codexflow.plans import questions as Q
from workload import sqlviews as S
from workload import views as W
from workload.corpus_queries import SENTENCES
from workload.registry import query
from workload.retrieval_queries import K2, sparse_hits
from workload.text_queries import _page, formatted, paragraphs_sql

NO_ANSWER = ("⚠️ No se encontró información relevante en los documentos indexados para responder su consulta legal. "
             "Por favor reformule la pregunta o sea más específico con el número del artículo.")


# ------------------------------------------------------------------ articles

@query("question_article", rf"""
WITH {S.ARTICLE_QUESTIONS} SELECT qid, nullif(regexp_extract(question, '(\d+(?:\.\d+){{2,}})', 1), '') AS article FROM questions
UNION ALL SELECT doc_id + 1000000, nullif(regexp_extract(text, '(\d+(?:\.\d+){{2,}})', 1), '') FROM documents""")
def question_article(spark, sf):
    docs = W.documents(spark, sf).select((F.col("doc_id") + 1000000).alias("qid"), F.col("text").alias("question"))
    both = W.article_questions(spark, sf).unionByName(docs)
    return both.select("qid", fields.question_article(F.col("question")).alias("article"))


def spans_sql(view: str, body: str, mark: str, line_start: str, tag: str = "") -> str:
    """First span per article: lines, segment numbers, segments, first match; ends in first_span<tag>."""
    return rf"""
ln{tag} AS (SELECT doc_id, pos, lines[pos] AS line FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS pos FROM (
    SELECT doc_id, string_split({body}, chr(10)) AS lines FROM {view}))),
sg{tag} AS (SELECT *, sum(CAST(pos > 1 AND regexp_matches(line, '(?i)^({line_start})') AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS seg_no FROM ln{tag}),
seg{tag} AS (SELECT doc_id, seg_no, string_agg(line, chr(10) ORDER BY pos) AS seg FROM sg{tag} GROUP BY doc_id, seg_no),
found{tag} AS (
  SELECT a.article, doc_id, seg_no, trim(regexp_extract(seg || chr(10), '(?is){mark}ART[IÍ]CULO\s*' || replace(a.article, '.', '[.]') || '[.]?\s.*'), ' ' || chr(10)) AS span
  FROM seg{tag}, (SELECT DISTINCT article FROM asked WHERE article IS NOT NULL) a
  WHERE regexp_matches(seg || chr(10), '(?is){mark}ART[IÍ]CULO\s*' || replace(a.article, '.', '[.]') || '[.]?\s')),
first_span{tag} AS (SELECT article, arg_min(span, doc_id * 100000 + seg_no) AS span FROM found{tag} GROUP BY article)"""


ASKED = rf"asked AS (SELECT qid, question, nullif(regexp_extract(question, '(\d+(?:\.\d+){{2,}})', 1), '') AS article FROM questions)"
PLAIN_START = r"ART[IÍ]CULO\s+\d|CAP[IÍ]TULO|SECCI[OÓ]N|PARTE"
HEAD_START = r"#{1,4}\s*ART[IÍ]CULO\s*\d|#{1,4}\s*CAP[IÍ]TULO|#{1,4}\s*SECCI[OÓ]N"


@query("article_lookup", f"""
WITH {S.PLAIN}, {S.ARTICLE_QUESTIONS}, {ASKED}, {spans_sql('plain', 'body', '', PLAIN_START)}
SELECT qid, question, article, span FROM asked LEFT JOIN first_span USING (article)""")
def article_lookup(spark, sf):
    return R.lookup(W.article_questions(spark, sf), W.plain(spark, sf), F.col("doc_id"), "body")


@query("article_lookup_md", f"""
WITH {S.LEGAL}, {S.ARTICLE_QUESTIONS}, {ASKED}, {spans_sql('legal', 'body', '#{1,4}' + chr(92) + 's*', HEAD_START)}
SELECT qid, question, article, span FROM asked LEFT JOIN first_span USING (article)""")
def article_lookup_md(spark, sf):
    return R.lookup(W.article_questions(spark, sf), W.legal(spark, sf), F.col("doc_id"), "body", markdown=True)


@query("select_context", f"""
WITH {S.PLAIN}, {S.ARTICLE_QUESTIONS}, {ASKED}, {spans_sql('plain', 'body', '', PLAIN_START)}
SELECT qid, coalesce(span, question) AS context FROM asked LEFT JOIN first_span USING (article)""")
def select_context(spark, sf):
    found = R.lookup(W.article_questions(spark, sf), W.plain(spark, sf), F.col("doc_id"), "body")
    return found.select("qid", A.select_context(F.col("span"), F.col("question")).alias("context"))


OPEN = f"""open_ AS (SELECT a.qid, a.question FROM asked a LEFT JOIN first_span f USING (article) WHERE f.span IS NULL)"""


@query("direct_query", f"""
WITH {S.PLAIN}, {S.ARTICLE_QUESTIONS}, {ASKED},
pg AS (SELECT doc_id, page_no, {_page('text')} AS text FROM (
  SELECT doc_id, page_no, substring(body, (page_no - 1) * 1500 + 1, 1500) AS text FROM (
    SELECT doc_id, body, unnest(generate_series(1, greatest(CAST(ceil(length(body) / 1500.0) AS BIGINT), 1))) AS page_no FROM plain))),
assembled AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_no) AS body FROM pg WHERE text <> '' GROUP BY doc_id),
{paragraphs_sql('assembled', 'body')}, {spans_sql('mended', 'body', '', PLAIN_START)}, {OPEN}, {S.bm25('mended', 'body', 3, 'open_')},
near AS (SELECT qid, string_agg(body, chr(10) || chr(10) ORDER BY rank) AS text FROM sparse JOIN mended ON doc_id = id GROUP BY qid)
SELECT asked.qid, article, {formatted('coalesce(span, near.text)')} AS answer, 'pdf_direct' AS mode
FROM asked LEFT JOIN first_span USING (article) LEFT JOIN near ON near.qid = asked.qid""")
def direct_query(spark, sf):
    plain = W.plain(spark, sf)
    last = F.greatest(F.ceil(F.length("body") / W.PAGE_CHARS), F.lit(1)).cast("int")
    pages = plain.select("doc_id", "body", F.explode(F.sequence(F.lit(1), last)).alias("page_no")).select(
        "doc_id", "page_no", F.substring("body", (F.col("page_no") - 1) * W.PAGE_CHARS + 1, F.lit(W.PAGE_CHARS)).alias("text"))
    return Q.direct_query(W.article_questions(spark, sf), pages).select("qid", "article", "answer", "mode")


@query("markdown_query", f"""
WITH {S.LEGAL}, {S.ARTICLE_QUESTIONS}, {ASKED}, {spans_sql('legal', 'body', '#{1,4}' + chr(92) + 's*', HEAD_START)},
{OPEN},
{S.bm25('legal', 'body', 3, 'open_')},
near AS (SELECT qid, string_agg(body, chr(10) || chr(10) ORDER BY rank) AS text FROM sparse JOIN legal ON doc_id = id GROUP BY qid)
SELECT asked.qid, article, coalesce(span, near.text) AS context, {formatted('coalesce(span, near.text)')} AS answer FROM asked LEFT JOIN first_span USING (article) LEFT JOIN near ON near.qid = asked.qid""")
def markdown_query(spark, sf):
    golden = W.legal(spark, sf).select("doc_id", F.col("body").alias("text"))
    return Q.markdown_query(W.article_questions(spark, sf), golden).select("qid", "article", "context", "answer")


HEADING = "#{1,4}" + chr(92) + "s*"


@query("library_query", f"""
WITH {S.LEGAL}, {S.ARTICLE_QUESTIONS}, {ASKED},
gold AS (SELECT doc_id, {S.strip('body')} AS body FROM legal WHERE sha256(body) IN (SELECT sha256(body) FROM legal WHERE doc_id % 2 = 0)),
{spans_sql('gold', 'body', HEADING, HEAD_START)}, {OPEN}, {S.bm25('gold', 'body', 3, 'open_')},
near AS (SELECT qid, string_agg(body, chr(10) || chr(10) ORDER BY rank) AS text FROM sparse JOIN gold ON doc_id = id GROUP BY qid),
rest AS (SELECT doc_id, {_page('body')} AS body FROM legal WHERE doc_id NOT IN (SELECT doc_id FROM gold)),
whole AS (SELECT * FROM rest WHERE body <> ''), {paragraphs_sql('whole', 'body')}, {spans_sql('mended', 'body', '', PLAIN_START, '_rest')}
SELECT asked.qid, article, {formatted('coalesce(g.span, o.span, near.text)')} AS answer,
  CASE WHEN g.span IS NULL AND o.span IS NOT NULL THEN 'pdf_direct' ELSE 'markdown_direct' END AS mode
FROM asked LEFT JOIN first_span g USING (article) LEFT JOIN first_span_rest o USING (article) LEFT JOIN near ON near.qid = asked.qid""")
def library_query(spark, sf):
    """Stored copies of half of the documents; the others answer what those do not name."""
    body = F.concat(F.lit("---\nsource_pdf: x\n---\n\n"), "body")
    docs = W.legal(spark, sf).select("doc_id", F.col("source").alias("name"), F.col("body").alias("text"), content_hash(F.col("body")).alias("file_hash"))
    stored = W.legal(spark, sf).filter("doc_id % 2 = 0").groupBy(content_hash(F.col("body")).alias("file_hash")).agg(F.min(body).alias("body"))
    return Q.library_query(W.article_questions(spark, sf), docs, stored).select("qid", "article", "answer", "mode")


@query("choose_markdown", f"""
WITH {S.LIBRARY},
m AS (SELECT file_hash, '---' || chr(10) || 'source_pdf: ' || name || chr(10) || '---' || chr(10) || chr(10) || 'golden ' || chars AS body FROM manifest)
SELECT doc_id, CASE WHEN body IS NOT NULL THEN trim(substring(body, position(chr(10) || '---' || chr(10) IN body) + 5), ' ' || chr(10)) ELSE text END AS text,
  CASE WHEN body IS NOT NULL THEN source || ' (Golden MD)' ELSE source END AS source_label,
  CASE WHEN body IS NOT NULL THEN 'markdown_direct' ELSE 'pdf_direct_fallback' END AS mode
FROM lib LEFT JOIN m USING (file_hash)""")
def choose_markdown(spark, sf):
    body = F.concat(F.lit("---\nsource_pdf: "), "name", F.lit("\n---\n\ngolden "), "chars")
    stored = W.manifest(spark, sf).select("file_hash", body.alias("body"))
    docs = W.library(spark, sf).select("doc_id", "file_hash", F.col("source").alias("name"), "text")
    return Q.choose_markdown(docs, stored).select("doc_id", "text", "source_label", "mode")


# ------------------------------------------------------------------- grading

HITS = f"""{S.QUESTIONS}, {S.CITABLE}, {S.bm25('passages', 'content', K2)},
hits AS (SELECT qid, question, nullif(regexp_extract(question, '\\d+(?:\\.\\d+){{2,}}'), '') AS asked_article, rank, id, content, article, page, source FROM sparse JOIN questions USING (qid) JOIN citable ON doc_id = id WHERE rank <= 10),
graded AS (SELECT *, len(list_intersect(list_distinct({S.tokens('question')}), {S.tokens('content')}))::DOUBLE
    / greatest(len(list_distinct({S.tokens('question')})), 1) >= 0.7
    OR {S.names_article('content', 'asked_article')} AS relevant FROM hits),
kept AS (SELECT * FROM graded QUALIFY relevant OR (NOT bool_or(relevant) OVER (PARTITION BY qid) AND rank <= 3))"""
THRESHOLD = 0.7


def _hits(spark, sf):
    """Ten best chunks per question, with what a citation needs."""
    from codexflow.operators.fusion import attach_content

    hits = sparse_hits(spark, sf, 10)
    return attach_content(hits.select("qid", "id", "rank"), W.citable(spark, sf)).join(W.questions(spark, sf), "qid")


def _kept(spark, sf):
    return A.grade_fallback(A.grade_chunks(_hits(spark, sf), THRESHOLD))


@query("grade_chunks", f"WITH {HITS} SELECT qid, id, relevant FROM graded")
def grade_chunks(spark, sf):
    return A.grade_chunks(_hits(spark, sf), THRESHOLD).select("qid", "id", "relevant")


@query("grade_fallback", f"WITH {HITS} SELECT qid, id, rank, relevant FROM kept")
def grade_fallback(spark, sf):
    return _kept(spark, sf).select("qid", "id", F.col("rank").cast("bigint").alias("rank"), "relevant")


@query("route_grade", f"""
WITH {HITS}
SELECT q.qid, count(k.id) AS n_docs, CASE WHEN count(k.id) > 0 THEN 'útil' ELSE 'no_útil' END AS grade,
  CASE WHEN count(k.id) > 0 THEN 'generate' ELSE 'no_answer' END AS next_step
FROM (SELECT qid FROM questions UNION ALL SELECT doc_id + 1000000 FROM labels) q LEFT JOIN kept k ON k.qid = q.qid GROUP BY q.qid""")
def route_grade(spark, sf):
    extra = W.table(spark, sf, "labels").select((F.col("doc_id") + 1000000).alias("qid"))
    return A.route_grade(W.questions(spark, sf).select("qid").unionByName(extra), _kept(spark, sf))


# ------------------------------------------------------------------- answers

CONTEXT = f"""{HITS},
num AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS n FROM kept),
ctx AS (SELECT qid, string_agg('[Doc ' || n || ' - Art. ' || coalesce(article, 'N/A') || ' - pág. ' || coalesce(CAST(page AS VARCHAR), '?') || ']:' || chr(10) || content,
    chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n) AS context,
  string_agg(content, chr(10) || '---' || chr(10) ORDER BY n) AS evidence,
  array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM num GROUP BY qid)"""

PASSAGES = rf"""{CONTEXT},
sent AS (SELECT qid, rank, pos, ss[pos] AS sentence, len(list_intersect(q, {S.tokens('ss[pos]')})) AS overlap FROM (
  SELECT qid, rank, q, ss, unnest(generate_series(1, len(ss))) AS pos FROM (
    SELECT qid, rank, list_distinct({S.tokens('question')}) AS q, {SENTENCES.format('content')} AS ss FROM kept))),
pass AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, rank, pos) AS passage_rank FROM sent WHERE overlap > 0 QUALIFY passage_rank <= 5),
ans AS (SELECT qid, string_agg(sentence, chr(10) ORDER BY rank, pos) AS answer FROM pass GROUP BY qid)"""


@query("build_context", f"WITH {CONTEXT} SELECT qid, context, evidence, sources FROM ctx")
def build_context(spark, sf):
    return A.build_context(_kept(spark, sf)).select("qid", "context", "evidence", F.array_join("source_docs", ",").alias("sources"))


@query("answer_sources", f"WITH {CONTEXT} SELECT qid, sources FROM ctx")
def answer_sources(spark, sf):
    return A.answer_sources(_kept(spark, sf)).select("qid", F.array_join("source_docs", ",").alias("sources"))


@query("key_passages", f"WITH {PASSAGES} SELECT qid, rank, pos - 1 AS pos, sentence, overlap, passage_rank FROM pass")
def key_passages(spark, sf):
    big = {c: F.col(c).cast("bigint") for c in ("rank", "pos", "overlap", "passage_rank")}
    return A.key_passages(_kept(spark, sf)).withColumns(big)


@query("answer_extractive", f"WITH {PASSAGES} SELECT qid, answer FROM ans")
def answer_extractive(spark, sf):
    return A.extractive_answers(_kept(spark, sf))


CHECKED = f"""{PASSAGES},
pair AS (SELECT qid, coalesce(answer, '') AS answer, evidence, sources FROM ctx LEFT JOIN ans USING (qid)),
chk AS (SELECT *, len(list_intersect(list_distinct({S.tokens('answer')}), {S.tokens('evidence')}))::DOUBLE / greatest(len(list_distinct({S.tokens('answer')})), 1) >= 0.8 AS clean FROM pair)"""


@query("check_grounded", f"""
WITH {CHECKED}
SELECT qid, CASE WHEN clean THEN 'útil' ELSE 'alucinación' END AS grade, CASE WHEN clean THEN 0.0 ELSE 0.9 END::DOUBLE AS hallucination_score FROM chk""")
def check_grounded(spark, sf):
    return A.answer_once(_kept(spark, sf), 1, None, None, 0.8).select("qid", "grade", "hallucination_score")


@query("retry_attempts", f"""
WITH {CHECKED}
SELECT qid, CASE WHEN clean THEN 1 ELSE 2 END AS attempts, CASE WHEN clean THEN 'útil' ELSE 'alucinación' END AS grade FROM chk""")
def retry_attempts(spark, sf):
    return A.answer_with_retries(_kept(spark, sf)).select("qid", "attempts", "grade")


@query("qa_end_to_end", f"""
WITH {CHECKED}
SELECT q.qid, coalesce(answer, '{NO_ANSWER}') AS answer, coalesce(sources, '') AS sources, CASE WHEN c.qid IS NULL THEN 0 WHEN clean THEN 1 ELSE 2 END AS attempts,
  CASE WHEN c.qid IS NULL THEN 'no_útil' WHEN clean THEN 'útil' ELSE 'alucinación' END AS grade,
  CASE WHEN c.qid IS NULL OR clean THEN 0.0 ELSE 0.9 END::DOUBLE AS hallucination_score
FROM (SELECT qid FROM questions UNION ALL SELECT doc_id + 1000000 FROM labels) q LEFT JOIN chk c ON c.qid = q.qid""")
def qa_end_to_end(spark, sf):
    questions = W.questions(spark, sf)
    unanswerable = W.table(spark, sf, "labels").select((F.col("doc_id") + 1000000).alias("qid"), F.lit("").alias("question"))
    out = A.answer_questions(questions.unionByName(unanswerable), _hits(spark, sf).drop("question"), THRESHOLD)
    return out.withColumn("sources", F.array_join("source_docs", ",")).drop("source_docs")


@query("chat_history", """
SELECT conv_id, turn, role, text, substring(text, 1, 500) AS preview, count(*) OVER (PARTITION BY conv_id, role) AS n_role FROM conversations""")
def chat_history(spark, sf):
    from codexflow.operators.answering import chat_history as history

    return history(W.table(spark, sf, "conversations"))
