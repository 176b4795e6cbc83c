"""BM25, vector search, fusion, reranking, two-level search."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexflow.hooks import fit_hashing
from codexflow.operators import dense as D
from codexflow.operators import fusion as U
from codexflow.operators import hierarchy as H
from codexflow.operators import lexical as X
from codexflow.operators import pruning as P
from codexflow.operators import vector_index as VI
from codexflow.operators.chunking import chunk_page_text, with_chunk_id
from codexflow.session import cut_lineage, new_table_path
from workload import sqlviews as S
from workload import views as W
from workload.registry import query

K2 = 20


# -------------------------------------------------------------------- sparse

BM25 = f"{S.QUESTIONS}, {S.PASSAGES}, {S.bm25('passages', 'content', K2)}"
_INDEXES: dict[tuple[str, str], X.Bm25Index] = {}


def _index(spark, sf):
    """Built and saved once per session and input; the queries read it."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        built = X.build_index(W.passages(spark, sf), "doc_id", "content")
        _INDEXES[key] = built.save(new_table_path(spark, "bm25"))
    return _INDEXES[key]


def sparse_hits(spark, sf, k=K2):
    return X.topk(_index(spark, sf), W.questions(spark, sf), k)


def _ranked(df, *extra):
    return df.select("qid", "id", *extra, F.col("rank").cast("bigint").alias("rank"))


@query("bm25_index", f"WITH {BM25} SELECT term, df, round(idf, 6) AS idf, round(avgdl, 6) AS avgdl FROM idf, st")
def bm25_index(spark, sf):
    index = X.build_index(W.passages(spark, sf), "doc_id", "content")
    return index.terms.select("term", "df", F.round("idf", 6).alias("idf"), F.round(F.lit(index.avgdl), 6).alias("avgdl"))


@query("bm25_score", f"WITH {BM25} SELECT qid, id, score FROM score")
def bm25_score(spark, sf):
    return X.score(_index(spark, sf), W.questions(spark, sf)).select("qid", "id", "score")


@query("bm25_topk", f"WITH {BM25} SELECT qid, id, score, rank FROM sparse")
def bm25_topk(spark, sf):
    return _ranked(sparse_hits(spark, sf), "score")


@query("bm25_topk_pruned", f"WITH {BM25} SELECT qid, id, score, rank FROM sparse")
def bm25_topk_pruned(spark, sf):
    """The same rows from the blocks that can hold them."""
    blocks = P.save_blocks(_index(spark, sf), new_table_path(spark, "bm25-blocks"))
    return _ranked(P.pruned_topk(blocks, W.questions(spark, sf), K2)[0], "score")


# --------------------------------------------------------------------- dense

DENSE = f"""{S.VECTORS},
sim AS (SELECT qid, id, qv.label AS qlabel, cv.label AS label, round(list_dot_product(qvec, vec), 6) + 0.0 AS score FROM qv, cv),
dense AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sim QUALIFY rank <= {K2})"""


def dense_hits(spark, sf, k=K2):
    return D.dense_topk(W.question_vectors(spark, sf).drop("label"), W.vectors(spark, sf).drop("label"), k)


@query("dense_topk", f"WITH {DENSE} SELECT qid, id, score, rank FROM dense")
def dense_topk(spark, sf):
    return _ranked(dense_hits(spark, sf), "score")


@query("dense_topk_blocks", f"WITH {DENSE} SELECT qid, id, score, rank FROM dense")
def dense_topk_blocks(spark, sf):
    """Questions in several blocks, as a larger set of them comes."""
    q, c = W.question_vectors(spark, sf).drop("label"), W.vectors(spark, sf).drop("label")
    return _ranked(D.dense_topk(q, c, K2, block=16), "score")


@query("dense_topk_filtered", f"""
WITH {DENSE}
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sim WHERE label = qlabel QUALIFY rank <= 10""")
def dense_topk_filtered(spark, sf):
    q, c = W.question_vectors(spark, sf), W.vectors(spark, sf)
    return _ranked(D.dense_topk(q.withColumnRenamed("label", "key"), c.withColumnRenamed("label", "key"), 10), "score")


@query("dense_topk_lsh")
def dense_topk_lsh(spark, sf):
    return _ranked(D.dense_topk_lsh(W.question_vectors(spark, sf), W.vectors(spark, sf), 10), "score")


def _vector_index(spark, sf):
    return VI.build(W.vectors(spark, sf).select("id", "vec"), new_table_path(spark, "vector-index"))


@query("dense_topk_index", f"WITH {DENSE} SELECT qid, id, score, rank FROM dense")
def dense_topk_index(spark, sf):
    """Exact search over the list index: bounds rule out members and are proven by the same rows."""
    return _ranked(VI.search(_vector_index(spark, sf), W.question_vectors(spark, sf), K2, exact=True), "score")


@query("dense_topk_ivf")
def dense_topk_ivf(spark, sf):
    """Approximate search over a quarter of the lists; recall is tested."""
    return _ranked(VI.search(_vector_index(spark, sf), W.question_vectors(spark, sf), K2, probe=32), "score")


# -------------------------------------------------------------------- fusion

FUSED = f"""{DENSE}, {BM25},
hits AS (SELECT qid, id, 0 AS branch, rank FROM dense UNION ALL SELECT qid, id, 1, rank FROM sparse),
withc AS (SELECT qid, id, branch, rank, content FROM hits JOIN passages ON doc_id = id),
fused AS (SELECT qid, arg_max(id, branch * 1000 + rank) AS id, content, row_number() OVER (PARTITION BY qid ORDER BY min(branch * 1000 + rank)) AS fused_rank
  FROM withc GROUP BY qid, content)"""


def fused_hits(spark, sf):
    return U.fuse(U.union_branches(dense_hits(spark, sf), sparse_hits(spark, sf)), W.passages(spark, sf))


@query("fuse_dedupe", f"WITH {FUSED} SELECT qid, id, fused_rank FROM fused")
def fuse_dedupe(spark, sf):
    return fused_hits(spark, sf).select("qid", "id", F.col("fused_rank").cast("bigint").alias("fused_rank"))


@query("fuse_rrf", f"""
WITH {FUSED}, r AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM hits GROUP BY qid, id)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM r""")
def fuse_rrf(spark, sf):
    return _ranked(U.fuse_rrf(U.union_branches(dense_hits(spark, sf), sparse_hits(spark, sf))), "score")


SCORED = f"""
paired AS (SELECT f.*, question, nullif(regexp_extract(question, '\\d+(?:\\.\\d+){{2,}}'), '') AS article FROM fused f JOIN questions USING (qid)),
scored AS (SELECT qid, id, content, fused_rank, round(CASE WHEN {S.names_article('content', 'article')} THEN 2.0 ELSE 0.0 END
  + len(list_intersect(list_distinct({S.tokens('question')}), {S.tokens('content')}))::DOUBLE / greatest(len(list_distinct({S.tokens('question')})), 1), 6) AS rerank_score FROM paired),
best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, fused_rank) AS rank FROM scored QUALIFY rank <= 10)"""
RERANKED = f"{FUSED}, {SCORED}"


@query("rerank_topk", f"WITH {RERANKED} SELECT qid, id, rerank_score, rank FROM best")
def rerank_topk(spark, sf):
    return _ranked(U.rerank(fused_hits(spark, sf), W.questions(spark, sf)), "rerank_score")


@query("rerank_fallback", f"WITH {FUSED} SELECT qid, id, CAST(NULL AS DOUBLE) AS rerank_score, fused_rank AS rank FROM fused WHERE fused_rank <= 10")
def rerank_fallback(spark, sf):
    return _ranked(U.fused_order(fused_hits(spark, sf)), "rerank_score")


def hybrid_hits(spark, sf):
    return U.hybrid_retrieve(W.questions(spark, sf), W.passages(spark, sf), sparse_hits(spark, sf), dense_hits(spark, sf))


@query("hybrid_retrieve", f"WITH {RERANKED} SELECT qid, id, rerank_score, rank, content FROM best")
def hybrid_retrieve(spark, sf):
    return _ranked(hybrid_hits(spark, sf), "rerank_score", "content")


DENSE_ONLY = f"""{DENSE}, {S.QUESTIONS}, {S.PASSAGES},
withc AS (SELECT qid, id, rank, content FROM dense JOIN passages ON doc_id = id),
fused AS (SELECT qid, arg_max(id, rank) AS id, content, row_number() OVER (PARTITION BY qid ORDER BY min(rank)) AS fused_rank FROM withc GROUP BY qid, content)"""


@query("hybrid_dense_only", f"WITH {DENSE_ONLY}, {SCORED} SELECT qid, id, rerank_score, rank FROM best")
def hybrid_dense_only(spark, sf):
    """The sparse branch is missing: dense serves alone."""
    return _ranked(U.hybrid_retrieve(W.questions(spark, sf), W.passages(spark, sf), None, dense_hits(spark, sf)), "rerank_score")


# ---------------------------------------------------------------- two levels

@query("hier_retrieve", f"""
WITH {DENSE},
lv AS (SELECT id, CASE WHEN label < 6 THEN label END AS article, CASE WHEN label < 9 THEN label END AS page FROM cv),
sm AS (SELECT qid, id AS sid, rank AS summary_rank, article, page FROM dense JOIN lv USING (id) WHERE rank <= 4),
fd AS (SELECT sm.qid, summary_rank, s.id, s.score, sm.article, sm.page,
    row_number() OVER (PARTITION BY sm.qid, summary_rank ORDER BY s.score DESC, s.id) AS chunk_rank
  FROM sm JOIN sim s ON s.qid = sm.qid JOIN lv ON lv.id = s.id
  WHERE CASE WHEN sm.article IS NOT NULL THEN lv.article = sm.article WHEN sm.page IS NOT NULL THEN lv.page = sm.page ELSE true END),
kept AS (SELECT * FROM fd WHERE chunk_rank <= CASE WHEN article IS NOT NULL OR page IS NOT NULL THEN 4 ELSE 2 END),
uq AS (SELECT qid, id, max(score) AS score, min(summary_rank * 1000 + chunk_rank) AS place FROM kept GROUP BY qid, id)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY place) AS rank FROM uq QUALIFY rank <= 8""")
def hier_retrieve(spark, sf):
    label = F.col("label")
    level = W.vectors(spark, sf).select(
        "id", "vec", F.when(label < 6, label).alias("article"), F.when(label < 9, label).alias("page"))
    return _ranked(H.hier_retrieve(W.question_vectors(spark, sf).drop("label"), level, level), "score")


@query("hier_end_to_end")
def hier_end_to_end(spark, sf):
    """Chunks to summaries to both levels' vectors to answers, over one index."""
    chunks = cut_lineage(with_chunk_id(chunk_page_text(W.noisy(spark, sf), "body")).select("chunk_id", "content", "article", "page"), "chunks")
    embedder = fit_hashing(chunks, "content")
    by_text = lambda df: embedder(df.withColumnRenamed("text", "content"))
    index = cut_lineage(H.index_levels(chunks, by_text), "levels")
    return _ranked(H.search_levels(W.article_questions(spark, sf), index, by_text), "score")
