import numpy as np
import pytest
from pyspark.sql import functions as F

from codexflow.operators import dense as D
from codexflow.operators import fusion as U
from codexflow.operators import hierarchy as H
from codexflow.operators import lexical as X
from codexflow.session import new_table_path
from workload import views as W


@pytest.fixture(scope="module")
def vecs(spark):
    rng = np.random.default_rng(3)
    q, c = rng.normal(size=(7, 8)), rng.normal(size=(400, 8))
    c[200:] = c[0]  # half of the corpus is one copied vector
    qs = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(q)], "qid bigint, qvec array<double>, key int")
    cs = spark.createDataFrame([(i, v.tolist(), 0 if i >= 50 else 1) for i, v in enumerate(c)], "id bigint, vec array<double>, key int")
    return q, c, qs, cs


def brute(q, c, k, allowed=lambda i, j: True):
    out = set()
    for i, v in enumerate(q):
        s = np.round(c @ v, 6)
        ids = [j for j in sorted(range(len(c)), key=lambda j: (-s[j], j)) if allowed(i, j)][:k]
        out |= {(i, j, r + 1) for r, j in enumerate(ids)}
    return out


@pytest.mark.parametrize("limits", [{}, {"block": 2}])
def test_dense_matches_brute_force(vecs, limits):
    q, c, qs, cs = vecs
    got = {(r["qid"], r["id"], r["rank"]) for r in D.dense_topk(qs.drop("key"), cs.drop("key"), 5, **limits).collect()}
    assert got == brute(q, c, 5)
    got = {(r["qid"], r["id"], r["rank"]) for r in D.dense_topk(qs, cs, 5, **limits).collect()}
    assert got == brute(q, c, 5, lambda i, j: i % 2 == (0 if j >= 50 else 1))


def test_saved_index_scores_alike(spark, sf):
    index = X.build_index(spark.read.parquet(f"{sf}/documents.parquet"))
    saved = index.save(new_table_path(spark, "index"))
    questions = W.questions(spark, sf)
    a, b = (sorted(map(tuple, X.score(i, questions).collect())) for i in (index, saved))
    assert a == b and a


def test_every_pair_that_shares_a_term_is_scored(spark):
    """Far more documents than any top k hold a term; scores may be negative, and ids of different size stay exact."""
    rows = [(i if i % 2 else 2**60 + i, "common " * (1 + i % 3) + f"own{i}") for i in range(700)] + [(None, "common rare"), (-1, "other"), (-2, ""), (-3, None)]
    index = X.build_index(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    questions = spark.createDataFrame([("a", "common common"), ("b", "own7 rare"), ("c", "nothing"), (None, "other")], "qid string, question string")
    scored = X.score(index, questions)
    found = [tuple(r) for r in scored.collect()]
    want = [("a", d) for d, t in rows if "common" in (t or "")] + [("b", 7), ("b", None), (None, -1)]
    assert sorted(map(repr, want)) == sorted(repr(r[:2]) for r in found)
    assert "hashpartitioning" not in scored._jdf.queryExecution().executedPlan().toString()
    in_parts = [tuple(r) for r in X.score(index, questions, most=1).collect()]
    assert sorted(map(repr, in_parts)) == sorted(map(repr, found))
    best = {tuple(r) for r in X.score(index, questions.filter("qid = 'a'"), 5).collect()}
    assert len(best) == 5 and best <= set(found) and min(s for _, _, s in best) >= max(s for q, d, s in found if q == "a" and (q, d, s) not in best)


def test_empty_inputs(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    index = X.build_index(docs)
    assert X.topk(index, spark.createDataFrame([(1, "a b")], "qid bigint, question string")).count() == 0


def test_fusion_properties(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "qid bigint, id bigint, rank int")
    b = spark.createDataFrame([(1, 12, 1), (1, 10, 2)], "qid bigint, id bigint, rank int")
    chunks = spark.createDataFrame([(10, "x"), (11, "y"), (12, "y")], "doc_id bigint, content string")
    hits = U.union_branches(a, b)
    rows = U.dedupe_by_content(U.attach_content(hits, chunks)).join(chunks.withColumnRenamed("doc_id", "id"), "id").orderBy("fused_rank").collect()
    assert [(r["content"], r["id"], r["fused_rank"]) for r in rows] == [("x", 10, 1), ("y", 12, 2)]
    rrf = U.fuse_rrf(hits).orderBy("rank").collect()
    assert [r["id"] for r in rrf] == [10, 12, 11]


def test_scorer_hook_and_null_scores(spark):
    cand = spark.createDataFrame([(1, i, f"c{i}", i) for i in range(1, 5)], "qid bigint, id bigint, content string, fused_rank int")
    q = spark.createDataFrame([(1, "q")], "qid bigint, question string")
    scorer = lambda df: df.withColumn("rerank_score", F.when(F.col("id") == 3, 1.0))
    rows = U.rerank(cand, q, 3, scorer).orderBy("rank").collect()
    assert [r["id"] for r in rows] == [3, 1, 2]


def test_missing_levels(vecs):
    q, c, qs, cs = vecs
    assert H.hier_retrieve(qs.drop("key"), cs, None) is None
    assert H.hier_retrieve(qs.drop("key"), None, cs, k_chunks=4).groupBy("qid").count().filter("count <> 8").count() == 0


def test_lsh_scores_are_exact_within_buckets(vecs):
    q, c, qs, cs = vecs
    rows = D.dense_topk_lsh(qs.drop("key"), cs.drop("key"), 3, bucket_length=2.0).collect()
    assert rows and all(r["rank"] <= 3 and r["score"] == round(float(c[r["id"]] @ q[r["qid"]]), 6) for r in rows)
    wide = D.dense_topk_lsh(qs.drop("key"), cs.drop("key"), 3, bucket_length=1e6, tables=8).collect()
    assert {(r["qid"], r["id"], r["rank"]) for r in wide} == brute(q, c, 3)


def test_article_numbers_match_exactly(spark):
    from codexflow.functions.fields import names_article

    cases = [("ver 2.2.2.4.11 aquí", "2.2.2.4.1", False), ("Artículo 2.2.2.4.1. Texto", "2.2.2.4.1", True), ("12.2.2.4.1", "2.2.2.4.1", False),
             ("(2.2.2.4.1)", "2.2.2.4.1", True), ("2.2.2.4.1.5", "2.2.2.4.1", False), ("nada", None, False), ("termina en 2.2.2.4.1.", "2.2.2.4.1", True)]
    df = spark.createDataFrame([(c, a) for c, a, _ in cases], "c string, a string")
    assert [r[0] for r in df.select(names_article(F.col("c"), F.col("a"))).collect()] == [w for *_, w in cases]


def test_bucketed_search_is_topped_up(vecs):
    q, c, qs, cs = vecs
    rows = D.dense_topk_lsh(qs.drop("key"), cs.drop("key"), 3, bucket_length=0.01, tables=1).collect()
    assert len(rows) == 3 * len(q)
    rows = D.dense_topk_lsh(qs.drop("key"), cs.drop("key"), 3, bucket_length=3.0, tables=8).collect()
    assert len({(r["qid"], r["id"]) for r in rows} & {(a, b) for a, b, _ in brute(q, c, 3)}) >= 0.9 * 3 * len(q)


def test_two_levels_over_their_own_index(spark):
    from codexflow.hooks import fit_hashing

    chunks = spark.createDataFrame(
        [(f"c{i}", f"uno dos {w} tres {w}. Luego {w} cuatro {w} cinco.", str(i % 3), None) for i, w in enumerate("agua pozo multa río lago mar".split())],
        "chunk_id string, content string, article string, page int")
    embedder = fit_hashing(chunks.withColumnRenamed("content", "text"))
    index = H.index_levels(chunks, embedder)
    assert index.count() == 12
    rows = H.search_levels(spark.createDataFrame([("q", "pozo")], "qid string, question string"), index, embedder).orderBy("rank").collect()
    assert rows[0]["id"] == "c1" and {"c1", "c4"} <= {r["id"] for r in rows}
