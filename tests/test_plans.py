"""The physical plans that scale depends on."""

from pyspark.sql import functions as F

from codexflow.operators import chunking as C
from codexflow.operators import lexical as X
from codexflow.plans.ingest import ingest
from codexflow.sources import library as L
from workload import views as W


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_ingest_has_no_shuffle(spark, sf):
    p = plan(ingest(docs(spark, sf).select("doc_id", "source", "text"), processed_at=F.lit("x")))
    assert "Exchange" not in p and p.count("ArrowEvalPython") == 1


def test_native_chunking_stays_in_the_jvm(spark, sf):
    p = plan(C.chunk_adaptive(docs(spark, sf).select("doc_id", "text"), splitter=C.fixed_splitter(800, 150)))
    assert "Exchange" not in p and "Python" not in p


def test_bm25_shuffles_neither_postings_nor_pairs(spark, sf):
    index = X.build_index(docs(spark, sf).select("doc_id", "text"))
    p = plan(X.score(index, W.questions(spark, sf), 5))
    assert p.count("Exchange") == 1 and "WindowGroupLimit" in p and "Cartesian" not in p and "NestedLoop" not in p
    assert "hashpartitioning(qid" in p and "term" not in p.split("Exchange")[1].split("\n")[0]


def test_scan_reads_only_needed_columns(spark, sf):
    p = plan(docs(spark, sf).filter("lang = 'es'").select("doc_id"))
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in p and "EqualTo(lang,es)" in p


def test_upsert_combines_before_the_shuffle(spark, sf):
    p = plan(L.upsert(W.manifest(spark, sf), W.manifest(spark, sf)))
    assert "partial_max_by" in p


def test_article_lookup_shuffles_no_segments(spark, sf):
    from codexflow.operators.articles import article_spans, first_spans

    wanted = F.broadcast(spark.createDataFrame([("2.2.1",), ("2.2.2",)], "article string"))
    p = plan(first_spans(article_spans(docs(spark, sf), F.col("doc_id"), wanted=wanted)))
    assert p.count("Exchange hash") == 1 and "partial_min_by" in p and "BroadcastHashJoin" in p and "SortMergeJoin" not in p


def test_many_questions_are_one_scan(spark, sf):
    """Ten blocks of questions and more still read the corpus once, and give what few at a time give."""
    from codexflow.operators.articles import lookup
    from codexflow.operators.dense import dense_topk

    index = X.build_index(docs(spark, sf).select("doc_id", "text"))
    many = spark.range(10 * X.BLOCK + 5).select(F.col("id").alias("qid"), F.concat(F.lit("the and 2.2."), F.col("id").cast("string")).alias("question"))
    assert plan(X.score(index, many, 5)).count("MapInPandas") == 1
    vectors = W.vectors(spark, sf).select("id", "vec")
    asked = many.select("qid", F.array(*[F.lit(float(i)) for i in range(4)]).alias("qvec"))
    assert plan(dense_topk(asked, vectors, 5)).count("MapInPandas") == 1
    assert plan(lookup(many, docs(spark, sf), F.col("doc_id"))).count("Scan parquet") <= 3  # the texts, and the numbers twice
    few = many.filter("qid < 20")
    one = sorted(map(tuple, X.topk(index, few, 5).collect()))
    parts = sorted(tuple(r)[:4] for r in X.rank(X.score(index, few, 5, most=7).filter("score > 0"), 5, [F.desc("score"), F.asc("id")]).collect())
    assert one == parts and len(one) == 100
