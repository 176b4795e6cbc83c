import pytest
from pyspark.sql import functions as F

from codexflow.functions import fixed_values as V
from codexflow.hooks import per_batch
from codexflow.operators import answering as A
from codexflow.operators import articles as R
from codexflow.operators import evaluation as E
from codexflow.plans import questions as Q
from codexflow.session import new_table_path

HITS = "qid bigint, question string, rank int, id bigint, content string, article string, page int, source string"


def hits(spark):
    return spark.createDataFrame([
        (1, "agua del pozo", 1, 10, "el agua del pozo es clara.", "2.2.1", 3, "a"),
        (1, "agua del pozo", 2, 11, "nada que ver.", None, None, "b"),
        (2, "artículo 2.2.9 dice", 1, 12, "sin coincidencia.", None, None, None),
        (2, "artículo 2.2.9 dice", 2, 13, "cita 2.2.9.", None, 1, "c"),
        *[(3, "xyz", r, 20 + r, f"otro {r}.", None, None, "d") for r in range(1, 6)]], HITS)


def test_grading_and_fallback(spark):
    kept = A.grade_fallback(A.grade_chunks(hits(spark), 0.9))
    assert {(r["qid"], r["id"]) for r in kept.collect()} == {(1, 10), (2, 13), (3, 21), (3, 22), (3, 23)}


def test_context_text(spark):
    kept = A.grade_fallback(A.grade_chunks(hits(spark), 0.9))
    rows = {r["qid"]: r for r in A.build_context(kept).collect()}
    assert rows[1]["context"] == "[Doc 1 - Art. 2.2.1 - pág. 3]:\nel agua del pozo es clara."
    assert rows[3]["context"].startswith("[Doc 1 - Art. N/A - pág. ?]:\notro 1.\n\n---\n\n[Doc 2")
    assert rows[2]["source_docs"] == ["c"]


def test_retry_uses_the_second_answer_and_keeps_everyone(spark):
    def say(text):
        return per_batch(lambda: lambda pdf: pdf.assign(answer=text), "answer string")

    first = lambda df: say("inventado todo")(df).select("qid", "answer")
    second = lambda df: df.select("qid", F.col("passages").alias("answer"))
    questions = spark.createDataFrame([(1, "agua del pozo"), (2, "artículo 2.2.9 dice"), (9, "nada")], "qid bigint, question string")
    out = A.answer_questions(questions, hits(spark).drop("question"), 0.9, answerers=[first, second])
    rows = {r["qid"]: r for r in out.collect()}
    assert rows[1]["attempts"] == 2 and rows[1]["grade"] == "útil" and rows[1]["answer"] == "el agua del pozo es clara."
    assert rows[9]["answer"] == V.NO_ANSWER and rows[9]["grade"] == "no_útil" and rows[9]["source_docs"] == []
    stuck = A.answer_questions(questions, hits(spark).drop("question"), 0.9, answerers=[first, first]).filter("qid = 1").first()
    assert (stuck["attempts"], stuck["grade"], stuck["hallucination_score"]) == (2, "alucinación", 0.9)


def test_failed_grader_drops_and_failed_verifier_passes(spark):
    grader = lambda df: df.withColumn("relevant", F.when(F.col("id") == 11, True))
    kept = A.grade_fallback(A.grade_chunks(hits(spark).filter("qid = 1"), grader=grader))
    assert [r["id"] for r in kept.collect()] == [11]
    verifier = lambda df: df.withColumn("clean", F.lit(None).cast("boolean"))
    assert A.answer_once(kept, 1, None, verifier, 0.8).first()["grade"] == "útil"


def test_first_document_wins_and_numbers_are_exact(spark):
    docs = spark.createDataFrame([
        (2, "CAPÍTULO I\nARTÍCULO 2.2.1. segundo\nARTÍCULO 2.2.10. otro"),
        (1, "ARTÍCULO 2.2.1 primero\nsigue\nARTÍCULO 3 fin")], "doc_id int, text string")
    qs = spark.createDataFrame([(1, "artículo 2.2.1?"), (2, "artículo 2.2.10"), (3, "artículo 9.9.9"), (4, "hola")], "qid int, question string")
    for most in (1024, 1):  # numbers that travel to the scan, numbers that are met in a shuffle
        got = {r["qid"]: r["span"] for r in R.lookup(qs, docs, F.col("doc_id"), most=most).collect()}
        assert got == {1: "ARTÍCULO 2.2.1 primero\nsigue", 2: "ARTÍCULO 2.2.10. otro", 3: None, 4: None}


def test_markdown_heading_first(spark):
    docs = spark.createDataFrame([(1, "ver ARTÍCULO 2.2.1 arriba\n## ARTÍCULO 2.2.1. cuerpo\ntexto\n## CAPÍTULO II")], "doc_id int, text string")
    qs = spark.createDataFrame([(1, "2.2.1")], "qid int, question string")
    assert R.lookup(qs, docs, F.col("doc_id"), markdown=True).first()["span"] == "## ARTÍCULO 2.2.1. cuerpo\ntexto"


def test_direct_query_retrieves_whole_documents(spark):
    qs = spark.createDataFrame([(1, "hola perro"), (2, "xyzzy")], "qid int, question string")
    pages = spark.createDataFrame([(d, p, f"doc {d} página {p} {'perro' if d == 2 else 'gato'}.") for d in (1, 2, 3, 4) for p in (1, 2)], "doc_id int, page_no int, text string")
    pages = pages.unionByName(spark.createDataFrame([(2, 3, "hola " + "relleno " * 30_000 + "final.")], "doc_id int, page_no int, text string"))
    rows = {r["qid"]: r for r in Q.direct_query(qs, pages).collect()}
    assert rows[1]["context"].startswith("doc 2 página 1") and rows[1]["context"].endswith("final.")
    assert rows[2]["context"] is None and rows[2]["answer"] == V.NO_PDF_TEXT
    assert {r["answer"] for r in Q.direct_query(qs, pages.limit(0)).collect()} == {V.NO_PDF_TEXT}


def test_library_query_asks_the_other_documents_too(spark):
    docs = spark.createDataFrame([(1, "h1", "a", "plain"), (2, "h2", "b", "ARTÍCULO 3.3.3. del otro.")], "doc_id int, file_hash string, name string, text string")
    stored = spark.createDataFrame([("h1", "---\nk: v\n---\n\n## ARTÍCULO 2.2.1. guardado")], "file_hash string, body string")
    qs = spark.createDataFrame([(1, "2.2.1"), (2, "3.3.3"), (3, "9.9.9")], "qid int, question string")
    rows = {r["qid"]: r for r in Q.library_query(qs, docs, stored).collect()}
    assert (rows[1]["mode"], rows[2]["mode"]) == ("markdown_direct", "pdf_direct") and "guardado" in rows[1]["context"] and "del otro" in rows[2]["context"]
    assert rows[3]["mode"] == "markdown_direct" and not rows[3]["found"]


def test_judge_and_report(spark):
    df = spark.createDataFrame([
        ("Q1", '```json\n{"faithfulness": 5, "completeness": 4, "citation_quality": 3, "reasoning": "ok"}\n```'), ("Q2", "no json")], "id string, reply string")
    scores = E.parse_judge(df)
    assert E.summary(scores).first()["overall"] == 2.0
    path = new_table_path(spark, "report")
    E.write_report(scores, ["id", "faithfulness"], path)
    lines = [r[0] for r in spark.read.text(path).collect()]
    assert "- overall: 2.00" in lines and "| Q1 | 5 |" in lines
    numbered = spark.createDataFrame([(i, 1, 1, 1) for i in (10, 2)], "id int, faithfulness int, completeness int, citation_quality int")
    path = new_table_path(spark, "report")
    E.write_report(numbered, ["id"], path)
    assert [r[0] for r in spark.read.text(path).collect()][-2:] == ["| 2 |", "| 10 |"]
    asked = spark.createDataFrame([("Q1", "¿qué?", "x")], "id string, question string, intent string")
    asked.write.parquet(golden := new_table_path(spark, "golden"))
    assert E.golden_set(spark, golden).count() == 1


@pytest.mark.parametrize("key", ["int", "string"])
def test_from_documents_to_answers(spark, key):
    from codexflow.hooks import embed_hashing
    from codexflow.operators import dense, fusion, lexical
    from codexflow.operators.chunking import with_chunk_id
    from codexflow.plans.ingest import ingest

    docs = spark.createDataFrame([
        (1, "a.md", "Resolución No. 0123\nARTÍCULO 2.2.1. El pozo capta 120 m³ de agua.\nARTÍCULO 2.2.2. Las multas se pagan."),
        (2, "b.md", "CONSIDERANDO\nque la vereda pide agua limpia"), (3, "c.md", "")], "doc_id int, source string, text string").withColumn("doc_id", F.col("doc_id").cast(key))
    chunks = cut(with_chunk_id(ingest(docs, processed_at=F.lit("t")).filter("success")))
    questions = spark.createDataFrame([(1, "¿quién capta agua según 2.2.1?"), (2, "xyzzy")], "qid bigint, question string")
    vectors = embed_hashing(
        chunks.select("chunk_id", F.lit(None).cast("bigint").alias("qid"), F.col("content").alias("text")).unionByName(
            questions.select(F.lit(None).cast("string").alias("chunk_id"), "qid", F.col("question").alias("text"))))
    near = dense.dense_topk(
        vectors.filter("qid is not null").select("qid", F.col("embedding").alias("qvec")),
        vectors.filter("chunk_id is not null").select(F.col("chunk_id").alias("id"), F.col("embedding").alias("vec")), 4)
    sparse = lexical.topk(lexical.build_index(chunks, "chunk_id", "content"), questions, 4)
    hits = fusion.hybrid_retrieve(questions, chunks.select("chunk_id", "content"), sparse, near, 3, id_col="chunk_id")
    hits = fusion.attach_content(hits.drop("content"), chunks, "chunk_id")
    rows = {r["qid"]: r for r in A.answer_questions(questions, hits).collect()}
    assert "El pozo capta 120 m³ de agua." in rows[1]["answer"] and rows[1]["source_docs"] == ["a.md"] and rows[1]["grade"] == "útil"
    assert set(rows) == {1, 2}


def cut(df):
    from codexflow.session import cut_lineage

    return cut_lineage(df, "chunks")
