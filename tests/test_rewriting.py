"""Completion, feedback, variants and compression on small cases."""

import time

import numpy as np
from pyspark.sql import functions as F

from codexflow.operators import lexical as X
from codexflow.operators import rewriting as R


def test_best_run_is_the_maximum_sum_segment(spark):
    random = np.random.default_rng(2)
    rows = [random.integers(-4, 5, int(random.integers(0, 12))).tolist() for _ in range(200)] + [[-1, -2], [0, 0], []]
    df = spark.createDataFrame(list(enumerate(rows)), "k int, v array<bigint>").select("k", R.best_run(F.col("v")).alias("r"))
    for k, r in df.collect():
        v = rows[k]
        runs = [(-sum(v[i:j + 1]), j, -i) for i in range(len(v)) for j in range(i, len(v)) if sum(v[i:j + 1]) > 0]
        want = min(runs, default=None)  # largest sum, first end, shortest
        assert (r and (r["sum"], r["first"], r["last"])) == (want and (-want[0], -want[2], want[1])), v


def test_compression_is_linear_and_keeps_unmatched_content(spark):
    def seconds(n):
        text = " ".join(f"Sentence {i} says little." for i in range(n)) + " The river floods here. The river falls. " + "Nothing more. " * n
        df = spark.createDataFrame([(1, 1, "river floods", text), (1, 2, "zebra", "One. Two."), (2, 3, "river", None), (3, 4, None, "River.")], "qid int, id int, question string, content string")
        start = time.time()
        rows = {r["id"]: r for r in R.compress_context(df).collect()}
        assert rows[1]["compressed"] == "The river floods here. The river falls." and rows[1]["first"] == n
        assert (rows[2]["compressed"], rows[2]["first"]) == ("One. Two.", None) and rows[3]["compressed"] is None and rows[4]["compressed"] == "River."
        return time.time() - start

    seconds(100)
    assert seconds(10_000) < 10 * max(seconds(2_500), 0.5)


def test_vague_questions_are_completed_from_the_users_last_one(spark):
    rows = [(1, 0, "user", "¿Qué ordena la resolución sobre vertimientos industriales?"), (1, 1, "assistant", "Ordena tratar residuos líquidos"),
            (1, 2, "user", "¿Y cuándo vence eso?"), (1, 3, "user", "¿Cuáles trámites exige aquella licencia ambiental definitiva?"),
            (2, 2, "user", "¿Eso?"), (3, 0, "user", None), (3, 1, "user", "hola"), (4, 0, "user", "plazos para recurso judicial"), (4, 9, "user", "¿eso?")]
    got = {(r["conv_id"], r["turn"]): r for r in R.complete_questions(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()}
    assert got[1, 2]["rewritten"] == "¿Y cuándo vence eso? ordena resolución sobre vertimientos industriales"
    assert not got[1, 0]["vague"] and got[1, 0]["rewritten"] == got[1, 0]["question"]
    assert got[1, 3]["vague"] and got[1, 3]["rewritten"].endswith("vence")
    assert got[2, 2]["rewritten"] == "¿Eso?" and got[3, 0]["rewritten"] == "" and got[4, 9]["rewritten"] == "¿eso?"  # too far back
    assert len(got) == 8


def test_feedback_without_hits_or_terms(spark):
    index = X.build_index(spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha delta"), (3, "zeta eta"), (4, "theta"), (5, None)], "doc_id int, text string"))
    questions = spark.createDataFrame([(1, "alpha"), (2, "unknown words"), (3, ""), (4, None)], "qid int, question string")
    got = {(r["qid"], r["term"]): r["weight"] for r in R.rewrite(index, questions, least_idf=0.0).collect()}
    assert {q for q, _ in got} == {1, 2} and got[2, "unknown"] == got[2, "words"] == 0.5
    assert abs(sum(w for (q, _), w in got.items() if q == 1) - 1) < 1e-5 and got[1, "alpha"] > 0.5 and (1, "zeta") not in got
    told = {(r["qid"], r["variant"]): r["question"] for r in R.variants(index, questions, least_idf=0.0).collect()}
    assert told[1, 0] == "alpha" and told[2, 0] == "unknown words" and (2, 1) not in told
    added = [set(t.split()[1:]) for (q, v), t in told.items() if q == 1 and v > 0]
    assert added and all(a.isdisjoint(b) for i, a in enumerate(added) for b in added[:i])
    assert {r["qid"] for r in R.multi_query_retrieve(index, questions, least_idf=0.0).collect()} == {1}
