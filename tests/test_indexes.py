"""Indexes that read less than the corpus: block bounds and vector lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexflow.operators import dense as D
from codexflow.operators import lexical as X
from codexflow.operators import pruning as P
from codexflow.operators import vector_index as VI
from codexflow.session import new_table_path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pruning_reads_few_blocks_of_a_skewed_corpus(spark):
    """Forty subjects; a question about one is answered from a few blocks, by the same rows."""
    random = np.random.default_rng(5)
    rows = [(i, " ".join([f"common{w}" for w in random.integers(0, 30, 20)] + [f"subject{i % 40}x{w}" for w in random.integers(0, 12, 12)])) for i in range(4000)]
    index = X.build_index(spark.createDataFrame(rows + [(9001, ""), (9002, None)], "doc_id bigint, text string"))
    blocks = P.save_blocks(index, new_table_path(spark, "blocks"), size=50)
    questions = spark.createDataFrame([(1, "subject3x1 subject3x2 common4"), (2, "subject7x5"), (3, "nothing here"), (4, "")], "qid int, question string")
    for k in (1, 5, 200):
        hits, read = P.pruned_topk(blocks, questions, k)
        assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, X.topk(index, questions, k).collect()))
        total, used = blocks.bounds.count(), read.count()
        assert total >= 80 and used <= (total // 4 if k <= 5 else total)
    again = P.load_blocks(spark, blocks.bounds.inputFiles()[0].split("/bounds/")[0])
    assert P.pruned_topk(again, questions, 5)[0].count() == P.pruned_topk(blocks, questions, 5)[0].count()


def test_pruning_of_an_empty_corpus(spark):
    index = X.build_index(spark.createDataFrame([], "doc_id bigint, text string"))
    blocks = P.save_blocks(index, new_table_path(spark, "blocks"))
    hits, read = P.pruned_topk(blocks, spark.createDataFrame([(1, "a b")], "qid int, question string"))
    assert hits.count() == 0 and read.count() == 0


@pytest.fixture(scope="module")
def clustered(spark):
    random = np.random.default_rng(6)
    centers = random.normal(size=(40, 16)) * 3
    vectors = centers[random.integers(0, 40, 6000)] + random.normal(size=(6000, 16))
    vectors[:500] = vectors[0]  # many copies of one
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id bigint, vec array<double>").repartition(6)
    asked = spark.createDataFrame([(i, vectors[i * 37].tolist()) for i in range(100)], "qid bigint, qvec array<double>")
    return asked, corpus, VI.build(corpus, new_table_path(spark, "vectors"), lists=32)


def test_index_holds_every_vector(clustered):
    _, corpus, index = clustered
    assert sorted(r[0] for r in index.members.select("id").collect()) == sorted(r[0] for r in corpus.select("id").collect())


def test_exact_search_gives_the_rows_of_a_full_scan(clustered):
    asked, corpus, index = clustered
    assert sorted(map(tuple, VI.search(index, asked, 10, exact=True).collect())) == sorted(map(tuple, D.dense_topk(asked, corpus, 10).collect()))


def test_recall_and_partition_pruning(clustered):
    asked, corpus, index = clustered
    hits = lambda df: {(r["qid"], r["rank"], r["score"]) for r in df.collect()}  # noqa: E731  copies score alike
    want, got = hits(D.dense_topk(asked, corpus, 10)), hits(VI.search(index, asked, 10, probe=6))
    assert len(want & got) >= 0.9 * len(want) and len(got) == len(want)
    one = asked.filter("qid = 5")
    chosen = VI.probed_lists(index, np.array([one.first()["qvec"]]), 3)
    assert chosen.sum() == 3
    p = plan(index.members.filter(F.col("list").isin(np.flatnonzero(chosen[0]).tolist())).select("id"))
    assert "PartitionFilters: [list" in p
    few = VI.search(index, one, 700, probe=1)  # more than a list holds: topped up by the full scan
    assert few.count() == 700


def test_recall_on_the_given_vectors(spark, sf):
    from workload import QUERIES

    want, got = ({(r["qid"], r["id"]) for r in QUERIES[q](spark, sf).collect()} for q in ("dense_topk", "dense_topk_ivf"))
    assert len(want & got) >= 0.9 * len(want)
    lsh = {(r["qid"], r["id"]) for r in QUERIES["dense_topk_lsh"](spark, sf).collect()}
    first = {(r["qid"], r["id"]) for r in QUERIES["dense_topk"](spark, sf).filter("rank <= 10").collect()}
    print("recall", len(want & got) / len(want), "lsh", len(first & lsh) / len(first))


def test_scans_hold_tiles_only(spark):
    """Exact candidates come out tile by tile, once the floors are known; a batch is never held whole."""
    from codexflow.functions import workers as K
    import pandas as pd

    random = np.random.default_rng(3)
    vectors, books = random.normal(size=(50, 8)), random.normal(size=(2, 4, 4))
    code = random.integers(0, 4, (3000, 2)).astype(np.uint8)
    pdf = pd.DataFrame({"id": range(3000), "code": [c.tobytes() for c in code], "error": 0.1, "list": 0})
    scan = K.scan_codes(list(range(50)), vectors, np.ones((50, 1), dtype=bool), np.zeros((1, 8)), books, 5, True, np.full(50, -np.inf), cells=5000)
    frames = list(scan(iter([pdf])))
    assert sum(map(len, frames)) == 150_000 and max(map(len, frames)) <= 5000


def test_sums_of_common_and_rare_terms():
    """Terms of most questions and of few are summed alike, over nulls, sliced lists and small tiles."""
    import pyarrow as pa
    from codexflow.functions import workers as K

    weights = [(q, "all", 0.5) for q in range(9)] + [(3, "rare", 2.0), (4, "rare", -1.0), (5, "zero", 0.0)]
    asked = K.Asked(*map(list, zip(*weights)))
    lists = pa.array([["x"], ["all", "rare"], None, [], ["zero", "x"], ["rare"]]).slice(1)
    total, met = np.zeros((5, 9)), np.zeros((5, 9), dtype=bool)
    for first, rows, row, code, place in asked.tiles(lists, cells=9, terms=2):
        assert lists.flatten().take(pa.array(place)).to_pylist() == asked.terms.take(pa.array(code)).to_pylist()
        total[first:first + rows], met[first:first + rows] = asked.sums(rows, row, code, np.ones(len(row)))
    assert total[0].tolist() == [.5, .5, .5, 2.5, -.5, .5, .5, .5, .5] and met[0].all() and not met[1:3].any()
    assert met[3].tolist() == [q == 5 for q in range(9)] and total[4].tolist() == [0, 0, 0, 2, -1, 0, 0, 0, 0]
