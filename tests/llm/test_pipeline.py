"""Pipeline stages one by one, on planted rows, and as a whole."""

import corpus_pipeline
from codexflow.llm.common import written

SF = "/root/testdata/sf0.01"
FILLER = "the quiet river runs past old stone houses while people walk home and talk about work weather music food and the long road ahead"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def clean(seed, n=120):
    words = FILLER.split()
    return ". ".join(" ".join(words[(i * (seed + 3) + seed * seed) % len(words)] + ("s" if (i + seed) % 7 == 0 else "") for i in range(k, k + 12)).capitalize() for k in range(0, n, 12)) + "."


def test_stages_take_effect(spark):
    rows = [(i, clean(i)) for i in range(6)] + [(10, clean(1)), (11, clean(2).replace("river", "RIVER")), (20, "You pathetic idiot. " + clean(7)), (30, "### $$$ !!! " * 60),
                                                (40, clean(8) + " Mail joe@example.org or +1 (614) 555-8001.")]
    docs = documents(spark, rows)
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: {r["doc_id"] for r in df.collect()}
    calm = stage["toxicity"](spark, docs, SF)
    assert calm.columns == docs.columns and 20 not in ids(calm) and {0, 1, 2, 3, 4, 5, 40} <= ids(calm)
    good = stage["quality"](spark, docs, SF)
    assert good.columns == docs.columns and 30 not in ids(good)
    unique = stage["near_copies"](spark, docs, SF)
    assert ids(unique) & {1, 10} == {1} and ids(unique) & {2, 11} == {2} and {0, 3, 4, 5, 20, 40} <= ids(unique)
    private = {r["doc_id"]: r for r in stage["personal_data"](spark, docs, SF).collect()}
    assert len(private) == len(rows) and private[40]["text"].endswith("Mail [EMAIL] or [PHONE].") and private[40]["n_chars"] == len(private[40]["text"])
    assert private[3]["text"] == clean(3)


def test_odd_and_empty_tables(spark, odd, empty):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, empty):
            out = stage(spark, docs.select("doc_id", "text", "lang", "source", "n_chars"), SF)
            assert name == "packing" or out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert out.count() <= 2 * docs.count() + 50


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
    whole = corpus_pipeline.run(spark, SF)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(key).collect())) == sorted(map(tuple, docs.select(key).collect()))
    assert corpus_pipeline.ORACLE_SQL is None
