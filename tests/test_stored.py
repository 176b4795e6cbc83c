"""Sketches, bucketed tables, stateful streams and the table function."""

import time
import uuid

import pytest
from pyspark.sql import functions as F

from codexflow.operators import chunking as C
from codexflow.session import new_table_path
from codexflow.sources import library as L
from codexflow.sources import sketch, tables
from codexflow.streaming import ingest as X
from workload import views as W


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def entries(spark, low, high):
    return spark.range(low, high).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("file_hash"), F.col("id").alias("doc_id"), F.lit("x").alias("text"))


def test_sketch_has_no_false_negative_and_few_false_positives(spark):
    stored, other = entries(spark, 0, 20_000), entries(spark, 100_000, 140_000)
    known = sketch.save(stored, new_table_path(spark, "sketch"))
    assert sketch.marked(stored, known).filter("maybe_stored").count() == 20_000
    assert sketch.marked(other, known).filter("maybe_stored").count() < 0.01 * 40_000
    nulls = spark.createDataFrame([(None, 1)], "file_hash string, doc_id int")
    assert sketch.marked(nulls, known).first()["maybe_stored"] is False
    assert sketch.marked(other, sketch.build(stored.limit(0))).filter("maybe_stored").count() == 0
    assert sketch.marked(stored, known, most_bytes=0).filter("maybe_stored").count() == 20_000  # not sent along


@pytest.mark.parametrize("most", [sketch.MOST_BYTES, 0])
def test_sketch_changes_no_result(spark, monkeypatch, most):
    monkeypatch.setattr(L, "marked", lambda d, s: sketch.marked(d, s, most))
    manifest, docs = entries(spark, 0, 50), entries(spark, 30, 90).unionByName(spark.createDataFrame([(None, -1, "x")], "file_hash string, doc_id bigint, text string"))
    known = sketch.save(manifest, new_table_path(spark, "sketch"))
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(L.known(docs, manifest, known)) == rows(L.known(docs, manifest)) and rows(L.unknown(docs, manifest, known)) == rows(L.unknown(docs, manifest))
    assert rows(L.convert_incremental(docs, manifest, F.lit("t"), sketch=known)) == rows(L.convert_incremental(docs, manifest, F.lit("t")))


def test_sketch_filters_below_the_exchange(spark, sf):
    known = sketch.save(W.manifest(spark, sf), new_table_path(spark, "sketch"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(L.known(W.library(spark, sf).select("doc_id", "file_hash"), W.manifest(spark, sf).hint("merge"), known))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    left = p[p.index("SortMergeJoin"):]
    assert left.index("Exchange hashpartitioning(file_hash") < left.index("BroadcastHashJoin") and "getbit" in left


def test_bucketed_upsert_moves_updates_only(spark):
    name = f"stored_{uuid.uuid4().hex[:8]}"
    rows = lambda a, b, day, tag: spark.range(a, b).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("file_hash"), F.concat(F.lit(tag), F.col("id").cast("string")).alias("name"), F.lit(day).alias("processed_at"))
    first = rows(0, 300, "2024-01-02", "old").unionByName(rows(300, 310, None, "untimed"))
    stored = tables.write(first, name, 8)  # no fewer than shuffle partitions, or Spark deals the stored side anew
    updates = rows(200, 400, "2024-01-01", "older").unionByName(rows(250, 260, "2024-01-02", "same")).unionByName(rows(5, 9, None, "untimed"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(tables.upsert(stored, updates))
        one, other = p[p.index("SortMergeJoin"):].split("FileScan parquet", 1)
        assert "Exchange" not in one and "Bucketed: true" in p  # the stored side is scanned right under the join
        got = sorted(map(tuple, tables.upsert(stored, updates).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted(map(tuple, L.upsert(first, updates).select("file_hash", "name", "processed_at").collect()))
    version = tables.append_and_compact(spark, name, updates, 8)
    again = tables.append_and_compact(spark, version, updates, 8)
    assert sorted(map(tuple, spark.table(again).collect())) == got and len(spark.table(again).inputFiles()) == 8


def test_golden_copies_are_few_files(spark, sf):
    path = new_table_path(spark, "golden")
    docs = W.library(spark, sf).drop("file_hash").withColumn("content", F.col("text")).repartition(32)
    L.write_golden_copies(L.render_golden_copy(docs, F.lit("d"), F.lit("t")), path)
    stored = spark.read.parquet(path)
    assert len(stored.inputFiles()) == stored.select("bucket").distinct().count()


def drain(query):
    query.awaitTermination()
    return query


def test_first_copies_state_and_replays(spark):
    source, out, check = (new_table_path(spark, n) for n in ("in", "out", "check"))
    rows = lambda ids, tag: spark.createDataFrame([(i, f"text {i % 50}{tag}") for i in ids], "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(source)
    for part in range(4):
        rows(range(part * 40, part * 40 + 40), "")
    stream = lambda: X.first_per_content(X.file_stream(spark, source, "*.parquet", "doc_id bigint, text string", files_per_batch=1), "2 seconds")
    run = lambda: drain(X.start(stream(), X.library_sink(out, ["doc_id"]), check))
    assert max(X.state_rows(run())) == 50  # one row of state per content
    time.sleep(3)
    rows(range(40), "")  # late copies: the state has given their hashes up, the library has them
    rows(range(1000, 1010), " new")
    last = run()
    rows(range(1010, 1012), " newer")
    time.sleep(3)
    assert max(X.state_rows(run())) < 50 + 12 and last.exception() is None
    found = [r["file_hash"] for r in spark.read.parquet(out).collect()]
    assert len(found) == len(set(found)) == 62
    X.library_sink(out, ["doc_id"])(spark.createDataFrame([(1, "h")], "doc_id bigint, file_hash string"), 90)
    X.library_sink(out, ["doc_id"])(spark.createDataFrame([(1, "h")], "doc_id bigint, file_hash string"), 90)  # a replay
    assert spark.read.parquet(out).filter("file_hash = 'h'").count() == 1


def test_final_windows_late_rows_and_compaction(spark):
    source, out, check = (new_table_path(spark, n) for n in ("in", "out", "check"))
    at = lambda minutes: f"2024-01-01 {minutes // 60:02d}:{minutes % 60:02d}:00"
    for rows in ([(0, "a"), (30, "a"), (70, "b")], [(200, "a"), (65, "b")], [(10, "a"), (62, "b"), (210, "a")], [(400, "a"), (205, "a")], [(20, "z"), (15, "a"), (401, "b")]):
        spark.createDataFrame([(at(m), k, 1.0) for m, k in rows], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(source)
    files = sorted(spark.read.parquet(source).inputFiles())
    assert len(files) == 5
    stream = X.file_stream(spark, source, "*.parquet", "ts timestamp_ntz, event_type string, value double", files_per_batch=1)
    for query in X.start_windows(stream, out, check, "30 minutes"):
        drain(query)
    settled = {(r["window"]["start"].hour, r["event_type"]): r for r in X.settled_windows(spark, out).collect()}
    batch = X.window_counts(spark.read.parquet(source)).collect()
    assert {k: r["n"] + r["n_late"] for k, r in settled.items()} == {(r["window"]["start"].hour, r["event_type"]): r["n"] for r in batch}
    assert settled[0, "a"]["status"] == "final" and settled[0, "z"]["n"] == 0 and settled[0, "z"]["n_late"] == 1
    assert settled[0, "a"]["n_late"] >= 1 and settled[6, "a"]["status"] == "open"
    merged = sorted(map(str, X.merged_windows(spark, f"{out}/all").collect()))
    merge = lambda df: df.groupBy("window", "event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    for upto in (2, 3, 3):
        X.compact(spark, f"{out}/all", upto, merge)
        assert sorted(map(str, X.merged_windows(spark, f"{out}/all").collect())) == merged
    assert spark.read.parquet(f"{out}/all").select("batch_id").distinct().count() == 2


def test_table_function_equals_the_expression(spark):
    docs = spark.createDataFrame([(1, "one\n\ntwo words here\n\nthree"), (2, None), (3, ""), (4, "x" * 50)], "doc_id int, text string")
    rules = (["\n\n", " "], 12, 4)
    C.register_split_recursive(spark, "cut_text", *rules)
    got = spark.sql("SELECT d.doc_id, c.* FROM {docs} AS d, LATERAL cut_text(d.text) AS c", docs=docs).collect()
    want = docs.select("doc_id", F.posexplode(C.split_recursive(F.col("text"), *rules)).alias("chunk_index", "content")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
