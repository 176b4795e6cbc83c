import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexflow.operators.enrich import merge_extra
from codexflow.operators.quality import report
from codexflow.plans import ingest as I
from codexflow.session import new_table_path
from codexflow.sources import files, library as L, pages as P, registry, store
from codexflow.streaming import ingest as X


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.md").write_text("---\nk: v\n---\n\nRESUELVE algo útil", encoding="utf-8")
    (tmp_path / "sub" / "a.md").write_text("texto", encoding="utf-8")
    (tmp_path / "p.txt").write_text("uno\fdos", encoding="utf-8")
    (tmp_path / "skip.bin").write_text("x")
    return tmp_path


def test_paths(spark, folder):
    good = str(folder)
    assert files.resolve_paths(spark, [good, f"{good}/none", f"{good}/skip.bin"]) == [good]
    with pytest.raises(FileNotFoundError):
        files.resolve_paths(spark, [good, f"{good}/none"], mode="strict")
    with pytest.raises(ValueError):
        files.resolve_paths(spark, [f"{good}/skip.bin"])


def test_read_markdown_and_registry(spark, folder):
    rows = {r["source"]: r["text"] for r in files.read_markdown(spark, str(folder)).collect()}
    assert rows == {"b.md": "RESUELVE algo útil", "a.md": "texto"}
    got = registry.load("text", spark, str(folder)).orderBy("page_no").collect()
    assert [(r["page_no"], r["text"]) for r in got] == [(1, "uno"), (2, "dos")]
    with pytest.raises(ValueError):
        registry.load("ocr", spark, str(folder))


def test_digests_of_files_that_are_no_value(spark, tmp_path):
    """Read by lines, every file has the digest of its bytes, and no task holds it whole or reads a part of it."""
    random = np.random.default_rng(2)
    parts = [b"PAR1\n\n", b"\r\n", b"\r", b"\n", b"\xef\xbb\xbf", b"x", b"\x00\xff", b""]
    bodies = {f"{i} é%20+.parquet": b"".join(parts[p] for p in random.integers(0, len(parts), 1 + i % 9)) for i in range(120)}
    bodies |= {"large.parquet": random.bytes(70_000_000), "long line.parquet": b"PAR1" + b"a" * 30_000_000 + b"\n", "packed.gz.parquet": b"\x1f\x8b\n\n"}
    (tmp_path / "sub").mkdir()
    for i, (name, body) in enumerate(bodies.items()):
        (tmp_path / ("sub" if i % 2 else "") / name).write_bytes(body)
    (tmp_path / "other.bin").write_bytes(b"not asked for")
    want = sorted((name, len(body), hashlib.sha256(body).hexdigest()) for name, body in bodies.items() if body)  # Spark lists no empty file
    listed = files.scan_files(spark, str(tmp_path), "*.parquet")
    for whole in (3, 20, files.WHOLE_BYTES):
        found = files.with_sha256(listed, str(tmp_path), ".parquet", whole)
        assert sorted(map(tuple, found.select("name", "length", "sha256").collect())) == want
        assert sorted(r[0] for r in found.select("path").collect()) == sorted(r[0] for r in listed.select("path").collect())


def test_digests_do_not_need_the_content_of_large_files(spark, tmp_path):
    (tmp_path / "a.parquet").write_bytes(b"PAR1\nx" * 1000)
    kept = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 5000)
    try:
        got = files.with_sha256(files.scan_files(spark, str(tmp_path), "*.parquet"), str(tmp_path), ".parquet", 5000).first()
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", kept)
    assert (got["length"], got["sha256"]) == (6000, hashlib.sha256(b"PAR1\nx" * 1000).hexdigest())


def test_pages_cap_and_blank(spark):
    pages = spark.createDataFrame([(1, n, "x" if n != 2 else " \n") for n in range(1, 405)], "doc_id int, page_no int, text string")
    text = P.assemble_pages(pages).first()["text"]
    assert text.startswith("[Página 1]\nx\n\n[Página 3]\nx") and text.endswith("[Página 404]\nx")
    assert P.assemble_pages(pages, max_pages=400).first()["text"].endswith("[Página 400]\nx")


def test_quality_fallback(spark):
    pages = spark.createDataFrame([(1, 1, None), (2, 1, "Tabla Si")], "doc_id int, page_no int, text string")
    rows = {r["doc_id"]: r for r in report(pages).collect()}
    assert (rows[1]["quality_score"], rows[1]["recommendation"], rows[1]["needs_ocr"]) == (0.35, "ocr_heavy", True)
    assert rows[2]["recommendation"] == "docling" and rows[2]["reasoning"].startswith("Chars/page: 8, Coverage: 0.01, Tables: True")


def test_manifest_round_trip(spark, tmp_path):
    assert L.read_manifest(spark, str(tmp_path / "missing")).count() == 0
    row = spark.createDataFrame([("h", "n", "m.md", "2024", "t", 3)], L.MANIFEST_SCHEMA)
    L.write_manifest(row, str(tmp_path / "m"))
    (tmp_path / "m" / "bad.json").write_text("{not json\n")
    with pytest.raises(ValueError):
        L.read_manifest(spark, str(tmp_path / "m"))
    aside = str(tmp_path / "aside")
    assert [r["file_hash"] for r in L.read_manifest(spark, str(tmp_path / "m"), aside).collect()] == ["h"]
    assert [r[0] for r in spark.read.text(aside).collect()] == ["{not json"]


def test_incremental_errors_and_force(spark):
    docs = spark.createDataFrame([("h", "x"), ("e", " ")], "file_hash string, text string")
    stored = spark.createDataFrame([("h", "n", "m", "t", "s", 1)], L.MANIFEST_SCHEMA)
    rows = {r["file_hash"]: r for r in L.convert_incremental(docs, stored, F.lit("new")).collect()}
    assert rows["h"]["tool"] == "cached" and rows["e"]["error"] == "no text extracted"
    assert {r["tool"] for r in L.convert_incremental(docs, stored, F.lit("new"), force=True).collect()} == {"new"}


def test_store(spark, tmp_path):
    df = spark.range(45).withColumnRenamed("id", "k")
    got = store.with_batch_id(df, "k", 20).collect()
    assert all(r["batch_id"] == r["k"] // 20 for r in got) and len(got) == 45
    path = str(tmp_path / "c")
    assert store.count(spark, path, "a") == 0
    store.append(df, path, "a")
    store.append(df, path, "b")
    assert store.count(spark, path, "a") == 45
    store.register_case(df, "case_x")
    assert "case_x" in store.list_cases(spark) and store.clear_case(spark, "case_x") and "case_x" not in store.list_cases(spark)


def test_golden_copies(spark, tmp_path):
    docs = spark.createDataFrame([("in/año 1.pdf", "raw", "body")], "path string, content string, text string")
    out = L.render_golden_copy(docs, F.lit("2024"), F.lit("docling"))
    L.write_golden_copies(out, str(tmp_path / "g"))
    L.write_golden_copies(L.render_golden_copy(docs.withColumn("text", F.lit("again")), F.lit("2023"), F.lit("docling")), str(tmp_path / "g"))
    copies = L.golden_copies(spark, str(tmp_path / "g"))
    assert copies.count() == 1
    row = copies.first()
    assert row["md_filename"] == f"año_1_{row['file_hash']}.md" and len(row["file_hash"]) == 64 and row["rendered"].endswith("---\n\nbody")


def test_ingest_quarantine(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a.md", "## RESUELVE\nuno"), (2, "b.md", " \n"), (3, "c.md", None)], "doc_id int, source string, text string")
    I.run(docs, str(tmp_path / "o"), "main", processed_at=F.lit("t"))
    out = spark.read.parquet(str(tmp_path / "o"))
    assert {(r["doc_id"], r["success"]) for r in out.collect()} == {(1, "true"), (2, "false"), (3, "false")}
    assert out.filter("doc_id = 1").first()["section"] == "RESUELVE"
    with pytest.raises(ValueError):
        I.ingest_with_loader(docs, "ocr")


def test_merge_extra(spark):
    df = spark.sql("SELECT map('a','1','b','1') x, map('b','2','c','2') y, map('c','3') z")
    assert df.select(merge_extra(F.col("x"), F.col("y"), F.col("z"))).first()[0] == {"a": "1", "b": "2", "c": "3"}


def test_stream_over_several_batches(spark, tmp_path):
    schema = "doc_id bigint, text string"
    src, out, ckpt = str(tmp_path / "in"), new_table_path(spark, "dedupe"), str(tmp_path / "ck")
    spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], schema).write.parquet(f"{src}/one")
    run = lambda: X.start(X.file_stream(spark, f"{src}/*", "*.parquet", schema), X.dedupe_sink(out, "doc_id"), ckpt).awaitTermination()
    run()
    spark.createDataFrame([(4, "x"), (5, "z")], schema).write.parquet(f"{src}/two")
    run()
    spark.createDataFrame([(0, "x")], schema).write.parquet(f"{src}/three")
    run()
    want = {(0, 4), (3, 1), (5, 1)}
    state = lambda: {(r["doc_id"], r["copies"]) for r in X.once_per_content(spark, out, "doc_id").collect()}
    assert state() == want
    X.dedupe_sink(out, "doc_id")(spark.createDataFrame([(4, "x"), (5, "z")], schema), 1)  # a replay of the second batch changes nothing
    assert state() == want


def test_late_events_count(spark, tmp_path):
    out, schema = new_table_path(spark, "windows"), "ts string, event_type string, value double"
    sink = X.window_sink(out)
    sink(spark.createDataFrame([("2024-01-09 10:00:00", "a", 1.0)], schema), 0)
    sink(spark.createDataFrame([("2024-01-01 10:10:00", "a", 2.0), ("2024-01-09 10:59:00", "a", 3.0)], schema), 1)
    assert sorted((r["n"], r["total"]) for r in X.merged_windows(spark, out).collect()) == [(1, 2.0), (2, 4.0)]


def test_bad_bytes_stop_nothing(spark, tmp_path):
    (tmp_path / "good.md").write_text("bueno", encoding="utf-8")
    (tmp_path / "bad.md").write_bytes(b"caf\xe9 \xff")
    rows = {r["source"]: (r["text"], r["error"]) for r in files.read_markdown(spark, str(tmp_path)).collect()}
    assert rows == {"good.md": ("bueno", None), "bad.md": (None, "not UTF-8")}
    (tmp_path / "good.txt").write_text("uno\fdos", encoding="utf-8")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    assert sorted(str(r["text"]) for r in registry.load_multiple("text", spark, [str(tmp_path)]).collect()) == ["None", "dos", "uno"]


def test_content_key_covers_everything(spark):
    from codexflow.functions.text import content_hash

    start = "x" * 300_000
    df = spark.createDataFrame([(start + "a",), (start + "b",)], "t string")
    assert df.select(content_hash(F.col("t")).alias("h")).distinct().count() == 2


def test_failing_rows_of_a_model(spark):
    from codexflow.hooks import per_batch

    def load():
        def run(pdf):
            if (pdf["x"] == 2).any():
                raise RuntimeError("no")
            return pdf.assign(y=pdf["x"] * 10.0)

        return run

    rows = per_batch(load, "y double")(spark.createDataFrame([(1,), (2,), (3,)], "x int").coalesce(1)).collect()
    assert {r["x"]: (r["y"], r["error"]) for r in rows} == {1: (10.0, None), 2: (None, "RuntimeError: no"), 3: (30.0, None)}


def test_extra_metadata_precedence(spark):
    from codexflow.operators.chunking import with_adaptive_chunks
    from codexflow.operators.enrich import enrich_chunks

    docs = spark.sql("SELECT 1 doc_id, '## RESUELVE\\nResolución No. 0123 NIT 900123456' text, map('nit', 'old', 'origin', 'web', 'h2', 'old') extra")
    row = enrich_chunks(with_adaptive_chunks(docs).drop("text"), extra="extra").first()
    assert row["metadata"]["origin"] == "web" and row["metadata"]["nit"] == row["nit"] and row["metadata"]["h2"] == "RESUELVE" and "extra" not in row


def test_arriving_batches_have_a_file_per_core(spark, monkeypatch):
    from workload import corpus_queries as C

    made = []
    monkeypatch.setattr(C.X, "file_stream", lambda spark, path, glob, schema, files_per_batch: made.append((path, files_per_batch)))
    C._arriving(spark, spark.range(1000), "spread", "id bigint", batches=2)
    (path, files), = made
    assert files >= spark.sparkContext.defaultParallelism
    assert len(spark.read.parquet(path).inputFiles()) == 2 * files and spark.read.parquet(path).count() == 1000
