import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codexflow.functions import fixed_values as V
from codexflow.functions.text import join_broken_paragraphs
from codexflow.functions.workers import split_text
from codexflow.operators import chunking as C


def slow_split(text, seps, size, overlap):
    """Brute force over lists of pieces, straight from the definition."""
    sep = next((s for s in seps if s in text), seps[-1])
    rest = seps[seps.index(sep) + 1:] if sep in text else []
    at = [m.start() for m in re.finditer(re.escape(sep), text)]
    cuts = sorted({0, *at, len(text)})
    pieces = [text[a:b] for a, b in zip(cuts, cuts[1:])]
    out, run = [], []

    def flush():
        held = []
        for p in run:
            if held and len("".join(held)) + len(p) > size:
                out.append("".join(held).strip())
                while held and (len("".join(held)) > overlap or len("".join(held)) + len(p) > size):
                    held.pop(0)
            held.append(p)
        out.append("".join(held).strip())

    for p in pieces:
        if len(p) < size:
            run.append(p)
            continue
        if run:
            flush()
        run = []
        out += slow_split(p, rest, size, overlap) if rest else [p]
    if run:
        flush()
    return [c for c in out if c]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n#", max_size=120), st.integers(3, 30), st.integers(0, 10))
def test_split_matches_brute_force(text, size, overlap):
    overlap = min(overlap, size - 1)
    assert split_text(text, ["\n#", "\n", " "], size, overlap) == slow_split(text, ["\n#", "\n", " "], size, overlap)


def test_split_on_documents(spark, sf):
    cut = C.split_recursive(F.col("text"), V.PAGE_TEXT_SEPARATORS, 300, 60)
    for row in spark.read.parquet(f"{sf}/documents.parquet").select("text", cut.alias("c")).collect():
        assert row["c"] == slow_split(row["text"], V.PAGE_TEXT_SEPARATORS, 300, 60)


def test_fixed_windows_rebuild_text(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text", C.split_fixed(F.col("text"), 80, 15).alias("c")).collect()
    for r in rows:
        assert r["c"][0] + "".join(p[15:] for p in r["c"][1:]) == r["text"]


@pytest.mark.parametrize("text, want", [
    ("# T\n\n## C\n\ntext one\nmore\n\npara\n### A\nx", [("T", "C", None, "# T  \n## C  \ntext one\nmore  \npara"), ("T", "C", "A", "### A\nx")]),
    ("intro\n## C\na\n## C\nb\n# T\nc", [(None, None, None, "intro"), (None, "C", None, "## C\na  \n## C\nb"), ("T", None, None, "# T\nc")]),
    ("#no\n##### five\n#", [("", None, None, "#no\n##### five  \n#")]),
    ("## A\n```\n# code\n\n## more\n```\ntail", [(None, "A", None, "## A\n```\n# code\n\n## more\n```\ntail")]),
    ("", []),
])
def test_headers(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string").select(C.split_headers(F.col("t")).alias("s"))
    assert [(s["h1"], s["h2"], s["h3"], s["content"]) for s in df.first()["s"]] == want


def loop_join(text):
    parts, out, i = [p.strip() for p in re.split(r"\n\n+", text)], [], 0
    starts = re.compile(r"(ART[IÍ]CULO|CAP[IÍ]TULO|SECCI[OÓ]N|P[AÁ]R[AÁ]GRAFO|\d+\.\s|\(Decreto|\(Par[aá]grafo)", re.I)
    while i < len(parts):
        nxt = parts[i + 1] if i + 1 < len(parts) else ""
        joins = parts[i] and parts[i][-1] not in ".;:)]\"" and nxt and not starts.match(nxt)
        out.append(parts[i] + " " + nxt if joins else parts[i])
        i += 2 if joins else 1
    return "\n\n".join(out)


def test_join_broken_paragraphs(spark):
    import random

    rng = random.Random(5)
    pool = ["abierto", "cerrado.", "¿qué?", "coma,", "ARTÍCULO 1. x", "parágrafo 2", "3. tres", "(Decreto 1)", "", "fin;", "sigue\nmás"]
    texts = ["\n\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", join_broken_paragraphs(F.col("t")).alias("x"))
    for r in df.collect():
        assert r["x"] == loop_join(r["t"])


def test_adaptive_keeps_what_fits(spark):
    table = "## T\n| a | b |\n| - | - |\n| 1 | 2 |"
    long = "## L\n" + "palabra " * 300
    rows = C.chunk_adaptive(spark.createDataFrame([(1, table + "\n" + long), (2, "")], "doc_id int, text string")).collect()
    assert rows[0]["content"] == table and not rows[0]["is_refined"]
    assert all(r["is_refined"] and len(r["content"]) <= 800 for r in rows[1:])
    assert [r["chunk_index"] for r in rows] == list(range(len(rows))) and {r["doc_id"] for r in rows} == {1}


def test_sections_and_paragraphs_grow_with_the_lines(spark):
    """Time per line of a long document stays within three times that of a short one."""
    import time

    def seconds(lines, copies):
        text = "\n\n".join(("## T" if i % 50 == 0 else "## ARTÍCULO" if i % 50 == 1 else f"línea {i} abierta") for i in range(lines))
        df = spark.createDataFrame([(text,)] * copies, "t string").coalesce(1)
        run = lambda: df.select(F.size(C.split_headers(F.col("t"))), F.length(join_broken_paragraphs(F.col("t")))).collect()
        run()
        start = time.perf_counter()
        run()
        return (time.perf_counter() - start) / (lines * copies)

    assert seconds(50_000, 1) < 3 * seconds(1_000, 50) + 1e-5


def test_parents_of_all_sections(spark):
    rows = C.with_parents(spark.createDataFrame([(1, "corto"), (2, "x" * 500)], "doc_id int, content string"), size=300, overlap=50).collect()
    assert [(r["doc_id"], r["child_no"], len(r["child"]), len(r["parent"])) for r in rows] == [(1, 0, 5, 5), (2, 0, 300, 500), (2, 1, 250, 500)]


def test_temporary_tables_go(spark):
    from codexflow.session import cut_lineage, temporary_tables
    from codexflow.sources.files import exists

    with temporary_tables(spark):
        path = cut_lineage(spark.range(3), "scratch").inputFiles()[0].rsplit("/", 1)[0]
        assert exists(spark, path)
    assert not exists(spark, path)
