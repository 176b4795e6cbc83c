import pytest
from pyspark.sql import functions as F

from codexflow.functions import fields, text as T


@pytest.fixture
def run(spark):
    def apply(fn, value):
        df = spark.createDataFrame([(value,)], "t string")
        return df.select(fn(F.col("t")).alias("x")).first()["x"]

    return apply


@pytest.mark.parametrize("fn, given, want", [
    (T.clean_general, " a \t\n b c ", "a b c"),
    (T.clean_ocr, "él l I 1 o O 1 , 5", "él 1 1 1 0 0 1.5"),
    (T.clean_ocr, "1,2,3", "1.2,3"),
    (T.normalize_resolution_number, "RESOLUCIÓN No. 00123", "Resolución No. 123"),
    (T.inject_headings, "según el artículo 5\nARTÍCULO 5. x\n## RESUELVE", "según el artículo 5\n### ARTÍCULO 5. x\n## RESUELVE"),
    (T.strip_noise, "a Decreto 1072 de 2015 x EVA - Gestor Normativo b\nDecreto 1072 de 2015 EVA Gestor Normativo c ---- ___",
     "a  b\n c  ___"),
    (T.normalize_units, "120 m³, 3.5m³ y 2. L/s", "120 m³, 3.5 m³ y 2 L/s"),
    (lambda c: T.normalize_units(c, compat=True), "120 m³", "120. m³"),
    (T.collapse_blank, " a\n\n\n\n\nb   c\n", "a\n\n\nb c"),
    (T.clean_basic, "[Página 3]a\n\n\n\n\nb", "a\n\nb"),
    (T.clean_page, "a\n \n____\nb", "a\nb"),
    (T.clean_contract, "Cláusula primera\nlas partes", "### CLÁUSULA primera\n### LAS PARTES"),
    (T.fold_accents, "Ñandú ß œuvre Łódź", "Nandu ss oeuvre Lodz"),
    (T.strip_code_fence, "```json\n{}\n```", "{}"),
    (T.strip_front_matter, "---\na: b\n---\n\nbody ", "body"),
    (T.strip_front_matter, "--- no end", "--- no end"),
    (T.sanitize_name, "año 2/ñ-x", "año_2_ñ-x"),
    (T.file_stem, "/a/b.c/d.tar.gz", "d.tar"),
    (T.file_suffix, "/a/D.PDF", ".pdf"),
    (T.format_answer, "**(\nParágrafo adicionado** por Decreto 1)", "(Parágrafo adicionado por Decreto 1)"),
    (T.format_answer, "PARÁGRAFO\n1. texto", "PARÁGRAFO 1. texto"),
    (T.format_answer, "intro 1. Uno 2. Dos", "intro\n1. Uno\n2. Dos"),
    (T.format_answer, "fin. (Decreto 17 de 2016,\nart. 1)", "fin.\n\n(Decreto 17 de 2016, art. 1)"),
    (T.format_answer, "línea rota\naquí sigue", "línea rota aquí sigue"),
    (T.lines_to_markdown, "ARTÍCULO 1. x\n1. uno\n\nEVA - Gestor Normativo\ny", "## ARTÍCULO 1. x\n\n- 1. uno\ny"),
    (fields.resolution_number, "Resolución Nro 123", "123"),
    (fields.entity, "el cargo de la CAR", "CAR"),
    (lambda c: fields.entity(c, compat=True), "el cargo", "car"),
    (fields.issue_date, "el 5 de Marzo de 2020", "5 de Marzo de 2020"),
    (lambda c: fields.issue_date_parsed(c).cast("string"), "5 de Marzo de 2020", "2020-03-05"),
    (lambda c: fields.issue_date_parsed(c).cast("string"), "31/02/2020", None),
    (fields.nit, "NIT: 900123456-7", "9001234567"),
    (fields.location, "vereda El Salitre, lote", "El Salitre"),
    (fields.concession_type, "Concesión de aguas superficiales", "Concesión de aguas superficiales"),
    (fields.document_type, "pozo de 3 m³", "concesion_aguas"),
    (fields.section, "x" * 301 + "|", "GENERAL"),
    (fields.article_of, "artículo 2.2.1.", "2.2.1"),
    (fields.question_article, "¿artículo 2.2.2.4.11?", "2.2.2.4.11"),
    (fields.question_article, "artículo 5", None),
])
def test_values(run, fn, given, want):
    assert run(fn, given) == want


def test_clean_dispatch(run):
    assert run(lambda c: T.clean(c, "general"), None) == ""
    assert run(lambda c: T.clean(c, "unknown"), "CONSIDERANDO que") == "## CONSIDERANDO que"
    assert run(lambda c: T.clean(c, "general", remove_accents=True), "árbol") == "arbol"
    T.register_profile("shout", lambda c: F.upper(c))
    try:
        assert run(lambda c: T.clean(c, "shout"), "x") == "X"
    finally:
        T.PROFILES.pop("shout")


def test_markdown_table(spark):
    df = spark.createDataFrame([([["a", "b"], ["1", None]],), ([],), ([[]],)], "rows array<array<string>>")
    got = [r[0] for r in df.select(T.rows_to_markdown_table(F.col("rows"))).collect()]
    assert got == ["| a | b |\n| --- | --- |\n| 1 |  |\n", None, None]


def test_cleaners_are_idempotent(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for fn in (T.clean_general, T.clean_loader, T.clean_markdown, T.clean_page):
        once = fn(F.col("text"))
        assert docs.filter(once != fn(once)).count() == 0
