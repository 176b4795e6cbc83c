"""Inputs that the queries derive from the given tables, in Spark.

The same views are written as SQL in ``workload/sqlviews.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FOOTER = "Decreto 1072 de 2015 Sector Trabajo "
PAGE_CHARS = 1500


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the file footer only once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _cat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def legal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, body): every document with legal structure added."""
    d = F.col("doc_id")

    def line(x, i):
        head = _cat("Resolución No. 0", d + 1000, " de la Secretaría Distrital de Ambiente, 5 de marzo de ",
                    d % 10 + 2010, ". NIT: ", d + 900000000, ". ", x)
        return (F.when(i == 0, head)
                .when(i % 4 == 1, _cat("## CONSIDERANDO\n\n", x))
                .when(i % 4 == 2, _cat("### ARTÍCULO 2.2.", d % 5, ".", i, ". ", x))
                .when(i % 4 == 3, _cat("PARÁGRAFO 1. ", x, " 120,5 m³ ____"))
                .otherwise(x))

    body = F.array_join(F.transform(F.split("text", "\n"), line), "\n\n")
    return documents(spark, sf_dir).select("doc_id", "source", body.alias("body"))


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The legal view without heading marks, as extracted page text looks."""
    return legal(spark, sf_dir).withColumn("body", F.regexp_replace("body", "#+ ", ""))


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain view with page furniture after it."""
    tail = _cat("\n\n\n\n\n[Página 3]\n", FOOTER, F.col("doc_id"), " EVA - Gestor Normativo\n",
                "departamento administrativo de la función pública\n-----\nDiario Oficial No. 77  fin")
    return plain(spark, sf_dir).withColumn("body", F.concat("body", tail))


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, body): four kinds of documents for metadata extraction."""
    d, kind = F.col("doc_id"), F.col("doc_id") % 4
    contract = _cat("CONTRATO de obra, cláusula primera. RESOLUCIÓN Nro ", d + 100, " del 2019-0", d % 9 + 1,
                    "-1", d % 9, ", CAR. NIT ", d + 80000000, "-7, localidad de Usme y otros. ", F.col("body"))
    water = _cat("Solicitud de concesión de aguas subterráneas, pozo ", d, ", vereda El Salitre. N.I.T. ",
                 d + 7000000, ". Fecha 0", d % 9 + 1, "/12/2020. Tabla | a | b | ", F.replace("body", F.lit(" de marzo de "), F.lit(" marzo ")))
    bare = _cat("Cargo de la SDA en el municipio de Chía, 1 de Enero de 2021, 120 m³ del pozo ", d, ". ", F.col("body"))
    body = F.when(kind == 0, F.col("body")).when(kind == 1, contract).when(kind == 2, water).otherwise(bare)
    return legal(spark, sf_dir).select("doc_id", body.alias("body"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_no, text): fixed pages of every document."""
    last = F.greatest(F.ceil(F.col("n_chars") / PAGE_CHARS), F.lit(1)).cast("int")
    rows = documents(spark, sf_dir).select(
        "doc_id", "text", F.explode(F.sequence(F.lit(1), last)).alias("page_no"))
    start = (F.col("page_no") - 1) * PAGE_CHARS + 1
    return rows.select("doc_id", "page_no", F.substring("text", start, F.lit(PAGE_CHARS)).alias("text"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, question): each benchmark item as a whole, with an article it asks for."""
    q = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(q.alias("qid"), _cat(F.col("text"), " artículo 2.2.4.", q % 12).alias("question"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, content, lang, source, n_chars): texts under article numbers, some the start of others (2.2.4.1 and 2.2.4.11)."""
    content = _cat("Artículo 2.2.4.", F.col("doc_id") % 12, ". ", F.col("text"))
    return documents(spark, sf_dir).select("doc_id", content.alias("content"), "lang", "source", "n_chars")


def article_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, question): one article question per benchmark item."""
    q = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        q.alias("qid"), _cat("¿Qué dice el artículo 2.2.", q % 6, ".", q % 11 * 4 + 2, "?").alias("question"))


def question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, qvec, label): the vector stored under the item's number."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"))
    vecs = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), "label")
    return items.join(vecs, "qid")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def citable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as citable chunks: doc_id, content, article, page, source."""
    return passages(spark, sf_dir).select(
        "doc_id", "content",
        F.when(F.col("lang") == "es", _cat("2.2.", F.col("doc_id"))).alias("article"),
        F.when(F.col("lang") != "de", F.floor(F.col("n_chars") / PAGE_CHARS) + 1).alias("page"), "source")


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its content hash and a file path."""
    from codexflow.functions.text import content_hash

    return documents(spark, sf_dir).select(
        "doc_id", "lang", "source", "text", content_hash(F.col("text")).alias("file_hash"),
        _cat("in/", F.col("source"), "/doc ", F.col("doc_id"), ".pdf").alias("path"))


def with_blanks(docs: DataFrame) -> DataFrame:
    """``docs`` and, beside them, rows without text under new ids, whose conversion fails."""
    d = F.col("doc_id")
    blank = docs.filter("doc_id % 10 = 3").withColumns({"doc_id": -1 - d, "text": F.lit(" ")})
    if "file_hash" in docs.columns:
        blank = blank.withColumn("file_hash", F.sha2(F.concat(F.lit("blank "), d.cast("string")).cast("binary"), 256))
    return docs.unionByName(blank)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored entries: one per distinct content of the English documents."""
    lib = library(spark, sf_dir).filter("lang = 'en'")
    first = lib.groupBy("file_hash").agg(F.min("doc_id").alias("doc_id"), F.max(F.length("text")).alias("chars"))
    return first.select(
        "file_hash", _cat("doc ", F.col("doc_id"), ".pdf").alias("name"), _cat("doc_", F.col("doc_id"), ".md").alias("md_filename"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")), "yyyy-MM-dd").alias("processed_at"),
        F.lit("docling").alias("source_tool"), F.col("chars").cast("bigint").alias("chars"))


def judge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, reply): labels rendered as judge answers, some fenced, some cut off."""
    d = F.col("doc_id")
    body = _cat('{"faithfulness": ', F.col("quality") * 5, ', "completeness": ', F.col("toxic") * 3 + 1,
                ', "citation_quality": ', d % 6, ', "reasoning": "doc ', d, '"')
    reply = (F.when(d % 7 == 3, body).when(d % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("}\n```")))
             .otherwise(F.concat(body, F.lit("}"))))
    return table(spark, sf_dir, "labels").select("doc_id", reply.alias("reply"))


def analysis_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, reply): one critical-analysis answer per document, some broken."""
    d, n = F.col("doc_id"), F.col("n_chars")
    body = _cat('{"tipo_documento": "', F.col("source"), '", "tono_general": "', F.col("lang"), '", "nivel_urgencia": ', n % 10,
                ', "nivel_coercion": ', d % 5, ', "obligaciones_criticas": [{"texto": "o', d, '", "sujeto": "', F.col("source"),
                '", "plazo": "', n % 30, ' días", "consecuencia_incumplimiento": "multa", "nivel_criticidad": ', n % 3,
                '}, {"texto": "p', d, '", "nivel_criticidad": 1}], "temas_principales": ["', F.col("lang"),
                '"], "definiciones_clave": {"término": "', F.col("source"), '"}, "analisis_critico": "largo ', n, '"')
    reply = F.when(n % 7 == 0, body).when(d % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("}\n```"))).otherwise(
        F.concat(body, F.lit("}")))
    return documents(spark, sf_dir).select("doc_id", reply.alias("reply"))
