"""Judge replies to scores, scores to a report; structured analysis replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexflow.functions.text import strip_code_fence

JUDGE_SCHEMA = "faithfulness int, completeness int, citation_quality int, reasoning string, _bad string"
ANALYSIS_SCHEMA = (
    "tipo_documento string, tono_general string, nivel_urgencia int, nivel_coercion int, "
    "obligaciones_criticas array<struct<texto:string,sujeto:string,plazo:string,"
    "consecuencia_incumplimiento:string,nivel_criticidad:int>>, temas_principales array<string>, "
    "plazos_inmediatos array<string>, `ambigüedades_identificadas` array<string>, definiciones_clave map<string,string>, "
    "excepciones_mencionadas array<string>, entidades_afectadas array<string>, referencias_internas array<string>, "
    "menciones_de_otras_leyes array<string>, analisis_critico string, _bad string")
_JSON = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
METRICS = ("faithfulness", "completeness", "citation_quality")


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    """The caller's questions (id, question, intent) as a Parquet table."""
    return spark.read.parquet(path).select("id", "question", "intent")


def parse_json_reply(df: DataFrame, reply: str, schema: str) -> DataFrame:
    """Add the struct ``parsed`` and the flag ``valid``."""
    parsed = F.from_json(strip_code_fence(F.col(reply)), schema, _JSON)
    out = df.withColumn("parsed", parsed)
    return out.withColumn("valid", F.col("parsed").isNotNull() & F.col("parsed._bad").isNull())


def parse_judge(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Scores of a judge reply; anything that does not parse scores zero."""
    out = parse_json_reply(df, reply, JUDGE_SCHEMA)
    score = lambda m: F.when(F.col("valid"), F.coalesce(f"parsed.{m}", F.lit(0))).otherwise(0)
    reason = F.when(F.col("valid"), F.coalesce("parsed.reasoning", F.lit("N/A"))).otherwise("Fallo: invalid JSON")
    return out.withColumns({**{m: score(m) for m in METRICS}, "reasoning": reason}).drop("parsed", reply)


def summary(scores: DataFrame) -> DataFrame:
    means = scores.agg(*[F.avg(m).alias(m) for m in METRICS], F.count("*").alias("n"))
    overall = sum((F.col(m) for m in METRICS), F.lit(0.0)) / len(METRICS)
    return means.withColumn("overall", overall)


def detail(scores: DataFrame, latency_seconds: str) -> DataFrame:
    return scores.withColumn("latency", F.format_string("%.2fs", F.col(latency_seconds)))


def report_rows(scores: DataFrame, columns: list[str]) -> DataFrame:
    """One Markdown table row per evaluated question."""
    cells = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return scores.select(*columns, F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |")).alias("line"))


def write_report(scores: DataFrame, columns: list[str], path: str, labels: dict[str, str] | None = None) -> None:
    """Mean scores and a table as text parts, in order of the first column's own type.

    ``labels`` names the metrics; by default their column names stand.
    """
    named = {m: m for m in (*METRICS, "overall")} | (labels or {})
    s = summary(scores)
    text = F.concat(
        *(F.format_string(f"- {named[m]}: %.2f\n", m) for m in ("overall", *METRICS)), F.lit("\n"),
        F.lit("| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns)))
    first = scores.schema[columns[0]].dataType
    head = s.select(F.lit(0).alias("part"), F.lit(None).cast(first).alias("key"), text.alias("value"))
    body = report_rows(scores, columns).select(
        F.lit(1).alias("part"), F.col(columns[0]).alias("key"), F.col("line").alias("value"))
    head.unionByName(body).orderBy("part", "key").select("value").write.mode("errorifexists").text(path)


def parse_analysis(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Critical-analysis reply: parsed columns, or an error on the row."""
    out = parse_json_reply(df, reply, ANALYSIS_SCHEMA)
    error = F.when(~F.col("valid"), "Error procesando el análisis especializado: invalid JSON")
    return out.withColumn("error", error)


def obligations(analysed: DataFrame, *keys: str) -> DataFrame:
    rows = analysed.filter("valid").select(*keys, F.posexplode("parsed.obligaciones_criticas").alias("pos", "_o"))
    return rows.select(*keys, "pos", "_o.*")


def definitions(analysed: DataFrame, *keys: str) -> DataFrame:
    return analysed.filter("valid").select(*keys, F.explode("parsed.definiciones_clave").alias("term", "definition"))
