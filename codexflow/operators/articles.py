"""Exact article lookup: segments are tested for the asked numbers where they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexflow.functions import fixed_values as V
from codexflow.functions.fields import question_article
from codexflow.functions.text import strip
from codexflow.session import cut_lineage

NUMBERS_AT_ONCE = 1_000_000  # asked article numbers, some 30 MB, that travel to the scan


def _segments(text: Column, starts: str) -> Column:
    return F.split(text, rf"(?iU)\n(?={starts})")


def article_spans(
    docs: DataFrame, order: Column, text: str = "text", markdown: bool = False, wanted: DataFrame | None = None,
) -> DataFrame:
    """(article, place, span): one row per article and segment that names it.

    A span runs from the mention to the end of its segment, that is to the next
    article, chapter or section. A document is cut in its own row. With
    ``wanted`` (article, no repeats) only these articles are looked at.
    """
    starts, mention = (V.HEADING_STARTS, V.HEADING_MENTION) if markdown else (V.PLAIN_STARTS, V.PLAIN_MENTION)
    cut = docs.select(order.alias("_doc"), F.posexplode_outer(_segments(F.col(text), starts)).alias("seg_no", "seg"))
    cut = cut.withColumn("seg", F.concat("seg", F.lit("\n")))
    named = F.array_distinct(F.regexp_extract_all("seg", F.lit(f"(?iU){mention}"), F.lit(1)))
    rows = cut.select("_doc", "seg_no", "seg", F.explode_outer(named).alias("article")).filter("article IS NOT NULL")
    if wanted is not None:
        rows = rows.join(wanted, "article", "left_semi")
    tail = r"(?:\.|(?![\d.]))" if markdown else r"\.?\s"
    head = r"#{1,4}\s*" if markdown else ""
    # the number is quoted, so its dots are literal
    pattern = F.concat(F.lit(rf"(?isU){head}ART[IÍ]CULO\s*\Q"), F.col("article"), F.lit(rf"\E{tail}.*"))
    span = strip(F.call_function("regexp_extract", F.col("seg"), pattern, F.lit(0)))
    return rows.select("article", F.struct("_doc", "seg_no").alias("place"), span.alias("span"))


def first_spans(spans: DataFrame) -> DataFrame:
    """First place wins. min_by combines before the shuffle, so an article that
    very many documents repeat sends one row per task."""
    return spans.groupBy("article").agg(F.min_by("span", "place").alias("span"), F.min("place").alias("place"))


def lookup(
    questions: DataFrame, docs: DataFrame, order: Column, text: str = "text", markdown: bool = False, most: int = NUMBERS_AT_ONCE,
) -> DataFrame:
    """(qid, question, article, span); span is NULL when not found or not asked.

    Up to ``most`` different asked numbers travel to the scan, so only their spans are shuffled;
    more numbers are met in a shuffle of the segments that name an article. Either way the texts are read once.
    """
    asked = questions.withColumn("article", question_article(F.col("question")))
    numbers = cut_lineage(asked.select("article").filter("article IS NOT NULL").distinct(), "asked-numbers")
    wanted = F.broadcast(numbers) if numbers.count() <= most else numbers

    def found(as_markdown):
        return first_spans(article_spans(docs, order, text, as_markdown, wanted)).filter("span <> ''").drop("place")

    plain = found(False).withColumnRenamed("span", "plain")
    out = asked.join(plain, "article", "left")
    if markdown:
        out = out.join(found(True).withColumnRenamed("span", "heading"), "article", "left")
        return out.select("qid", "question", "article", F.coalesce("heading", "plain").alias("span"))
    return out.select("qid", "question", "article", F.col("plain").alias("span"))
