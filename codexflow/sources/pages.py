"""Page text to document text. Input: (doc_id, page_no, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexflow.functions.text import clean_page, strip


def _assemble(pages: DataFrame, text: Column, keys: list[str]) -> DataFrame:
    """Ordered concatenation per document, one shuffle on the document key.

    The result is one text value per document, so a group is no larger than the
    row it becomes.
    """
    parts = pages.select(*keys, "page_no", text.alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "part")))
    return parts.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda p: p["part"]), "\n\n").alias("text"))


def _readable(pages: DataFrame, max_pages: int | None) -> DataFrame:
    kept = pages.filter(strip(F.col("text")) != "")
    return kept if max_pages is None else kept.filter(F.col("page_no") <= max_pages)


def assemble_pages(pages: DataFrame, max_pages: int | None = None, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    mark = F.concat(F.lit("[Página "), F.col("page_no").cast("string"), F.lit("]\n"), F.col("text"))
    return _assemble(_readable(pages, max_pages), mark, list(keys))


def assemble_pages_markdown(pages: DataFrame, max_pages: int | None = None, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    mark = F.concat(F.lit("## Página "), F.col("page_no").cast("string"), F.lit("\n\n"), F.col("text"))
    return _assemble(_readable(pages, max_pages), mark, list(keys))


def assemble_clean_pages(pages: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Clean each page before joining, so furniture never lands inside an article."""
    cleaned = pages.withColumn("text", clean_page(F.col("text")))
    return _assemble(_readable(cleaned, None), F.col("text"), list(keys))
