"""Named sources. A source gives (doc_id, page_no, text)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexflow.sources.files import scan_files, utf8

Source = Callable[..., DataFrame]
_SOURCES: dict[str, Source] = {}


def register_source(name: str, fn: Source) -> None:
    _SOURCES[name] = fn


def source_names() -> list[str]:
    return sorted(_SOURCES)


def load(name: str, spark: SparkSession, paths: list[str] | str, **options) -> DataFrame:
    if name not in _SOURCES:
        raise ValueError(f"unknown source {name!r}; known: {', '.join(source_names())}")
    return _SOURCES[name](spark, paths, **options)


def load_multiple(name: str, spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """All paths in one scan; a file that is not UTF-8 is one page without text."""
    return load(name, spark, paths, **options)


def _text_pages(spark: SparkSession, paths: list[str] | str, glob: str = "*.txt") -> DataFrame:
    """Form feeds separate pages."""
    files = scan_files(spark, paths, glob)
    pages = F.posexplode(F.coalesce(F.split(utf8(F.col("content")), "\f"), F.array(F.lit(None).cast("string")))).alias("pos", "text")
    return files.select(F.col("path").alias("doc_id"), pages).select(
        "doc_id", (F.col("pos") + 1).alias("page_no"), "text")


def _page_table(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    return spark.read.parquet(*([paths] if isinstance(paths, str) else paths)).select("doc_id", "page_no", "text")


register_source("text", _text_pages)
register_source("page_table", _page_table)
