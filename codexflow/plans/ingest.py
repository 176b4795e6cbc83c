"""End-to-end ingestion as one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexflow.functions import fields
from codexflow.functions import fixed_values as V
from codexflow.functions.text import clean_by_profile, clean, file_suffix, strip_front_matter
from codexflow.operators.chunking import Splitter, chunk_markdown, chunk_page_text, with_adaptive_chunks
from codexflow.operators.enrich import enrich_chunks


def prepare(docs: DataFrame, text: str = "text", profile: str | Column = "legal_colombia") -> DataFrame:
    """Header block off, then cleaned."""
    body = strip_front_matter(F.coalesce(F.col(text), F.lit("")))
    return docs.withColumn(text, clean(body, profile) if isinstance(profile, str) else clean_by_profile(body, profile))


def ingest(
    docs: DataFrame, text: str = "text", tool: str = "direct_md", processed_at: Column | None = None,
    profile: str | Column = "legal_colombia", size: int = V.ADAPTIVE_SIZE, overlap: int = V.ADAPTIVE_OVERLAP,
    splitter: Splitter | None = None,
) -> DataFrame:
    """Enriched chunks; a document that yields none is one row with its error.

    Everything happens in the document's row up to the final explode: the plan
    has no shuffle, and good and bad rows come out of one pass.
    """
    suffix = F.ltrim(file_suffix(F.col("path")), F.lit(".")) if "path" in docs.columns else F.lit(None).cast("string")
    base = prepare(docs, text, profile).withColumns({
        "original_format": suffix, "extraction_tool": F.lit(tool),
        "processed_at": processed_at if processed_at is not None else F.current_timestamp()})
    rows = enrich_chunks(with_adaptive_chunks(base, text, size, overlap, splitter).drop(text), keep_empty=True)
    success, content = F.col("chunk_index").isNotNull(), F.col("content")
    return rows.withColumns({
        "article": fields.article_number(F.col("h3"), content), "page": fields.page_of(content), "chunk_size": F.length(content),
        "success": success, "error": F.when(~success, F.lit("no text extracted"))})


def ingest_with_loader(docs: DataFrame, loader: str, **options) -> DataFrame:
    """Older form: the loader's own chunker, chosen by name."""
    chunkers = {"pymupdf": chunk_page_text, "docling": chunk_markdown}
    if loader not in chunkers:
        raise ValueError(f"unknown loader {loader!r}; known: {', '.join(sorted(chunkers))}")
    return chunkers[loader](docs, **options).withColumn("loader", F.lit(f"{loader}_legal"))


def run(docs: DataFrame, path: str, collection: str, batch: str = "all", **options) -> None:
    """Partitioned by outcome: readers of ``success=true`` never see the quarantine
    rows beside it. A batch that is run again replaces its own rows."""
    rows = ingest(docs, **options)
    rows.write.mode("overwrite").partitionBy("success").parquet(f"{path}/collection={collection}/batch={batch}")
