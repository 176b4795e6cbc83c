"""Document quality from page text, and the route it suggests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexflow.functions import fixed_values as V
from codexflow.functions.text import strip, tokens


def page_features(pages: DataFrame, sample_pages: int | None = None) -> DataFrame:
    """Per page (the first ``sample_pages`` if given): characters, words, coverage, table hint.

    Optional boolean input columns ``found_table`` and ``found_image`` add what a
    layout detector saw.
    """
    text = strip(F.coalesce("text", F.lit("")))
    has = lambda s: F.contains(F.col("_t"), F.lit(s))
    seen = lambda c: F.col(c) if c in pages.columns else F.lit(False)
    return (
        (pages if sample_pages is None else pages.filter(F.col("page_no") <= sample_pages)).withColumn("_t", text)
        .withColumn("n_words", F.size(tokens(F.col("_t"))))
        .select(
            "doc_id", "page_no", F.length("_t").alias("chars"), "n_words",
            F.least(F.lit(1.0), F.col("n_words") / V.WORDS_PER_PAGE).alias("coverage"),
            (seen("found_table") | has("│") | (has("Tabla") & has("Si"))).alias("has_table"),
            seen("found_image").alias("has_image"), F.col("text").isNull().alias("unreadable")))


def document_features(features: DataFrame) -> DataFrame:
    """Fold page features per document; sums combine before the shuffle."""
    return features.groupBy("doc_id").agg(
        (F.sum("chars") / F.greatest(F.count("*"), F.lit(1))).alias("avg_chars"),
        F.coalesce(F.avg("coverage"), F.lit(0.0)).alias("avg_coverage"),
        F.bool_or("has_table").alias("has_tables"), F.bool_or("has_image").alias("has_images"),
        F.bool_and("unreadable").alias("unreadable"))


def quality_score(dpi: Column) -> Column:
    bonus = F.when(dpi > 200, 0.1).otherwise(0.0)
    raw = F.col("avg_chars") / V.CHARS_PER_PAGE * 0.55 + F.col("avg_coverage") * 0.35 + bonus
    return F.least(F.lit(1.0), raw)


def quality_flags(df: DataFrame) -> DataFrame:
    chars, cov = F.col("avg_chars"), F.col("avg_coverage")
    return df.withColumns({
        "is_native": (chars > V.NATIVE_MIN_CHARS) & (cov > V.NATIVE_MIN_COVERAGE),
        "is_scanned": (chars < V.SCANNED_MAX_CHARS) | (cov < V.SCANNED_MAX_COVERAGE)})


def route(df: DataFrame) -> DataFrame:
    """Decide on the unrounded score."""
    return df.withColumn(
        "recommendation",
        F.when(F.col("has_tables") & (F.col("score") < V.TABLE_QUALITY), V.ROUTE_LAYOUT)
        .when(F.col("is_scanned") | (F.col("score") < V.LOW_QUALITY), V.ROUTE_OCR)
        .when(F.col("is_native"), V.ROUTE_NATIVE).otherwise(V.ROUTE_LAYOUT))


def assess(pages: DataFrame, dpi: Column | None = None) -> DataFrame:
    """Features, score, flags and route for every document."""
    docs = document_features(page_features(pages))
    scored = docs.withColumn("score", quality_score(F.lit(V.DEFAULT_DPI) if dpi is None else dpi))
    return route(quality_flags(scored))


def _even(column: str, digits: int) -> Column:
    """Half-even rounding, undisturbed by the last bits of a sum."""
    return F.bround(F.round(column, 9), digits)


def report(pages: DataFrame, dpi: float = V.DEFAULT_DPI) -> DataFrame:
    """Rounded report; a document whose pages are all unreadable gets the safe
    fallback row instead of a score."""
    bad = F.col("unreadable")
    boolean = lambda c: F.when(F.col(c), "True").otherwise("False")
    reasoning = F.format_string(
        V.QUALITY_REASONING,
        _even("avg_chars", 0), _even("avg_coverage", 2), boolean("has_tables"), F.lit(dpi), "recommendation")
    either = lambda fallback, value: F.when(bad, F.lit(fallback)).otherwise(value)
    return assess(pages, F.lit(dpi)).select(
        "doc_id",
        either(False, F.col("is_native")).alias("is_native"),
        either(True, F.col("is_scanned")).alias("is_scanned"),
        either(V.FALLBACK_SCORE, _even("score", 3)).alias("quality_score"),
        either(0.0, _even("avg_chars", 1)).alias("avg_chars_per_page"),
        either(0.0, _even("avg_coverage", 3)).alias("text_coverage"),
        F.lit(dpi).alias("dpi_estimate"),
        either(False, F.col("has_tables")).alias("has_tables"),
        either(False, F.col("has_images")).alias("has_images"),
        either(V.ROUTE_OCR, F.col("recommendation")).alias("recommendation"),
        either(True, F.col("recommendation") == V.ROUTE_OCR).alias("needs_ocr"),
        either("Error: no readable page → Fallback OCR Safe", reasoning).alias("reasoning"))
