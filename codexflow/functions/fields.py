"""Metadata fields of a legal document, as Column expressions over its text."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from codexflow.functions import fixed_values as V
from codexflow.functions.text import first_match, first_of, not_empty, strip


def resolution_number(text: Column) -> Column:
    return first_of(text, V.RESOLUTION_PATTERNS, 1)


def entity(text: Column, compat: bool = False) -> Column:
    """Issuing body. The two acronyms match as whole, upper-case words only;
    ``compat`` matches them anywhere in any case."""
    if compat:
        return strip(first_of(text, V.ENTITY_PATTERNS, 0))
    names, acronyms = V.ENTITY_PATTERNS[:3], V.ENTITY_PATTERNS[3:]
    return strip(F.coalesce(
        first_of(text, names, 0),
        *[first_match(text, rf"\b{p}\b", 0, "U") for p in acronyms]))


def issue_date(text: Column) -> Column:
    return first_of(text, V.DATE_PATTERNS, 0)


def issue_date_parsed(raw: Column) -> Column:
    """Typed date of any of the three accepted spellings, NULL if impossible."""
    day = F.regexp_extract(raw, r"^(\d{1,2})\s", 1)
    name = F.lower(F.regexp_extract(raw, r"(?iU)de\s+([a-z]+)\s+de", 1))
    year = F.regexp_extract(raw, r"(\d{4})$", 1)
    month = F.array_position(F.array(*[F.lit(m) for m in V.MONTHS]), name)
    long_form = F.when(
        month > 0,
        F.try_to_date(F.concat_ws("-", year, month.cast("string"), day), "y-M-d"))
    return F.coalesce(long_form, F.try_to_date(raw, "dd/MM/yyyy"), F.try_to_date(raw, "yyyy-MM-dd"))


def nit(text: Column) -> Column:
    return F.translate(first_of(text, V.NIT_PATTERNS, 1), " -\n\t", "")


def location(text: Column) -> Column:
    return strip(first_of(text, V.LOCATION_PATTERNS, 1))


def concession_type(text: Column) -> Column:
    return strip(first_of(text, V.CONCESSION_PATTERNS, 0))


def document_type(text: Column) -> Column:
    low = F.lower(text)
    every = lambda words: reduce(and_, [F.contains(low, F.lit(w)) for w in words])
    kinds = [(reduce(or_, map(every, ways)), name) for name, ways in V.DOCUMENT_TYPES]
    return F.coalesce(*[F.when(test, name) for test, name in kinds], F.lit(V.DOCUMENT_TYPE_ELSE))


def section(text: Column) -> Column:
    up = F.upper(text)
    named = [F.when(F.contains(up, F.lit(word)), label) for word, label in V.SECTION_WORDS]
    table = (F.contains(F.substring(up, 1, V.TABLE_WORD_WITHIN), F.lit(V.TABLE_WORD))
             | F.contains(F.substring(text, 1, V.TABLE_MARK_WITHIN), F.lit(V.TABLE_MARK)))
    return F.coalesce(*named, F.when(table, V.SECTION_TABLE), F.lit(V.SECTION_ELSE))


def legal_metadata(text: Column) -> Column:
    """All document-level fields as one struct."""
    kind, number = document_type(text), resolution_number(text)
    raw_date = issue_date(text)
    return F.struct(
        kind.alias("document_type"),
        number.alias("resolution_number"),
        entity(text).alias("entity"),
        raw_date.alias("issue_date"),
        issue_date_parsed(raw_date).alias("issue_date_parsed"),
        nit(text).alias("nit"),
        location(text).alias("location"),
        concession_type(text).alias("concession_type"),
        (kind == "resolucion").alias("is_resolucion"),
        number.isNotNull().alias("has_resolution_number"))


# ------------------------------------------------------------- chunk fields

def page_of(text: Column) -> Column:
    """First page mark in the chunk, NULL when the page is unknown."""
    return first_match(text, r"\[Página\s*(\d+)\]", 1, "U").cast("int")


def trim_article(number: Column) -> Column:
    return not_empty(F.rtrim(number, F.lit(".")))


def article_of(text: Column) -> Column:
    return trim_article(first_match(text, r"ARTÍCULO\s*([\d.]+)", 1, "iU"))


def article_number(header: Column, text: Column) -> Column:
    """Digits of the article heading, else the first article in the text."""
    return F.coalesce(trim_article(first_match(header, r"(\d[\d.]*)", 1, "U")), article_of(text))


def question_article(question: Column) -> Column:
    return first_match(question, V.ARTICLE_IN_QUESTION, 1, "U")


def context_header(source: Column, article: Column, page: Column) -> Column:
    info = F.coalesce(F.concat(F.lit("Art. "), article), F.lit("Contexto general"))
    page_text = F.coalesce(page.cast("string"), F.lit("?"))
    return F.concat(F.lit("[Documento: "), source, F.lit(" | "), info, F.lit(" | Página: "), page_text, F.lit("]\n"))


def context_header_markdown(source: Column, article: Column, section_title: Column) -> Column:
    info = F.coalesce(F.concat(F.lit("Art. "), article), F.lit("Contexto general"))
    part = F.coalesce(F.concat(F.lit(" | "), F.nullif(section_title, F.lit(""))), F.lit(""))
    return F.concat(F.lit("[Documento: "), source, F.lit(" | "), info, part, F.lit(" | Formato: Markdown]\n"))


def names_article(content: Column, article: Column) -> Column:
    """Whether the text holds exactly this article number, not one it is a part of."""
    exact = F.concat(F.lit(r"(?<![\d.])\Q"), article, F.lit(r"\E(?!\.?\d)"))
    return F.coalesce(article.isNotNull() & F.contains(content, article) & F.rlike(content, exact), F.lit(False))
