"""Splitting a document into sections and chunks, inside its own row.

All splitters are Column -> array Column. Nothing is shuffled: a document's
lines, sections and chunks never leave the row until the final explode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexflow.functions import fields
from codexflow.functions import fixed_values as V
from codexflow.functions.arrays import empty, let
from codexflow.functions.text import clean_loader, strip, sub, when_any
from codexflow.functions.workers import batch_splitter, chunk_table

# A noncharacter: valid in a string, never part of text.
GUARD = "\ufdd1"
HEADER_LINE = r"#{1,4}(?:[ \n]|$)"
Splitter = Callable[[Column], Column]  # array<string> -> array<array<string>>


# ------------------------------------------------------------ fixed windows

def split_fixed(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters, each starting size - overlap after the last."""
    last = F.greatest(F.length(text) - overlap, F.lit(1)) - 1
    starts = F.sequence(F.lit(0), last, F.lit(size - overlap))
    return F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size)))


# --------------------------------------------------------- recursive split

def split_recursive_all(texts: Column, separators: list[str], size: int, overlap: int) -> Column:
    """array<string> -> array<array<string>>; NULL elements stay NULL.

    The one place where text goes through an Arrow batch: the same fold as
    array expressions gave equal chunks at about a thirtieth of the speed.
    """
    split = F.arrow_udf(batch_splitter(separators, size, overlap), "array<array<string>>")
    # not actually random: the mark keeps the optimizer from copying the call into filters
    return split.asNondeterministic()(texts)


def split_recursive(text: Column, separators: list[str], size: int, overlap: int) -> Column:
    return F.coalesce(F.get(split_recursive_all(F.array(text), separators, size, overlap), F.lit(0)),
                      empty("array<string>"))


def register_split_recursive(spark: SparkSession, name: str, separators: list[str], size: int, overlap: int) -> None:
    """SQL twin of ``split_recursive``: ``SELECT doc_id, c.* FROM docs, LATERAL name(text) AS c`` gives (chunk_index, content)."""
    spark.udtf.register(name, F.udtf(chunk_table(separators, size, overlap), returnType="chunk_index bigint, content string"))


def recursive_splitter(separators: list[str], size: int, overlap: int) -> Splitter:
    return lambda texts: split_recursive_all(texts, separators, size, overlap)


def fixed_splitter(size: int, overlap: int) -> Splitter:
    return lambda texts: F.transform(texts, lambda t: F.when(t.isNotNull(), split_fixed(t, size, overlap)))


# ---------------------------------------------------------- header sections

def _guard_fences(text: Column) -> Column:
    """Hide headings and blank lines inside fenced blocks from the section cutter."""
    def hide(t):
        parts = F.split(t, r"(?m)^(?=(?:```(?!.*```)|~~~))")
        return F.array_join(F.transform(
            parts, lambda p, i: F.when(i % 2 == 1, sub(p, r"\n(?=[#\n])", "\n" + GUARD)).otherwise(p)), "")

    return when_any(text, ("```", "~~~"), hide)


def split_headers(text: Column) -> Column:
    """array<struct<h1,h2,h3,h4,content>>: text between Markdown headings.

    Lines are stripped; paragraphs of a section are joined by a Markdown line
    break. A heading clears deeper levels. Neighbours with the same heading path
    merge, and a section that ends in a bare heading merges into its child.
    """
    lines = F.array_join(F.transform(F.split(text, "\n"), strip), "\n")
    body = sub(strip(_guard_fences(lines)), r"\n{2,}", "  \n")
    body = sub(body, rf"(?<! )\n(?={HEADER_LINE})", "  \n")
    blocks = F.split(body, rf"  \n(?={HEADER_LINE})")

    def describe(b):
        marks = F.regexp_extract(b, rf"^(#{{1,4}})(?:[ \n]|$)", 1)
        title = strip(F.regexp_extract(b, r"^#+([^\n]*)", 1))
        return F.struct(
            b.alias("text"), F.length(marks).alias("level"), title.alias("title"),
            (F.left(F.substring_index(b, "\n", -1), F.lit(1)) == "#").alias("bare"))

    return let(F.filter(F.transform(blocks, describe), lambda b: b["text"] != ""), _sections)


PATH = ("h1", "h2", "h3", "h4")


def _last_of_level(blocks: Column, level: int) -> Column:
    """Per block: the position of the last heading of this level so far, or -1."""
    def spread(at):
        until = lambda k: F.coalesce(F.get(at, k), F.size(blocks))
        runs = F.transform(at, lambda p, k: F.array_repeat(p, until(k + 1) - p))
        return F.concat(F.array_repeat(F.lit(-1), until(F.lit(0))), F.flatten(runs))

    found = F.filter(F.transform(blocks, lambda b, i: F.when(b["level"] == level, i)), F.isnotnull)
    return let(found, spread)


def _sections(blocks: Column) -> Column:
    """Blocks to sections in linear time: heading positions give every block its
    path, and neighbours alone decide where a section starts."""
    def paths(last):
        def path(b, i):
            at = [F.get(last[h], i) for h in PATH]
            own = [at[0] >= 0, *(at[n] > F.greatest(F.lit(-1), *at[:n]) for n in range(1, 4))]
            named = [F.when(own[n], F.get(blocks, at[n])["title"]).alias(h) for n, h in enumerate(PATH)]
            depth = sum((F.when(own[n] & F.get(blocks, at[n])["title"].isNotNull(), 1).otherwise(0) for n in range(4)), F.lit(0))
            return F.struct(F.struct(*named).alias("path"), depth.alias("depth"), b["bare"].alias("bare"))

        return F.transform(blocks, path)

    def cut(placed):
        def starts_section(x, i):
            before = F.get(placed, i - 1)
            merges = before["path"].eqNullSafe(x["path"]) | (before["bare"] & (before["depth"] < x["depth"]))
            return F.when((i == 0) | ~F.coalesce(merges, F.lit(False)), i)

        def collect(starts):
            def section(start, k):
                end = F.coalesce(F.get(starts, k + 1), F.size(blocks))
                texts = F.transform(F.slice(blocks, start + 1, end - start), lambda b: b["text"])
                content = F.replace(F.array_join(texts, "  \n"), F.lit(GUARD), F.lit(""))
                return F.struct(*[F.get(placed, end - 1)["path"][h].alias(h) for h in PATH], content.alias("content"))

            return F.transform(starts, section)

        return let(F.filter(F.transform(placed, starts_section), F.isnotnull), collect)

    last = F.struct(*[_last_of_level(blocks, n).alias(h) for n, h in enumerate(PATH, start=1)])
    return let(let(last, paths), cut)


# ---------------------------------------------------------------- composites

def _subchunks(sections: Column, size: int, splitter: Splitter) -> Column:
    """Sections that fit stay whole (tables are not cut); others are refined."""
    oversize = F.transform(sections, lambda s: F.when(F.length(s["content"]) > size, s["content"]))

    def refine(pair):
        s, cut = pair["s"], pair["cut"]
        heads = [s[h].alias(h) for h in ("h1", "h2", "h3", "h4")]
        return F.transform(
            F.coalesce(cut, F.array(s["content"])),
            lambda c, i: F.struct(
                *heads, F.when(cut.isNotNull(), i).alias("section_chunk_index"),
                cut.isNotNull().alias("is_refined"), c.alias("content")))

    pairs = F.arrays_zip(sections.alias("s"), splitter(oversize).alias("cut"))
    return F.flatten(F.transform(pairs, refine))


def with_adaptive_chunks(
    df: DataFrame, text: str = "text", size: int = V.ADAPTIVE_SIZE, overlap: int = V.ADAPTIVE_OVERLAP,
    splitter: Splitter | None = None,
) -> DataFrame:
    """Add a ``chunks`` array column, still one row per document."""
    splitter = splitter or recursive_splitter(V.ADAPTIVE_SEPARATORS, size, overlap)
    sections = df.withColumn("_sections", split_headers(F.col(text)))
    return sections.withColumn("chunks", _subchunks(F.col("_sections"), size, splitter)).drop("_sections")


def explode_chunks(df: DataFrame, chunks: str = "chunks", keep_empty: bool = False) -> DataFrame:
    """One row per chunk with a document-wide, 0-based chunk_index.

    ``keep_empty`` keeps a document without chunks as one row of NULLs.
    """
    keep = [c for c in df.columns if c != chunks]
    # the outer form spares the size filter that Spark infers for a plain explode,
    # which would compute the whole array a second time below the projection
    rows = df.select(*keep, F.posexplode_outer(chunks).alias("chunk_index", "_c"))
    if not keep_empty:
        rows = rows.filter("_c IS NOT NULL")
    return rows.select(*keep, "chunk_index", "_c.*")


def with_chunk_id(chunks: DataFrame) -> DataFrame:
    """One key per chunk, for document ids of any type: ``id#index``."""
    return chunks.withColumn("chunk_id", F.concat_ws("#", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")))


def with_parents(sections: DataFrame, content: str = "content", size: int = V.ADAPTIVE_SIZE, overlap: int = V.ADAPTIVE_OVERLAP) -> DataFrame:
    """One row per child window of every section, beside its whole parent."""
    keep = [c for c in sections.columns if c != content]
    cut = F.posexplode(split_fixed(F.col(content), size, overlap)).alias("child_no", "child")
    return sections.select(*keep, F.col(content).alias("parent"), cut)


def chunk_adaptive(
    df: DataFrame, text: str = "text", size: int = V.ADAPTIVE_SIZE, overlap: int = V.ADAPTIVE_OVERLAP,
    splitter: Splitter | None = None,
) -> DataFrame:
    """Headings first, then size; empty documents give no rows."""
    return explode_chunks(with_adaptive_chunks(df, text, size, overlap, splitter).drop(text))


def chunk_page_text(
    df: DataFrame, text: str = "text", source: str = "source", size: int = V.LOADER_SIZE,
    overlap: int = V.LOADER_OVERLAP, splitter: Splitter | None = None, min_chars: int = 1,
) -> DataFrame:
    """Assembled page text to chunks with a context line; chunks shorter than
    ``min_chars`` (by default: blank ones) are dropped after numbering."""
    splitter = splitter or recursive_splitter(V.PAGE_TEXT_SEPARATORS, size, overlap)
    keep = [c for c in df.columns if c != text]
    cut = F.flatten(splitter(F.array(clean_loader(F.col(text)))))
    pieces = df.select(*keep, F.posexplode_outer(cut).alias("chunk_index", "_piece"))
    out = (
        pieces.filter(F.length(strip(F.col("_piece"))) >= min_chars)
        .withColumn("article", fields.article_of(F.col("_piece")))
        .withColumn("page", fields.page_of(F.col("_piece"))))
    header = fields.context_header(F.col(source), F.col("article"), F.col("page"))
    return (
        out.withColumn("content", F.concat(header, strip(F.col("_piece"))))
        .withColumn("chunk_size", F.length("content")).drop("_piece"))


def chunk_markdown(
    df: DataFrame, text: str = "text", source: str = "source", size: int = V.LOADER_SIZE,
    overlap: int = V.LOADER_OVERLAP, splitter: Splitter | None = None, min_chars: int = 1,
) -> DataFrame:
    """Markdown to chunks with a context line; numbering counts kept chunks only,
    those of ``min_chars`` or more (by default: all but blank ones)."""
    splitter = splitter or recursive_splitter(V.MARKDOWN_SEPARATORS, size, overlap)
    chunked = with_adaptive_chunks(df.withColumn(text, clean_loader(F.col(text))), text, size, overlap, splitter)
    kept = F.filter("chunks", lambda c: F.length(strip(c["content"])) >= min_chars)
    out = explode_chunks(chunked.withColumn("chunks", kept).drop(text))
    out = out.withColumn("article", fields.article_number(F.col("h3"), F.col("content")))
    title = F.coalesce(F.nullif("h2", F.lit("")), F.nullif("h1", F.lit("")))
    header = fields.context_header_markdown(F.col(source), F.col("article"), title)
    return (
        out.withColumn("content", F.concat(header, strip(F.col("content"))))
        .withColumn("chunk_size", F.length("content")).withColumn("format", F.lit("markdown")))
