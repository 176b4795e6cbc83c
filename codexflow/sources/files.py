"""File sources: path resolution and Markdown scans."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexflow.functions.text import file_name, file_stem, file_suffix, strip_front_matter
from codexflow.functions.workers import digest_lines

log = logging.getLogger(__name__)
DEFAULT_GLOB = "*.{md,txt,html}"
WHOLE_BYTES = 16 << 20  # of a file that may be one value


def _status(spark: SparkSession, path: str) -> str:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return "missing"
    return "dir" if fs.getFileStatus(hadoop).isDirectory() else "file"


def resolve_paths(
    spark: SparkSession, paths: list[str], suffixes: tuple[str, ...] = (".md", ".txt", ".html"), mode: str = "lenient",
) -> list[str]:
    """Keep directories and files with a known suffix.

    ``lenient`` skips others with a warning, ``strict`` raises on the first one.
    An empty result is an error in both modes. Only the given roots are looked
    at here; Spark lists the files below them.
    """
    kept = []
    for path in paths:
        kind = _status(spark, path)
        if kind == "dir" or (kind == "file" and path.lower().endswith(suffixes)):
            kept.append(path)
        elif mode == "strict":
            raise FileNotFoundError(f"not a readable document or directory: {path}")
        else:
            log.warning("skipped %s: not a readable document or directory", path)
    if not kept:
        raise ValueError("no valid documents found")
    return kept


def scan_files(spark: SparkSession, paths: list[str] | str, glob: str = DEFAULT_GLOB) -> DataFrame:
    """File listing; the content column is read only when selected."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob).load(paths)
        .withColumn("name", file_name(F.col("path"))))


def with_sha256(files: DataFrame, paths: list[str] | str, suffix: str, whole: int = WHOLE_BYTES) -> DataFrame:
    """(path, name, length, sha256) of the ``files`` that ``scan_files`` found by ``*suffix`` in ``paths``.

    A file of over ``whole`` bytes is no value: its task reads it from start to end, a line and a batch of lines at a time.
    ``whole`` is 3 at least, as a byte order mark alone is no line.
    """
    small = files.filter(F.col("length") <= whole).select("path", "name", "length", F.sha2("content", 256).alias("sha256"))
    spark = files.sparkSession
    codec = spark._jvm.org.apache.hadoop.io.compress.PassthroughCodec  # bytes as they are, and no split
    lines = (
        spark.read.format("text").option("lineSep", "\n").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}")
        .option("io.compression.codecs", codec.CLASSNAME).option(codec.OPT_EXTENSION, suffix).load(paths)
        .filter(F.col("_metadata.file_size") > whole)
        .select("_metadata.file_path", "_metadata.file_size", F.col("value").cast("binary").alias("line")))
    large = lines.mapInArrow(digest_lines, "path string, length long, sha256 string")
    return small.unionByName(large.select("path", file_name(F.col("path")).alias("name"), "length", "sha256"))


def exists(spark: SparkSession, path: str) -> bool:
    return _status(spark, path) != "missing"


def utf8(content: Column) -> Column:
    """Text of binary content; NULL where the bytes are not UTF-8."""
    return F.try_validate_utf8(content.cast("string"))


def read_markdown(spark: SparkSession, paths: list[str] | str, glob: str = "*.md") -> DataFrame:
    """One row per file: path, source, header-free text, error. A file that is not
    UTF-8 has no text and says so; the others are not affected."""
    files = scan_files(spark, paths, glob).withColumn("_text", utf8(F.col("content")))
    return files.select("path", F.col("name").alias("source"), strip_front_matter(F.col("_text")).alias("text"),
                        F.when(F.col("_text").isNull(), F.lit("not UTF-8")).alias("error"))


def path_parts(df: DataFrame, path: str = "path") -> DataFrame:
    p = F.col(path)
    return df.withColumns({"name": file_name(p), "stem": file_stem(p), "suffix": file_suffix(p)})
