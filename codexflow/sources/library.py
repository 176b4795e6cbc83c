"""Content-addressed document library: a table keyed by content hash.

Manifest columns: file_hash, name, md_filename, processed_at, source_tool, chars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexflow.functions.text import content_hash, file_name, file_stem, sanitize_name, strip
from codexflow.sources.files import exists
from codexflow.sources.sketch import marked

MANIFEST_SCHEMA = (
    "file_hash string, name string, md_filename string, processed_at string, source_tool string, chars bigint")


def read_manifest(spark: SparkSession, path: str, quarantine: str | None = None) -> DataFrame:
    """Missing manifest gives no rows. Malformed lines are written to ``quarantine``
    as text, or are an error where no such folder is given: a forgotten entry
    would be converted again."""
    if not exists(spark, path):
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    raw = spark.read.schema(MANIFEST_SCHEMA + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    bad = spark.read.text(path).filter(F.trim("value") != "").select("value", F.from_json(
        "value", MANIFEST_SCHEMA + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r")).filter(
        "r._bad IS NOT NULL OR r.file_hash IS NULL").select("value")
    if quarantine is not None:
        bad.write.mode("overwrite").text(quarantine)
    elif not bad.isEmpty():
        raise ValueError(f"malformed manifest lines in {path}; name a quarantine folder to set them aside")
    return raw.filter("_bad IS NULL AND file_hash IS NOT NULL").drop("_bad")


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Write a new version; the caller points readers at it (a table being read
    is never overwritten in place)."""
    manifest.write.mode("errorifexists").json(path)


def md_filename(path: Column, file_hash: Column) -> Column:
    return F.concat(sanitize_name(file_stem(path)), F.lit("_"), file_hash, F.lit(".md"))


def render_golden_copy(
    docs: DataFrame, processed_at: Column, source_tool: Column, path: str = "path", content: str = "content",
    body: str = "text",
) -> DataFrame:
    """Add file_hash, md_filename and the rendered file (header block + body)."""
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\n"))
    hashed = docs.withColumn("file_hash", content_hash(F.col(content)))
    return hashed.withColumns({
        "md_filename": md_filename(F.col(path), F.col("file_hash")),
        "rendered": F.concat(
            F.lit("---\n"), line("source_pdf", file_name(F.col(path))), line("processed_at", processed_at),
            line("source_tool", source_tool), line("file_hash", F.col("file_hash")), F.lit("---\n\n"), F.col(body)),
        "processed_at": processed_at, "chars": F.length(body).cast("bigint")})


def write_golden_copies(rendered: DataFrame, path: str, files_per_bucket: int = 1) -> None:
    """Parquet bucketed by hash prefix: 256 folders of ``files_per_bucket`` files, however many tasks or documents."""
    salt = F.pmod(F.xxhash64("file_hash"), F.lit(files_per_bucket))
    dealt = rendered.withColumn("bucket", F.substring("file_hash", 1, 2)).repartition("bucket", salt)
    dealt.write.mode("append").partitionBy("bucket").parquet(path)


def golden_copies(spark: SparkSession, path: str) -> DataFrame:
    """The stored copies; of a document converted again only the latest."""
    return latest_per_hash(spark.read.parquet(path).drop("bucket"), F.struct("processed_at", "rendered"))


def known(docs: DataFrame, manifest: DataFrame, sketch: DataFrame | None = None) -> DataFrame:
    """Documents that are stored. With the library's ``sketch`` only those that may be are shuffled."""
    maybe = docs if sketch is None else marked(docs, sketch).filter("maybe_stored").drop("maybe_stored")
    return maybe.join(manifest.select("file_hash"), "file_hash", "left_semi")


def unknown(docs: DataFrame, manifest: DataFrame, sketch: DataFrame | None = None) -> DataFrame:
    """Documents that are not stored. With the library's ``sketch`` most of them stay where they are."""
    if sketch is None:
        return docs.join(manifest.select("file_hash"), "file_hash", "left_anti")
    told = marked(docs, sketch)
    maybe = told.filter("maybe_stored").drop("maybe_stored").join(manifest.select("file_hash"), "file_hash", "left_anti")
    return told.filter("NOT maybe_stored").drop("maybe_stored").unionByName(maybe)


def lookup(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest columns beside each document, NULL when it is not stored."""
    return docs.join(manifest, "file_hash", "left")


def latest_per_hash(rows: DataFrame, order: Column) -> DataFrame:
    """One row per hash, the last by ``order``.

    max_by combines on the map side, so a hash shared by very many copies sends
    one row per task, not all of them.
    """
    others = [c for c in rows.columns if c != "file_hash"]
    best = F.max_by(F.struct(*others), order).alias("_r")
    return rows.groupBy("file_hash").agg(best).select("file_hash", "_r.*")


def upsert(manifest: DataFrame, updates: DataFrame) -> DataFrame:
    """Same hash replaces; at equal time the update wins."""
    tagged = manifest.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    return latest_per_hash(tagged, F.struct("processed_at", "_new", "name")).drop("_new")


def list_all(manifest: DataFrame) -> DataFrame:
    return manifest.orderBy(F.desc("processed_at"), "file_hash")


def delete(manifest: DataFrame, gone: DataFrame) -> DataFrame:
    """Manifest without the entries whose ``file_hash`` is in ``gone``."""
    return manifest.join(gone.select("file_hash"), "file_hash", "left_anti").select(*manifest.columns)


def convert_incremental(docs: DataFrame, manifest: DataFrame, tool: Column, force: bool = False, sketch: DataFrame | None = None) -> DataFrame:
    """Route each document: stored ones are reused, new ones are converted.

    An empty conversion is a row-level error and does not stop the others. With the library's
    ``sketch`` the texts of documents that are surely new are not shuffled.
    """
    have = manifest.select("file_hash", F.lit(True).alias("_have"))
    if sketch is None:
        routed = docs.join(have, "file_hash", "left")
    else:
        told = marked(docs, sketch)
        maybe = told.filter("maybe_stored").drop("maybe_stored").join(have, "file_hash", "left")
        routed = maybe.unionByName(told.filter("NOT maybe_stored").drop("maybe_stored").withColumn("_have", F.lit(None).cast("boolean")))
    cached = F.coalesce("_have", F.lit(False)) if not force else F.lit(False)
    empty = ~F.col("was_cached") & (strip(F.coalesce("text", F.lit(""))) == "")
    return (
        routed.withColumn("was_cached", cached).drop("_have")
        .withColumn("tool", F.when(F.col("was_cached"), F.lit("cached")).otherwise(tool))
        .withColumn("error", F.when(empty, F.lit("no text extracted")))
        .withColumn("success", ~empty))
