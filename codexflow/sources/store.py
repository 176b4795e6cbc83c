"""Chunk collections as Parquet, partitioned by collection name."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexflow.session import cut_lineage
from codexflow.sources.files import exists


def append(chunks: DataFrame, path: str, collection: str, batch: str | None = None) -> int:
    """Add chunks to a collection; returns how many rows the batch holds.

    Spark's own writer is the batching: each task writes its share, and a failed
    job leaves nothing visible. With ``batch`` the rows replace what that batch
    wrote before, so a repeated call doubles nothing.
    """
    if batch is None:
        batch = uuid.uuid4().hex
    target = f"{path}/collection={collection}/batch={batch}"
    chunks.write.mode("overwrite").parquet(target)
    return chunks.sparkSession.read.schema(chunks.schema).parquet(target).count()


def read(spark: SparkSession, path: str, collection: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("collection") == collection).drop("collection", "batch")


def count(spark: SparkSession, path: str, collection: str) -> int:
    """Rows in the collection, 0 when nothing was stored yet."""
    return read(spark, path, collection).count() if exists(spark, f"{path}/collection={collection}") else 0


def with_batch_id(df: DataFrame, order: str, batch_size: int) -> DataFrame:
    """Number rows by a unique key of any type and cut them into batches.

    A global row_number would send every row to one task. Rows are dealt by key
    ranges and numbered inside each; a range starts after the rows counted in the
    ranges before it, and only those counts, one row per task, meet in one task.
    """
    ranged = cut_lineage(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").agg(F.count("*").alias("_size")).select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return (
        ranged.withColumn("_n", number).join(offsets, "_part")
        .withColumn("batch_id", F.floor((F.col("_before") + F.col("_n")) / batch_size))
        .drop("_part", "_n", "_before"))


def register_case(df: DataFrame, name: str) -> None:
    """Session-only corpus: a temporary view, never indexed."""
    df.createOrReplaceTempView(name)


def list_cases(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables() if t.isTemporary)


def clear_case(spark: SparkSession, name: str) -> bool:
    return spark.catalog.dropTempView(name)


def ingest_summary(chunks: DataFrame, source: str, success: str = "success", *group: Column | str) -> DataFrame:
    """Chunks loaded and indexed, distinct sources, failures."""
    ok = F.col(success)
    return chunks.groupBy(*group).agg(
        F.count("*").alias("docs_loaded"),
        F.sum(ok.cast("long")).alias("docs_indexed"),
        F.countDistinct(source).alias("n_sources"),
        F.sum((~ok).cast("long")).alias("n_errors"))
