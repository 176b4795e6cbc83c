"""The library as bucketed tables: rows of one content hash lie in one bucket, so upserts and lookups do not move the stored side."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexflow.session import new_table_path
from codexflow.sources.library import latest_per_hash


def write(rows: DataFrame, name: str, buckets: int, path: str | None = None) -> DataFrame:
    """Store rows (one per ``file_hash``) as table ``name``: one file per bucket, however many tasks made them."""
    path = path or new_table_path(rows.sparkSession, name)
    (rows.repartition(buckets, "file_hash").write.mode("errorifexists").bucketBy(buckets, "file_hash").sortBy("file_hash")
     .option("path", path).saveAsTable(name))
    return rows.sparkSession.table(name)


def upsert(stored: DataFrame, updates: DataFrame) -> DataFrame:
    """The rows of ``library.upsert`` for a bucketed ``stored`` with one row per hash: only the updates are shuffled, to its buckets."""
    others = [c for c in stored.columns if c != "file_hash"]
    new = latest_per_hash(updates.select(*stored.columns), F.struct("processed_at", "name"))
    new = new.select("file_hash", F.struct(*others).alias("_new"))
    both = stored.select("file_hash", F.struct(*others).alias("_old")).join(new, "file_hash", "full")
    # at equal time the update wins; a missing time is older than any
    wins = F.col("_old").isNull() | (F.col("_new").isNotNull() & (F.col("_old.processed_at").isNull() | F.coalesce(F.col("_new.processed_at") >= F.col("_old.processed_at"), F.lit(False))))
    return both.select("file_hash", F.when(wins, F.col("_new")).otherwise(F.col("_old")).alias("_r")).select("file_hash", "_r.*")


def append_and_compact(spark: SparkSession, name: str, updates: DataFrame, buckets: int) -> str:
    """A new version of table ``name`` with the updates merged in, one file per bucket again; returns the version's name.

    Readers keep the version they have; the caller drops it when none is left.
    """
    version = f"{name}_{uuid.uuid4().hex[:8]}"
    write(upsert(spark.table(name), updates), version, buckets)
    return version
