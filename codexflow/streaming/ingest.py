"""Continuous ingestion with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codexflow.functions.text import content_hash
from codexflow.plans.ingest import ingest
from codexflow.sources.files import exists

BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(
    spark: SparkSession, path: str, glob: str, schema: str, fmt: str = "parquet", files_per_batch: int | None = None,
) -> DataFrame:
    """Arriving files; streaming sources need their schema spelled out."""
    reader = spark.readStream.schema(schema).format(fmt).option("pathGlobFilter", glob)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).load(path)


def start(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def _replace_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """A replayed batch overwrites its own folder: the sink is idempotent."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def ingest_sink(path: str, text: str = "text", **options):
    """Chunks and failed documents of each batch, told apart by ``success``."""
    def batch(df: DataFrame, batch_id: int) -> None:
        _replace_batch(ingest(df, text=text, **options), path, batch_id)

    return batch


def dedupe_sink(path: str, key: str, content: str = "text"):
    """Per batch: each content's smallest key and number of copies. ``once_per_content``
    merges the batches, so a later batch may still lower a key, and a replayed batch
    replaces its own rows. No state is kept in executor memory."""
    def batch(df: DataFrame, batch_id: int) -> None:
        hashed = df.withColumn("file_hash", content_hash(F.col(content)))
        _replace_batch(hashed.groupBy("file_hash").agg(F.min(key).alias(key), F.count("*").alias("copies")), path, batch_id)

    return batch


def once_per_content(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(file_hash, smallest key, copies) over all batches so far."""
    return spark.read.parquet(path).groupBy("file_hash").agg(F.min(key).alias(key), F.sum("copies").alias("copies"))


def window_counts(events: DataFrame, ts: str = "ts", width: str = "1 hour") -> DataFrame:
    """Events and sum of values per window and type."""
    timed = events.withColumn("ts", F.col(ts).cast("timestamp"))
    return timed.groupBy(F.window("ts", width).alias("window"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def window_sink(path: str, ts: str = "ts", width: str = "1 hour"):
    """Partial counts of each batch. They add up whenever they arrive, so an event
    may be late by any time and still counts; ``merged_windows`` adds them."""
    def batch(df: DataFrame, batch_id: int) -> None:
        _replace_batch(window_counts(df, ts, width), path, batch_id)

    return batch


def merged_windows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("window", "event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


# ------------------------------------------------- state kept by the engine

def first_per_content(stream: DataFrame, delay: str, ts: str | None = None, content: str = "text") -> DataFrame:
    """The first copy of each content to arrive; copies within ``delay`` are dropped by the engine's keyed state.

    A hash is held for ``delay`` after it came and then given up, so state is bounded by the contents of that time;
    copies that come later pass here and meet the library in ``library_sink``. Time is that of arrival, so no row is too
    late to count; with ``ts`` it is the rows' own, and the engine also drops rows over ``delay`` behind the newest.
    """
    time = F.current_timestamp() if ts is None else F.col(ts).cast("timestamp")
    hashed = stream.withColumns({"file_hash": content_hash(F.col(content)), "_time": time})
    return hashed.withWatermark("_time", delay).dropDuplicatesWithinWatermark(["file_hash"]).drop("_time")


def library_sink(path: str, columns: list[str]):
    """Append contents that no earlier batch stored; a replayed batch replaces its own rows."""
    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        new = df.select("file_hash", *columns)
        if batch_id and exists(spark, path):
            earlier = spark.read.parquet(path).filter(F.col("batch_id") < batch_id).select("file_hash")
            new = new.join(earlier, "file_hash", "left_anti")
        _replace_batch(new.dropDuplicates(["file_hash"]), path, batch_id)

    return batch


def state_rows(query: StreamingQuery) -> list[int]:
    """Rows of state after each batch of a finished query, as the engine reports them."""
    return [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in query.recentProgress]


def final_windows(events: DataFrame, delay: str, ts: str = "ts", width: str = "1 hour") -> DataFrame:
    """Windows that no row within ``delay`` can change any more, each given out once (append mode)."""
    timed = events.withColumn("ts", F.col(ts).cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", width).alias("window"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def start_windows(events: DataFrame, path: str, checkpoint: str, delay: str, ts: str = "ts", width: str = "1 hour") -> list[StreamingQuery]:
    """Two queries over the stream: final windows below ``path/final``, all rows counted per batch below ``path/all``."""
    final = (final_windows(events, delay, ts, width).writeStream.outputMode("append").format("parquet")
             .option("path", f"{path}/final").option("checkpointLocation", f"{checkpoint}/final").trigger(availableNow=True).start())
    return [final, start(events, window_sink(f"{path}/all", ts, width), f"{checkpoint}/all")]


def settled_windows(spark: SparkSession, path: str) -> DataFrame:
    """(window, event_type, status, n, total, n_late, total_late): per window what came in time, and beside it what came late.

    A window is ``final`` once it was given out, or when a later window was: then all its rows were late. The others
    are ``open``: their rows so far are in ``n``. Rows in time and late add up to all rows.
    """
    final = spark.read.parquet(f"{path}/final")
    closed = final.agg(F.max("window.end")).first()[0]
    both = merged_windows(spark, f"{path}/all").withColumnsRenamed({"n": "n_all", "total": "total_all"}).join(final, ["window", "event_type"], "left")
    given = F.col("n").isNotNull() | F.coalesce(F.col("window.end") <= F.lit(closed), F.lit(False))
    in_time = lambda c: F.when(given, F.coalesce(c, F.lit(0))).otherwise(F.col(f"{c}_all"))
    return both.select("window", "event_type", F.when(given, "final").otherwise("open").alias("status"), in_time("n").alias("n"), in_time("total").alias("total"),
                       (F.col("n_all") - in_time("n")).alias("n_late"), (F.col("total_all") - in_time("total")).alias("total_late"))


def compact(spark: SparkSession, path: str, upto: int, merge: Callable[[DataFrame], DataFrame]) -> None:
    """Replace the folders of batches up to ``upto`` by one that holds their merged rows, as batch ``upto``.

    The merged rows are written beside the stream's folder first. Run it between runs of the stream, on batches its checkpoint
    has settled; a run that was cut off is finished by running it again.
    """
    merged, done = f"{path}-merged-{upto}", f"{path}-merged-{upto}/_SUCCESS"
    if not exists(spark, done):
        merge(spark.read.parquet(path).filter(F.col("batch_id") <= upto).drop("batch_id")).write.mode("overwrite").parquet(merged)
    files = spark._jvm.org.apache.hadoop.fs
    store = files.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in store.listStatus(files.Path(path)):
        name = status.getPath().getName()
        if name.startswith("batch_id=") and int(name.split("=")[1]) <= upto:
            store.delete(status.getPath(), True)
    store.rename(files.Path(merged), files.Path(f"{path}/batch_id={upto}"))
