"""An existence sketch over content hashes: tells in the scan which documents are surely not stored.

A blocked Bloom filter (Putze, Sanders and Singler, 2007) as a table: a hash belongs to one block, and within it sets a few
bits. The table travels to the scan if it is small enough; each row looks at one block. A row the sketch rules
out is new; the others may be stored and go on to the join that decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = 128  # of 64 bits in a block
PROBES = 6
BITS_PER_KEY = 12
MOST_BYTES = 256 << 20  # of a sketch that travels to the scan


def blocks_for(keys: int) -> int:
    return max(1, -(-keys * BITS_PER_KEY // (WORDS * 64)))


def _block(file_hash: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), file_hash), blocks).cast("int")


def _places(file_hash: Column) -> Column:
    """The bits a hash sets within its block."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(i), file_hash), F.lit(WORDS * 64)).cast("int") for i in range(PROBES)])


def build(manifest: DataFrame, keys: int | None = None) -> DataFrame:
    """(block, blocks, words array<long>) over ``file_hash``; sized for ``keys`` entries, by default for those there are."""
    blocks = F.lit(blocks_for(manifest.count() if keys is None else keys))
    bits = manifest.filter("file_hash IS NOT NULL").select(_block(F.col("file_hash"), blocks).alias("block"), F.explode(_places(F.col("file_hash"))).alias("place"))
    bit = F.expr("shiftleft(1L, place % 64)")
    words = bits.groupBy("block", F.floor(F.col("place") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    held = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))  # ``WORDS`` entries at most
    return held.select("block", blocks.alias("blocks"), F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda w: F.coalesce(F.element_at("m", w), F.lit(0).cast("long"))).alias("words"))


def save(manifest: DataFrame, path: str, keys: int | None = None) -> DataFrame:
    """Write the sketch of one version of the library and give it back."""
    build(manifest, keys).write.mode("errorifexists").parquet(path)
    return load(manifest.sparkSession, path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def marked(docs: DataFrame, sketch: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``docs`` with ``maybe_stored``: false only if no entry has the document's ``file_hash``; null hashes are not stored.

    A sketch of more than ``most_bytes`` is not sent along: then every row may be stored, and the join decides alone.
    """
    size = sketch.agg(F.count("*").alias("n"), F.max("blocks").alias("blocks")).first()
    if size["n"] * WORDS * 8 > most_bytes:
        return docs.withColumn("maybe_stored", F.col("file_hash").isNotNull())
    blocks = F.lit(size["blocks"] or 1)
    near = F.broadcast(sketch.select(F.col("block").alias("_block"), F.col("words").alias("_words")))
    met = docs.withColumn("_block", _block(F.col("file_hash"), blocks)).join(near, "_block", "left")
    hit = F.forall(_places(F.col("file_hash")), lambda p: F.getbit(F.get("_words", F.floor(p / 64).cast("int")), p % 64) == 1)
    return met.withColumn("maybe_stored", F.coalesce(F.col("file_hash").isNotNull() & hit, F.lit(False))).drop("_block", "_words")
