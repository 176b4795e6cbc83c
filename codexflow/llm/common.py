"""Helpers shared by the training-data operators.

Code that runs inside tasks lives in modules pickled by value (``by_value``), so executors
need no copy of this package.
"""

from __future__ import annotations

import pickle
import sys
import uuid
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codexflow.session import new_table_path

SLICE_BYTES = 4 << 20  # text handed to a worker function at once; one longer text goes alone
BATCH_ROWS = 2_000


def by_value(name: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[name])


by_value(__name__)


class Shared:
    """An object for all tasks: broadcast once, by value like the code, and unpacked once per Python worker.

    A worker that serves several tasks keeps it, with whatever it has cached; a few objects at most are kept.
    """

    def __init__(self, spark: SparkSession, value):
        self.data, self.key = spark.sparkContext.broadcast(cloudpickle.dumps(value)), uuid.uuid4().hex

    @property
    def value(self):
        kept = sys.modules.setdefault("_codexflow_shared", ModuleType("_codexflow_shared")).__dict__.setdefault("kept", {})
        if self.key not in kept:
            if len(kept) >= 4:
                kept.clear()
            kept[self.key] = pickle.loads(self.data.value)
        return kept[self.key]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors.

    ``session.temporary_tables`` deletes what was written inside it, unless ``path`` was made before.
    """
    path = path or new_table_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(id_col: str, parts: int, part: int) -> Column:
    """The row's place outside training: crc32 of the id as text leaves ``part``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def labelled_sample(docs: DataFrame, marks: DataFrame, text_col: str, bound: int) -> DataFrame:
    """At most ``bound`` rows (text, label), the same ones on every run.

    ``marks`` (doc_id, label) holds the rows one may learn from. Rows are drawn by hash, so every
    source and class comes in proportion, and the drawn ids are the only rows broadcast.
    """
    drawn = (marks.filter("doc_id is not null and label is not null").dropDuplicates(["doc_id"])
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound))
    texts = docs.select("doc_id", F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id"]).select("text", "label")


def slices(batch: pa.RecordBatch, text_col: str | None, limit: int = SLICE_BYTES):
    """Cut a batch so that the texts of a slice stay within ``limit`` bytes."""
    if text_col is None or batch.num_rows < 2:
        yield batch
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def map_slices(df: DataFrame, make, schema: str | T.StructType, text_col: str | None = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """``make()`` runs once per task and returns ``work(dict of lists) -> dict of lists``; it gets ``limit`` bytes of text at a time."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(fields)

    def run(batches):
        work = None
        for batch in batches:
            for part in slices(batch, text_col, limit):
                work = work or make()
                yield pa.RecordBatch.from_pydict(work(part.to_pydict()), schema=arrow)

    return df.mapInArrow(run, fields)


def is_usable(col: str) -> Column:
    """True for a vector that is not null, not all zero and holds only finite components."""
    bad = F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(col).isNotNull() & ~bad & F.exists(col, lambda x: x != 0), F.lit(False))
