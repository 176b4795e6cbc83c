"""Loaders as a Spark data source: ``spark.read.format("page_text")`` and ``spark.readStream`` over Parquet files of texts.

A partition is a range of a file's row groups, read where the task runs through the file system that the path names
(local and mounted paths, and the stores pyarrow opens). A file that cannot be read is one row with its error, and the
others are not affected. The stream's offset is the number of files in the order of their names.
"""

from __future__ import annotations

import sys

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "doc_id bigint, text string, source string, error string"
ARROW = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("source", pa.string()), ("error", pa.string())])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[str]:
    """The Parquet files at or below ``path``, by name; hidden ones are passed over."""
    store, place = opened(path)
    info = store.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"no files at {path}")
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(place, recursive=True))
    files = sorted(f.path for f in found if f.is_file and f.path.endswith(".parquet") and not f.base_name.startswith(("_", ".")))
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    return [scheme + f.lstrip("/") if scheme and scheme != "file://" else f for f in files]


class RowGroups(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


def cut(files: list[str], groups: int) -> list[RowGroups]:
    """Ranges of up to ``groups`` row groups; a file whose footer cannot be read is one range, so its reader reports it."""
    out = []
    for path in files:
        try:
            store, place = opened(path)
            with store.open_input_file(place) as f:
                n = pq.ParquetFile(f).num_row_groups
        except Exception:
            n = 1
        out += [RowGroups(path, lo, min(lo + groups, n)) for lo in range(0, n, groups)]
    return out


def batches(part: RowGroups, id_column: str, text_column: str):
    """The range's rows; after an error one row that tells it."""
    name = part.path.rsplit("/", 1)[-1]
    try:
        store, place = opened(part.path)
        with store.open_input_file(place) as f:
            for batch in pq.ParquetFile(f).iter_batches(1_000, range(part.first, part.last), [id_column, text_column]):
                ids, texts = (batch.column(batch.schema.names.index(c)) for c in (id_column, text_column))
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), texts.cast(pa.string()), pa.array([name] * len(ids)), pa.nulls(len(ids), pa.string())], schema=ARROW)
    except Exception as problem:  # whatever a file raises is that file's error
        yield pa.RecordBatch.from_pydict({"doc_id": [None], "text": [None], "source": [name], "error": [f"{type(problem).__name__}: {problem}"]}, schema=ARROW)


class PageFiles:
    def __init__(self, options: dict):
        self.path, self.groups = options["path"], int(options.get("rowgroups", 1))
        self.columns = options.get("id", "doc_id"), options.get("text", "text")

    def read(self, partition):
        yield from batches(partition, *self.columns)


class PageReader(PageFiles, DataSourceReader):
    def partitions(self):
        return cut(listed(self.path), self.groups)


class PageStream(PageFiles, DataSourceStreamReader):
    def initialOffset(self):
        return {"files": 0}

    def latestOffset(self):
        return {"files": len(listed(self.path))}

    def partitions(self, start, end):
        return cut(listed(self.path)[start["files"]:end["files"]], self.groups)


class PageSource(DataSource):
    """Options: ``path``; ``id`` and ``text``, the columns to read; ``rowgroups`` per partition."""

    @classmethod
    def name(cls):
        return "page_text"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return PageReader(self.options)

    def streamReader(self, schema):
        return PageStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageSource)
