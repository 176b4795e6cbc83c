"""Content-addressed WARC archive (operator 12).

``archive`` makes a WARC record per page and stores it in two tables: ``heads`` keeps each record's exact header bytes,
``payloads`` each different payload once, under its SHA-256, length and a second hash, so payloads that differ in any of
the three never share a row. ``restore`` joins both, checks every payload against its digest and gives the
original records back; ``parse`` reads their fields from the bytes. ``write_files`` and ``read_files`` exchange records
with plain WARC files.

Payloads are stored and shuffled compressed (zstd), each on its own. A payload that very many records share is one key: heads of a key are dealt over salts in proportion to its
records, and its payload is repeated once per salt.
"""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexflow.llm.common import by_value, map_slices, written

by_value(__name__)

# fixed values: the format's record layout
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAK = "\r\n"
RECORD_END = BREAK * 2
URN = "urn:page:"
SHARE = 1024  # records of one payload per salt


def keyed(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(id, url, payload binary, key, size, sha1): null payloads are empty; the key tells contents apart."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    return own.select("*", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha1"),
                      F.concat_ws("-", F.sha2("payload", 256), F.octet_length("payload"), F.hex(F.xxhash64("payload"))).alias("key"))


def line(name: str, value: Column) -> Column:
    """One header line; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(BREAK)), F.lit(""))


def head_text(date: str) -> Column:
    """WARC and HTTP header of a record (id, url, size, sha1, refers_to): all its bytes before the payload."""
    urn = lambda c: F.concat(F.lit(f"<{URN}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    is_revisit = F.col("record_type") == "revisit"
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), F.col("size"), F.lit(RECORD_END))
    block = F.length(http) + F.when(is_revisit, 0).otherwise(F.col("size"))
    return F.concat(
        F.lit(f"{VERSION}{BREAK}"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", urn("id")), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("WARC-Refers-To", F.when(is_revisit, urn("refers_to"))), line("WARC-Profile", F.when(is_revisit, F.lit(PROFILE))),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", block.cast("string")), F.lit(BREAK), http)


def join_shared(rows: DataFrame, groups: DataFrame, key: str, hot: int = 10_000) -> DataFrame:
    """``rows`` with the columns of ``groups`` (one row per key, ``copies`` rows of ``rows`` each), by key.

    Keys with over a ``hot``-th of all rows, at most ``hot`` of them, are broadcast; the others are shuffled.
    """
    total = groups.agg(F.sum("copies")).first()[0] or 0
    is_hot = F.col("copies") > max(total // hot, 1)
    often = F.broadcast(groups.filter(is_hot))
    return rows.join(often, key).unionByName(rows.join(often, key, "left_anti").join(groups.filter(~is_hot), key))


def archive(pages: DataFrame, least: int = 1000, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id",
            url_col: str = "url", payload_col: str = "html", broadcast_keys: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(heads, payloads), both written: one head per row of ``pages``, one payload per content.

    Of records whose payloads are equal and have at least ``least`` bytes, that with the largest id is a response and the
    others are revisits that refer to it; smaller ones are all responses. Rows that repeat the largest id are responses
    too; rows with a null id are revisits, or responses where no copy has an id. Null payloads are empty. Line
    breaks in a url are percent-encoded, a null url gives no line. Payloads of any length are one value each, up
    to Spark's 2 GB. An empty table gives empty tables; other columns are not read. ``broadcast_keys`` (of some 100 bytes)
    bounds the keys that travel to the pages, it changes no result.
    """
    own = keyed(pages, id_col, url_col, payload_col)
    thin = written(own.drop("payload"), "records")
    groups = written(thin.groupBy("key").agg(F.max("id").alias("largest"), F.count("*").alias("copies")), "contents")
    told = join_shared(thin, groups, "key")
    revisits = (F.col("size") >= least) & F.col("largest").isNotNull() & ~F.col("id").eqNullSafe(F.col("largest"))
    told = (told.withColumn("record_type", F.when(revisits, "revisit").otherwise("response"))
            .withColumn("refers_to", F.when(revisits, F.col("largest"))))
    heads = written(told.select("key", "copies", head_text(date).cast("binary").alias("head")), "heads")
    # contents of one record stay where they are; only those of several meet
    several = groups.filter("copies > 1").select("key", "copies")
    several = F.broadcast(several) if several.count() <= broadcast_keys else several
    packed = lambda rows: map_slices(rows.select("key", "payload"), lambda: pack, "key string, packed binary", "payload")
    once = packed(own.join(several, "key", "left_anti")).withColumn("copies", F.lit(1).cast("long"))
    shared = packed(own.join(several, "key", "left_semi")).groupBy("key").agg(F.first("packed").alias("packed")).join(several, "key")
    return heads, written(once.unionByName(shared), "payloads")


def pack(rows):
    return {"key": rows["key"], "packed": [pa.compress(p, codec="zstd", asbytes=True) for p in rows["payload"]]}


def unpack(rows):
    sizes = (int(k.split("-")[1]) for k in rows["key"])
    return {"key": rows["key"], "head": rows["head"], "payload": [pa.decompress(p, n, codec="zstd", asbytes=True) for p, n in zip(rows["packed"], sizes)]}


def restore(heads: DataFrame, payloads: DataFrame) -> DataFrame:
    """(head, payload, record): every record's bytes as first made, and its whole payload, also for revisits.

    A payload whose digest is not its key's raises an error.
    """
    salts = F.ceil(F.col("copies") / SHARE).cast("int")
    stored = payloads.select("key", "packed", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    dealt = heads.select("key", "head", F.pmod(F.xxhash64("head"), salts).cast("int").alias("salt"))
    joined = dealt.join(stored, ["key", "salt"]).select("key", "head", "packed")
    whole = map_slices(joined, lambda: unpack, "key string, head binary, payload binary", "packed")
    whole = whole.withColumn("payload", F.when(F.sha2("payload", 256) == F.substring_index("key", "-", 1), F.col("payload"))
                             .otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), F.col("key")))))
    is_revisit = F.contains(F.col("head"), F.lit(f"{BREAK}WARC-Type: revisit{BREAK}".encode()))
    own = F.when(is_revisit, F.lit(b"")).otherwise(F.col("payload"))
    return whole.select("head", "payload", F.concat("head", own, F.lit(RECORD_END.encode())).alias("record"))


def field(head: Column, name: str) -> Column:
    """A header field's value; null where the record has none."""
    found = F.regexp_extract(head, f"(?md)^{name}: (.*?)\\r$", 1)
    return F.when(found != "", found)


def parse(records: DataFrame, id_type: str = "long", record_col: str = "record") -> DataFrame:
    """``records`` with (page_id, url, record_type, refers_to, payload_sha1, block_bytes) as the record's WARC header states them."""
    head = F.substring_index(F.col(record_col).cast("string"), RECORD_END, 1)
    number = lambda name: F.nullif(F.regexp_extract(F.col("warc_head"), f"(?md)^{name}: <{URN}(.*?)>\\r$", 1), F.lit("")).cast(id_type)
    h = F.col("warc_head")
    return (records.withColumn("warc_head", F.concat(head, F.lit("\r"))).withColumn("page_id", number("WARC-Record-ID"))
            .withColumn("url", field(h, "WARC-Target-URI")).withColumn("record_type", field(h, "WARC-Type"))
            .withColumn("refers_to", number("WARC-Refers-To"))
            .withColumn("payload_sha1", F.replace(field(h, "WARC-Payload-Digest"), F.lit("sha1:"), F.lit("")))
            .withColumn("block_bytes", field(h, "Content-Length").cast("long")).drop("warc_head"))


def write_files(records: DataFrame, path: str, compression: str = "gzip", per_file: int = 20_000, record_col: str = "record") -> None:
    """Records (binary) one after the other in WARC files below ``path``, ``per_file`` records at most in each."""
    body = F.expr(f"left(`{record_col}`, octet_length(`{record_col}`) - {len(RECORD_END)})").cast("string")  # the bytes as they are
    (records.select(body.alias("value")).write.option("lineSep", RECORD_END).option("compression", compression)
     .option("maxRecordsPerFile", per_file).text(path))


def cut_records(data: bytes) -> list[bytes]:
    """The records of a WARC file, cut by their stated lengths; gzip files of one or many members too."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    out, at = [], 0
    while at < len(data):
        body = data.index(RECORD_END.encode(), at) + len(RECORD_END)
        fields = dict(f.split(b":", 1) for f in data[at:body].split(BREAK.encode())[1:] if b":" in f)
        length = next(int(v) for k, v in fields.items() if k.lower() == b"content-length")
        out.append(data[at:body + length + len(RECORD_END)])
        at = body + length + len(RECORD_END)
    return out


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, record binary) of all WARC files below ``path``; each file is read whole by one task, up to Spark's 2 GB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), "content")

    def make():
        def work(rows):
            found = [(f, r) for f, data in zip(rows["file"], rows["content"]) for r in cut_records(data)]
            return {"file": [f for f, _ in found], "record": pa.array([r for _, r in found], pa.binary())}

        return work

    return map_slices(files, make, "file string, record binary", "content")


def checked_records(pages: DataFrame, least: int = 1000, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, read back from its archive.

    Size and SHA-1 are those of the payload's bytes as restored; the rest comes from the record's header.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    back = parse(restore(*archive(pages, least, id_col=id_col, url_col=url_col, payload_col=payload_col)), kind)
    return back.select(F.col("page_id").alias(id_col), F.octet_length("payload").cast("long").alias("payload_bytes"),
                       F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")
