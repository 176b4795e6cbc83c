"""WARC archive: exact records, decisions, round trips through tables and files."""

import gzip
import hashlib
import tempfile

import pytest
from pyspark.sql import functions as F

from codexflow.llm import warc
from codexflow.llm.queries import ORACLES, QUERIES

BIG = "x" * 700 + "é" * 200  # 1,100 bytes


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, None, BIG), (4, "http://a/\r\nWARC-Type: revisit\r\n", "small"), (5, "u", "small"),
            (6, "u", None), (7, "u", ""), (8, "u", "a\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + BIG), (3, "again", BIG),
            (None, "u", BIG), (None, "u", "y" * 2000), (9, "u", "🙂字\x00" * 300_000), (10, "u", "z" * 999), (11, "u", "z" * 999), (12, "u", "z" * 1000), (13, "u", "z" * 1000)]
    return spark.createDataFrame([(*r, "clash", 1, b"x") for r in rows], "page_id long, url string, html string, record_type string, size int, head binary")


def expected(rows):
    largest: dict = {}
    for r in rows:
        if r["page_id"] is not None:
            largest[r["html"] or ""] = max(largest.get(r["html"] or "", r["page_id"]), r["page_id"])
    out = []
    for r in rows:
        data = (r["html"] or "").encode()
        to = largest.get(r["html"] or "")
        again = len(data) >= 1000 and to is not None and to != r["page_id"]
        out.append((r["page_id"], len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("keys", [200_000, 0])
def test_rows(pages, keys, monkeypatch):
    monkeypatch.setattr(warc, "SHARE", 2)  # several salts
    made = warc.archive
    monkeypatch.setattr(warc, "archive", lambda *a, **k: made(*a, **k, broadcast_keys=keys))
    assert sorted(map(tuple, warc.checked_records(pages).collect()), key=str) == expected(pages.collect())
    assert warc.checked_records(pages.limit(0)).count() == 0


def test_payloads_are_stored_once_and_records_are_exact(spark, pages):
    heads, payloads = warc.archive(pages)
    assert heads.count() == pages.count() and payloads.count() == len({r["html"] or "" for r in pages.collect()})
    records = warc.restore(heads, payloads)
    one = bytes(records.filter(F.col("head").contains(F.lit(b"<urn:page:12>\r\nWARC-Date"))).first()["record"])
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: 1000\r\n\r\n"
    sha = hashlib.sha1(b"z" * 1000).hexdigest()
    assert one == (f"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:page:12>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: u\r\nWARC-Payload-Digest: sha1:{sha}\r\n"
                   f"WARC-Refers-To: <urn:page:13>\r\nWARC-Profile: {warc.PROFILE}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"
    parsed = {r["page_id"]: r for r in warc.parse(records).filter("page_id > 3").collect()}
    assert parsed[4]["url"] == "http://a/%0D%0AWARC-Type: revisit%0D%0A" and parsed[4]["record_type"] == "response" and parsed[8]["record_type"] == "response"
    path = tempfile.mkdtemp(prefix="warc-") + "/files"
    for compression in ("gzip", "none"):
        warc.write_files(records, f"{path}-{compression}", compression, per_file=5)
        back = [bytes(r["record"]) for r in warc.read_files(spark, f"{path}-{compression}").collect()]
        assert sorted(back) == sorted(bytes(r["record"]) for r in records.collect())
    assert warc.cut_records(gzip.compress(one) + gzip.compress(one)) == [one, one]


def test_a_changed_payload_is_found(pages):
    heads, payloads = warc.archive(pages.filter("page_id < 5"))
    import pyarrow as pa

    wrong = payloads.withColumn("packed", F.when(F.col("copies") == 2, F.lit(pa.compress(b"other", codec="zstd", asbytes=True))).otherwise(F.lit(pa.compress(b"x", codec="zstd", asbytes=True))))
    with pytest.raises(Exception):
        warc.restore(heads, wrong).collect()


def test_op12_rows(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    got = QUERIES["op12_warc"](spark, sf)
    want = con.sql(ORACLES["op12_warc"])
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
