import base64
import gzip
import hashlib
import io
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import warc
from ledgerline.llm.queries import op11_warc


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def brute(pages):
    first = {}
    for i, html in pages:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, html in pages:
        data, lead = (html or "").encode(), first.get(html or "")
        again = lead is not None and i != lead
        out.append((i, len(data), digest(data), "revisit" if again else "response", lead if again else None))
    return sorted(out, key=str)


def page(i, payload, refers_to=None):
    return warc.page_record(f"urn:page:{i}", f"http://h/{i}", None if refers_to else payload, len(payload), hashlib.sha1(payload).hexdigest(), refers_to)


def read(data, size, block=64):
    """All records, read by ranges of ``size`` bytes, each on its own."""
    return [(first, *r) for first in range(0, len(data), size) for r in warc.records_in(io.BytesIO(data), len(data), first, min(first + size, len(data)), block)]


def test_whole_table(spark, sf_dir):
    got = sorted(map(tuple, op11_warc(spark, sf_dir).collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    assert got == sorted(con.sql(warc.ORACLE_SQL).fetchall())


def test_awkward_pages(spark):
    rows = [
        (5, None, "same"), (3, "http://a/\r\nX: y zé", "same"), (3, "http://a/", "same"), (9, "", "same"), (None, "u", "same"), (None, None, "only nulls"), (None, None, "only nulls"),
        (7, "http://b/", None), (2, "http://b/", ""), (8, "x", "Über 😀\r\n\r\nWARC/1.1\r\n"), (1, "x", "long " * 100_000), (4, "x", "\x00"), (10, "x", "u"),
    ]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, payload string, sha1 string")
    for sizes in ({}, {"file_bytes": 300, "range_bytes": 100}):
        got = warc.archive_pages(spark, pages, **sizes)
        assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        assert sorted(map(tuple, got.collect()), key=str) == brute([(i, h) for i, _, h in rows])
    assert warc.archive_pages(spark, pages.limit(0)).count() == 0


def test_small_payloads_can_be_left_alone(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = {r["page_id"]: r["refers_to"] for r in warc.archive_pages(spark, pages, least_bytes=3).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}


def test_a_hot_payload_is_one_response(spark):
    pages = spark.range(4000).select((9_999 - F.col("id")).alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("html"))
    got = warc.archive_pages(spark, pages)
    hot = got.where(F.col("payload_bytes") == 3).where(F.col("payload_digest") == digest(b"hot"))
    assert hot.count() == 1334 and hot.where("record_type = 'response'").count() == 1 and hot.where("refers_to = 6000").count() == 1333
    assert got.where("record_type = 'response'").count() == 2667


def test_every_range_owns_the_records_that_start_inside():
    rng = random.Random(3)
    payloads = [bytes(rng.randrange(256) for _ in range(rng.randrange(300))) for _ in range(25)] + [b"", warc.MAGIC * 40, b"a" * 5000]
    data = b"".join(page(i, p) for i, p in enumerate(payloads))
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == len(payloads)
    for size in (1, 2, 3, 7, 64, 100, 1000, len(data)):
        for block in (3, 64, 1 << 18):
            if size > 2 or block > 3:
                found = read(data, size, block)
                assert [(r[5], r[9], r[10], r[11], r[12]) for r in found] == [(f"urn:page:{i}", len(p), digest(p), True, p) for i, p in enumerate(payloads)]
                assert all(r[0] <= r[1] < r[0] + size for r in found)


def test_stored_archives_inside_a_payload_are_no_records(spark, tmp_path):
    inner = page("inner", os.urandom(400))
    stored = gzip.compress(gzip.decompress(page("outer", os.urandom(200) + inner + os.urandom(200))), 0)
    data = page("before", b"x") + stored + page("after", b"y")
    assert inner in data
    path = tmp_path / "nested.warc.gz"
    path.write_bytes(data)
    files = spark.createDataFrame([(str(path), len(data))], "path string, bytes long")
    records = warc.read_archives(files, range_bytes=100)
    assert "urn:page:inner" in [r["record_id"] for r in records.collect()]
    got = sorted(warc.without_nested(records).collect(), key=lambda r: r["offset"])
    assert [r["record_id"] for r in got] == ["urn:page:before", "urn:page:outer", "urn:page:after"] and all(r["digest_ok"] for r in got)


def test_damaged_members_have_errors_and_the_next_are_read():
    good, bad = page(1, b"one"), bytearray(page(2, os.urandom(3000)))
    bad[-6] ^= 0xFF  # the check sum
    found = read(good + bytes(bad) + b"\0\0junk" + page(3, b"three") + page(4, b"four")[:-9], 10**6)
    assert [r[5] or r[13].split(":")[0] for r in found] == ["urn:page:1", "damaged", "urn:page:3", "truncated"]
    assert read(b"", 10) == [] and read(b"\x1f\x8b\x08", 10) == [] and read(gzip.compress(b"no archive"), 10) == []


def test_records_of_other_writers():
    block = b"HTTP/1.1 200 OK\r\nX-A: 1\r\n\r\nbody"
    text = b"WARC/1.0\r\nwarc-type:  response\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: application/http;\r\n msgtype=response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    other = b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\na:b\r\n\r\n"
    found = read(gzip.compress(text + other), 10**6)
    assert [(r[3], r[4], r[9], r[12]) for r in found] == [(0, "response", 4, b"body"), (1, "metadata", 3, b"a:b")]
    short = read(gzip.compress(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc"), 10**6)
    assert short[0][13] == "short block"


def test_revisits_keep_the_size_and_digest_of_the_payload():
    (found,) = read(page(7, b"payload", "urn:page:1"), 10**6)
    assert found[4:6] == ("revisit", "urn:page:7") and found[8:13] == ("urn:page:1", 7, digest(b"payload"), None, None)


@pytest.mark.parametrize("uri", ["http://a/b?c=%20#d", "http://ä/ b\n"])
def test_targets_are_one_line(uri):
    (found,) = read(warc.page_record("x", uri, b"", 0, hashlib.sha1(b"").hexdigest(), None), 100)
    assert found[6] == uri.replace("ä", "%C3%A4").replace(" ", "%20").replace("\n", "%0A")
