import base64
import hashlib
import io
import zlib

import pytest
from pyspark.sql import functions as F

from tracewise.llm import warc
from tracewise.sources.tables import table

PAGES = "page_id long, url string, html string"


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_round_trip_of_given_pages(spark):
    pages = table(spark, "/root/testdata/sf0.001", "pages")
    twice = pages.unionByName(pages.withColumn("page_id", F.col("page_id") + 10_000))
    rows = {r.page_id: r for r in warc.archive_round_trip(twice, with_payload=True).collect()}
    assert len(rows) == twice.count()
    first = {}
    given = {r.page_id: (r.html or "").encode() for r in twice.collect()}
    for i in sorted(given):
        first.setdefault(given[i], i)
    for i, b in given.items():
        r, f = rows[i], first[b]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(b), digest(b), "response" if f == i else "revisit", None if f == i else f)
        if f == i:
            assert bytes(r.payload) == b


def test_awkward_pages(spark):
    big = "<p>" + "long page " * 300_000
    rows = [(3, "http://a/é\r\nx: y", None), (1, None, ""), (2, "u", "same"), (2, "u", "same"), (5, "u", "same"), (None, "u", "same"), (None, None, "alone"), (7, "u", big)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("refers_to", F.lit(1)).withColumn("payload", F.lit("x")).withColumn("sha", F.lit("x"))
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_round_trip(pages).collect()), key=repr)
    assert got == sorted([(3, 0, "revisit", 1), (1, 0, "response", None), (2, 4, "response", None), (2, 4, "response", None), (5, 4, "revisit", 2),
                          (None, 4, "revisit", 2), (None, 5, "response", None), (7, len(big), "response", None)], key=repr)
    least = {r.page_id: r.record_type for r in warc.archive_round_trip(pages.filter("page_id in (1, 3, 5, 2)"), min_bytes=1).collect()}
    assert least == {1: "response", 3: "response", 2: "response", 5: "revisit"}
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0


class Drip(io.RawIOBase):
    """A stream that gives a few bytes at a time."""

    def __init__(self, data, n=7):
        self.data, self.n = io.BytesIO(data), n

    def read(self, size=-1):
        return self.data.read(min(size, self.n) if size > 0 else self.n)


def test_reader_is_sequential_and_strict():
    a, b = warc.record(1, "http://x", b"hello\r\n\r\nthere", None), warc.record(2, None, b"hello\r\n\r\nthere", 1)
    got = list(warc.read_records(Drip(a + b), with_payload=True))
    assert [(r["WARC-Type"], r["payload"]) for r in got] == [("response", b"hello\r\n\r\nthere"), ("revisit", b"")]
    plain = zlib.decompress(a, 31)
    again = lambda x: (lambda z: z.compress(x) + z.flush())(zlib.compressobj(wbits=31))
    for bad in (a[:-9], again(plain.replace(b"there", b"thera")), again(plain + b"x"), again(plain[:-6]), again(b"no record\r\n\r\n")):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.read_records(Drip(bad)))
    assert list(warc.read_records(Drip(b""))) == []


def test_addresses_come_back_as_given(spark):
    urls = ["https://a.org/b%20c?q=%C3%A9", "http://ü.example/ä b", "plain", "100%", "a\r\nWARC-Type: revisit", "", None, "http://x/" + "é" * 200_000]
    pages = spark.createDataFrame([(i, u, f"page {i}") for i, u in enumerate(urls)], PAGES)
    got = {r.page_id: r.url for r in warc.archive_round_trip(pages).collect()}
    assert got == {i: u or "" for i, u in enumerate(urls)}
    head = warc.zlib.decompress(warc.record(1, urls[0], b"", None), 31)
    assert b"WARC-Target-URI: https://a.org/b%20c?q=%C3%A9\r\n" in head and b"X-Given-URL" not in head
