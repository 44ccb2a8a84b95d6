import gzip
import hashlib

from curricle.llm import warc
from curricle.llm.common import scratch
from pyspark.sql import functions as F

PAGES = "page_id bigint, url string, html string"


def read_back(spark, pages, **how):
    path = scratch(spark, "warc-test")
    warc.write_archives(pages, path, **how)
    return path, {r.page_id: r for r in warc.payloads(warc.reassembled(warc.read_archives(spark, path))).collect()}


def test_segments_chunks_and_revisits(spark):
    big = "é\r\n\r\nWARC/1.1\r\n0\r\n\r\n" * 900
    rows = [(5, "http://a/ b", big), (3, "http://a", big), (9, None, big), (1, "u", "short"), (2, "u", "short"), (4, "v", None), (6, "v", ""), (7, "w", "x" * 100), (8, "w", "x" * 100)]
    path, got = read_back(spark, spark.createDataFrame(rows, PAGES).repartition(3), segment=700, chunk=64, records_per_file=5)
    assert len(got) == len(rows)
    for id_, _, html in rows:
        want = (html or "").encode()
        r = got[id_]
        assert r.whole and r.payload_bytes == len(want) and r.digest == hashlib.sha256(want).hexdigest()
        assert r.payload is None if r.type == "revisit" else bytes(r.payload) == want
    assert {k: r.refers_to for k, r in got.items() if r.type == "revisit"} == {5: 3, 9: 3, 8: 7}
    for (content,) in spark.read.format("binaryFile").load(path).select("content").collect():
        text = gzip.decompress(bytes(content))
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")


def test_lost_segments_are_noticed(spark):
    path = scratch(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([(1, "u", "y" * 5000)], PAGES), path, segment=1000)
    records = warc.read_archives(spark, path)
    assert records.count() > 4
    assert not warc.reassembled(records.where("segment != 2")).first().whole
    assert not warc.reassembled(records.where("total is null")).first().whole
    assert warc.reassembled(records.orderBy(F.desc("segment"))).first().whole


def test_broken_records_have_no_payload(spark):
    path = scratch(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([(1, "u", "y" * 5000), (2, "u", "fine")], PAGES), path, segment=1000)
    records = warc.read_archives(spark, path)
    for part in (records.where("segment is null or segment != 2"), records.withColumn("total", F.col("total") + 1)):
        got = {r.page_id: r for r in warc.payloads(warc.reassembled(part)).collect()}
        assert not got[1].whole and got[1].payload is None and got[1].payload_bytes is None
        assert got[2].whole and bytes(got[2].payload) == b"fine"


def test_repeated_rows_come_back_each(spark):
    rows = [(1, "u", "y" * 90_000)] * 2 + [(1, "u", "other " * 9000), (2, "v", "y" * 90_000), (None, None, "z" * 70_000), (None, None, "z" * 70_000), (3, "w", None)]
    path = scratch(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(3), path)
    got = sorted(((r.page_id or 0), r.type, r.payload_bytes, r.whole, r.refers_to or 0) for r in warc.payloads(warc.reassembled(warc.read_archives(spark, path))).collect())
    assert got[2:] == [(1, "response", 54_000, True, 0), (1, "response", 90_000, True, 0), (1, "response", 90_000, True, 0), (2, "revisit", 90_000, True, 1), (3, "response", 0, True, 0)]
    assert [x[2:4] for x in got[:2]] == [(70_000, True)] * 2


def test_framing():
    for body in (b"", b"a", b"ab" * 100):
        for size in (1, 3, 1000):
            assert warc.dechunked(warc.chunked(body, size)) == body
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    assert warc.dechunked(b"9\r\nabc\r\n0\r\n\r\n") is None and warc.dechunked(b"zz\r\n") is None


def test_no_pages_and_null_ids(spark, data):
    from curricle.llm.queries import op2_warc

    _, got = read_back(spark, spark.createDataFrame([(None, None, None)], PAGES))
    assert got[None].type == "response" and got[None].payload_bytes == 0
    out = op2_warc(spark, data)
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    first = {}
    for k in sorted(pages):
        first.setdefault(pages[k], k)
    for r in out.collect():
        body = pages.pop(r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        again = len(body) >= 100 and first[body] != r.page_id
        assert (r.record_type, r.refers_to) == (("revisit", first[body]) if again else ("response", None))
    assert not pages
