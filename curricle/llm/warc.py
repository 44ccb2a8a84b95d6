"""WARC archives: writing with segments, chunked framing and revisits, and reading with reassembly.

Archives are gzip files of whole WARC/1.1 records, written and read through Spark's own data sources, so that they can lie in
any store. A record whose block is longer than a segment goes on in continuation records; chunked HTTP bodies stay framed
as they came. Reading groups segments by the identifier of the record where they began, orders them by number, verifies numbers
and total length, and takes the payload out of its framing.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binaries, flagged, mapped, small_batches, stored

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = "record_id string, page_id bigint, type string, origin string, segment int, total bigint, refers_to bigint, digest string, target string, block binary"


def plan_revisits(pages: DataFrame, id_: str, payload: str, least_bytes: int) -> DataFrame:
    """pages as id, url, payload (binary), refers_to and shared: of rows with equal payloads of `least_bytes` or more, all but that with
    the least id refer to it; `shared` marks rows whose id isn't theirs alone. Only rows whose payload may not be alone are shuffled."""
    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_}`").cast("bigint").alias("id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("key", F.when(F.octet_length("payload") >= least_bytes, F.sha2("payload", 256)))
    several = rows.select("id", "key").where("key is not null").groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    several = several.select(F.col("key").alias("k2"), "first")
    marked = flagged(rows, "key", several, "k2")
    alone = marked.where(~F.col("__maybe")).withColumn("refers_to", F.lit(None).cast("bigint"))
    more = marked.where("__maybe").join(several, F.expr("key = k2"), "left").withColumn("refers_to", F.when(F.col("id") != F.col("first"), F.col("first")))
    names = ["id", "url", "payload", "refers_to"]
    out = alone.select(names).unionByName(more.select(names))
    twice = stored(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 and id is not null").select(F.col("id").alias("i2")), "shared-ids")
    return flagged(out, "id", twice, "i2", out="shared").withColumn("shared", F.col("shared") | F.col("id").isNull())


def _urn(page: int | None, own: str = "", segment: int = 1) -> str:
    return f"<urn:x-page:{'' if page is None else page}{own and f'.{own}'}{f':{segment}' if segment > 1 else ''}>"


def chunked(body: bytes, size: int) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(body[i: i + size]), body[i: i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes | None:
    """The body that a chunked framing carries (chunk extensions and trailers are skipped), None if it breaks off."""
    parts, at = [], 0
    while True:
        line = framed.find(b"\r\n", at)
        if line < 0:
            return None
        try:
            n = int(framed[at:line].split(b";", 1)[0], 16)
        except ValueError:
            return None
        if not n:
            return b"".join(parts)
        at = line + 2
        if framed[at + n: at + n + 2] != b"\r\n":
            return None
        parts.append(framed[at: at + n])
        at += n + 2


def records_of(page: int | None, url: str | None, payload: bytes, refers_to: int | None, own: str, segment: int, chunk: int, date: str) -> Iterator[bytes]:
    """The records of one page, without what ends each; `own` tells them from those of other rows with the page's id."""
    digest = hashlib.sha256(payload).hexdigest()
    head = ["WARC/1.1", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    kind = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        block = kind + b"Content-Length: %d\r\n\r\n" % len(payload)
        extra = ["WARC-Type: revisit", f"WARC-Record-ID: {_urn(page, own)}", f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    else:
        block = kind + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
        extra = ["WARC-Type: response", f"WARC-Record-ID: {_urn(page, own)}"]
    parts = [block[i: i + segment] for i in range(0, len(block), segment)]
    for number, part in enumerate(parts, 1):
        lines = [*head, *extra] if number == 1 else [head[0], head[1], "WARC-Type: continuation", f"WARC-Record-ID: {_urn(page, own, number)}", f"WARC-Segment-Origin-ID: {_urn(page, own)}"]
        if len(parts) > 1:
            lines.append(f"WARC-Segment-Number: {number}")
        if number == len(parts) > 1:
            lines.append(f"WARC-Segment-Total-Length: {len(block)}")
        if number == 1:
            lines.append("Content-Type: application/http; msgtype=response")
        lines.append(f"Content-Length: {len(part)}")
        yield "\r\n".join(lines).encode() + b"\r\n\r\n" + part


def write_archives(pages: DataFrame, path: str, id_: str = "page_id", payload: str = "html", least_bytes: int = 100, segment: int = 1 << 15,
                   chunk: int = 1 << 13, records_per_file: int = 4096, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes the pages (id, url, payload) to gzip archives under path. Ids must be whole numbers (or text that says one). A null payload is empty, a null url has no target;
    rows that share an id (or have none) get record identifiers of their own, so that each comes back as a row. No page, no archive."""
    small_batches(pages.sparkSession)

    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = uuid.uuid4().hex if row[-1] else ""
            yield pa.RecordBatch.from_arrays([binaries(list(records_of(*row[:-1], own, segment, chunk, date)))], ["value"])

    lines = mapped(plan_revisits(pages, id_, payload, least_bytes), f, "value binary")
    lines.select(F.col("value").cast("string")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _bounded(source: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The decompressed content of gzip members, in parts."""
    while source:
        z = zlib.decompressobj(wbits=31)
        data = source
        while data and not z.eof:
            yield z.decompress(data, step)
            data = z.unconsumed_tail
        source = z.unused_data


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of a gzip archive."""
    held, at = b"", 0
    parts = _bounded(content)

    def upto(n: int) -> bool:
        nonlocal held, at
        if len(held) >= n:
            return True
        more = [held[at:]]
        size = len(more[0])
        n, at = n - at, 0
        for part in parts:
            more.append(part)
            size += len(part)
            if size >= n:
                break
        held = b"".join(more)
        return size >= n

    while True:
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not upto(len(held) + 1):
                return
        fields = dict(x.split(": ", 1) for x in held[at:end].decode().split("\r\n")[1:] if ": " in x)
        fields = {k.lower(): v for k, v in fields.items()}
        n = int(fields["content-length"])
        at = end + 4
        if not upto(at + n + 4):
            raise ValueError("an archive breaks off")
        yield fields, held[at: at + n]
        at += n + 4


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:x-page:").removesuffix(">").split(":")[0].split(".")[0]
    return int(number) if number else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record (FIELDS)."""
    small_batches(spark)

    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        def made(rows: list) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in FIELDS.split(", ")])

        for content in batch.column(0):
            rows, size = [], 0
            for h, block in parse_archive(content.as_py()):
                id_, origin, number, total = h["warc-record-id"], h.get("warc-segment-origin-id"), h.get("warc-segment-number"), h.get("warc-segment-total-length")
                rows.append((id_, _page(origin or id_), h["warc-type"], origin or id_, number and int(number), total and int(total), _page(h.get("warc-refers-to")),
                             h.get("warc-payload-digest", "").removeprefix("sha256:"), h.get("warc-target-uri"), block))
                size += len(block)
                if size > 1 << 20:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)

    return mapped(spark.read.format("binaryFile").load(path).select("content"), f, FIELDS)


def reassembled(records: DataFrame) -> DataFrame:
    """One row for each row that was written: record_id, page_id, type, refers_to, digest, target, blocks (in order), whole (numbers and total length fit).

    Records without segments are not shuffled. Segments of a page may lie in any archives, in any order.
    """
    names = ["record_id", "page_id", "type", "refers_to", "digest", "target"]
    single = records.where("segment is null").select(*names, F.array("block").alias("blocks"), F.lit(True).alias("whole"))
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    many = records.where("segment is not null").groupBy("origin").agg(
        *(first(c) for c in names), F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"))
    numbers = F.col("parts.segment") == F.sequence(F.lit(1), F.size("parts"))
    length = F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, x: a + F.octet_length(x["block"])) == F.col("total")
    return single.unionByName(many.select(*names, F.col("parts.block").alias("blocks"), F.coalesce(numbers & length, F.lit(False)).alias("whole")))


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, type, refers_to, digest, target, whole, payload (binary, out of its framing; null for revisits and for records whose segments, total
    length or chunks don't fit, which aren't `whole`), payload_bytes (of revisits: as their header says; null for broken records)."""
    small_batches(pages.sparkSession)
    names = ["page_id", "type", "refers_to", "digest", "target", "whole"]

    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out, size, sound = [], [], []
        for kind, whole, blocks in zip(*(batch.column(k).to_pylist() for k in (1, len(names) - 1, len(names))), strict=True):
            if not whole:
                out.append(None)
                size.append(None)
                sound.append(False)
                continue
            head, _, body = b"".join(blocks).partition(b"\r\n\r\n")
            fields = dict(x.lower().split(b": ", 1) for x in head.split(b"\r\n")[1:] if b": " in x)
            if fields.get(b"transfer-encoding") == b"chunked":
                body = dechunked(body)
            sound.append(body is not None)
            out.append(None if kind == "revisit" else body)
            size.append(int(fields.get(b"content-length", 0)) if kind == "revisit" else None if body is None else len(body))
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) - 1], pa.array(sound), pa.array(out, pa.binary()), pa.array(size, pa.int64())], [*names, "payload", "payload_bytes"])

    return mapped(pages.select(*names, "blocks"), f, "page_id bigint, type string, refers_to bigint, digest string, target string, whole boolean, payload binary, payload_bytes bigint")
