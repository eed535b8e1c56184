"""WARC archives: segmented writing, and reading with segment reassembly.

A page becomes a response record whose HTTP body is framed as ``Transfer-Encoding: chunked``, or a
revisit record of the response with the same payload. Blocks over ``segment_bytes`` are cut into a
first segment and continuation records. Archives are gzip files written by Spark's text writer, one
record a row with CRLF CRLF as line end, so they go to any file system and only finished tasks
count. Reading streams each file record by record, groups segments by origin identifier, orders them
by number, verifies the total length, decodes the chunked framing and checks the payload's digest.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch

CRLF = b"\r\n"
_PRINTABLE = "".join(chr(c) for c in range(33, 127) if c != 37)


def chunked(payload: bytes, size: int = 8192) -> bytes:
    out = bytearray()
    for i in range(0, len(payload), size):
        piece = payload[i : i + size]
        out += b"%x\r\n" % len(piece) + piece + CRLF
    return bytes(out + b"0\r\n\r\n")


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped, bad framing raises ValueError."""
    out, at = bytearray(), 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            raise ValueError("chunk size line without end")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if not size:
            return bytes(out)
        if body[at + size : at + size + 2] != CRLF:
            raise ValueError("chunk length and data differ")
        out += body[at : at + size]
        at += size + 2


def records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page, without the CRLF CRLF that ends each."""

    def record(kind: str, block: bytes, *more: str) -> bytes:
        head = ["WARC/1.1", f"WARC-Type: {kind}", "WARC-Date: 2024-01-01T00:00:00Z", f"Content-Length: {len(block)}", *more]
        return "\r\n".join(head).encode("ascii") + CRLF + CRLF + block

    name = f"<urn:uuid:{uuid.uuid4()}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = http + (b"Content-Length: %d\r\n\r\n" % len(payload) if revisit else b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload))
    first = [f"WARC-Record-ID: {name}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    first += [f"WARC-Target-URI: {quote(url, safe=_PRINTABLE)}"] if url is not None else []
    first += [f"X-Page-Id: {page_id}"] if page_id is not None else []
    if revisit:
        yield record("revisit", block, *first, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}")
        return
    if len(block) <= segment_bytes:
        yield record("response", block, *first)
        return
    cuts = range(0, len(block), segment_bytes)
    for number, at in enumerate(cuts, 1):
        piece = block[at : at + segment_bytes]
        if number == 1:
            yield record("response", piece, *first, "WARC-Segment-Number: 1")
        else:
            total = [f"WARC-Segment-Total-Length: {len(block)}"] if number == len(cuts) else []
            yield record("continuation", piece, f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Segment-Origin-ID: {name}", f"WARC-Segment-Number: {number}", *total)


def parsed(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, read one at a time."""
    while line := stream.readline():
        if line == CRLF:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (CRLF, b""):
            name, _, value = line.decode("utf-8").partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("record cut short")
        yield head, block


def payload_of(block: bytes) -> tuple[bytes, dict[str, str]]:
    """The decoded body of an HTTP response, and its headers."""
    head, _, body = block.partition(CRLF + CRLF)
    fields = dict((a.strip().lower(), b.strip()) for a, _, b in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:]))
    return (dechunked(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body), fields


def plan_records(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload, digest, revisit and refers_to of each page.

    Of payloads that are equal and have ``least_bytes`` or more, the page with the largest page_id is
    the response (all rows of that id, if it is repeated) and the others revisit it. A null html is an
    empty payload. A null page_id never is the largest; where a payload has no other, all are responses.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.encode("html", "utf-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    long = rows.where(F.octet_length("payload") >= least_bytes)
    last = long.groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = rows.join(last, "digest", "left")
    revisit = F.coalesce(F.col("last").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("last"))), F.lit(False))
    return joined.select("page_id", "url", "payload", "digest", revisit.alias("revisit"), F.when(revisit, F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, segment_bytes: int = 65_536, records_per_file: int = 1000) -> None:
    """Writes archives of ``records_per_file`` records at most, so of bounded size, into ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for i in range(batch.num_rows):
                page_id, url, payload, digest, revisit, refers_to = (c[i].as_py() for c in batch.columns)
                for r in records(page_id, url, payload, digest, refers_to, revisit, segment_bytes):
                    out.append(r)
                    size += len(r)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    made = plan_records(pages).mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    made.write.options(lineSep="\r\n\r\n", compression="gzip", maxRecordsPerFile=records_per_file, **{"zlib.compress.level": "BEST_SPEED"}).text(path)


_READ = "origin string, page_id long, url string, record_type string, refers_to long, declared string, segment int, total long, payload_bytes long, payload_digest string, block binary"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and problem of each origin record.

    ``problem`` is null unless segments are missing or doubled, the total length or the digest differs, or
    framing is bad; then the payload's columns are null. Only segmented blocks are shuffled whole.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def finish(block: bytes) -> tuple[int, str]:
        payload, _ = payload_of(block)
        return len(payload), hashlib.sha1(payload).hexdigest()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("origin", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("declared", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("block", pa.binary())])
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for head, block in parsed(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())))):
                    kind, number = head["warc-type"], head.get("warc-segment-number")
                    row = {"origin": head.get("warc-segment-origin-id") or head["warc-record-id"], "record_type": None if kind == "continuation" else kind, "segment": int(number or 0), "declared": head.get("warc-payload-digest", "").removeprefix("sha1:") or None}
                    row |= {name: int(head[key]) if key in head else None for name, key in (("page_id", "x-page-id"), ("refers_to", "x-refers-to-page"), ("total", "warc-segment-total-length"))}
                    row["url"] = unquote(head["warc-target-uri"]) if "warc-target-uri" in head else None
                    if kind == "revisit":
                        row |= {"payload_bytes": int(payload_of(block)[1]["content-length"]), "payload_digest": row["declared"]}
                    elif number is None:
                        try:
                            row |= dict(zip(("payload_bytes", "payload_digest"), finish(block), strict=True))
                        except ValueError:
                            pass
                    else:
                        row["block"] = block
                        size += len(block)
                    rows.append(row)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    first = lambda c: F.max(c).alias(c)  # noqa: E731  one row of an origin has it, the others null
    parts = F.sort_array(F.collect_list(F.when(F.col("segment") > 0, F.struct("segment", "block")))).alias("parts")
    grouped = files.mapInArrow(scan, _READ).groupBy("origin").agg(*[first(c) for c in ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "declared", "total")], parts)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(n).to_pylist() for n in ("payload_bytes", "payload_digest", "declared", "total")}
            problem: list[str | None] = []
            for i, segments in enumerate(batch.column("parts")):
                bad = None
                if len(segments):
                    found = segments.as_py()
                    block = b"".join(s["block"] for s in found)
                    if [s["segment"] for s in found] != list(range(1, len(found) + 1)) or len(block) != cols["total"][i]:
                        bad = "segments"
                    else:
                        try:
                            cols["payload_bytes"][i], cols["payload_digest"][i] = finish(block)
                        except ValueError:
                            bad = "framing"
                elif cols["payload_digest"][i] is None:
                    bad = "framing"
                if not bad and cols["declared"][i] and cols["payload_digest"][i] != cols["declared"][i]:
                    bad = "digest"
                if bad:
                    cols["payload_bytes"][i] = cols["payload_digest"][i] = None
                problem.append(bad)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(cols["payload_bytes"], pa.int64()), pa.array(cols["payload_digest"], pa.string()), batch.column("record_type"), batch.column("refers_to"), pa.array(problem, pa.string())], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem"])

    return grouped.mapInArrow(assemble, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, problem string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "archives")
    # Segments are smaller than ordinary pages, so that long payloads take the way through continuation records.
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path, segment_bytes=4096)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM q
"""
