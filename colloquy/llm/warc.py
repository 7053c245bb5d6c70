"""WARC archives of web pages: writing, reading, and assembling transactions.

Every page becomes three records of one capture: the request, the response (or a revisit of an earlier
response with the same payload) and a metadata record. Request and metadata name the response in
``WARC-Concurrent-To``; ``assemble`` joins them again through it.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import BATCH_ROWS

CRLF = "\r\n"
#: Ends every record; Spark's text writer puts it after each row.
RECORD_END = CRLF * 2
#: Payloads shorter than this are always stored.
REVISIT_BYTES = 100
#: Captures in a file at most, so that one file can be read by one task.
FILE_CAPTURES = 2000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(*parts: Column) -> Column:
    """A record's name, from what the record says; equal rows have equal names."""
    hexed = F.md5(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts])))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(hexed, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line; none for a null. Line ends, percent signs and outer blanks of a value are escaped."""
    plain = value.cast("string")
    for char, code in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        plain = F.replace(plain, F.lit(char), F.lit(code))
    plain = F.regexp_replace(F.regexp_replace(plain, "^[ \\t]", "%20"), "[ \\t]$", "%20")
    return F.coalesce(F.concat(F.lit(f"{name}: "), plain, F.lit(CRLF)), F.lit(""))


def _record(kind: str | Column, name: Column, url: Column, content: str, body: Column, date: str, *more: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(F.lit("WARC/1.1" + CRLF), _field("WARC-Type", kind), _field("WARC-Record-ID", name), _field("WARC-Date", F.lit(date)),
                    _field("WARC-Target-URI", url), *more, _field("Content-Type", F.lit(content)), _field("Content-Length", F.octet_length(body)),
                    F.lit(CRLF), body)


def captures(pages: DataFrame, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """``(record)``: the three records of each row of ``pages(page_id, url, html)`` as one text.

    Of rows with equal payloads of at least 100 bytes, that with the smallest page_id is the response
    and the others revisit it (repeated rows with that smallest page_id are all responses; rows without
    a page_id are responses only if no row of the payload has one). Null html is an empty payload, a
    null url leaves out its header. Extra columns are ignored. Groups of copies meet only in a minimum
    per digest that is combined before the shuffle.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("bytes", F.octet_length("html").cast("bigint"))
    # The first page of each payload, and its url, which its record's name is made of.
    firsts = rows.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(
        F.min(F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("first_id"), F.col("url").alias("first_url"))).alias("f"), F.count("*").alias("n"))
    firsts = firsts.where("n > 1").select("digest", "f.first_id", "f.first_url")
    rows = rows.join(firsts, "digest", "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    capture = _urn(F.lit("capture"), F.col("page_id"), F.col("url"), F.col("digest"))
    original = _urn(F.lit("capture"), F.col("first_id"), F.col("first_url"), F.col("digest"))
    url, sha = F.col("url"), F.concat(F.lit("sha256:"), F.col("digest"))
    concurrent = _field("WARC-Concurrent-To", capture)
    path = F.coalesce(F.nullif(F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#\\s]*)", 1), F.lit("")), F.lit("/"))
    host = F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#\\s]*)", 1)
    asked = F.concat(F.lit("GET "), path, F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(RECORD_END))
    said = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(RECORD_END))
    noted = F.concat(_field("page-id", F.col("page_id")), _field("payload-length", F.col("bytes")))
    response = _record(F.when(again, "revisit").otherwise("response"), capture, url, "application/http; msgtype=response",
                       F.concat(said, F.when(again, "").otherwise(F.col("html"))), date, _field("WARC-Payload-Digest", sha),
                       F.when(again, F.concat(_field("WARC-Profile", F.lit(REVISIT_PROFILE)), _field("WARC-Refers-To", original))).otherwise(""))
    request = _record("request", _urn(F.lit("request"), capture), url, "application/http; msgtype=request", asked, date, concurrent)
    metadata = _record("metadata", _urn(F.lit("metadata"), capture), url, "application/warc-fields", noted, date, concurrent)
    return rows.select(F.concat(request, F.lit(RECORD_END), response, F.lit(RECORD_END), metadata).alias("record"))


def write(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write ``pages`` as gzipped WARC files of at most ``FILE_CAPTURES`` captures below ``path``."""
    (captures(pages, date).write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", FILE_CAPTURES)
     .text(path))


RECORDS = ("warc_type string, record_id string, concurrent_to string, refers_to string, target_uri string, digest string, "
           "fields map<string,string>, http_bytes long, measured string, payload binary")
_ARROW = pa.schema([("warc_type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()),
                    ("digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("http_bytes", pa.int64()), ("measured", pa.string()), ("payload", pa.binary())])


def _plain(value: str) -> str:
    return value.replace("%20", " ").replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%") if "%" in value else value


def _named(block: bytes) -> dict[str, str]:
    """``name: value`` lines; names in lower case."""
    lines = (line.partition(b":") for line in block.split(b"\r\n") if line)
    return {name.strip().lower().decode(): _plain(value.decode("utf-8", "replace").removeprefix(" ")) for name, _, value in lines}


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(headers, block)`` of every record of an uncompressed archive; a block's length is taken from its header."""
    at = 0
    while (head := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", head)
        headers = _named(data[data.index(b"\r\n", head):end])
        at = end + 4 + int(headers["content-length"])
        yield headers, data[end + 4:at]
        at += 4


def _rows(name: str, data: bytes, payloads: bool) -> Iterator[tuple]:
    for headers, block in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
        kind, fields, body = headers.get("warc-type", ""), {}, b""
        if headers.get("content-type", "").startswith("application/http"):
            head, _, body = block.partition(b"\r\n\r\n")
            fields = _named(head.partition(b"\r\n")[2]) | {"start": head.partition(b"\r\n")[0].decode("utf-8", "replace")}
        elif headers.get("content-type", "") == "application/warc-fields":
            fields = _named(block)
        yield (kind, headers.get("warc-record-id"), headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), headers.get("warc-target-uri"),
               headers.get("warc-payload-digest"), list(fields.items()), len(body), hashlib.sha256(body).hexdigest() if kind == "response" else None, body if payloads else None)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives at ``path`` (gzipped or not), in ``RECORDS``; a file is read by one task."""
    def records(batches):
        for batch in batches:
            for name, data in zip(batch["path"].to_pylist(), batch["content"]):
                rows = _rows(name, data.as_py(), payloads)
                while part := [row for _, row in zip(range(BATCH_ROWS), rows)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), _ARROW)], schema=_ARROW)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(records, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: each response or revisit with its request and metadata record.

    Records are joined through ``WARC-Concurrent-To``; captures without a request or metadata keep a
    null there, and requests or metadata that name no capture are left out. Repeated records give
    repeated captures.
    """
    concurrent = F.col("concurrent_to").alias("record_id")
    request = records.where("warc_type = 'request'").select(concurrent, F.struct(F.col("record_id").alias("id"), F.col("fields")).alias("request")).dropDuplicates(["record_id"])
    metadata = records.where("warc_type = 'metadata'").select(concurrent, F.struct(F.col("record_id").alias("id"), F.col("fields")).alias("metadata")).dropDuplicates(["record_id"])
    main = records.where("warc_type in ('response', 'revisit')").select(
        "record_id", "target_uri", F.struct("warc_type", F.col("digest"), "refers_to", "fields", "http_bytes", "measured", "payload").alias("response"))
    return main.join(request, "record_id", "left").join(metadata, "record_id", "left")


def page_table(captured: DataFrame) -> DataFrame:
    """``(page_id, url, payload_bytes, payload_digest, record_type, refers_to)`` per capture; ``refers_to`` is the response's page_id.

    Bytes and digest are those of the body that was read; a revisit's are those of the response it names, null if that is missing.
    """
    page = F.element_at("metadata.fields", F.lit("page-id")).cast("bigint")
    rows = captured.select("record_id", page.alias("page_id"), F.col("target_uri").alias("url"), F.col("response.http_bytes").alias("bytes"), F.col("response.measured").alias("digest"),
                           F.col("response.warc_type").alias("record_type"), F.col("response.refers_to").alias("target"))
    own = lambda name: F.when(F.col("record_type") == "response", F.col(name)).otherwise(F.col(f"t_{name}"))
    # Only revisited responses are looked up: far fewer than the revisits that name them.
    named = rows.where("target is not null").select(F.col("target").alias("record_id")).distinct()
    targets = rows.join(named, "record_id", "left_semi").select(F.col("record_id").alias("target"), F.col("page_id").alias("refers_to"), F.col("bytes").alias("t_bytes"), F.col("digest").alias("t_digest")).dropDuplicates(["target"])
    return rows.join(targets, "target", "left").select("page_id", "url", own("bytes").alias("payload_bytes"), own("digest").alias("payload_digest"), "record_type", "refers_to")
