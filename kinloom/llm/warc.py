"""WARC archives: writing pages as request, response and metadata records, reading archives back,
and assembling transactions through the records' concurrent-to identifiers.

Archives are written by Spark's text writer, so they may lie in any store that Spark writes: each
row is a record without its last two line ends, which are the writer's line separator. Files are
gzip members. Reading parses whole files by Content-Length; a writer's file has at most
``file_rows`` captures, and a file is one task's memory.

Of pages with equal payloads of at least ``revisit_bytes`` bytes, the one with the largest page_id
is a response, the others are revisits (identical-payload-digest) without the payload. Rows that
repeat that largest page_id are responses as well. Nulls: a null html is an empty payload; a null
url is an empty target; a null page_id is carried, comes before every other in order, and never
makes a revisit of a page with one. An empty table writes nothing and reads back as no captures.
Other columns of ``pages`` are left out.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.operators.components import connected_components
from kinloom.plans.scratch import Scratch, small

CRLF = "\r\n"
URN = "<urn:x-capture:"
DATE = "2024-01-01T00:00:00Z"
#: Records that answer.
MAIN = ("response", "revisit", "resource")


def with_revisits(pages: DataFrame, revisit_bytes: int, s: Scratch) -> DataFrame:
    """Adds digest, bytes and ref: the (page_id, row) of the response that a row revisits."""
    html = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"))
    p = p.withColumn("digest", F.sha1("html")).withColumn("bytes", F.octet_length("html").cast("long")).withColumn("row", F.monotonically_increasing_id())
    last = F.max(F.struct("page_id", "row")).alias("ref")
    equal = p.where(F.col("bytes") >= revisit_bytes).groupBy("digest", "bytes").agg(last, F.count(F.lit(1)).alias("n")).where("n > 1 and ref.page_id is not null").drop("n")
    equal = s.table(equal, "equal")
    p = p.join(small(equal), ["digest", "bytes"], "left")
    return p.withColumn("ref", F.when(~F.col("page_id").eqNullSafe(F.col("ref.page_id")), F.col("ref")))


def write_archive(pages: DataFrame, path: str, revisit_bytes: int = 1000, file_rows: int = 2000, scratch: Scratch | None = None) -> None:
    s = scratch or Scratch(pages.sparkSession)
    p = with_revisits(pages, revisit_bytes, s)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    urn = lambda page, row, kind: F.concat(F.lit(URN), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), row.cast("string"), F.lit(f":{kind}>"))
    one_line = F.regexp_replace("url", r"[\r\n]+", " ")
    capture = urn(F.col("page_id"), F.col("row"), "response")
    again = F.col("ref").isNotNull()

    def record(kind, record_id, content, *more):
        head = F.concat(F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", kind), line("WARC-Record-ID", record_id), line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", one_line), *more, line("Content-Length", F.octet_length(content).cast("string")))
        return F.concat(head, F.lit(CRLF), content)

    host = F.regexp_extract(one_line, r"://([^/?#]*)", 1)
    target = F.regexp_extract(one_line, r"://[^/?#]*([^#]*)", 1)
    asked = F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF))
    answer = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF), F.when(again, "").otherwise(F.col("html")))
    told = F.concat(line("page-id", F.coalesce(F.col("page_id").cast("string"), F.lit(""))), line("payload-length", F.col("bytes").cast("string")))
    concurrent = line("WARC-Concurrent-To", capture)
    kind = F.when(again, "revisit").otherwise("response")
    refers = F.when(again, F.concat(line("WARC-Refers-To", urn(F.col("ref.page_id"), F.col("ref.row"), "response")), F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}"))).otherwise("")
    rows = F.array(
        record(F.lit("request"), urn(F.col("page_id"), F.col("row"), "request"), asked, concurrent, F.lit(f"Content-Type: application/http;msgtype=request{CRLF}")),
        record(kind, capture, answer, line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), refers, F.lit(f"Content-Type: application/http;msgtype=response{CRLF}")),
        record(F.lit("metadata"), urn(F.col("page_id"), F.col("row"), "metadata"), told, concurrent, F.lit(f"Content-Type: application/warc-fields{CRLF}")),
    )
    out = p.select(F.explode(rows).alias("value"))
    out.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", 3 * file_rows).text(path)


RECORD = T.StructType([T.StructField(n, t) for n, t in (("type", T.StringType()), ("record_id", T.StringType()), ("concurrent_to", T.ArrayType(T.StringType())), ("refers_to", T.StringType()), ("target", T.StringType()), ("date", T.StringType()), ("digest", T.StringType()), ("length", T.LongType()), ("found_digest", T.StringType()), ("fields", T.StringType()), ("payload", T.BinaryType()))])


def _inflate(data: bytes) -> bytes:
    """All gzip members of a file; a file that isn't compressed as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    parts = []
    while data:
        d = zlib.decompressobj(31)
        parts.append(d.decompress(data))
        data = d.unused_data
    return b"".join(parts)


def parse(data: bytes, payloads: bool):
    """Records of an uncompressed archive, as tuples of RECORD's fields. A record may name several concurrent ones; one
    whose length is missing or no number ends where the next record begins."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        head: dict[str, str] = {}
        concurrent: list[str] = []
        for row in data[at:end].split(b"\r\n")[1:]:
            name, _, value = row.partition(b":")
            name, value = name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace")
            head.setdefault(name, value)
            if name == "warc-concurrent-to":
                concurrent.append(value)
        start, told = end + 4, head.get("content-length", "")
        following = -1 if told.isdecimal() else data.find(b"\r\n\r\nWARC/", start - 4)
        size = int(told) if told.isdecimal() else max(0, (following if following >= 0 else len(data.removesuffix(b"\r\n\r\n"))) - start)
        body = memoryview(data)[start : start + size]
        at = start + size
        kind, length, found, fields, payload = head.get("warc-type"), None, None, None, None
        if head.get("content-type", "").startswith("application/http"):
            cut = data.find(b"\r\n\r\n", start, start + size)
            http = bytes(body[: cut - start]).decode("latin-1") if cut >= 0 else ""
            payload = body[cut + 4 - start :] if cut >= 0 else body
            fields = http.split("\r\n", 1)[0]
            if kind == "revisit":
                told = [x.split(":", 1)[1] for x in http.split("\r\n")[1:] if x.lower().startswith("content-length:")]
                length = int(told[0]) if told and told[0].strip().isdecimal() else None
            else:
                length, found = len(payload), hashlib.sha1(payload).hexdigest()
        elif kind == "metadata":
            fields = bytes(body).decode("utf-8", "replace")
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        yield kind, head.get("warc-record-id"), concurrent, head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-date"), digest, length, found, fields, bytes(payload) if payloads and payload is not None else None


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records of the archives in a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("content")
    types = [pa.string(), pa.string(), pa.list_(pa.string())] + [pa.string()] * 4 + [pa.int64(), pa.string(), pa.string(), pa.binary()]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data, rows, size = _inflate(batch.column(0)[i].as_py()), [], 0
                for r in parse(data, payloads):
                    rows.append(r)
                    size += len(r[10] or b"")
                    if len(rows) >= 4000 or size > 8 << 20:
                        yield _batch(rows, types)
                        rows, size = [], 0
                yield _batch(rows, types)

    return files.mapInArrow(run, RECORD)


def _batch(rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], RECORD.names)


def captures(records: DataFrame, s: Scratch) -> DataFrame:
    """(record_id, capture_id) of request and metadata records, through concurrent-to identifiers.

    A capture is called as its response. Most records name their response, and then one join does. Only if a
    record names none, or a response names others, are the records' links followed both ways and over any number of steps."""
    links = s.table(records.select("record_id", F.col("type").isin(*MAIN).alias("main"), "concurrent_to"), "links")
    mains = links.where("main").select(F.col("record_id").alias("capture_id"))
    edges = links.select("record_id", "main", F.explode("concurrent_to").alias("to"))
    direct = edges.where("not main").join(mains, F.col("to") == F.col("capture_id")).groupBy("record_id").agg(F.min("capture_id").alias("capture_id"))
    direct = s.table(direct, "direct")
    open_ = edges.where("main").select("record_id").union(links.where("not main and size(concurrent_to) > 0").select("record_id").join(direct, "record_id", "left_anti"))
    if open_.isEmpty():
        return direct
    of = connected_components(edges, "record_id", "to", s)
    named = of.join(mains, F.col("node") == F.col("capture_id")).groupBy("label").agg(F.min("capture_id").alias("capture_id"))
    far = of.join(named, "label").select(F.col("node").alias("record_id"), "capture_id")
    far = far.join(links.where("not main").select("record_id"), "record_id", "left_semi").join(direct, "record_id", "left_anti")
    return s.table(direct.unionByName(far), "captures")


def transactions(records: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One nested row per capture: (capture_id, target, date, request, response, metadata).

    Records of a capture meet by its response's identifier; a capture has few of them, so no group is
    large. Records whose capture has no response are left out; null identifiers meet nothing; of several requests of a
    capture the one of greatest identifier is given, and so with metadata. No records give no captures."""
    s = scratch or Scratch(records.sparkSession)
    side = records.where(F.col("type").isin("request", "metadata")).select("record_id", "type", F.struct("record_id", "fields").alias("part"))
    side = side.join(captures(records, s), "record_id")
    pick = lambda kind: F.max(F.when(F.col("type") == kind, F.col("part"))).alias(kind)
    side = side.groupBy("capture_id").agg(pick("request"), pick("metadata"))
    answers = records.where(F.col("type").isin(*MAIN)).select(F.col("record_id").alias("capture_id"), "target", "date", F.struct("type", "record_id", "refers_to", "digest", "length", "found_digest", "fields", "payload").alias("response"))
    return answers.join(side, "capture_id", "left").select("capture_id", "target", "date", "request", "response", "metadata")


def op3(pages: DataFrame) -> DataFrame:
    """Writes the archives into the shared folder, reads them back and digests the captures."""
    s = Scratch(pages.sparkSession)
    path = s.path("warc")
    write_archive(pages, path, scratch=s)
    t = transactions(read_records(pages.sparkSession, path, payloads=False), s)
    told = F.nullif(F.regexp_extract("metadata.fields", r"page-id: (-?\d+)", 1), F.lit("")).cast("long")
    return t.select(
        told.alias("page_id"),
        F.col("response.length").alias("payload_bytes"),
        F.coalesce("response.found_digest", "response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.nullif(F.regexp_extract("response.refers_to", r"^<urn:x-capture:(-?\d+):", 1), F.lit("")).cast("long").alias("refers_to"),
    )


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM p),
r AS (
  SELECT *, payload_bytes >= 1000 AND last IS NOT NULL AND page_id IS DISTINCT FROM last AS again FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN last END AS refers_to
FROM r
"""
