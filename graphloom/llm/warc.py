"""WARC archives: writing pages as transactions, reading records, and assembling captures.

A page becomes a response (or, if another page has the same payload of at least
`least` bytes, a revisit of the one with the smallest id), a request and a
metadata record; the latter two name the first in WARC-Concurrent-To. Files are
WARC/1.1, gzip-compressed, written by Spark's text writer (records end in two
line ends, which is its line separator), so lost tasks are simply run again. Pages of
similar size are written together, so that the records of a file bound its bytes.

Reading takes any WARC files (plain or gzip, one member or many) of bounded size
each. A transaction is put together by the record that the others are concurrent
to: one grouped shuffle on that identifier joins response or revisit, request and
metadata into one nested row. Of several records of a kind the one with the
smallest record id is taken.

Every row with an id is a page with records of its own, named by id, payload digest
and, of rows that agree in both, a running number in the order of their URLs: ids
may repeat, with the same payload or another. Rows of one id with one payload never
revisit each other; a revisit refers to the first of the rows that hold the smallest id.
Null payloads are empty, null URLs give records without target. Rows with a null
id are left out. An empty table gives no captures; records without
partner give a capture with null parts. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import new_path, written
from .textkit import lean

CRLF = "\r\n"
#: Bytes of a file before compression, about; a file is read by one task.
FILE_BYTES = 64 << 20
#: Pages of up to so many bytes are written to files together; larger ones have files of their own.
SIZE_CLASSES = (32 << 10, 1 << 20, 32 << 20)
#: Bytes of headers, request and metadata that a page has besides its payload, about.
PAGE_BYTES = 2048
#: Places that the pages of one payload are dealt to when they look for the first of them.
SALTS = 16
DATE = "2024-01-01T00:00:00Z"


def _record_id(kind: str, page: Column, digest: Column, copy: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.lit(kind), page.cast("string"), digest, copy.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), *(x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]), F.lit(">"))


def salted_join(many: DataFrame, few: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """many joined with few, which has one row a key; rows of one key are dealt to SALTS places by the column `by`."""
    spread = few.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return many.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(spread.hint("merge"), [key, "_salt"], how).drop("_salt")


def _record(kind: str, headers: list[tuple[str, Column]], block: Column) -> Column:
    """Text of a record; headers that are null are left out."""
    lines = [F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Date: {DATE}{CRLF}")]
    lines += [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")) for name, value in headers]
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block)


def transactions(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100) -> DataFrame:
    """(record): the three records of every page as text, in one row each."""
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload")).where("page is not null")
    rows = rows.withColumn("sha", F.sha2(F.encode("payload", "UTF-8"), 256))
    named = rows.where(F.octet_length("payload") >= least).select("page", "sha")
    first = named.groupBy("sha").agg(F.min("page").alias("first"), F.max("page").alias("last")).where("first < last").drop("last")
    revisits = salted_join(named, first, "sha", "page").where("first < page").select("page", "sha", "first").distinct()
    numbered = rows.withColumn("copy", F.row_number().over(Window.partitionBy("page", "sha").orderBy("url")) - 1)
    full = numbered.join(revisits.hint("merge"), ["page", "sha"], "left")
    page, again = F.col("page"), F.col("first").isNotNull()
    target = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    key = page, F.col("sha"), F.col("copy")
    own = _record_id("response", *key)
    digest = F.concat(F.lit("sha256:"), F.col("sha"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(CRLF * 2))
    common = [("WARC-Record-ID", own), ("WARC-Target-URI", target), ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http; msgtype=response"))]
    response = _record("response", common, F.concat(http, "payload"))
    revisit = _record("revisit", [*common, ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", _record_id("response", F.col("first"), F.col("sha"), F.lit(0)))], http)
    path = F.coalesce(F.nullif(F.regexp_replace(target, "^[a-zA-Z]+://[^/?#]*|#.*$", ""), F.lit("")), F.lit("/"))
    host = F.coalesce(F.regexp_extract(target, "^[a-zA-Z]+://([^/?#]*)", 1), F.lit(""))
    request = _record("request", [("WARC-Record-ID", _record_id("request", *key)), ("WARC-Target-URI", target), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), path, F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2)))
    metadata = _record("metadata", [("WARC-Record-ID", _record_id("metadata", *key)), ("WARC-Target-URI", target), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("page-id: "), page.cast("string"), F.lit(CRLF)))
    return full.select(F.explode(F.array(F.when(again, revisit).otherwise(response), request, metadata)).alias("record"))


def write_warc(pages: DataFrame, path: str, payload_col: str = "html", **columns) -> None:
    """Write the transactions of pages as .gz files of WARC records in folders under path."""
    size = F.coalesce(F.octet_length(F.col(payload_col).cast("string")), F.lit(0))
    kind = sum((F.when(size > bound, 1).otherwise(0) for bound in SIZE_CLASSES), F.lit(0))
    found = {r[0] for r in pages.select(kind).distinct().collect()} or {0}
    for k in sorted(found):
        # equal payloads are of one class, so that each class can be written on its own
        own = pages.where(kind == k) if len(found) > 1 else pages
        at_most = 3 * max(1, FILE_BYTES // (SIZE_CLASSES[k] + PAGE_BYTES)) if k < len(SIZE_CLASSES) else 3
        transactions(own, payload_col=payload_col, **columns).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", at_most).text(f"{path}/{k}")


_HEADER = re.compile(rb"^([^:\r\n]+):[ \t]*(.*?)[ \t]*$", re.M)
RECORD = "record_id string, type string, target string, concurrent array<string>, refers_to string, digest string, fields map<string,string>, payload_bytes long, payload_sha256 string, payload binary"


def unpacked(data: bytes) -> bytes:
    """A gzip file of one member or many, or a plain one."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data) + member.flush())
        data = member.unused_data
    return b"".join(out)


def records(data: bytes) -> Iterator[tuple[dict[str, list[str]], memoryview]]:
    """(headers with lower-case names, block) of each record."""
    view, at = memoryview(data), 0
    while True:
        at = data.find(b"WARC/1.", at)
        if at < 0:
            return
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError(f"record at byte {at} has no end of headers")
        headers: dict[str, list[str]] = {}
        for name, value in _HEADER.findall(data[at:end].replace(b"\r", b"")):
            headers.setdefault(name.decode("utf-8", "replace").strip().lower(), []).append(value.decode("utf-8", "replace"))
        size = int(headers["content-length"][0])
        if end + 4 + size > len(data):
            raise ValueError(f"record at byte {at} is cut off")
        yield headers, view[end + 4 : end + 4 + size]
        at = end + 4 + size


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), pa.binary()]
        names = [x.split(" ")[0] for x in RECORD.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            for k in range(batch.num_rows):
                rows, held = [], 0
                for head, block in records(unpacked(batch.column(0)[k].as_buffer().to_pybytes())):
                    one = lambda n, h=head: h.get(n, [None])[0]
                    kind, payload, size, sha, fields = one("warc-type"), None, None, None, []
                    mime = one("content-type") or ""
                    if mime.startswith("application/http"):
                        raw = bytes(block)
                        http, _, payload = raw.partition(b"\r\n\r\n")
                        if kind == "revisit":
                            found = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
                            payload, size = None, int(found[1]) if found else None
                    elif mime.startswith("application/warc-fields"):
                        fields = [(a.decode("utf-8", "replace").strip(), b.decode("utf-8", "replace")) for a, b in _HEADER.findall(bytes(block).replace(b"\r", b""))]
                    else:
                        payload = bytes(block)
                    if payload is not None:
                        size, sha = len(payload), hashlib.sha256(payload).hexdigest()
                        said = one("warc-payload-digest") or ""
                        if kind == "response" and said.startswith("sha256:") and said[7:].lower() != sha:
                            raise ValueError(f"{one('warc-record-id')}: payload does not match its digest")
                    rows.append((one("warc-record-id"), kind, one("warc-target-uri"), head.get("warc-concurrent-to", []), one("warc-refers-to"), one("warc-payload-digest"), fields, size, sha, payload if with_payload else None))
                    held += len(block) if with_payload else 200
                    if held > 4_000_000:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return run


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """RECORD rows of all records of the files under path; payload only if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("content")
    return files.mapInArrow(lean(_read(payloads)), RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """One row a capture: capture id, kind of the main record, and structs main, request, metadata."""
    whole = F.struct("record_id", "type", "target", "refers_to", "digest", "fields", "payload_bytes", "payload_sha256", "payload")
    main = F.col("type").isin("response", "revisit", "resource")
    keyed = found.select("type", F.when(main, F.array("record_id")).otherwise(F.col("concurrent")).alias("of"), "record_id", whole.alias("r")).where("type in ('response','revisit','resource','request','metadata')")
    keyed = keyed.select(F.explode("of").alias("capture_id"), "type", "record_id", "r")

    def part(*kinds: str) -> Column:
        return F.min_by("r", F.when(F.col("type").isin(*kinds), F.col("record_id")))

    pick = lambda c, *kinds: F.when(F.max(F.col("type").isin(*kinds)), part(*kinds)).alias(c)
    return keyed.groupBy("capture_id").agg(pick("main", "response", "revisit", "resource"), pick("request", "request"), pick("metadata", "metadata"))


def op8_warc(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    captures = written(
        assemble(read_warc(spark, path)).select(
            "capture_id", F.col("metadata.fields")["page-id"].cast("long").alias("page_id"), F.col("main.payload_bytes").alias("payload_bytes"),
            F.regexp_replace("main.digest", "^sha256:", "").alias("payload_digest"), F.col("main.type").alias("record_type"), F.col("main.refers_to").alias("refers_to_id"),
        ),
        "captures",
    )
    responses = captures.where("record_type = 'response'").select(F.col("capture_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    again = captures.where("record_type = 'revisit'")
    targets = responses.join(again.select("refers_to_id").distinct().hint("merge"), "refers_to_id")
    revisits = salted_join(again, targets, "refers_to_id", "page_id", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    return captures.where("record_type = 'response'").select(*columns, F.lit(None).cast("long").alias("refers_to")).union(revisits.select(*columns, "refers_to"))


OP8_SQL = """
with p as (select page_id, coalesce(html, '') h from pages where page_id is not null),
d as (select page_id, strlen(h)::bigint payload_bytes, sha256(h) payload_digest from p),
f as (select payload_digest, min(page_id) first_id from d where payload_bytes >= 100 group by 1)
select d.page_id, d.payload_bytes, d.payload_digest,
  case when f.first_id < d.page_id then 'revisit' else 'response' end record_type,
  case when f.first_id < d.page_id then f.first_id end refers_to
from d left join f using (payload_digest)
"""
