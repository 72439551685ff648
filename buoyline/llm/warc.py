"""WARC archives of web pages, and the assembly of capture transactions.

`write_archive` writes three records per page: the request, the response (or a
revisit that points to the response of an equal payload) and a metadata record;
request and metadata name the capture in WARC-Concurrent-To. Files are plain
WARC/1.1 in one gzip stream each, below a folder that all executors share, at
most PAGES_PER_FILE pages long. `read_records` parses them by Content-Length,
one record at a time, whether a file is one gzip member or one per record.
`assemble` joins a capture's records through their concurrent-to identifiers
and emits one nested row per capture.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PAGES_PER_FILE = 1000
FILES_PER_BATCH = 1  # whole files that one Arrow batch holds when archives are read
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

HOT = 1000  # keys of over 1/HOT of all rows are looked up from a broadcast; there are fewer than HOT of them
KINDS = ("request", "response", "revisit", "metadata")
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*([0-9]+)")
_PAGE = re.compile(rb"(?m)^pageId:[ \t]*(-?[0-9]+)")

RECORD = (
    "type string, record_id string, concurrent_to string, refers_to string, uri string, date string, "
    "page_id long, payload_bytes long, payload_digest string, valid boolean"
)


def base32(hexes: Column) -> Column:
    """Upper-case base32 of 40 hex digits, of which 15 (60 bits) are 12 base32 digits."""
    parts = [F.lpad(F.conv(F.substring(hexes, at, n), 16, 32), n * 4 // 5, "0") for at, n in ((1, 15), (16, 15), (31, 10))]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    return F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def _record(kind: str, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record as binary, without the last byte of its closing CRLFCRLF."""
    named = [F.concat(F.lit(f"\r\n{name}: "), value) for name, value in headers]  # a null value leaves its header out
    head = F.concat(F.lit(f"WARC/1.1\r\nWARC-Type: {kind}"), *[F.coalesce(h, F.lit("")) for h in named],
                    F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), block, F.lit("\r\n\r").cast("binary"))


def lookup(rows: DataFrame, key: str, spread: Column, table: DataFrame, value: str, counts: DataFrame, total: Column) -> DataFrame:
    """`rows` with `value` of the row of `table` (one per key) that has their `key`; null where there is none.

    A key, or the null key, may hold any share of the rows. `counts` gives each
    key's rows `n`, and `total` is no less than their sum, so fewer than HOT keys
    hold over 1/HOT of it: these are broadcast. In the shuffled join the rows
    that need nothing more from it are dealt by `spread` instead of their key.
    """
    hot = F.broadcast(counts.where(F.col("n") * HOT > total).select(key))
    served = F.broadcast(table.join(hot, key).select(F.col(key).alias("_hot"), F.col(value).alias("_served")))
    first = rows.join(served, F.col(key) == F.col("_hot"), "left")
    done = F.col(key).isNull() | F.col("_hot").isNotNull()
    dealt = first.withColumn("_dealt", F.when(done, F.xxhash64(spread).cast("string")).otherwise(F.col(key)))
    other = table.select(F.col(key).alias("_other"), F.col(value).alias("_found"))
    return dealt.join(other, F.col("_dealt") == F.col("_other"), "left").withColumn(
        value, F.when(done, F.col("_served")).otherwise(F.col("_found"))).drop("_hot", "_served", "_dealt", "_other", "_found")


def classify(pages: DataFrame, least_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, bytes, first): `first` is set for pages that revisit another's payload.

    Of equal payloads of `least_bytes` or more, the smallest key is the
    response; every row that holds it (a repeated row) is one. A null key is
    never smallest unless all are null, and then no row revisits.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.regexp_replace(F.col(url).cast("string"), r"[\r\n]", " ").alias("url"), payload.alias("payload"))
    # The hash is a column of its own: it is used three times and must not be taken as often.
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("digest", base32(F.col("sha1"))).drop("sha1").withColumn("bytes", F.octet_length("payload").cast("long"))
    rows = rows.withColumn("same", F.concat_ws(":", "digest", "bytes"))
    groups = rows.groupBy("same", "bytes").agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
    firsts = groups.where((F.col("bytes") >= least_bytes) & F.col("least").isNotNull()).select("same", "least")
    total = pages.agg(F.count("*")).scalar()
    named = lookup(rows, "same", F.struct("page_id", "url"), firsts, "least", groups.select("same", "n"), total)
    revisits = F.col("least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least"))
    return named.select("page_id", "url", "payload", "digest", "bytes", F.when(revisits, F.col("least")).alias("first"))


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> str:
    """Write the pages as WARC files below `path` (a shared folder) and return it.

    Equal rows share their record identifiers; a page whose url or payload
    differs gets identifiers of its own. Null html is an empty payload.
    """
    rows = classify(pages, least_bytes, key, url, html)
    revisit = F.col("first").isNotNull()
    # A response's identifier follows from its key and payload alone, so a revisit can name it.
    rows = rows.withColumn("original", _urn(F.lit("capture"), F.coalesce("first", "page_id"), F.col("digest")))
    rows = rows.withColumn("capture", F.when(revisit, _urn(F.lit("revisit"), F.col("page_id"), F.col("digest"), F.col("url"))).otherwise(F.col("original")))
    original, capture = F.col("original"), F.col("capture")
    base = [("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit(DATE))]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("bytes").cast("string"), F.lit("\r\n\r\n")).cast("binary")
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    kind = ("Content-Type", F.lit("application/http; msgtype=response"))
    linked = lambda name: [("WARC-Record-ID", _urn(F.lit(name), capture)), ("WARC-Concurrent-To", capture), *base]
    request = _record("request", [*linked("request"), ("Content-Type", F.lit("application/http; msgtype=request"))],
                      F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")).cast("binary"))
    response = _record("response", [("WARC-Record-ID", capture), *base, digest, kind], F.concat(http, F.col("payload")))
    again = _record("revisit", [("WARC-Record-ID", capture), *base, digest, kind, ("WARC-Refers-To", original),
                                ("WARC-Profile", F.lit(REVISIT_PROFILE))], http)
    fields = F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n")).cast("binary")
    metadata = _record("metadata", [*linked("metadata"), ("Content-Type", F.lit("application/warc-fields"))], fields)
    end = F.lit("\n").cast("binary")
    # The text writer ends each row with "\n": the last byte of the metadata record.
    lines = rows.select(F.concat(request, end, F.when(revisit, again).otherwise(response), end, metadata).cast("string").alias("value"))
    lines.write.option("maxRecordsPerFile", PAGES_PER_FILE).option("compression", "gzip").mode("overwrite").text(path)
    return path


def _headers(stream: BinaryIO) -> dict[str, str]:
    """Header values by lower-case name, up to the blank line."""
    head = {}
    while (line := stream.readline().rstrip(b"\r\n")):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        head[name.strip().lower()] = value.removeprefix(" ")
    return head


def parse(stream: BinaryIO):
    """Records of one archive as tuples in the order of RECORD, with one record's block in memory at a time.

    A response without a digest header is valid; a block without HTTP headers is
    all payload. Sizes and pages that a record does not state are null. A file
    that ends within a record is an error.
    """
    while line := stream.readline():
        if not line.strip():
            continue  # the blank lines between records
        head = _headers(stream)
        want = int(head["content-length"])
        block = stream.read(want)
        if len(block) < want:
            raise ValueError("the archive ends within a record")
        kind, size, digest, page, valid = head["warc-type"], None, None, None, True
        said = head.get("warc-payload-digest")
        if kind == "response":
            cut = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") else 0
            payload = memoryview(block)[cut:] if cut != 3 else b""
            size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            valid = said in (None, f"sha1:{digest}")
        elif kind == "revisit":
            stated = _LENGTH.search(block)
            size, digest = int(stated[1]) if stated else None, said.removeprefix("sha1:") if said else None
        elif kind == "metadata":
            stated = _PAGE.search(block)
            page = int(stated[1]) if stated else None
        yield (kind, head.get("warc-record-id"), head.get("warc-concurrent-to"), head.get("warc-refers-to"),
               head.get("warc-target-uri"), head.get("warc-date"), page, size, digest, valid)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below `path`; payloads are measured and digested, not returned."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(FILES_PER_BATCH))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    types = [pa.string()] * 6 + [pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                with gzip.GzipFile(fileobj=pa.BufferReader(content.as_buffer())) as stream:
                    rows = list(parse(stream))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names)

    return files.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, request, capture (response or revisit), metadata, refers_to.

    Records are brought together by WARC-Concurrent-To (the capture's own record
    by its identifier); other kinds of record are left out. Equal captures, from repeated pages, come out as often
    as they went in. refers_to is the page of the response that a revisit names;
    any number of revisits may name one. The records are written once to the
    checkpoint folder, so that archives are read once.
    """
    records = records.where(F.col("type").isin(*KINDS)).checkpoint()
    own = F.col("type").isin("response", "revisit")
    body = F.struct("type", "record_id", "refers_to", "uri", "date", "payload_bytes", "payload_digest", "valid")
    extra = F.struct("record_id", "uri", "page_id")
    grouped = records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(
        F.max(F.when(F.col("type") == "request", F.struct("record_id", "uri"))).alias("request"),
        F.max(F.when(own, body)).alias("capture"),
        F.max(F.when(F.col("type") == "metadata", extra)).alias("metadata"),
        F.count_if(own).alias("copies"),
    )
    each = grouped.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1))))).drop("copies", "copy")
    named = grouped.where("capture.type = 'response'").select(
        F.col("capture_id").alias("named"), F.col("metadata.page_id").alias("refers_to"))
    counts = records.where(F.col("refers_to").isNotNull()).groupBy(F.col("refers_to").alias("named")).agg(F.count("*").alias("n"))
    total = records.agg(F.count("*")).scalar()
    each = each.withColumn("named", F.col("capture.refers_to"))
    return lookup(each, "named", F.col("capture_id"), named, "refers_to", counts, total).drop("named")
