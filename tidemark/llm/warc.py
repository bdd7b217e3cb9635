"""A content-addressed archive of web pages in WARC records.

Writing keeps two tables below a folder: ``payloads`` holds each distinct payload once, by
its SHA-256; ``records`` holds the exact header of every record (WARC and HTTP fields, as
they stand in the archive) and the digest of its payload. Reading checks every stored
payload against its digest, rebuilds the original records by a join, and holds the length
of each record's block against its ``Content-Length``. ``write_files``
and ``read_files`` do the same with plain ``.warc`` files.

Of records with equal payloads of at least ``least`` bytes, the one with the largest page_id
is a response and the others revisit it.

Defined results: null html is an empty payload; a null url is an empty target URI, and
control characters in one are percent-encoded. Rows that repeat a page_id give a record
each; if that page is the response of its group, each of them is. A null page_id never
is the response of a group unless all are null. Extra columns are ignored. An empty table
gives an empty archive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def _payload() -> Column:
    return F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")


def _http_header() -> Column:
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))


def _record_header() -> Column:
    """WARC fields and HTTP header, up to where the payload begins."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    for c in "\r\n\t ":
        url = F.replace(url, F.lit(c), F.lit(f"%{ord(c):02X}"))
    revisit = F.col("refers_to").isNotNull()
    http = _http_header()
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))

    def line(name: str, value: Column | str) -> Column:
        return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit("\r\n"))

    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Date", DATE),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", PROFILE), line("WARC-Refers-To", F.concat(F.lit("<urn:x-page:"), F.col("refers_to").cast("string"), F.lit(">"))))).otherwise(""),
        line("Content-Type", "application/http;msgtype=response"),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
        http,
    )


def records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """``page_id, header, sha256`` for each page: its exact record header and its payload's strong digest."""
    p = _payload()
    heads = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.octet_length(p).cast("long").alias("payload_bytes"), F.sha1(p).alias("sha1"), F.sha2(p, 256).alias("sha256")
    )
    groups = heads.where(F.col("payload_bytes") >= least).groupBy("sha256").agg(F.max("page_id").alias("largest"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest"))
    return heads.join(groups, "sha256", "left").withColumn("refers_to", refers).select("page_id", _record_header().alias("header"), "sha256")


def write_archive(pages: DataFrame, path: str, least: int = 1000) -> None:
    """Write ``pages(page_id, url, html)`` below ``path``."""
    records(pages, least).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/records")
    p = _payload()
    store = pages.select(F.sha2(p, 256).alias("sha256"), p.alias("payload")).groupBy("sha256").agg(F.first("payload").alias("payload"))
    store.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/payloads")


def _field(name: str) -> Column:
    return F.regexp_extract("header", rf"(?m)^{name}: <?(?:urn:x-page:|sha1:)?([^>\r\n]*)", 1)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, url, record_type, refers_to, header, payload, payload_bytes, payload_digest, record, record_sha256`` of every record.

    ``record`` is the original record, without the blank lines that end it. A stored payload that does not have its
    digest, a record whose digest or length is not its payload's, or one whose block has another length than it says, is
    an error.
    """
    store = spark.read.parquet(f"{path}/payloads")
    same = F.sha2("payload", 256) == F.col("sha256")
    store = store.select(
        F.when(same, F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "sha256"))).alias("sha256"),
        "payload",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
    )
    rows = spark.read.parquet(f"{path}/records").join(store, "sha256", "left")
    kept = (F.col("payload_digest") == _field("WARC-Payload-Digest")) & (F.col("payload_bytes") == _field("WARC-Payload-Length").cast("long"))
    digest = F.when(kept, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("record without its payload: "), "header")))
    start = F.instr("header", "\r\n\r\n") + 4  # the block begins after the first empty line
    head = F.encode("header", "UTF-8")
    record = F.concat(head, F.when(_field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b"")))
    before = F.octet_length(F.substring(F.col("header"), F.lit(1), start - 1))
    fits = F.octet_length(record) - before == _field("Content-Length").cast("long")
    rows = rows.withColumn("record", F.when(fits, record).otherwise(F.raise_error(F.concat(F.lit("record of another length: "), "header"))))
    number = lambda name: F.nullif(_field(name), F.lit("")).cast("long")
    return rows.select(
        number("WARC-Record-ID").alias("page_id"),
        _field("WARC-Target-URI").alias("url"),
        _field("WARC-Type").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"),
        "header",
        "payload",
        "payload_bytes",
        digest.alias("payload_digest"),
        "record",
        F.sha2("record", 256).alias("record_sha256"),
    )


def write_files(archive: DataFrame, path: str, per_file: int = 1000) -> None:
    """Write the records of ``read_archive`` as plain WARC files; the text sink's line separator is the records' end.

    A file is read as a whole, so it holds few records.
    """
    archive.select(F.decode("record", "UTF-8").alias("record")).write.mode("overwrite").option("lineSep", END).option("maxRecordsPerFile", per_file).text(path)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            data, at, out = content.as_py(), 0, []
            while data.startswith(b"WARC/", at):
                head = data.index(b"\r\n\r\n", at)
                fields = dict(re.findall(rb"([\w-]+): ?([^\r]*)", data[at:head]))
                end = head + 4 + int(fields[b"Content-Length"])
                body = data.index(b"\r\n\r\n", head + 4) + 4
                page = re.search(rb"\d+|$", fields[b"WARC-Record-ID"])[0]
                refers = re.search(rb"\d+|$", fields.get(b"WARC-Refers-To", b""))[0]
                out.append((int(page) if page else None, fields[b"WARC-Type"].decode(), int(refers) if refers else None, data[body:end]))
                at = end + 4
            names = ["page_id", "record_type", "refers_to", "payload"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, record_type, refers_to, payload`` of every record in the WARC files below ``path``."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parse, "page_id long, record_type string, refers_to long, payload binary")
