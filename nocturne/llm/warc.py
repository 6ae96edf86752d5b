"""Content-addressed WARC archive.

The archive is two tables below one path: ``payloads`` keeps each distinct payload once, by its
SHA-256; ``headers`` keeps the exact header bytes of every record and the digest of its payload.
Records are put together again by a join on the digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import shuffles_dropped, table

LEAST_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n\r\n"


def _name(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _line(name: str, value) -> Column:
    return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit("\r\n"))


def _clean(value: Column) -> Column:
    """A header value keeps to one line."""
    return F.translate(F.coalesce(value, F.lit("")), "\r\n", "")


def headers_of(pages: DataFrame, page_id: str, url: str, html: str, least: int, date: str) -> DataFrame:
    """``(page_id, payload_digest, payload_bytes, record_type, header, http)`` of each row."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = table(pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.sha2(payload, 256).alias("payload_digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
    ), "page-digests")
    first = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"))
    rows = rows.join(first, "payload_digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(_END))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), _line("WARC-Record-ID", _name(F.col("page_id"))),
        _line("WARC-Date", date), _line("WARC-Target-URI", _clean(F.col("url"))), _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", _name(F.col("first"))), _line("WARC-Profile", _PROFILE))).otherwise(""),
        _line("Content-Type", "application/http; msgtype=response"), _line("Content-Length", length.cast("string")), F.lit("\r\n"),
    )
    return rows.select("page_id", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), header.cast("binary").alias("header"), http.cast("binary").alias("http"))


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_BYTES, date: str = DATE) -> None:
    """Writes one record per row of ``pages`` below ``path``.

    The payload is the html in UTF-8, null is empty. Among equal payloads of ``least`` bytes or more
    the smallest page_id is the response and the others revisit it; rows of that same page_id
    are responses too. Rows without an id revisit the response of their payload, or are
    responses where no row of it has an id. Other columns are left out.
    """
    with shuffles_dropped(pages.sparkSession):
        headers_of(pages, page_id, url, html, least, date).write.parquet(f"{path}/headers")
        payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
        stored = pages.select(F.sha2(payload, 256).alias("payload_digest"), payload.alias("payload"))
        stored.groupBy("payload_digest").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``(record, payload_bytes, verified)``: the bytes of every record, put together from the archive.

    ``payload_bytes`` is the size of the full payload; ``verified`` tells that the stored
    payload has the digest it is stored under.
    """
    headers = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads")
    sizes = payloads.select("payload_digest", F.octet_length("payload").cast("long").alias("payload_bytes"), (F.sha2("payload", 256) == F.col("payload_digest")).alias("verified"))
    end = F.lit(_END).cast("binary")
    full = headers.where("record_type = 'response'").join(payloads, "payload_digest").select(
        F.concat("header", "http", "payload", end).alias("record"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        (F.sha2("payload", 256) == F.col("payload_digest")).alias("verified"),
    )
    short = headers.where("record_type = 'revisit'").join(sizes, "payload_digest").select(F.concat("header", "http", end).alias("record"), "payload_bytes", "verified")
    return full.unionByName(short)


def parse(records: DataFrame) -> DataFrame:
    """The fields of each record, with the payload of responses cut out of the record's bytes.

    Returns ``(page_id, url, record_type, refers_to, payload_digest, payload, payload_bytes, whole)``. Digest and size of
    a response are computed from the bytes cut out, those of a revisit from the stored payload; ``whole`` tells
    that they agree with the header.
    """
    text = F.col("record").cast("string")
    head = F.substring_index(text, _END, 1)
    field = lambda name: F.regexp_extract(F.col("head"), rf"(?m)^{name}: (.*?)\r?$", 1)
    page = lambda name: F.regexp_extract(field(name), r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    cut = records.withColumn("head", head)
    cut = cut.withColumns({"length": field("Content-Length").cast("long"), "block": F.expr("substring(record, octet_length(head) + 5)")})
    cut = cut.withColumn("block", F.expr("substring(block, 1, octet_length(block) - 4)"))
    http = F.octet_length(F.substring_index(F.col("block").cast("string"), _END, 1)) + 4
    cut = cut.withColumn("payload", F.call_function("substring", F.col("block"), http + 1))
    kind = field("WARC-Type")
    digest = F.regexp_extract(field("WARC-Payload-Digest"), "^sha256:([0-9a-f]{64})$", 1)
    response = kind == "response"
    whole = (F.octet_length("block") == F.col("length")) & F.col("verified") & (~response | ((F.sha2("payload", 256) == digest) & (F.octet_length("payload") == F.col("payload_bytes"))))
    return cut.select(
        page("WARC-Record-ID").alias("page_id"), field("WARC-Target-URI").alias("url"), kind.alias("record_type"), page("WARC-Refers-To").alias("refers_to"),
        F.when(response, F.sha2("payload", 256)).otherwise(digest).alias("payload_digest"), F.when(response, F.col("payload")).alias("payload"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), whole.alias("whole"),
    )
