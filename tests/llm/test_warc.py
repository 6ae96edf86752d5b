import hashlib
import re

from pyspark.sql import functions as F

from nocturne.llm import warc
from nocturne.session import work_folder

SCHEMA = "page_id long, url string, html string"


def pages(spark):
    big = "<p>" + "words " * 40 + "é\r\n\r\nWARC/1.1</p>"
    rows = [
        (1, "http://a", big), (2, "http://b", big), (0, "http://c\r\nX: y", big + "!"), (3, "http://d", big + "!"), (4, None, None), (5, "http://e", ""), (6, "http://f", "x" * 99),
        (7, "http://g", "x" * 99), (8, "http://h", "y" * 100), (9, "http://h", "y" * 100), (8, "http://h", "y" * 100), (None, "http://n", big), (None, "http://m", "z" * 300),
        (None, "http://m", "z" * 300), (10, "http://l", "long " * 200_000),
    ]
    return spark.createDataFrame(rows, SCHEMA).withColumn("payload", F.lit(1)).withColumn("first", F.lit(2))


def test_round_trip(spark):
    path = work_folder(spark, "warc")
    table = pages(spark)
    warc.write_archive(table, path)
    assert spark.read.parquet(f"{path}/payloads").groupBy("payload_digest").count().where("count > 1").isEmpty()
    got = warc.parse(warc.read_records(spark, path)).collect()
    rows = table.collect()
    first = {}
    for r in rows:
        if r.page_id is not None and len((r.html or "").encode()) >= 100:
            first[r.html] = min(r.page_id, first.get(r.html, r.page_id))
    want = []
    for r in rows:
        data = (r.html or "").encode()
        lead = first.get(r.html, r.page_id) if len(data) >= 100 else r.page_id
        kind = "response" if lead == r.page_id else "revisit"
        want.append((r.page_id, re.sub("[\r\n]", "", r.url or ""), kind, lead if kind == "revisit" else None, hashlib.sha256(data).hexdigest(), len(data), data if kind == "response" else None, True))
    have = [(r.page_id, r.url, r.record_type, r.refers_to, r.payload_digest, r.payload_bytes, None if r.payload is None else bytes(r.payload), r.whole) for r in got]
    assert sorted(map(str, have)) == sorted(map(str, want))


def test_records_are_exact(spark):
    path = work_folder(spark, "warc")
    warc.write_archive(pages(spark).where("page_id IN (1, 2)"), path)
    first, second = sorted((bytes(r.record) for r in warc.read_records(spark, path).collect()), key=len, reverse=True)
    assert first.startswith(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\n") and first.endswith(b"</p>\r\n\r\n")
    head, block = first.split(b"\r\n\r\n", 1)
    assert int(re.search(rb"\nContent-Length: (\d+)", head)[1]) == len(block) - 4
    assert b"WARC-Refers-To: <urn:page:1>\r\n" in second and second.count(b"words") == 0


def test_a_changed_payload_is_noticed(spark):
    path, other = work_folder(spark, "warc"), work_folder(spark, "warc")
    warc.write_archive(pages(spark), path)
    spark.read.parquet(f"{path}/headers").write.parquet(f"{other}/headers")
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.concat("payload", F.lit(b"x"))).write.parquet(f"{other}/payloads")
    assert warc.parse(warc.read_records(spark, other)).where("whole").isEmpty()


def test_empty_table(spark):
    path = work_folder(spark, "warc")
    warc.write_archive(spark.createDataFrame([], SCHEMA), path)
    assert warc.parse(warc.read_records(spark, path)).count() == 0
