import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from nocturne.llm import sharding
from nocturne.session import work_folder


@pytest.mark.parametrize("bucket_rows", [3, 50_000])
def test_law_and_slots(hard, bucket_rows):
    rows = hard.select("doc_id", "text").collect()
    got = sharding.document_shards(hard, bucket_rows=bucket_rows).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    counts = Counter(r.shard for r in got)
    assert set(counts) <= set(range(8)) and max(counts.values()) - min(counts[s] for s in range(8)) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))


def test_layout_does_not_matter_and_the_seed_does(hard):
    rows = hard.select("doc_id", "lang", "text")
    one = sorted(map(str, sharding.shuffled(rows.repartition(7), bucket_rows=10).collect()))
    assert one == sorted(map(str, sharding.shuffled(rows.coalesce(1), bucket_rows=10).collect()))
    before = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    rows.sparkSession.conf.set("spark.sql.shuffle.partitions", "3")
    assert one == sorted(map(str, sharding.shuffled(rows, bucket_rows=10).collect()))
    rows.sparkSession.conf.set("spark.sql.shuffle.partitions", before)
    assert one != sorted(map(str, sharding.shuffled(rows, seed=1, bucket_rows=10).collect()))


def test_copies_spread_evenly(spark):
    df = spark.range(25_000).select(F.lit(1).alias("a"), F.lit(None).cast("string").alias("b")).union(spark.range(100).select("id", F.lit("x")))
    got = sharding.shuffled(df, bucket_rows=1000)
    counts = [r["count"] for r in got.groupBy("shard").count().collect()]
    assert len(counts) == 8 and sum(counts) == 25_100 and max(counts) - min(counts) <= 1
    assert got.where("b = 'x'").groupBy("shard").count().count() == 8


def test_written_shards_keep_their_order(spark, hard):
    path = work_folder(spark, "shards")
    placed = sharding.shuffled(hard.select("doc_id", "text"))
    sharding.write_shards(placed, path, files=3)
    back = spark.read.parquet(path)
    assert sorted(map(str, back.select("doc_id", "text", "shard", "slot").collect())) == sorted(map(str, placed.select("doc_id", "text", "shard", "slot").collect()))


def test_empty_table_and_plan(none, hard):
    assert sharding.document_shards(none).count() == 0
    plan = sharding.document_shards(hard)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_columns_come_from_whole_documents_written_as_shards(spark, hard):
    rows = hard.select("doc_id", "text")
    got = sharding.document_shards(rows)
    back = spark.read.parquet(got.inputFiles()[0].rsplit("/shard=", 1)[0])
    placed = back.select("doc_id", "text", "shard", "slot").collect()
    assert Counter((r.doc_id, r.text) for r in placed) == Counter(map(tuple, rows.collect()))
    want = Counter((r.doc_id, zlib.crc32((r.text or "").encode()), r.shard, r.slot) for r in placed)
    assert Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in got.collect()) == want


def test_buckets_follow_bytes_and_no_bucket_is_gathered(hard, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 1 << 12)
    rows = hard.select("doc_id", "text")
    got = sharding.shuffled(rows)
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(map(tuple, rows.collect()))
    counts = [r["count"] for r in got.groupBy("shard").count().collect()]
    assert max(counts) - min(counts) <= 1
