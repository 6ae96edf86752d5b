"""Streams over several batches and restarts equal the batch result."""

from pyspark.sql import functions as F

from nocturne.session import work_folder
from nocturne.streaming import live, sinks

SCHEMA = "user_id long, event_id long, timestamp long, hr int, event_time timestamp"


def rows(spark, first, n, users=3):
    return spark.range(first, first + n).select(
        (F.col("id") % users).alias("user_id"), F.col("id").alias("event_id"),
        (1704067200 + F.col("id") * 37).alias("timestamp"), (50 + F.col("id") % 60).cast("int").alias("hr"),
        F.timestamp_seconds(1704067200 + F.col("id") * 37).alias("event_time"),
    )


def test_duplicates_and_restarts(spark):
    source, folder = work_folder(spark, "in"), work_folder(spark, "out")
    rows(spark, 0, 500).coalesce(1).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema
    stream = lambda: live.deduplicated(live.read_stream(spark, source, schema, files_per_batch=1))
    live.run_available(stream(), folder)
    rows(spark, 250, 500).coalesce(1).write.mode("append").parquet(source)  # half of them again
    target = live.run_available(stream(), folder)
    got = live.written_rows(spark, target, schema)
    assert got.count() == 750 and got.select("user_id", "timestamp").distinct().count() == 750


def test_updates_over_batches(spark):
    source, folder = work_folder(spark, "in"), work_folder(spark, "out")
    for k in range(3):
        rows(spark, k * 100, 100).coalesce(1).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema
    stream = live.sync_progress(live.read_stream(spark, source, schema, files_per_batch=1))
    sinks.upsert(stream, folder, ["user_id"])
    got = {r["user_id"]: tuple(r)[1:] for r in sinks.latest(spark, folder, stream.schema).collect()}
    want = rows(spark, 0, 300).groupBy("user_id").agg(F.min("timestamp"), F.max("timestamp"), F.count(F.lit(1))).collect()
    assert got == {r[0]: tuple(r)[1:] for r in want}


def test_reading_costs_the_same_after_any_number_of_batches(spark):
    source, folder = work_folder(spark, "in"), work_folder(spark, "out")
    read = []
    for k in range(9):
        # null users, a user in each batch and one in a single batch
        part = rows(spark, k * 50, 50, 5).withColumn("user_id", F.when(F.col("user_id") == 4, F.lit(None)).when(F.col("user_id") == 3, 100 + k).otherwise(F.col("user_id")))
        part.coalesce(1).write.mode("append").parquet(source)
        stream = live.sync_progress(live.read_stream(spark, source, part.schema))
        sinks.upsert(stream, folder, ["user_id"], buckets=4)
        table = sinks.latest(spark, folder, stream.schema)
        read.append((len(table.inputFiles()), len(sinks.versions(spark, f"{folder}/data", "version")), len(sinks.versions(spark, f"{folder}/manifest", "version"))))
    assert max(n for n, *_ in read) <= 4 and max(v for _, v, _ in read) <= 8 and max(m for *_, m in read) <= 2
    got = {r["user_id"]: tuple(r)[1:] for r in table.collect()}
    want = spark.read.parquet(source).groupBy("user_id").agg(F.min("timestamp"), F.max("timestamp"), F.count(F.lit(1))).collect()
    assert got == {r[0]: tuple(r)[1:] for r in want} and len(got) == 13


def test_an_update_that_runs_twice_is_the_same(spark, monkeypatch):
    source, folder = work_folder(spark, "in"), work_folder(spark, "out")
    calls = []
    drain = sinks._drain

    def twice(stream, folder_, mode, write):
        drain(stream, folder_, mode, lambda batch, n: (write(batch, n), calls.append(n), write(batch, n)))

    monkeypatch.setattr(sinks, "_drain", twice)
    for k in range(3):
        rows(spark, k * 40, 60).coalesce(1).write.mode("append").parquet(source)
    read = lambda: live.read_stream(spark, source, rows(spark, 0, 1).schema, files_per_batch=1)
    sinks.upsert(live.sync_progress(read()), folder, ["user_id"], 4)
    got = {r.user_id: r.n_rows for r in sinks.latest(spark, folder, live.sync_progress(read()).schema).collect()}
    assert got == {u: 60 for u in range(3)} and calls == [0, 1, 2]
    other = work_folder(spark, "out")
    sinks.insert_new(read(), other, ["user_id", "timestamp"], ["event_id"])
    assert sorted(tuple(r) for r in sinks.ledger(spark, other).select("batch", "offered", "inserted", "ignored").collect()) == [(0, 60, 60, 0), (1, 60, 40, 20), (2, 60, 40, 20)]


def test_inserts_are_counted_and_made_once(spark):
    source, folder = work_folder(spark, "in"), work_folder(spark, "out")
    schema = rows(spark, 0, 1).schema
    odd = spark.createDataFrame([(None, 1, 1704067200, 70, None), (None, 2, 1704067200, 71, None), (1, 3, None, 72, None), (1, 4, None, 73, None)], SCHEMA)
    batches = [rows(spark, 0, 100).unionByName(rows(spark, 50, 50)).unionByName(odd), rows(spark, 80, 100).unionByName(odd), rows(spark, 0, 180)]
    for part in batches:
        part.write.mode("append").parquet(source)
        sinks.insert_new(live.read_stream(spark, source, schema), folder, ["user_id", "timestamp"], ["event_id"])
    got = sorted(tuple(r) for r in sinks.ledger(spark, folder).select("batch", "offered", "inserted", "ignored").collect())
    assert got == [(0, 154, 102, 52), (1, 104, 80, 24), (2, 180, 0, 180)]
    table = sinks.inserted(spark, folder, schema)
    assert table.count() == 182 and table.select("user_id", "timestamp").distinct().count() == 182
    assert sorted(r.hr for r in table.where("user_id IS NULL OR timestamp IS NULL").collect()) == [70, 72]


def test_baseline_state_survives_restarts_and_late_days(spark):
    source, folder = work_folder(spark, "in"), work_folder(spark, "out")
    values = {1: 50.0, 2: 60.0, 3: 40.0, 4: 80.0, 5: None, 6: 45.0}
    for day in (2, 1, 6, 4, 3, 5, 4):
        one = spark.createDataFrame([(1, f"2024-01-0{day}", values[day])], "user_id long, date string, v double")
        one.select("user_id", F.to_date("date").alias("date"), "v").coalesce(1).write.mode("append").parquet(source)
        stream = live.running_baseline(live.read_stream(spark, source, spark.read.parquet(source).schema), "v")
        sinks.upsert(stream, folder, ["user_id"])
    want = None
    for day in sorted(values):
        v = values[day]
        want = want if v is None else v if want is None else 0.1 * v + 0.9 * want
    got = sinks.latest(spark, folder, stream.schema).first()
    assert abs(got["baseline"] - want) < 1e-9 and got["days"] == 5 and str(got["date"]) == "2024-01-06"


def test_sessions_of_several_files_are_emitted_once(spark):
    source, folder = work_folder(spark, "in"), work_folder(spark, "out")
    for i in range(3):
        # a user with any number may come, -1 too
        one = rows(spark, i * 1000, 1, 1).withColumns({"hr": F.lit(90), "user_id": F.lit(-1).cast("long"), "closing": F.lit(None).cast("boolean")})
        one.coalesce(1).write.mode("append").parquet(source)
    stream = live.activity_sessions(live.read_stream(spark, source, one.schema, files_per_batch=1), 60, "1 minute", delay="1 hour")
    target = live.run_available(stream, folder)
    live.closing_row(spark.read.parquet(source), 60, "2 hours").write.mode("append").parquet(source)
    live.run_available(stream, folder)
    got = live.written_rows(spark, target, stream.schema)
    assert sorted(r.start_ts for r in got.collect()) == [1704067200 + i * 37000 for i in range(3)]
