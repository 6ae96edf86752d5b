"""Packets (D1-D9), tables and documents (IO1-IO19)."""

from pyspark.sql import functions as F

from catalog import fixtures
from catalog.aggregate_queries import day_rows
from catalog.base import cte, query, sql
from nocturne.operators.nights import local_minute
from nocturne.schema import SPORTS
from nocturne.session import work_folder
from nocturne.sources import documents, packets
from nocturne.sources import sensor as tables
from nocturne.sources.adapters import sensor, table

F32 = "CAST(CAST({} AS FLOAT) AS DOUBLE)"
_RR1, _RR2 = "CAST(coalesce(floor(rr), 0) AS INT)", "CAST(coalesce(floor(rr2), 0) AS INT)"


def ok_rr(c):
    return f"CASE WHEN {c} > 200 AND {c} < 2500 THEN CAST({c} AS DOUBLE) END"


cte("decoded", "sensor", f"""
    SELECT user_id, ts AS timestamp, hr, rr_count, rr1_ms, rr2_ms, acc_x, acc_y, acc_z, abs(sqrt(acc_x * acc_x + acc_y * acc_y + acc_z * acc_z) - 1) AS movement, gyro, spo2 FROM (
      SELECT user_id, ts, CASE WHEN user_id % 2 = 0 THEN hr WHEN {_RR1} > 200 AND {_RR1} < 2000 THEN 60000 // {_RR1} ELSE 0 END AS hr,
        CASE WHEN {_RR2} > 0 THEN 2 WHEN {_RR1} > 0 THEN 1 ELSE 0 END AS rr_count, {ok_rr(_RR1)} AS rr1_ms, {ok_rr(_RR2)} AS rr2_ms,
        {F32.format('acc_x')} AS acc_x, {F32.format('acc_y')} AS acc_y, {F32.format('acc_z')} AS acc_z, {F32.format('gyro')} AS gyro, spo2 FROM sensor)""")
DECODED = "rr1_ms rr2_ms acc_x acc_y acc_z movement gyro"
FIELDS = ["timestamp", "hr", "rr_count", "rr1_ms", "rr2_ms", "acc_x", "acc_y", "acc_z", "movement", "gyro", "spo2"]


@query("d1_decode_frames", sql("SELECT * FROM decoded", "decoded", DECODED))
def d1(spark, sf):
    d = packets.decode_frames(fixtures.frames(spark, sf))
    return d.where("d_ok").select("user_id", *[F.col(f"d.{f}").alias(f) for f in FIELDS])


cte("records", "sensor", f"""
    SELECT user_id, ts AS timestamp, hr, CASE WHEN {_RR2} > 0 THEN 2 WHEN {_RR1} > 0 THEN 1 ELSE 0 END AS rr_count, {ok_rr(_RR1)} AS rr1_ms, {ok_rr(_RR2)} AS rr2_ms,
      {F32.format('acc_x')} AS acc_x, {F32.format('acc_y')} AS acc_y, {F32.format('acc_z')} AS acc_z,
      abs(sqrt(pow({F32.format('acc_x')}, 2) + pow({F32.format('acc_y')}, 2) + 1) - 1) AS movement, {F32.format('gyro')} AS gyro, CAST(NULL AS INT) AS spo2,
      hr % 7 AS byte16, label AS byte17, label * 2 AS byte66, hr % 5 AS byte68, label + 1 AS byte105, 9 AS byte106 FROM sensor""")


@query("d2_decode_records", sql("SELECT * FROM records", "records", DECODED))
def d2(spark, sf):
    d = packets.decode_records(fixtures.records(spark, sf))
    fields = FIELDS + [f"byte{i}" for i in packets.UNKNOWN_BYTES]
    return d.where("d_ok").select("user_id", *[F.col(f"d.{f}").alias(f) for f in fields])


@query("d3_integrity_audit", sql("""
    SELECT user_id % 2 AS layout, count(*) AS n, 1.0 AS header_rate, avg(CASE WHEN coalesce(spo2, 0) = 97 THEN 0.0 ELSE 1.0 END) AS payload_rate, 1.0 AS length_rate FROM sensor GROUP BY 1""",
    "sensor", "header_rate payload_rate length_rate"))
def d3(spark, sf):
    f = packets.packet_fields(fixtures.frames(spark, sf)).withColumn("layout", F.col("user_id") % 2)
    return packets.integrity_audit(f, ["layout"])


_CODES = "[14, 19, 22, 23, 34, 66, 141, 145, 85]"
cte("packets", "", f"""
    SELECT o_custkey % 40 AS session, o_orderkey AS ts, direction, o_orderkey % 256 AS sequence, {_CODES}[CAST(o_orderkey % 9 + 1 AS INT)] AS cmd_code
    FROM orders, (SELECT unnest(['TX', 'RX']) AS direction)""")


def log(spark, sf):
    return packets.packet_fields(fixtures.packet_log(spark, sf))


@query("d4_command_frequency", sql("""
    SELECT cmd_code, CASE cmd_code WHEN 14 THEN 'ALARM_CONFIG' WHEN 19 THEN 'CONFIGURE_SENSOR' WHEN 22 THEN 'GET_STRAP_STATUS' WHEN 23 THEN 'READ_FLASH_DATA' WHEN 34 THEN 'HISTORY_QUERY'
      WHEN 66 THEN 'HISTORY_RANGE_REQUEST' WHEN 141 THEN 'GET_DEVICE_NAME' WHEN 145 THEN 'GET_DEVICE_SERIAL' ELSE 'UNKNOWN' END AS command,
      count(CASE WHEN direction = 'TX' THEN 1 END) AS tx, count(CASE WHEN direction = 'RX' THEN 1 END) AS rx, min(sequence) AS first_sequence, max(sequence) AS last_sequence
    FROM packets GROUP BY 1, 2""", "packets"))
def d4(spark, sf):
    return packets.command_frequency(log(spark, sf))


@query("d5_pair_responses", sql("""
    SELECT coalesce(t.session, r.session) AS session, coalesce(t.sequence, r.sequence) AS sequence, request, responses, n_responses FROM (
      SELECT session, sequence, arg_max(cmd_code, ts) AS request FROM packets WHERE direction = 'TX' GROUP BY 1, 2) t
    FULL JOIN (SELECT session, sequence, array_to_string(list_sort(list_distinct(list(cmd_code))), ',') AS responses, count(*) AS n_responses FROM packets WHERE direction = 'RX' GROUP BY 1, 2) r
      ON r.session = t.session AND r.sequence = t.sequence""", "packets"))
def d5(spark, sf):
    p = packets.pair_responses(log(spark, sf), ["session"])
    return p.withColumn("responses", F.array_join(F.transform("responses", lambda c: c.cast("string")), ","))


@query("d6_field_profile", sql("""
    SELECT user_id, min(gap) AS gap_min, max(gap) AS gap_max, avg(gap) AS gap_avg, count(DISTINCT gap) AS gaps, min(hr) AS hr_min, max(hr) AS hr_max, avg(hr) AS hr_avg, min(gyro) AS gyro_min, max(gyro) AS gyro_max
    FROM (SELECT *, timestamp - lag(timestamp) OVER (PARTITION BY user_id ORDER BY timestamp) AS gap FROM records) GROUP BY 1""", "records", "gap_avg hr_avg gyro_min gyro_max"))
def d6(spark, sf):
    d = packets.decode_records(fixtures.records(spark, sf)).select("user_id", "d.*")
    return packets.field_profile(d, ["user_id"])


@query("d7_stored_fallback", sql("""
    SELECT user_id, ts AS timestamp, hr, CASE WHEN rr > 200 AND rr < 2500 THEN rr END AS rr1_ms, CASE WHEN abs(acc_x * 120) < 20 THEN acc_x * 120 ELSE 0 END AS acc_x,
           CASE WHEN abs(gyro * 1000) < 50 THEN gyro * 1000 ELSE 0 END AS gyro, spo2 FROM sensor WHERE hr > 30""", "sensor", "rr1_ms acc_x gyro"))
def d7(spark, sf):
    s = sensor(spark, sf).withColumns({"acc_x": F.col("acc_x") * 120, "gyro": F.col("gyro") * 1000})
    stored = s.where("hr > 30").select("user_id", *[c.alias(name) for name, c in tables.stored_columns().items()])
    return stored.select("user_id", "timestamp", "hr", "rr1_ms", "acc_x", "gyro", "spo2")


@query("d8_recompute_heart_rate", sql("""
    SELECT user_id, ts AS timestamp, CASE WHEN hr > 70 THEN hr WHEN rr > 200 AND rr < 2000 THEN CAST(round_even(60000.0 / rr, 0) AS INT) ELSE 0 END AS hr FROM sensor""", "sensor"))
def d8(spark, sf):
    s = sensor(spark, sf).withColumn("hr", F.when(F.col("hr") > 70, F.col("hr")).otherwise(0))
    return tables.recompute_hr(s).select("user_id", "timestamp", "hr")


@query("d9_unknown_bytes", sql("""
    SELECT name, CASE WHEN min(v) = max(v) THEN 0 ELSE round_even(corr(v, hr), 3) END AS vs_hr, CASE WHEN min(v) = max(v) THEN 0 ELSE round_even(corr(v, movement), 3) END AS vs_movement,
           min(v) AS low, max(v) AS high, round_even(avg(v), 1) AS mean
    FROM (SELECT hr, movement, unnest(['byte16', 'byte17', 'byte66', 'byte68', 'byte105', 'byte106']) AS name, unnest([byte16, byte17, byte66, byte68, byte105, byte106]) AS v FROM records) GROUP BY 1""", "records", "vs_hr vs_movement mean"))
def d9(spark, sf):
    d = packets.decode_records(fixtures.records(spark, sf)).select("user_id", "d.*")
    return packets.unknown_byte_study(d)


@query("d9_unknown_byte_minutes", sql("""
    SELECT user_id, timestamp // 60 AS minute, avg(byte16) AS byte16, avg(byte17) AS byte17, avg(byte66) AS byte66, avg(byte68) AS byte68, avg(byte105) AS byte105, avg(byte106) AS byte106
    FROM records GROUP BY 1, 2""", "records", "byte16 byte17 byte66 byte68 byte105 byte106"))
def d9_minutes(spark, sf):
    d = packets.decode_records(fixtures.records(spark, sf)).select("user_id", "d.*")
    return packets.unknown_byte_minutes(d)


# ---------------------------------------------------------------------- tables


@query("io1_sensor_scan", sql("""
    SELECT s.user_id, s.ts AS timestamp, CASE WHEN s.label IN (0, 1) THEN s.hr ELSE d.hr END AS hr, CASE WHEN s.label IN (0, 1) THEN CASE WHEN s.rr > 200 AND s.rr < 2500 THEN s.rr END ELSE d.rr1_ms END AS rr1_ms,
           CASE WHEN s.label IN (0, 1) THEN s.acc_x ELSE d.acc_x END AS acc_x, s.spo2
    FROM sensor s JOIN decoded d ON d.user_id = s.user_id AND d.timestamp = s.ts WHERE s.label > 1 OR s.hr > 30""", "decoded", "rr1_ms acc_x"))
def io1(spark, sf):
    f = fixtures.frames(spark, sf)
    hex_ = F.when(F.col("label") == 0, "").when(F.col("label") == 1, F.concat(F.lit("hr_ble:"), "frame")).otherwise(F.col("frame"))
    raw = f.withColumns({"raw_hex": hex_, "id": F.col("timestamp")})
    # every row again, later in the table and with another heart rate: the first wins
    again = raw.where("hr > 30").withColumns({"id": F.col("id") + 10**12, "hr": F.col("hr") + 1, "raw_hex": F.lit("")})
    return tables.scan(raw.unionByName(again)).select("user_id", "timestamp", "hr", "rr1_ms", "acc_x", "spo2")


@query("io2_capture_scan", sql("""
    SELECT user_id, timestamp, hr, rr_count, rr1_ms, rr2_ms, acc_x, acc_y, acc_z, movement, gyro, spo2 FROM records""", "records", DECODED))
def io2(spark, sf):
    """Each user's day is one capture; every record is captured twice, the later wins."""
    r = fixtures.records(spark, sf).withColumn("day", F.floor(F.col("timestamp") / 86400))
    bodies = r.groupBy("user_id", "day").agg(
        F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("timestamp", "record"))), lambda x: x["record"]), "")).alias("b")
    )
    text = F.base64("b")
    other = F.struct(F.struct(F.lit("https://host/other").alias("url"), F.struct(text.alias("text")).alias("_content")).alias("request"))
    entry = F.struct(F.struct(F.lit("https://host/metrics-service/v1").alias("url"), F.struct(text.alias("text")).alias("_content")).alias("request"))
    doc = F.to_json(F.struct(F.struct(F.array(other, entry).alias("entries")).alias("log")))
    first = bodies.select("user_id", doc.alias("doc"), F.lit(1).alias("seq"))
    post = F.struct(F.struct(F.lit("https://host/metrics-service/v1").alias("url"), F.struct(text.alias("text")).alias("postData")).alias("request"))
    second = bodies.select("user_id", F.to_json(F.struct(F.struct(F.array(post).alias("entries")).alias("log"))).alias("doc"), F.lit(2).alias("seq"))
    out = documents.har_records(first.unionByName(second))
    return out.drop("rr3_ms")


def docs(spark, sf):
    return fixtures.day_documents(spark, sf)


@query("io3_day_document_scores", sql("""
    SELECT user_id, date, recovery AS recovery_score, hrv AS hrv_ms, CASE WHEN has_view = 1 THEN rhr END AS rhr_bpm, resp AS resp_rate, sleep AS sleep_performance, sleep AS sleep_score,
           awake_pct AS stress_pct, efficiency AS sleep_efficiency, CAST(NULL AS DOUBLE) AS sleep_consistency, sleep AS hours_vs_needed, strain AS strain_score, CAST(kilojoule AS BIGINT) AS steps FROM daily""",
    "daily", "recovery_score hrv_ms rhr_bpm resp_rate sleep_performance sleep_score stress_pct sleep_efficiency sleep_consistency hours_vs_needed strain_score"))
def io3(spark, sf):
    return documents.day_scores(docs(spark, sf))


@query("io3_contributor_titles", sql("""
    SELECT user_id, date, recovery AS score, recovery / 100 AS fill, hrv AS hrv, CASE WHEN has_view = 1 THEN CAST(CAST(rhr AS INT) AS VARCHAR) ELSE '--' END AS rhr FROM daily""", "daily", "score fill hrv"))
def io3_titles(spark, sf):
    t = documents.contributor_titles(docs(spark, sf))
    return t.select(
        "user_id", "date", "score", "fill", F.col("contributors")["HEART RATE VARIABILITY"].cast("double").alias("hrv"),
        F.col("contributors")["RESTING HEART RATE"].alias("rhr"),
    )


def cycle_documents(spark, sf):
    o = table(spark, sf, "orders")
    start = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 24) * 3600
    state = F.when(F.col("o_orderstatus") == "P", "PENDING_SCORE").otherwise("SCORED")
    score = F.struct(
        (F.col("o_orderkey") % 211 / 10).alias("strain"), F.col("o_totalprice").alias("kilojoule"),
        (60 + F.col("o_custkey") % 20).cast("double").alias("average_heart_rate"), F.lit(150.0).alias("max_heart_rate"),
    )
    cycle = F.struct(
        F.col("o_orderkey").alias("id"), fixtures.iso(start).alias("start"), fixtures.iso(start + 86400).alias("end"),
        state.alias("score_state"), score.alias("score"),
    )
    return o.select((F.col("o_custkey") % 50).alias("user_id"), F.to_json(F.array(cycle)).alias("doc"))


_CYCLE = """
    SELECT o_custkey % 50 AS user_id, o_orderkey AS cycle_id, {} AS date, (o_orderkey % 211) / 10.0 AS strain, o_totalprice AS kilojoule, CAST(60 + o_custkey % 20 AS DOUBLE) AS avg_hr, 150.0 AS max_hr
    FROM orders WHERE o_orderstatus <> 'P'"""


@query("io4_cycles_by_end", sql(_CYCLE.format("strftime(o_orderdate + to_hours(CAST(o_orderkey % 24 + 25 AS INT)), '%Y-%m-%d')"), "", "strain kilojoule avg_hr max_hr"))
def io4(spark, sf):
    return documents.cycles(cycle_documents(spark, sf))


@query("io4_cycles_by_start", sql(_CYCLE.format("strftime(o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT)), '%Y-%m-%d')"), "", "strain kilojoule avg_hr max_hr"))
def io4_start(spark, sf):
    return documents.cycles(cycle_documents(spark, sf), "start")


cte("stage_iv", "daily", """
    SELECT user_id, date, stage, CAST(floor(s + lo * dur) AS BIGINT) AS start_ts, CAST(floor(s + hi * dur) AS BIGINT) AS end_ts FROM (
      SELECT user_id, date, s, 8 * 3600 + CAST(sleep AS BIGINT) AS dur, unnest(['awake', 'light', 'light', 'deep', 'rem']) AS stage,
             unnest([0.0E0, 0.1E0, 0.9E0, 0.2E0 + h, 0.3E0 + h]) AS lo, unnest([0.1E0, 0.2E0 + h, 1.0E0, 0.3E0 + h, 0.9E0]) AS hi
      FROM (SELECT *, recovery / 200 AS h, CAST(epoch(CAST(date AS DATE)) AS BIGINT) - 3600 AS s FROM daily))""")


@query("io5_stage_timeline", sql("SELECT * FROM stage_iv", "stage_iv"))
def io5(spark, sf):
    return documents.stage_timeline(docs(spark, sf))


@query("io5_stage_minutes", sql("""
    SELECT user_id, date, stage, count(*) AS minutes FROM (SELECT user_id, date, minute, arg_max(stage, end_ts) AS stage FROM (
      SELECT *, unnest(range(start_ts // 60, end_ts // 60 + 1)) AS minute FROM stage_iv) GROUP BY 1, 2, 3) GROUP BY 1, 2, 3""", "stage_iv"))
def io5_minutes(spark, sf):
    m = documents.expand_minutes(documents.stage_timeline(docs(spark, sf)), ["user_id", "date"])
    return m.groupBy("user_id", "date", "stage").agg(F.count(F.lit(1)).alias("minutes"))


def label_documents(spark, sf):
    """Scrubber entries of a user's calendar day: clock text and stage, some repeated."""
    rows = sensor(spark, sf).withColumn("night", F.floor((F.col("timestamp") + 3600) / 86400))
    style = F.element_at(F.array(*[F.lit(s) for s in ("AWAKE", "LIGHT_SLEEP", "SWS_SLEEP", "REM_SLEEP")]), F.col("label") + 1)
    m = local_minute(F.col("timestamp"))
    hour = F.floor(m / 60).cast("int")
    clock = F.format_string("%d:%02d %s", F.when(hour % 12 == 0, 12).otherwise(hour % 12), (m % 60).cast("int"), F.when(hour < 12, "AM").otherwise("PM"))
    entry = F.concat(F.lit('{"secondary_contextual_display": "'), clock, F.lit('","scrubber_style":"'), style, F.lit('"}'))
    rows = rows.withColumn("entry", entry)
    return rows.groupBy("user_id", "night").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("timestamp", "entry"))), lambda x: x["entry"]), ",").alias("t")
    ).select("user_id", "night", F.concat(F.lit("["), "t", F.lit(',{"secondary_contextual_display":"12:00 AM","scrubber_style":"AWAKE"}]')).alias("doc"))


@query("io6_scrubber_labels", sql("""
    SELECT user_id, night, clock, ['awake', 'light', 'deep', 'rem'][CAST(arg_min(label, ts) + 1 AS INT)] AS stage, clock + CASE WHEN clock < 720 THEN 1440 ELSE 0 END AS night_order
    FROM (SELECT user_id, (ts + 3600) // 86400 AS night, ((ts + 3600) % 86400) // 60 AS clock, label, ts FROM sensor
          UNION ALL SELECT DISTINCT user_id, (ts + 3600) // 86400, 0, 0, 99999999999 FROM sensor) GROUP BY 1, 2, 3""", "sensor"))
def io6(spark, sf):
    return documents.scrubber_labels(label_documents(spark, sf))


@query("io7_stress_timeline", sql("""
    SELECT user_id, date, minute, arg_max(v, k) AS stress FROM (
      SELECT user_id, date, (s + CAST(floor(x * dur) AS BIGINT)) // 60 AS minute, v, k FROM (
        SELECT user_id, date, s, 8 * 3600 + CAST(sleep AS BIGINT) AS dur, unnest([0.0, 0.5, 0.5]) AS x, unnest([round_even(recovery / 50, 2), round_even(strain / 10, 2), round_even(sleep / 50, 2)]) AS v, unnest([0, 2, 3]) AS k
        FROM (SELECT *, CAST(epoch(CAST(date AS DATE)) AS BIGINT) - 3600 AS s FROM daily))) GROUP BY 1, 2, 3""", "daily", "stress", digits=2), digits=2)
def io7(spark, sf):
    return documents.stress_timeline(docs(spark, sf))


def stress_documents(spark, sf):
    """Stress points in one of the three places a document may have them."""
    e = table(spark, sf, "events")
    ts = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    value = (F.col("event_id") % 100).cast("double")
    point = F.struct(ts.alias("timestamp"), value.alias("value"))
    alt = F.struct(ts.alias("time"), value.alias("stress_level"))
    graph = F.to_json(F.struct(F.struct(F.array(point).alias("data_points")).alias("stressGraph")))
    nested = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.struct(F.array(alt).alias("timeline")).alias("content"))).alias("items"))).alias("sections")))
    top = F.to_json(F.struct(F.array(point).alias("data_points")))
    kind = F.col("event_type")
    return e.select("user_id", F.when(kind == "view", graph).when(kind == "click", nested).otherwise(top).alias("doc"))


@query("io7_stress_points", sql("SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp, CAST(event_id % 100 AS DOUBLE) AS stress FROM events", "", "stress"))
def io7_points(spark, sf):
    return documents.stress_points(stress_documents(spark, sf))


def activity_texts(spark, sf):
    o = table(spark, sf, "orders")
    doc = F.struct(
        F.struct(F.concat(F.lit("Run "), "o_orderpriority").alias("title_display"), F.col("o_orderstatus").alias("subtitle_display")).alias("title_bar"),
        F.array(
            F.struct(F.lit("Duration").alias("stat_title_display"), F.lit("0:30").alias("stat_main_value_display")),
            F.struct(F.lit("Activity Strain").alias("stat_title_display"), (F.col("o_orderkey") % 21).cast("string").alias("stat_main_value_display")),
        ).alias("horizontal_stats"),
        F.struct(F.concat(F.date_format(F.add_months(F.to_date("o_orderdate"), 120), "yyyy-MM-dd"), F.lit("T06:00:00Z")).alias("at"), (F.col("o_orderkey") * 3).cast("string").alias("activity_id")).alias("meta"),
        ((F.col("o_custkey") % 130) - 10).alias("sleepEfficiencyValue"),
    )
    return o.select((F.col("o_custkey") % 500).alias("user_id"), F.col("o_orderkey").alias("doc_id"), F.to_json(doc).alias("doc"))


@query("io8_activity_documents", sql("""
    SELECT o_custkey % 500 AS user_id, o_orderkey AS doc_id, 'Run ' || o_orderpriority AS title, o_orderstatus AS subtitle, CAST(o_orderkey % 21 AS VARCHAR) AS strain, strftime(o_orderdate + INTERVAL 10 YEAR, '%Y-%m-%d') AS activity_date FROM orders"""))
def io8(spark, sf):
    return documents.activity_documents(activity_texts(spark, sf))


@query("io8_activities_by_date", sql("""
    SELECT o_custkey % 500 AS user_id, strftime(o_orderdate + INTERVAL 10 YEAR, '%Y-%m-%d') AS activity_date, count(*) AS n, sum(o_orderkey % 21) AS strain_sum FROM orders GROUP BY 1, 2""", "", "strain_sum"))
def io8_dates(spark, sf):
    a = documents.activities_by_date(activity_texts(spark, sf))
    total = F.aggregate("activities", F.lit(0.0), lambda s, x: s + x["strain"].cast("double"))
    return a.select("user_id", "activity_date", F.size("activities").alias("n"), total.alias("strain_sum"))


@query("io9_health_age", sql("SELECT c_custkey, CAST(20 + c_nationkey AS VARCHAR) AS age_value_display, 'years' AS age_subtitle_display, CAST(20 + c_nationkey AS DOUBLE) AS age, c_nationkey / 10.0 AS pace, -1.5 AS years_difference FROM customer", "", "age pace years_difference"))
def io9(spark, sf):
    c = table(spark, sf, "customer")
    age = 20 + F.col("c_nationkey")
    tile = F.struct(F.lit("AGE_TILE").alias("type"), F.struct(
        age.cast("string").alias("age_value_display"), F.lit("years").alias("age_subtitle_display"),
        F.struct(age.cast("double").alias("age"), (F.col("c_nationkey") / 10).alias("pace_of_aging"), F.lit(-1.5).alias("years_difference")).alias("style_values"),
    ).alias("content"))
    empty = F.struct(F.lit("TEXT").alias("type"), F.lit(None).cast(
        "struct<age_value_display string, age_subtitle_display string, style_values struct<age double, pace_of_aging double, years_difference double>>").alias("content"))
    doc = F.struct(F.array(F.struct(F.array(F.struct(F.struct(F.array(empty, tile).alias("items")).alias("content"))).alias("items"))).alias("sections"))
    return documents.health_age(c.select("c_custkey", F.to_json(doc).alias("doc")), "AGE_TILE")


@query("io10_stage_tiles", sql("""
    SELECT user_id, date, awake_pct, CAST(awake_pct AS INT) // 60 + (CAST(awake_pct AS INT) % 60) / 60.0 AS awake_hours, sleep AS light_pct, (sleep * 3) / 60 AS light_hours,
           rhr AS deep_pct, (rhr * 2) / 60 AS deep_hours, hrv AS rem_pct, hrv / 60 AS rem_hours FROM daily""", "daily",
    "awake_pct awake_hours light_pct light_hours deep_pct deep_hours rem_pct rem_hours"))
def io10(spark, sf):
    return documents.stage_tiles(docs(spark, sf))


@query("io11_find_ids", sql("SELECT o_custkey % 500 AS user_id, o_orderkey AS doc_id, CAST(o_orderkey * 3 AS VARCHAR) AS activity_id FROM orders"))
def io11(spark, sf):
    return documents.find_ids(activity_texts(spark, sf))


@query("io11_find_efficiency", sql("""
    SELECT o_custkey % 500 AS user_id, o_orderkey AS doc_id, CASE WHEN o_custkey % 130 - 10 BETWEEN 1 AND 100 THEN CAST(o_custkey % 130 - 10 AS DOUBLE) END AS efficiency FROM orders""", "", "efficiency"))
def io11_efficiency(spark, sf):
    return documents.find_efficiency(activity_texts(spark, sf))


def _hm(c):
    return f"CAST(CAST(floor({c}) AS INT) // 60 AS VARCHAR) || ':' || lpad(CAST(CAST(floor({c}) AS INT) % 60 AS VARCHAR), 2, '0')"


@query("io12_official_fields", sql(f"""
    SELECT user_id, date, {_hm('sleep_hours * 60')} AS hours_of_sleep, {_hm('sleep')} AS restorative_sleep, {_hm('sleep * 5')} AS time_in_bed, CAST(CAST(sleep AS INT) AS VARCHAR) || '%' AS pct_of_need,
      '7:30' AS healthy_min, {_hm('strain')} AS recent_strain_need, '62%' AS consistency, CAST(CAST(efficiency AS INT) AS VARCHAR) || '%' AS efficiency, CAST(n_events AS VARCHAR) AS wake_events,
      CAST(CAST(awake_pct AS INT) AS VARCHAR) || '%' AS sleep_stress_pct, CAST(CAST(hrv AS INT) AS VARCHAR) AS hrv, CASE WHEN has_view = 1 THEN CAST(CAST(rhr AS INT) AS VARCHAR) ELSE '--' END AS rhr,
      CAST(CAST(resp AS INT) AS VARCHAR) AS respiratory_rate FROM daily""", "daily"))
def io12(spark, sf):
    return documents.official_fields(docs(spark, sf))


@query("io12_field_coverage", sql("""
    SELECT unnest(['hours_of_sleep', 'restorative_sleep', 'time_in_bed', 'pct_of_need', 'healthy_min', 'recent_strain_need', 'consistency', 'efficiency', 'wake_events', 'sleep_stress_pct', 'hrv', 'rhr', 'respiratory_rate']) AS field,
           (SELECT count(*) FROM daily) AS n""", "daily"))
def io12_coverage(spark, sf):
    return documents.field_coverage(documents.official_fields(docs(spark, sf)))


@query("io1_capture_table", sql("SELECT user_id, date, count(*) AS n, CAST(sum(hr) AS BIGINT) AS hr, max(ts) AS last_ts FROM day GROUP BY 1, 2", "day"))
def io1_table(spark, sf):
    path = work_folder(spark, "capture")
    tables.write_partitioned(day_rows(spark, sf).select("user_id", "date", "timestamp", "hr"), path)
    return tables.read_table(spark, path).groupBy("user_id", "date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("hr").alias("hr"), F.max("timestamp").alias("last_ts")
    )


@query("io13_csv_sink", sql("SELECT user_id, count(*) AS n, sum(hr) AS heart_rate, count(spo2) AS n_spo2, sum(gyro) AS gyro FROM sensor GROUP BY 1", "sensor", "gyro"))
def io13(spark, sf):
    path = work_folder(spark, "csv")
    rows = sensor(spark, sf)
    tables.write_csv(tables.export_frame(rows, ["user_id"]), path)
    back = spark.read.csv(path, header=True, schema="user_id long, timestamp long, heart_rate int, rr1 double, rr2 double, "
                          "rr3 double, spo2 int, accel_x double, accel_y double, accel_z double, gyro double")
    return back.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("heart_rate").alias("heart_rate"), F.count("spo2").alias("n_spo2"), F.sum("gyro").alias("gyro")
    )


@query("io14_json_sink", sql("SELECT user_id, date, recovery, official_recovery FROM (SELECT d.user_id, d.date, d.recovery, o.recovery AS official_recovery FROM daily d LEFT JOIN official o ON o.user_id = d.user_id AND o.date = d.date)", "official", "recovery official_recovery"))
def io14(spark, sf):
    from catalog.daily_queries import pairs

    path = work_folder(spark, "json")
    tables.write_json(pairs(spark, sf, "left").select("user_id", "date", "recovery", "official_recovery"), path)
    return spark.read.schema("user_id long, date string, recovery double, official_recovery double").json(path)


@query("io15_merge_sources", sql("""
    SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.ts, b.ts) AS timestamp, coalesce(a.hr, b.hr + 1) AS hr, CASE WHEN a.ts IS NOT NULL THEN 0 ELSE 1 END AS source
    FROM (SELECT * FROM sensor WHERE label = 2) a FULL JOIN (SELECT * FROM sensor WHERE hr > 60) b ON b.user_id = a.user_id AND b.ts = a.ts""", "sensor"))
def io15(spark, sf):
    s = sensor(spark, sf).select("user_id", "timestamp", "hr", "label")
    cache = s.where("label = 2").drop("label")
    own = s.where("hr > 60").select("user_id", "timestamp", (F.col("hr") + 1).alias("hr"))
    return tables.merge_sources([cache, own])


@query("io16_page", sql("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 250", "", "o_totalprice"))
def io16(spark, sf):
    return tables.page(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 100, 250)


@query("io18_stage_segments", sql("""
    SELECT user_id, date, stage, least(lo, hi) AS start_x, greatest(lo, hi) AS end_x FROM (
      SELECT user_id, date, unnest(['rem', 'deep', 'deep']) AS stage, unnest([h, 0.75E0, 0.8E0]) AS lo, unnest([h + 0.1E0, h * 0.5E0, 0.9E0]) AS hi FROM (SELECT *, recovery / 200 AS h FROM daily))""", "daily", "start_x end_x"))
def io18(spark, sf):
    return documents.stage_segments(docs(spark, sf))


@query("io18_stage_metrics", sql("""
    SELECT user_id, date, CAST(CAST(sleep AS INT) % 3 AS VARCHAR) || ':30' AS rem, CAST(NULL AS VARCHAR) AS deep, CAST(NULL AS VARCHAR) AS light, CAST(CAST(sleep AS INT) % 2 AS VARCHAR) || ':05' AS awake,
           CAST(n_events AS VARCHAR) AS disturbances, CAST(NULL AS VARCHAR) AS time_in_bed FROM daily""", "daily"))
def io18_metrics(spark, sf):
    return documents.stage_metrics(docs(spark, sf))


def workout_documents(spark, sf):
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    start = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + (k % 20) * 1800
    kind = k % 3
    doc = F.struct(
        k.cast("string").alias("id"), (c % 60).cast("int").alias("sport_id"), fixtures.iso(start).alias("start"), fixtures.iso(start + 1800 + k % 600).alias("end"),
        F.when(kind == 0, (k % 5000) * 1000.0).alias("duration_ms"), F.when(kind == 1, (k % 4000).cast("double")).alias("duration_s"),
        F.struct((k % 211 / 10).alias("strain"), (90 + c % 40).cast("int").alias("average_heart_rate"), F.lit(170).alias("max_heart_rate"),
                 (k % 3000).cast("double").alias("kilojoule"), (k % 9000).cast("double").alias("distance_meter")).alias("score"),
    )
    return o.select(F.to_json(doc).alias("doc"))


_SPORTS = ", ".join("({}, '{}')".format(k, v.replace("'", "''")) for k, v in SPORTS.items())


@query("io19_workouts", sql("""
    SELECT sport_id, coalesce(sport_name, 'Activity') AS name, count(*) AS n, sum(strain) AS strain,
           sum(kcal) AS kcal, sum(duration_s) AS duration_s, sum(distance) AS distance_km, min(start_ts) AS first_ts FROM (
      SELECT o_custkey % 60 AS sport_id, (o_orderkey % 211) / 10.0 AS strain, round((o_orderkey % 3000) / 4.184) AS kcal, (o_orderkey % 9000) / 1000.0 AS distance,
             CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 5000 WHEN 1 THEN o_orderkey % 4000 ELSE 1800 + o_orderkey % 600 END AS duration_s, CAST(epoch(o_orderdate) AS BIGINT) + (o_orderkey % 20) * 1800 AS start_ts FROM orders)
    LEFT JOIN sports USING (sport_id) GROUP BY 1, 2""", "", "strain kcal duration_s distance_km", extra=f"sports(sport_id, sport_name) AS (VALUES {_SPORTS})"))
def io19(spark, sf):
    w = documents.workouts(workout_documents(spark, sf))
    return w.groupBy("sport_id", "name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("strain").alias("strain"), F.sum("kcal").alias("kcal"), F.sum("duration_s").alias("duration_s"),
        F.sum("distance_km").alias("distance_km"), F.min("start_ts").alias("first_ts"),
    )

