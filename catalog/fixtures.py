"""Binary frames and JSON documents that Spark derives from the given tables.

They feed the ingest queries: each document is built from a table row with
expressions only, so the oracles can compare with the table itself.
"""

from pyspark.sql import functions as F

from nocturne.functions.binary import crc16_modbus
from nocturne.session import cut_lineage
from nocturne.sources.adapters import daily_scores, sensor


_WRITTEN = {}


def written(build):
    """The built table as files in the shared folder, written once per application."""

    def source(spark, sf):
        key = (spark.sparkContext.applicationId, sf, build.__name__)
        if key not in _WRITTEN:
            _WRITTEN[key] = cut_lineage(build(spark, sf), build.__name__)
        return _WRITTEN[key]

    return source


def spread(rows):
    """Table rows over all cores, before they grow to documents: the documents themselves are never shuffled or sorted."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def packed(*fields):
    """Hex digits of numbers, each with its little-endian bytes (``(column, bytes)``), seven bytes at most.

    The digits of all of them come from one number with a one before its first byte.
    """
    size = sum(n for _, n in fields)
    number, at = F.lit(1 << 8 * size), size
    for c, n in fields:
        for i in range(n):
            at -= 1
            v, left = c.cast("long"), 8 * (at - i)
            v = F.shiftleft(v, left) if left > 0 else F.shiftright(v, -left) if left < 0 else v
            number = number.bitwiseOR(v.bitwiseAND(F.lit(255 << 8 * at)))
    return F.substring(F.hex(number), 2, 2 * size)


def le(c, n):
    return packed((c, n))


def u8(c):
    return le(c, 1)


def float32(c):
    """Big-endian single precision of a double, rounded to nearest."""
    a = F.abs(c)
    e = F.floor(F.log2(F.when(a > 0, a).otherwise(1.0)))
    # a mantissa step has at least 29 bits after the point, so adding a half is exact
    m = ((a / F.pow(F.lit(2.0), e.cast("double")) - 1) * 8388608 + 0.5).cast("long")
    bits = F.when(c < 0, 3 << 31).otherwise(1 << 32) + F.shiftleft((e + 127).cast("long"), 23) + m
    return F.when(a > 0, F.substring(F.hex(bits), 2, 8)).otherwise("00000000")


def zeros(n):
    return F.lit("00" * n)


@written
def frames(spark, sf):
    """Sensor rows with a frame: short for even users, long for odd ones."""
    s = sensor(spark, sf)
    rr1 = F.coalesce(F.floor("rr1_ms"), F.lit(0)).cast("long")
    rr2 = F.coalesce(F.floor("rr2_ms"), F.lit(0)).cast("long")
    spo2 = F.coalesce(F.col("spo2") - 10, F.lit(0))
    count = F.when(rr2 > 0, 2).when(rr1 > 0, 1).otherwise(0)
    # as an array function this step stays out of whole-stage code, whose one method would be too long to be compiled
    s = s.withColumn("floats", F.transform(F.array("gyro", "acc_x", "acc_y", "acc_z"), float32))
    floats = F.concat(*[F.get("floats", F.lit(i)) for i in range(4)])
    head = F.concat(F.lit("2F"), zeros(6), le(F.col("timestamp"), 4), zeros(3), u8(spo2))
    short = F.col("user_id") % 2 == 0
    by_layout = lambda a, b: F.when(short, a).otherwise(b)
    middle = by_layout(F.concat(zeros(4), u8(F.col("hr"))), F.lit("")), packed((count, 1), (rr1, 2), (rr2, 2)), by_layout(zeros(11), zeros(16))
    s = s.withColumn("payload", F.concat(head, *middle, floats, by_layout(zeros(24), zeros(60))))
    header = F.concat(F.lit("AA01"), le(F.octet_length("payload") / 2 + 4, 2), F.lit("0100"))
    # rows with an oxygen value of 97 carry a damaged checksum
    damaged = F.when(F.col("spo2") == 97, 1).otherwise(0)
    s = s.withColumns({"header": header, "crc": (F.crc32(F.unhex("payload")) + damaged).bitwiseAND(F.lit(0xFFFFFFFF))})
    s = s.withColumn("header_crc", crc16_modbus(F.col("header"), 6))
    return s.withColumn("frame", F.concat("header", le(F.col("header_crc"), 2), "payload", le(F.col("crc"), 4))).drop("floats", "payload", "header", "crc", "header_crc")


@written
def records(spark, sf):
    """Sensor rows as 124-byte records; the z value keeps the oxygen byte."""
    s = sensor(spark, sf)
    rr1 = F.coalesce(F.floor("rr1_ms"), F.lit(0)).cast("long")
    rr2 = F.coalesce(F.floor("rr2_ms"), F.lit(0)).cast("long")
    count = F.when(rr2 > 0, 2).when(rr1 > 0, 1).otherwise(0)
    body = F.concat(
        zeros(12), le(F.col("timestamp"), 4), u8(F.col("hr") % 7), u8(F.col("label")), zeros(1), u8(F.col("hr")), u8(count),
        le(rr1, 2), le(rr2, 2), zeros(4), float32(F.col("gyro")), zeros(12),
        float32(F.col("acc_x")), float32(F.col("acc_y")), float32(F.col("acc_z")), zeros(9),
        u8(F.col("label") * 2), zeros(1), u8(F.col("hr") % 5), zeros(36), u8(F.col("label") + 1), u8(F.lit(9)), zeros(9),
    )
    return s.withColumn("record", F.concat(F.lit("AA0174"), body, zeros(5)))


@written
def packet_log(spark, sf):
    """A command log from orders: one request and two responses per order."""
    o = spread(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey"))
    codes = F.array(*[F.lit(c) for c in (0x0E, 0x13, 0x16, 0x17, 0x22, 0x42, 0x8D, 0x91, 0x55)])
    code = F.element_at(codes, (F.col("o_orderkey") % 9 + 1).cast("int"))
    rows = o.select(
        (F.col("o_custkey") % 40).alias("session"), F.col("o_orderkey").alias("ts"), code.alias("code"),
        F.explode(F.array(F.lit("TX"), F.lit("RX"))).alias("direction"),
    )
    sent = F.col("direction") == "TX"
    payload = F.concat(
        F.when(sent, "23").otherwise("24"), u8(F.col("ts") % 256), u8(F.col("code")), le(F.col("ts"), 4)
    )
    header = F.concat(F.lit("AA01"), le(F.lit(11), 2), F.when(sent, "0001").otherwise("0100"))
    rows = rows.withColumns({"payload": payload, "header": header})
    return rows.select(
        "session", "ts", "direction",
        F.concat("header", le(crc16_modbus(F.col("header"), 6), 2), "payload", le(F.crc32(F.unhex("payload")), 4)).alias("frame"),
    )


def _struct(**fields):
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _text(c):
    return F.regexp_replace(F.bround(c, 2).cast("string"), r"\.0$", "")


def night_bounds(d):
    """Night of a day: 23:00 to 07:00 and as many seconds as the sleep score."""
    start = F.unix_seconds(F.col("date").cast("timestamp")) - 3600
    return start, start + 8 * 3600 + F.col("sleep").cast("long")


def iso(ts):
    return F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


@written
def day_documents(spark, sf):
    """A day document per row of ``daily_scores``."""
    d = spread(daily_scores(spark, sf))
    metric = lambda i, t, s: _struct(id=F.lit(i), title=F.lit(t), status=s)
    gauge = lambda i, v: _struct(type=F.lit("SCORE_GAUGE"), content=_struct(
        id=F.lit(i), score_display=_text(v), gauge_fill_percentage=v / 100, metrics=F.lit(None).cast("array<struct<id string, title string, status string>>")))
    tiles = lambda *m: _struct(type=F.lit("CONTRIBUTORS_TILE"), content=_struct(
        id=F.lit("TILE"), score_display=F.lit(None).cast("string"), gauge_fill_percentage=F.lit(None).cast("double"), metrics=F.array(*m)))
    part = lambda *items: _struct(sections=F.array(_struct(id=F.lit("s"), items=F.array(*items))))
    recovery = part(gauge("RECOVERY_SCORE_GAUGE", F.col("recovery")), tiles(
        metric("CONTRIBUTOR_HRV", "Heart Rate Variability", _text(F.col("hrv"))),
        metric("CONTRIBUTOR_RHR", "Resting Heart Rate", F.when(F.col("has_view") == 1, _text(F.col("rhr"))).otherwise("--")),
        metric("CONTRIBUTOR_RESPIRATORY_RATE", "Respiratory Rate", _text(F.col("resp"))),
        metric("CONTRIBUTOR_SLEEP_PERFORMANCE", "Sleep Performance", F.concat(_text(F.col("sleep")), F.lit("%")))))
    sleep = part(gauge("SLEEP_SCORE_GAUGE", F.col("sleep")), tiles(
        metric("SLEEP_STRESS", "High Sleep Stress", F.concat(_text(F.col("awake_pct")), F.lit("%"))),
        metric("SLEEP_EFFICIENCY", "Sleep Efficiency", F.concat(_text(F.col("efficiency")), F.lit("%"))),
        metric("REM", "REM sleep", F.concat((F.col("sleep") % 3).cast("int"), F.lit(":30"))),
        metric("AWAKE", "Awake time", F.concat((F.col("sleep") % 2).cast("int"), F.lit(":05"))),
        metric("DIST", "Disturbances", F.col("n_events").cast("string")),
        metric("HOURS_VS_NEEDED", "Hours vs Needed", F.concat(_text(F.col("sleep")), F.lit("%")))))
    strain = part(gauge("STRAIN_SCORE_GAUGE", F.col("strain")), tiles(
        metric("STEPS", "Steps", F.format_number(F.col("kilojoule"), 0))))
    start, end = night_bounds(d)
    share = F.col("recovery") / 200
    rng = lambda a, b: _struct(lower_endpoint=a, upper_endpoint=b)
    zone = lambda i, pct, t, *r: _struct(
        id=F.lit(i), bar_graph_tile_percentage_display=F.concat(pct.cast("int"), F.lit("%")), bar_graph_tile_time_display=t,
        bar_graph=_struct(time_bound_ranges=F.array(*r)))
    hm = lambda c: F.concat(F.floor(c / 60).cast("int"), F.lit(":"), F.lpad((c % 60).cast("int").cast("string"), 2, "0"))
    zones = F.array(
        zone("AWAKE", F.col("awake_pct"), hm(F.col("awake_pct")), rng(F.lit(0.0), F.lit(0.1))),
        zone("LIGHT_SLEEP", F.col("sleep"), hm(F.col("sleep") * 3), rng(F.lit(0.1), F.lit(0.2) + share), rng(F.lit(0.9), F.lit(1.0))),
        zone("SWS_SLEEP", F.col("rhr"), hm(F.col("rhr") * 2), rng(F.lit(0.2) + share, F.lit(0.3) + share)),
        zone("REM_SLEEP", F.col("hrv"), hm(F.col("hrv")), rng(F.lit(0.3) + share, F.lit(0.9))),
    )
    stat = lambda c: F.array(_struct(current_stat_text=c))
    no = lambda t: F.lit(None).cast(t)
    point = lambda x, v: _struct(position_x=x, data_scrubber_details=_struct(value_display=v))
    plot = lambda style, *segs: _struct(plot=_struct(style=F.lit(style), segments=F.array(*[_struct(points=F.array(*s)) for s in segs])))
    blank = F.lit("1")
    chart = F.array(
        plot("HR_LINE", [point(F.lit(0.0), blank), point(F.lit(1.0), blank)]),
        plot("STYLE_REM", [point(share, blank), point(share + 0.1, blank), point(share + 0.05, blank)]),
        plot("STYLE_SWS", [point(F.lit(0.75), blank), point(share * 0.5, blank)], [point(F.lit(0.8), blank), point(F.lit(0.9), blank)]),
    )
    stress_plot = F.array(plot("STRESS", [
        point(F.lit(0.0), _text(F.col("recovery") / 50)), point(F.lit(0.25), F.lit("--")), point(F.lit(0.5), _text(F.col("strain") / 10)),
        point(F.lit(0.5), _text(F.col("sleep") / 50))]))
    zones_t = "array<struct<id string, bar_graph_tile_percentage_display string, bar_graph_tile_time_display string, bar_graph struct<time_bound_ranges array<struct<lower_endpoint double, upper_endpoint double>>>>>"
    plots_t = "array<struct<plot struct<style string, segments array<struct<points array<struct<position_x double, data_scrubber_details struct<value_display string>>>>>>>>"

    def card(title=None, stat_text=None, duration=None, legend=None, zones=None, plots=None):
        return _struct(content=_struct(
            title=F.lit(title).cast("string"), arrow_stat=stat(stat_text) if stat_text is not None else no("array<struct<current_stat_text string>>"),
            duration_display=duration if duration is not None else no("string"),
            legend_entries=legend if legend is not None else no("array<struct<style string, stat_display string>>"),
            heart_rate_zones=(zones if zones is not None else no(zones_t)).cast(zones_t),
            plots=(plots if plots is not None else no(plots_t)).cast(plots_t)))

    def section(name, text, *cards):
        return _struct(id=F.lit(name), items=F.array(_struct(type=F.lit("CARD"), content=_struct(
            id=F.lit(name), arrow_stat=stat(text), card_content=F.array(*cards)))))

    legend = F.array(
        _struct(style=F.lit("HEALTHY_MIN"), stat_display=F.lit("7:30")), _struct(style=F.lit("RECENT_STRAIN"), stat_display=hm(F.col("strain"))))
    last_night = _struct(
        header_section=_struct(destination=_struct(parameters=_struct(start_time=iso(start), end_time=iso(end)))),
        sections=F.array(
            section("hours_of_sleep", hm(F.col("sleep_hours") * 60), card("RESTORATIVE SLEEP", hm(F.col("sleep"))),
                    card(duration=hm(F.col("sleep") * 5), plots=chart), card(zones=zones)),
            section("hours_vs_needed", F.concat(_text(F.col("sleep")), F.lit("%")), card(legend=legend)),
            section("sleep_consistency", F.lit("62%"), card("NONE")),
            section("sleep_efficiency", F.concat(_text(F.col("efficiency")), F.lit("%")), card("WAKE EVENTS", F.col("n_events").cast("string"))),
            section("sleep_stress", F.concat(_text(F.col("awake_pct")), F.lit("%")), card(plots=stress_plot)),
        ))
    doc = F.to_json(_struct(recovery=recovery, sleep=sleep, strain=strain, last_night=last_night))
    return d.select("user_id", "date", doc.alias("doc"))
