"""Binary packets as column jobs.

Frames are hex text: header of 8 bytes (start, revision, length LE, two routing
bytes, CRC-16 LE), payload, CRC-32 LE. All decoding is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nocturne.functions.binary import byte_hex, crc16_modbus, crc32, float32_bits, float32_value, u8, uint_le
from nocturne.functions.scalars import movement, pearson, valid_rr
from nocturne.schema import COMMAND_NAMES

RECORD_BYTES = 124
HEADER = 8
UNKNOWN_BYTES = [16, 17, 66, 68, 105, 106]


def _spo2(raw: Column) -> Column:
    return F.when((raw > 0) & (raw < 100), raw + 10)


def decode_frames(df: DataFrame, frame: str = "frame", first: int = 1_600_000_000,
                  last: int = 2_100_000_000) -> DataFrame:
    """Adds the struct ``d`` of a sensor frame and ``d_ok``, whether the text is one.

    Short frames (payload up to 80 bytes) store the heart rate; long ones only beat
    intervals. Floats that are not finite or above 100 set all four to zero.
    """
    # named steps, so that every field is computed once
    at = lambda i: HEADER + i
    h = F.col(frame).cast("binary")
    c = F.col
    v = df.withColumn("_size", F.floor(F.octet_length(h) / 2) - 12).withColumn("_short", c("_size") <= 80)
    # count and two intervals follow each other in both layouts
    beats = F.substring(h, F.when(c("_short"), at(20) * 2 + 1).otherwise(at(15) * 2 + 1), F.lit(10))
    v = v.withColumn("_beats", beats).withColumns(
        {
            "_ts": uint_le(h, at(7), 4), "_spo2": u8(h, at(14)), "_hr_s": u8(h, at(19)),
            "_count": u8(c("_beats"), 0), "_rr1_all": uint_le(c("_beats"), 1, 2), "_rr2_all": uint_le(c("_beats"), 3, 2),
            # an array function keeps this step out of whole-stage code, whose one method would be too long to be compiled
            "_floats": F.transform(F.array(*[float32_bits(h, at(p)) for p in (36, 40, 44, 48)]), float32_value),
        }
    )
    sane = F.lit(True)
    for i in range(4):
        sane = sane & F.coalesce(F.abs(F.get("_floats", F.lit(i))) <= 100, F.lit(False))
    v = v.withColumn("_sane", sane)
    short = c("_short")
    v = v.withColumns(
        {
            **{f"_f{i}": F.when(c("_sane"), F.get("_floats", F.lit(i))).otherwise(0.0) for i in range(4)},
            "_rr1": F.when(short | (c("_count") >= 1), c("_rr1_all")).otherwise(0),
            "_rr2": F.when(short | (c("_count") >= 2), c("_rr2_all")).otherwise(0),
        }
    )
    from_beat = F.when((c("_rr1") > 200) & (c("_rr1") < 2000), F.floor(60000 / c("_rr1"))).otherwise(0)
    record = F.struct(
        c("_ts").alias("timestamp"),
        F.when(short, c("_hr_s")).otherwise(from_beat).cast("int").alias("hr"),
        c("_count").alias("rr_count"),
        valid_rr(c("_rr1").cast("double")).alias("rr1_ms"), valid_rr(c("_rr2").cast("double")).alias("rr2_ms"),
        F.lit(None).cast("double").alias("rr3_ms"),
        c("_f1").alias("acc_x"), c("_f2").alias("acc_y"), c("_f3").alias("acc_z"),
        movement(c("_f1"), c("_f2"), c("_f3")).alias("movement"), c("_f0").alias("gyro"), _spo2(c("_spo2")).alias("spo2"),
    )
    ok = (
        h.isNotNull() & (c("_size") >= 52) & F.startswith(F.col(frame), F.lit("AA01")) & byte_hex(h, HEADER).isin("2F", "2f")
        # between first and last, with the time named once: a filter is evaluated below these steps
        & (F.abs(c("_ts") * 2 - (first + last)) <= last - first)
    )
    return v.withColumns({"d_ok": F.coalesce(ok, F.lit(False)), "d": record}).select(*df.columns, "d_ok", "d")


def decode_records(df: DataFrame, record: str = "record", first: int = 1_000_000_000) -> DataFrame:
    """Adds the struct ``d`` of a 124-byte record (payload from byte 3) and ``d_ok``.

    The oxygen byte lies inside the last acceleration value; ``spo2_suspect`` says so.
    """
    h = F.col(record)
    c = F.col
    p = lambda i: 3 + i
    v = df.withColumns(
        {
            "_ts": uint_le(h, p(12), 4), "_count": u8(h, p(20)), "_hr": u8(h, p(19)), "_spo2": u8(h, p(55)),
            **{f"_rr{k}": uint_le(h, p(21 + 2 * k), 2).cast("double") for k in range(3)},
            **{f"_b{i}": float32_bits(h, p(q)) for i, q in enumerate((29, 45, 49, 53))},
            **{f"byte{i}": u8(h, p(i)) for i in UNKNOWN_BYTES},
        }
    )
    v = v.withColumns({f"_f{i}": float32_value(c(f"_b{i}")) for i in range(4)})
    beats = F.filter(
        F.array(*[F.when(c("_count") >= k + 1, c(f"_rr{k}")) for k in range(3)]), lambda b: (b > 200) & (b < 2500)
    )
    finite = c("_f1").isNotNull() & c("_f2").isNotNull() & c("_f3").isNotNull()
    v = v.withColumns({"_beats": beats, "_finite": finite})
    v = v.withColumns({f"_f{i}": F.when(c("_finite"), c(f"_f{i}")).otherwise(0.0) for i in (1, 2, 3)})
    out = F.struct(
        c("_ts").alias("timestamp"), c("_hr").alias("hr"), c("_count").alias("rr_count"),
        *[F.get(c("_beats"), F.lit(k)).alias(f"rr{k + 1}_ms") for k in range(3)],
        c("_f1").alias("acc_x"), c("_f2").alias("acc_y"), c("_f3").alias("acc_z"),
        F.when(c("_finite"), movement(c("_f1"), c("_f2"), c("_f3"))).otherwise(0.0).alias("movement"),
        F.when(F.abs(c("_f0")) <= 100, c("_f0")).otherwise(0.0).alias("gyro"),
        _spo2(c("_spo2")).alias("spo2"), F.lit(True).alias("spo2_suspect"),
        *[c(f"byte{i}") for i in UNKNOWN_BYTES],
    )
    ok = h.isNotNull() & (F.length(h) >= RECORD_BYTES * 2) & (c("_ts") > first)
    return v.withColumns({"d_ok": F.coalesce(ok, F.lit(False)), "d": out}).select(*df.columns, "d_ok", "d")


def split_records(df: DataFrame, body: str = "body") -> DataFrame:
    """One row per 124-byte record of a binary body; ``at`` is its number."""
    n = F.floor(F.octet_length(body) / RECORD_BYTES).cast("int")
    return df.withColumn("_n", n).where("_n > 0").withColumn(
        "at", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    ).withColumn(
        "record", F.hex(F.substring(F.col(body), F.col("at") * RECORD_BYTES + 1, F.lit(RECORD_BYTES)))
    ).drop("_n", body)


def packet_fields(df: DataFrame, frame: str = "frame") -> DataFrame:
    """Header and command fields of a packet log with its checks."""
    v = df.withColumn("_h", F.upper(F.col(frame)).cast("binary"))
    h, size = F.col("_h"), F.col("size")
    tail = F.concat(*[F.substring(h, size * 2 - 2 * i - 1, F.lit(2)).cast("string") for i in range(4)])
    return v.withColumn("size", F.floor(F.octet_length(h) / 2).cast("int")).where("size >= 12").withColumns(
        {
            "cmd_type": u8(h, 8), "sequence": u8(h, 9), "cmd_code": u8(h, 10),
            "header_ok": (crc16_modbus(h, 6) == uint_le(h, 6, 2)).cast("int"),
            "payload_ok": (crc32(h, 8, size - 12) == F.conv(tail, 16, 10).cast("long")).cast("int"),
            "length_ok": (uint_le(h, 2, 2) == size - 8).cast("int"),
        }
    ).drop("_h")


def integrity_audit(packets: DataFrame, by: list[str]) -> DataFrame:
    return packets.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("header_ok").alias("header_rate"),
        F.avg("payload_ok").alias("payload_rate"), F.avg("length_ok").alias("length_rate"),
    )


def command_name(code: Column) -> Column:
    out = F.lit("UNKNOWN")
    for k, name in COMMAND_NAMES.items():
        out = F.when(code == k, name).otherwise(out)
    return out


def command_frequency(packets: DataFrame) -> DataFrame:
    """Packets per command code and direction with their sequence range."""
    sent, received = F.col("direction") == "TX", F.col("direction") == "RX"
    return packets.groupBy("cmd_code", command_name(F.col("cmd_code")).alias("command")).agg(
        F.sum(sent.cast("int")).alias("tx"), F.sum(received.cast("int")).alias("rx"),
        F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"),
    )


def pair_responses(packets: DataFrame, keys: list[str]) -> DataFrame:
    """Last request and all response codes of each sequence number of a session.

    Sequence numbers have one byte, so a session's responses are grouped per number
    and code first and the listed codes are at most 256.
    """
    sent = packets.where("direction = 'TX'").groupBy(*keys, "sequence").agg(
        F.max_by("cmd_code", "ts").alias("request")
    )
    received = packets.where("direction = 'RX'").groupBy(*keys, "sequence", "cmd_code").agg(
        F.count(F.lit(1)).alias("n")
    ).groupBy(*keys, "sequence").agg(
        F.sort_array(F.collect_list("cmd_code")).alias("responses"), F.sum("n").alias("n_responses")
    )
    return sent.join(received, [*keys, "sequence"], "full")


def field_profile(records: DataFrame, keys: list[str]) -> DataFrame:
    """Timestamp gaps and field ranges of decoded records per key.

    Gaps are taken inside each day; the gap across midnight comes from the days' first and last
    records, so no task sorts a whole key.
    """
    v = records.withColumn("_day", F.floor(F.col("timestamp") / 86400))
    inside = v.withColumn("gap", F.col("timestamp") - F.lag("timestamp").over(W.partitionBy(*keys, "_day").orderBy("timestamp")))
    days = v.groupBy(*keys, "_day").agg(F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last"))
    across = days.select(*keys, (F.col("_first") - F.lag("_last").over(W.partitionBy(*keys).orderBy("_day"))).alias("gap"))
    both = inside.select(*keys, "gap", "hr", "gyro").unionByName(across, allowMissingColumns=True)
    plausible = F.when((F.col("gyro") > -100) & (F.col("gyro") < 100), F.col("gyro"))
    return both.groupBy(*keys).agg(
        F.min("gap").alias("gap_min"), F.max("gap").alias("gap_max"), F.avg("gap").alias("gap_avg"),
        F.count_distinct("gap").alias("gaps"), F.min("hr").alias("hr_min"), F.max("hr").alias("hr_max"),
        F.avg("hr").alias("hr_avg"), F.min(plausible).alias("gyro_min"), F.max(plausible).alias("gyro_max"),
    )


def unknown_byte_study(records: DataFrame) -> DataFrame:
    """Correlation of every unknown byte with heart rate and movement, with its range."""
    long = records.select(
        "hr", "movement",
        F.explode(F.array(*[
            F.struct(F.lit(f"byte{i}").alias("name"), F.col(f"byte{i}").alias("value")) for i in UNKNOWN_BYTES
        ])).alias("b"),
    ).select("hr", "movement", "b.*")

    def r(c: str) -> Column:
        flat = (F.min("value") == F.max("value")) | (F.min(c) == F.max(c))
        return F.when((F.count(F.lit(1)) < 10) | flat, 0.0).otherwise(F.bround(pearson(F.col("value"), F.col(c)), 3))

    return long.groupBy("name").agg(
        r("hr").alias("vs_hr"), r("movement").alias("vs_movement"), F.min("value").alias("low"),
        F.max("value").alias("high"), F.bround(F.avg("value"), 1).alias("mean"),
    )


def unknown_byte_minutes(records: DataFrame, keys: list[str] = ["user_id"]) -> DataFrame:
    """One-minute means of the unknown bytes."""
    minute = F.floor(F.col("timestamp") / 60).alias("minute")
    return records.groupBy(*keys, minute).agg(*[F.avg(f"byte{i}").alias(f"byte{i}") for i in UNKNOWN_BYTES])
