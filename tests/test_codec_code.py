"""Frames are coded in methods that the JVM compiles (8000 bytes of code at most), and mean what they meant."""

import random
import re
import struct

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from catalog import fixtures
from nocturne.functions import binary
from nocturne.operators.trends import keep_one
from nocturne.sources import packets
from nocturne.sources import sensor as tables

from test_scale import SF, plan


def longest_method(df):
    debug = df.sparkSession._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$")
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(df._jdf.queryExecution().executedPlan()))), default=0)


def crc16(data):
    crc = 0xFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ 0xA001 if crc & 1 else crc >> 1
    return crc


@pytest.fixture
def without_adaptive(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("name", ["d1_decode_frames", "io1_sensor_scan"])
def test_decoding_is_compiled(spark, without_adaptive, name):
    assert longest_method(entry.queries()[name](spark, SF)) < 8000


def test_building_frames_is_compiled(spark, without_adaptive, monkeypatch):
    built = []
    monkeypatch.setattr(fixtures, "_WRITTEN", {})
    monkeypatch.setattr(fixtures, "cut_lineage", lambda df, name: built.append(df) or df)
    fixtures.frames(spark, SF)
    assert longest_method(built[0]) < 8000


def test_checks_of_a_frame_are_no_loops(spark):
    text = plan(entry.queries()["d3_integrity_audit"](spark, SF))
    # the text is put in upper case once in the step and in the filter, not for every field
    assert "lambda" not in text and text.count("upper(") <= 3


def test_crc16_of_any_bytes(spark):
    r = random.Random(3)
    texts = [r.randbytes(9).hex() for _ in range(200)] + ["00" * 9, "FF" * 9]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (1, 6, 9):
        assert [x[0] for x in df.select(binary.crc16_modbus(F.col("t"), n)).collect()] == [crc16(bytes.fromhex(t)[:n]) for t in texts]
    assert spark.createDataFrame([(None,), ("AA01",)], "t string").select(binary.crc16_modbus(F.col("t"), 6).alias("c")).where("c is not null").count() == 0


def test_single_precision_of_any_bits(spark):
    r = random.Random(4)
    bits = [r.getrandbits(32) for _ in range(500)] + [0, 1 << 31, 1, 0x807FFFFF, 0x00800000, 0x7F7FFFFF, 0x7F800000, 0xFF800000, 0x7FC00000]
    got = [x[0] for x in spark.createDataFrame([(b,) for b in bits], "b long").select(binary.float32_value(F.col("b"))).collect()]
    want = [None if b >> 23 & 0xFF == 0xFF else struct.unpack(">f", struct.pack(">I", b))[0] for b in bits]
    assert list(map(str, got)) == list(map(str, want))  # tells -0.0 from 0.0
    values = [r.uniform(-1, 1) for _ in range(200)] + [0.1, -0.04, 1e-9, 0.5, -2.0, 0.0]
    made = [x[0] for x in spark.createDataFrame([(v,) for v in values], "v double").select(fixtures.float32(F.col("v"))).collect()]
    assert made == [struct.pack(">f", v).hex().upper() for v in values]


def test_packed_numbers(spark):
    got = spark.range(1).select(
        fixtures.packed((F.lit(7), 1), (F.lit(0x1234), 2), (F.lit(0x01020304), 4)).alias("a"), fixtures.le(F.lit(-2), 2).alias("b"), fixtures.u8(F.lit(None).cast("int")).alias("c"),
    ).first()
    assert tuple(got) == ("07341204030201", "FEFF", None)


def test_fields_of_both_layouts_and_of_no_frames(spark):
    """Short frames keep every field; long ones have beats only as their count says; times outside the range and other kinds are no frames."""
    def frame(size, ts=1700000000, kind="2F", start="AA01", beats=b""):
        body = bytearray(size)
        body[7:11] = struct.pack("<I", ts)
        body[14] = 87
        body[15:15 + len(beats)] = beats
        body[36:52] = struct.pack(">4f", 0.25, -1.5, 0.0, 100.0)
        return start + "00" * 6 + kind + body.hex().upper()[2:] + "00" * 4

    short = bytes(4) + bytes([61, 0]) + struct.pack("<HH", 900, 2600)
    texts = {
        "short": frame(80, beats=short), "two": frame(81, beats=b"\x02" + struct.pack("<HH", 900, 950)), "one": frame(81, beats=b"\x01" + struct.pack("<HH", 900, 950)),
        "low": frame(81, kind="2f"), "first": frame(52, 1_600_000_000), "last": frame(52, 2_100_000_000),
        "early": frame(52, 1_599_999_999), "late": frame(52, 2_100_000_001), "kind": frame(52, kind="2E"), "start": frame(52, start="AA02"), "small": frame(52)[:-2], "none": None,
    }
    got = {r.k: r for r in packets.decode_frames(spark.createDataFrame(list(texts.items()), "k string, frame string")).collect()}
    assert {k for k, r in got.items() if r.d_ok} == {"short", "two", "one", "low", "first", "last"}
    beats = {k: (got[k].d.hr, got[k].d.rr_count, got[k].d.rr1_ms, got[k].d.rr2_ms) for k in ("short", "two", "one", "low")}
    assert beats == {"short": (61, 0, 900.0, None), "two": (66, 2, 900.0, 950.0), "one": (66, 1, 900.0, None), "low": (0, 0, None, None)}
    assert (got["two"].d.gyro, got["two"].d.acc_x, got["two"].d.acc_y, got["two"].d.acc_z, got["two"].d.spo2) == (0.25, -1.5, 0.0, 100.0, 97)


def test_only_usable_rows_are_picked(spark):
    rows = [(1, 5, 1, False), (1, 6, 2, True), (1, 4, 3, None), (2, 1, 4, False), (None, 9, 5, True), (3, None, 6, True), (3, 1, 7, True)]
    got = keep_one(spark.createDataFrame(rows, "k int, id int, v int, ok boolean"), ["k"], ["id"], where="ok")
    assert got.columns == ["k", "id", "v"] and sorted(map(tuple, got.collect()), key=str) == [(1, 6, 2), (3, None, 6), (None, 9, 5)]
    raw = spark.createDataFrame([(1, 10, 1, 30, None), (1, 10, 2, 31, None), (1, 11, 3, None, "")], "user_id long, timestamp long, id long, hr int, raw_hex string")
    raw = raw.withColumns({c: F.lit(None).cast("double") for c in ("rr_count", "rr1_ms", "acc_x", "acc_y", "acc_z", "gyro", "spo2")})
    assert [(r.timestamp, r.hr) for r in tables.scan(raw).collect()] == [(10, 31)]
