"""Hand-computed values of single rules."""

import math

import pytest
from pyspark.sql import functions as F

from nocturne.functions import binary
from nocturne.functions.scalars import clock_minute, night_minute, to_number
from nocturne.operators import aggregates, decoding, scores, sequence, series
from nocturne.operators.nights import NIGHT


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first().asDict()


def test_float_and_checksums(spark):
    f = spark.createDataFrame([("3FC00000",), ("BEC28F5C",), ("00000000",), ("7F800000",), ("00000001",)], "h string")
    got = [r[0] for r in f.select(binary.float32_be(F.col("h"), 0)).collect()]
    assert got == [1.5, -0.3799999952316284, 0.0, None, 2.0**-149]
    text = F.hex(F.lit("123456789").cast("binary"))
    got = one(spark, a=binary.crc16_modbus(text, 9), b=binary.crc32(text, 0, F.lit(9)), c=binary.uint_le(F.lit("34120000"), 0, 4))
    assert got == {"a": 0x4B37, "b": 3421780262, "c": 0x1234}


def test_text_numbers(spark):
    got = one(spark, **{f"v{i}": to_number(F.lit(t)) for i, t in enumerate(["7:45", "7h 45m", "47%", "--", "1,234"])})
    assert list(got.values()) == [7.75, 7.75, 47.0, None, 1234.0]
    got = one(spark, a=clock_minute(F.lit("1:54 AM")), b=clock_minute(F.lit("12:05 AM")), c=night_minute(clock_minute(F.lit("11:22 PM"))), d=night_minute(clock_minute(F.lit("1:54 AM"))))
    assert got == {"a": 114, "b": 5, "c": 1402, "d": 1554}


def test_hrv_time_domain(night_frame):
    rr = [800.0, 810.0, 790.0, 1200.0, 805.0]
    got = aggregates.hrv_time_domain(night_frame([60] * 5, rr), min_beats=2, min_clean=1).first()
    assert got["rmssd_clean"] == pytest.approx(math.sqrt(250))
    got = aggregates.hrv_time_domain(night_frame([60] * 4, [800.0, 820.0, 790.0, 810.0]), min_beats=2).first()
    assert (got["sd1"], got["sd2"]) == (pytest.approx(16.6667, abs=1e-4), pytest.approx(5.7735, abs=1e-4))
    assert got["sd2_total"] == pytest.approx(0.1)


def test_entropy(night_frame):
    got = aggregates.binned_entropy(night_frame([50, 51, 56, 62, 63, 63]), "hr", 5.0, NIGHT).first()
    assert got["entropy"] == pytest.approx(1.91830, abs=1e-5)


def test_ema(spark):
    df = spark.createDataFrame([(1, "2024-01-01", 50.0), (1, "2024-01-02", 60.0), (1, "2024-01-03", 40.0)], "user_id long, date string, v double")
    got = [r["e"] for r in series.ema_baseline(df, "v", "e").orderBy("date").collect()]
    assert got == pytest.approx([50, 51, 49.9])


def test_scores(spark):
    lit = F.lit
    got = one(
        spark,
        sc1=scores.recovery_custom(lit(96.0), lit(55.0), lit(90.0), lit(15.0), 90.0, 54.0),
        sc6=scores.sleep_score_calibrated(lit(420.0), lit(92.0), lit(8.0)),
        sc8=scores.strain(lit(216.0)),
        sc9=scores.strain_calibrated(lit(65.0), lit(50), lit(100)),
        sc10=scores.sleep_need(lit(14.0), 1.0),
        sc12=scores.vo2max(lit(180.0), lit(55.0), lit(200)),
        sc13=scores.bedtime(lit(8.0), lit(420)),
    )
    assert got["sc6"] == 69 and got["sc8"] == 15.0 and got["sc9"] == 7.1
    assert got["sc10"] == 8.1 and got["sc12"] == 50.1 and got["sc13"] == "22:45"
    hrv = 100 / (1 + math.exp(-4 * (96 / 90 - 0.85)))
    assert got["sc1"] == round(0.6 * hrv + 0.25 * (50 - 8) + 0.15 * 90)


def labels(spark, seq, name="phase"):
    return spark.createDataFrame([(1, "n", i, s) for i, s in enumerate(seq)], f"user_id long, night string, win int, {name} string")


def test_smoothing(spark):
    got = sequence.smooth_isolated(labels(spark, "aabccdc")).orderBy("win").collect()
    assert "".join(r["phase"] for r in got) == "aaacccc"
    for short in ("a", "ab"):
        got = sequence.smooth_isolated(labels(spark, short)).orderBy("win").collect()
        assert "".join(r["phase"] for r in got) == short


def test_viterbi_two_states(spark):
    df = spark.createDataFrame([(1, "n", 0, 0.9, 0.1), (1, "n", 1, 0.4, 0.6), (1, "n", 2, 0.9, 0.1)], "user_id long, night string, win int, p0 double, p1 double")
    got = decoding.viterbi(df, [[0.8, 0.2], [0.2, 0.8]], [0.5, 0.5]).orderBy("win").collect()
    assert [r["state"] for r in got] == [0, 0, 0]


def test_hydration_never_below_zero(spark):
    rows = [(1, "d", i, g) for i, g in enumerate([-1, 2, -5, 3, 1])]
    got = scores.hydration(spark.createDataFrame(rows, "user_id long, date string, timestamp long, glasses int")).orderBy("timestamp").collect()
    assert [r["intake_ml"] for r in got] == [0, 500, 0, 750, 1000]
