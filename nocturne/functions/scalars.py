"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nocturne.schema import OFFICIAL_STAGE, STAGE_CODE


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def sigmoid100(ratio: Column, slope: float | Column, center: float | Column) -> Column:
    """0-100 logistic curve; the exponent is clamped so it cannot overflow."""
    slope = slope if isinstance(slope, Column) else F.lit(float(slope))
    center = center if isinstance(center, Column) else F.lit(float(center))
    return 100.0 / (1.0 + F.exp(clamp(-slope * (ratio - center), -500.0, 500.0)))


def valid_hr(hr: Column, above: int = 30, below: int | None = None) -> Column:
    """The heart rate where it is plausible, else NULL."""
    ok = hr > above
    if below is not None:
        ok = ok & (hr < below)
    return F.when(ok, hr)


def valid_rr(rr: Column, above: int = 200, below: int = 2500) -> Column:
    """The beat interval where it is plausible, else NULL."""
    return F.when((rr > above) & (rr < below), rr)


def movement(x: Column, y: Column, z: Column, signed: bool = False) -> Column:
    """Deviation of the acceleration magnitude from 1 g."""
    dev = F.sqrt(x * x + y * y + z * z) - 1.0
    return dev if signed else F.abs(dev)


def to_number(text: Column) -> Column:
    """``"47%"``, ``"1,234"``, ``"7:45"``, ``"7h 45m"`` as a double; ``"--"`` is NULL."""
    t = F.trim(text)
    hm = r"^(\d+)h\s*(\d+)m"
    colon = r"^(\d+):(\d{1,2})$"

    def sixty(pattern: str) -> Column:
        return F.regexp_extract(t, pattern, 1).cast("double") + (
            F.regexp_extract(t, pattern, 2).cast("double") / 60.0
        )

    return (
        F.when(t.rlike(hm), sixty(hm))
        .when(t.rlike(colon), sixty(colon))
        .otherwise(F.regexp_replace(t, "[%,]", "").try_cast("double"))
    )


def digits_number(text: Column) -> Column:
    """Keep digits and dots only; 0 where nothing is left (app displays)."""
    return F.coalesce(F.regexp_replace(text, "[^0-9.]", "").try_cast("double"), F.lit(0.0))


def clock_minute(text: Column) -> Column:
    """Minute of the day of a 12-hour clock text such as ``"1:54 AM"``."""
    p = r"^\s*(\d{1,2}):(\d{2})\s*([AaPp])[Mm]\s*$"
    hour = F.regexp_extract(text, p, 1).try_cast("int") % 12
    half = F.when(F.upper(F.regexp_extract(text, p, 3)) == "P", 12).otherwise(0)
    return (hour + half) * 60 + F.regexp_extract(text, p, 2).try_cast("int")


def night_minute(minute: Column) -> Column:
    """Clock minutes before noon sort after midnight."""
    return minute + F.when(minute < 720, 1440).otherwise(0)


def hhmm(minute: Column) -> Column:
    """``HH:mm`` of a minute of the day (taken modulo one day)."""
    m = F.pmod(minute.cast("int"), F.lit(1440))
    return F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), (m % 60).cast("int"))


def stage_code(stage: Column) -> Column:
    """Class number of a stage name; NULL for names outside the four stages."""
    out = F.lit(None).cast("int")
    for name, code in STAGE_CODE.items():
        out = F.when(stage == name, code).otherwise(out)
    return out


def stage_name(code: Column) -> Column:
    """Stage name of a class number; anything else is light."""
    out = F.lit("light")
    for name, k in STAGE_CODE.items():
        out = F.when(code == k, name).otherwise(out)
    return out


def official_stage(name: Column) -> Column:
    """Stage name of a stage as official documents spell it."""
    out = F.lit(None).cast("string")
    for official, stage in OFFICIAL_STAGE.items():
        out = F.when(name == official, stage).otherwise(out)
    return out


def recovery_zone(score: Column) -> Column:
    return F.when(score >= 67, "green").when(score >= 34, "yellow").otherwise("red")


def stress_level(ratio: Column) -> Column:
    return F.when(ratio < 1.5, "LOW").when(ratio < 3.0, "MEDIUM").otherwise("HIGH")


def strain_band(strain: Column) -> Column:
    return (
        F.when(strain < 10, "green")
        .when(strain < 14, "yellow")
        .when(strain < 18, "orange")
        .otherwise("red")
    )


def correlation_strength(r: Column) -> Column:
    return (
        F.when(F.abs(r) > 0.5, "strong").when(F.abs(r) > 0.3, "moderate").otherwise("weak")
    )


def steps(c: Column, cases: list[tuple[float, float]], default: float = 0.0) -> Column:
    """First value whose upper bound exceeds ``c``; ``default`` beyond the last."""
    out = F.lit(float(default))
    for bound, value in reversed(cases):
        out = F.when(c < bound, F.lit(float(value))).otherwise(out)
    return out


def pearson(x: Column, y: Column) -> Column:
    """Correlation of complete pairs, NULL (not an error) where one side is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))
