import math

import pytest
from pyspark.sql import functions as F

from nocturne.plans import scorers
from nocturne.plans.scorers import RHR, Scorer, score_days, score_readings


@pytest.fixture(scope="module")
def days(spark):
    rows = [(1, "2024-01-01", "80", 50.0, 5), (1, "2024-01-02", "x", 50.0, 6), (1, "2024-01-03", None, 50.0, 7), (2, "2024-01-01", "NaN", 50.0, 8),
            (2, "2024-01-02", "80", 500.0, 9), (2, "2024-01-03", "80", None, 10), (2, "2024-01-03", "80", 50.0, 10)]
    return spark.createDataFrame(rows, "user_id long, date string, hrv string, rhr double, error int").withColumn("date", F.to_date("date"))


def test_each_fault_is_an_error_of_its_day(days):
    got = {(r.user_id, r.date.day, r.rhr_bpm): (r.error, r.recovery) for r in score_days(days, {"simple": scorers.scorers()["simple"]}).collect()}
    assert {e for e, _ in got.values()} == {None, "not_a_number:hrv", "missing:hrv", "out_of_range:rhr", "missing:rhr"}
    assert all((e is None) == (score is not None) for e, score in got.values())
    assert got[1, 1, 50.0] == (None, math.floor(80 / 1.5 * 0.6 + 70 * 0.4))


def test_scorers_do_not_affect_each_other(days):
    raising = Scorer({"rhr": RHR}, lambda: {"strain": F.raise_error(F.lit("never on a bad day")).cast("double")})
    null = Scorer({"rhr": RHR}, lambda: {"strain": F.lit(None)})
    lacking = Scorer({"rhr": RHR, "steps": scorers.ANY}, lambda: {"strain": F.col("steps")})
    bad = days.where("rhr is null or rhr > 400")
    got = score_days(bad, {"raising": raising, "lacking": lacking, **scorers.scorers()}).collect()
    assert len(got) == bad.count() * 6 and all(r.error for r in got)
    one = score_days(days.where("hrv = '80' and rhr = 50"), {"null": null, "lacking": lacking, "simple": scorers.scorers()["simple"]}).collect()
    assert sorted((r.algo, r.error) for r in one if r.algo != "simple") == [("lacking", "missing:steps")] * 2 + [("null", "no_result:strain")] * 2
    assert [r.error for r in one if r.algo == "simple"] == [None, None]


def test_registered_scorers_run_in_one_pass(days, monkeypatch):
    monkeypatch.setattr(scorers, "_SCORERS", dict(scorers._SCORERS))
    scorers.register_scorer("pulse", Scorer({"rhr": RHR}, lambda: {"recovery": 150 - F.col("rhr")}))
    out = score_days(days)
    assert out.where("algo = 'pulse' and error is null").select("recovery").distinct().collect()[0][0] == 100
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Generate") == 1
    assert score_days(days.limit(0)).count() == 0


def test_a_day_function_fails_on_its_day_only(spark):
    rows = [(1, "2024-01-01", 2, 60.0), (1, "2024-01-01", 1, 50.0), (1, "2024-01-02", 1, 0.0), (None, "2024-01-01", 1, 10.0), (3, None, 1, 20.0)]
    readings = spark.createDataFrame(rows, "user_id long, date string, timestamp long, hr double").withColumn("date", F.to_date("date"))
    functions = {
        "first": lambda day: {"rhr_bpm": day["hr"].iloc[0]},
        "inverse": lambda day: {"strain": 1 / float(day["hr"].iloc[0])},
        "unknown": lambda day: {"steps": 1.0},
        "text": lambda day: {"strain": "many"},
        "infinite": lambda day: {"strain": math.inf},
    }
    got = {(r.algo, r.user_id, str(r.date)): r for r in score_readings(readings, functions, ["hr"]).collect()}
    assert len(got) == 4 * 5
    assert got["first", 1, "2024-01-01"].rhr_bpm == 50 and got["first", 3, "None"].rhr_bpm == 20 and got["first", None, "2024-01-01"].rhr_bpm == 10
    assert {k[1:]: r.error for k, r in got.items() if k[0] == "inverse" and r.error} == {(1, "2024-01-02"): "ZeroDivisionError"}
    assert {r.error for k, r in got.items() if k[0] in ("unknown", "text", "infinite")} == {"ValueError"}
