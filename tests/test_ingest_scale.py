"""Documents and frames are made where they are read; only table rows and intervals are shuffled."""

import random

import pytest

from catalog import fixtures
from nocturne.sources import documents

from test_scale import SF, plan


@pytest.mark.parametrize("build", ["frames", "records", "packet_log", "day_documents"])
def test_made_documents_are_not_shuffled(spark, monkeypatch, build):
    plans = []
    monkeypatch.setattr(fixtures, "_WRITTEN", {})
    monkeypatch.setattr(fixtures, "cut_lineage", lambda df, name: plans.append(plan(df)) or df)
    getattr(fixtures, build)(spark, SF)
    made = {"frames": "crc32", "records": "AA0174", "packet_log": "crc32", "day_documents": "StructsToJson"}[build]
    top = plans[0].split("Exchange")[0]
    assert made in top and made not in plans[0][len(top):]


def slow_minutes(rows):
    best = {}
    for key, stage, start, end in rows:
        a, b = start // 60, end // 60
        for m in range(min(a, b), max(a, b) + 1):
            if (key, m) not in best or best[key, m][0] < end:
                best[key, m] = (end, stage)
    return {k: v[1] for k, v in best.items()}


def test_minutes_go_to_the_interval_that_ends_last(spark):
    r = random.Random(5)
    rows = []
    for key in range(30):
        ends = r.sample(range(0, 6000), 12)
        rows += [(key if key else None, r.choice("ald"), e - r.randint(-300, 2500), e) for e in ends]
    df = spark.createDataFrame(rows + [(3, "a", None, 50), (3, "a", 50, None)], "k long, stage string, start_ts long, end_ts long")
    out = documents.expand_minutes(df, ["k"])
    text = plan(out)
    got = {(x.k, x.minute): x.stage for x in out.collect()}
    assert got == slow_minutes(rows) and out.count() == len(got)
    # the minutes are made after the only shuffle
    assert text.count("Exchange hashpartitioning(k") == 1 and "minute" not in text.split("Exchange hashpartitioning(k")[1]


def test_captured_records_are_picked_before_they_are_decoded(spark):
    """The pick carries the bytes of a record, not its fields, so each record is decoded once."""
    captures = spark.createDataFrame([(1, "{}", 1)], "user_id long, doc string, seq int")
    plan = documents.har_records(captures)._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by(record" in plan and "max_by(struct" not in plan and "max_by(named_struct" not in plan
