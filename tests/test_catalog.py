"""Registered queries against their oracles on the smallest tables.

By default a sample over all operator groups; CATALOG=all checks every query.
"""

import os

import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "p4_evening_night", "p9_thin_dense_nights", "w1_resting_hr", "w3_sws_hrv", "w16_ema_baseline", "a1_daily_features", "a14_binned_entropy",
    "a37_behaviour_impact", "a41_roc_auc", "a42_transition_probabilities", "st2_calibrated_rules", "st12_hr_delta", "q1_smooth_isolated",
    "q5_floor_runs", "q7_viterbi", "q13_gate_override", "j3_interval_majority", "j17_match_workouts", "e1_sleep_bounds", "e2_activity_bouts",
    "sp1_lf_hf", "sc3_recovery_engine", "sc18_hydration", "d1_decode_frames", "d3_integrity_audit", "io1_sensor_scan", "io3_day_document_scores",
    "io15_merge_sources", "m1_features_a", "s1_idempotent_insert", "s1_insert_ledger", "k4_keep_first_and_last", "d7_stored_fallback", "q12_hierarchical_decode", "m12_gain_sweep",
]


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


@pytest.mark.parametrize("name", list(entry.queries()) if os.environ.get("CATALOG") == "all" else SAMPLE)
def test_query(spark, con, name):
    ok, message, _ = check.compare(spark, con, name, SF)
    assert ok, message


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
