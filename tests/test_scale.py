"""Plans and hot keys."""

import re

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

import __spark_entry__ as entry
from nocturne.operators import order_stats, positions, series, stagers, trends
from nocturne.operators.nights import NIGHT, with_night
from nocturne.plans import features, held_out
from nocturne.sources import adapters

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_positions_of_a_hot_key(spark):
    rows = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 50 + 1).otherwise(0).alias("k"), (F.col("id") * 7919 % 40).alias("day"), "id"
    )
    got = positions.sliced_position(rows, "k", "day", ["id"])
    want = rows.withColumn("want", F.row_number().over(W.partitionBy("k").orderBy("day", "id")) - 1)
    assert got.join(want, ["k", "day", "id"]).where("pos <> want").count() == 0
    assert got.count() == 20000


def test_a_supplier_with_most_rows_stays_one_user(spark, tmp_path):
    items = adapters.table(spark, SF, "lineitem")
    hot = items.withColumn("l_suppkey", F.when(F.col("l_orderkey") % 4 > 0, 1).otherwise(F.col("l_suppkey")))
    hot.write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {r[0]: r[1] for r in hot.groupBy("l_suppkey").count().collect()}
    s = adapters.sensor(spark, str(tmp_path))
    got = s.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("timestamp").alias("seconds")).collect()
    assert {r.user_id: r.n for r in got} == want and all(r.n == r.seconds for r in got)


def test_night_windows_cost_one_shuffle_after_the_adapter(spark):
    night = with_night(adapters.sensor(spark, SF))
    base = plan(night).count("Exchange hashpartitioning")
    staged = stagers.stage_windows(night, stagers.RULE_SETS["fallback"], None, 20, rest_rows=30, rest_step=3)
    assert plan(staged).count("Exchange hashpartitioning") == base + 1


def test_no_cartesian_products_and_little_python(spark):
    python = {"st9_spectral", "q7_viterbi"}
    for name in ("a1_daily_features", "st2_calibrated_rules", "j3_interval_majority", "j17_match_workouts", "a37_behaviour_impact",
                 "e2_activity_bouts", "w19_movement_proxy", "j14_parameter_sweep", *python):
        p = plan(entry.queries()[name](spark, SF))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name
        assert bool(re.search("ArrowEvalPython|PandasUDF|MapInPandas", p)) == (name in python), name


def test_pushed_filters_and_pruned_columns(spark):
    p = plan(series.resting_hr(with_night(adapters.sensor(spark, SF)), NIGHT))
    scans = re.findall(r"ReadSchema: struct<([^>]*)", p)
    assert scans and all("l_tax" not in s and "l_returnflag" not in s for s in scans)


def test_order_statistics_match_the_sorted_table(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 997 / 10.0).alias("s"), (F.col("id") % 3 == 0).alias("y"))
    values = sorted(r[0] for r in df.select("s").collect())
    got = {r["share"]: r["value"] for r in order_stats.exact_quantiles(df, "s", [0.0, 0.1, 0.5, 1.0]).collect()}
    for q, v in got.items():
        at = (len(values) - 1) * q
        lo, hi = values[int(at)], values[min(len(values) - 1, int(at) + 1)]
        assert v == pytest.approx(lo + (hi - lo) * (at - int(at)))
    pos = [r[0] for r in df.where("y").select("s").collect()]
    neg = [r[0] for r in df.where("not y").select("s").collect()]
    import bisect

    neg.sort()
    wins = sum((bisect.bisect_left(neg, p) + bisect.bisect_right(neg, p)) / 2 for p in pos) / (len(pos) * len(neg))
    assert order_stats.roc_auc(df, "s", F.col("y")).first()["auc"] == pytest.approx(wins)


def test_keep_one_combines_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id", (F.col("id") * 2).alias("v"))
    got = sorted(tuple(r) for r in trends.keep_one(df, ["k"], ["id"]).collect())
    assert got == [(0, 0, 0), (1, 1, 2)]
    p = plan(trends.keep_one(df, ["k"], ["id"]))
    assert p.index("Exchange") < p.rindex("partial_min_by")


def test_forward_sum(spark, night_frame):
    df = night_frame(list(range(50, 70)))
    got = [r["s"] for r in positions.forward_sum(df, F.col("hr").cast("long"), 5, "s", NIGHT).orderBy("timestamp").collect()]
    assert got[:16] == [sum(range(50 + i, 55 + i)) for i in range(16)] and got[16:] == [None] * 4


def held(df):
    """Rows of the fullest task and of all."""
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    return max(sizes), sum(sizes)


def night_table(spark, nights, rows):
    return spark.range(nights * rows).select(
        (F.col("id") % nights).alias("user_id"), F.concat(F.lit("2024-01-0"), F.col("id") % nights % 9).alias("night"), (F.col("id") / nights).cast("long").alias("timestamp"), (50 + F.col("id") % 30).cast("int").alias("hr"))


def test_rows_of_a_task_do_not_grow_with_the_nights(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for nights in (100, 400):
            tasks = positions.tasks_for(spark, nights * 60, 1000)
            most, rows = held(features.windows_of(night_table(spark, nights, 60), 20, tasks=tasks))
            assert rows == nights * 40 and most < 2500
            most, rows = held(positions.sliced_position(night_table(spark, nights, 60), "user_id", "timestamp", ["hr"], tasks))
            assert rows == nights * 60 and most < 2500
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_models_by_night_hold_a_bounded_number_of_windows(spark, monkeypatch):
    monkeypatch.setattr(held_out, "WINDOWS", 500)
    for nights in (100, 400):
        most, rows = held(held_out.by_night(night_table(spark, nights, 30)))
        assert rows == nights * 30 and most < 1500
