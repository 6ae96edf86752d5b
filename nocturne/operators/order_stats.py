"""Exact order statistics over a whole table without a single-task sort.

Equal values are counted before the shuffle, so ties cost nothing. The counts are written once,
range-partitioned by value; each range is ranked in its own task, and range totals (one row
each) give the offset. Spark's shuffle partitions set the number of ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nocturne.session import cut_lineage


def value_counts(df: DataFrame, value: str, counts: dict[str, Column]) -> DataFrame:
    """One row per distinct value with running totals of every count.

    ``before_<name>`` sums the counts of all smaller values. The counts are computed here and now.
    """
    per_value = df.where(F.col(value).isNotNull()).groupBy(value).agg(
        *[F.sum(c).cast("long").alias(n) for n, c in counts.items()]
    )
    cut = cut_lineage(per_value.repartitionByRange(value).withColumn("_slice", F.spark_partition_id()), "value-counts")
    totals = cut.groupBy("_slice").agg(*[F.sum(n).alias(f"_t_{n}") for n in counts])
    # a row for each range
    earlier = W.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "_slice", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in counts]
    )
    inside = W.partitionBy("_slice").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    ranked = cut.join(offsets, "_slice")
    return ranked.select(
        value, *counts,
        *[(F.coalesce(F.sum(n).over(inside), F.lit(0)) + F.col(f"_o_{n}")).alias(f"before_{n}") for n in counts],
    )


def exact_quantiles(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per share."""
    counted = value_counts(df, value, {"n": F.lit(1)})
    last = counted.agg(F.sum("n") - 1).scalar()
    ranked = counted.withColumn("_last", last)

    def inside(k: Column) -> Column:
        return (F.col("before_n") <= k) & (k < F.col("before_n") + F.col("n"))

    def target(share: float) -> Column:
        goal = F.col("_last") * F.lit(float(share))
        lo, hi = inside(F.floor(goal)), inside(F.ceil(goal))
        return F.when(
            lo | hi,
            F.struct(
                F.lit(float(share)).alias("share"), lo.alias("lo"), hi.alias("hi"),
                (goal - F.floor(goal)).alias("weight"),
            ),
        )

    # as many entries as shares, and only the values next to a share keep any
    hits = F.filter(F.array(*[target(s) for s in shares]), lambda t: t.isNotNull())
    hit = ranked.select(value, F.explode(hits).alias("t"))
    v = F.col(value)
    return hit.groupBy("t.share").agg(
        (
            F.max(F.when(F.col("t.lo"), v)) * (1 - F.max("t.weight"))
            + F.max(F.when(F.col("t.hi"), v)) * F.max("t.weight")
        ).alias("value")
    )


def roc_auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Area under the ROC curve; ties count half."""
    counts = {"p": positive.cast("int"), "q": (~positive).cast("int")}
    counted = value_counts(df, score, counts)
    wins = F.sum(F.col("p").cast("double") * (F.col("before_q") + F.col("q") / 2.0))
    return counted.agg((wins / (F.sum("p").cast("double") * F.sum("q"))).alias("auc"))


def operating_points(df: DataFrame, score: str, positive: Column, held: list[float]) -> DataFrame:
    """Share of positives at or above the threshold that keeps a share of negatives below it."""
    cuts = exact_quantiles(df.where(~positive), score, held).agg(
        F.collect_list(F.struct(F.col("share").alias("negative_recall"), F.col("value").alias("threshold")))
    )
    # one array with an entry per held share
    return (
        df.where(positive & F.col(score).isNotNull())
        .withColumn("_cuts", cuts.scalar())
        .select(score, F.explode("_cuts").alias("c"))
        .select(score, "c.*")
        .groupBy("negative_recall", "threshold")
        .agg(F.avg((F.col(score) >= F.col("threshold")).cast("double")).alias("positive_recall"))
    )
