"""Comparison with official labels and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nocturne.functions.scalars import pearson
from nocturne.operators.nights import NIGHT
from nocturne.operators.series import runs

CLASSES = range(4)


def _spine(df: DataFrame) -> DataFrame:
    """The sixteen class pairs."""
    pairs = [(i, j) for i in CLASSES for j in CLASSES]
    return df.sparkSession.createDataFrame(pairs, "a int, b int")


# -------------------------------------------------------------- classification


def confusion_matrix(df: DataFrame, true: str = "label", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    by = by or []
    counts = df.groupBy(*by, true).pivot(pred, list(CLASSES)).agg(F.count(F.lit(1)))
    return counts.select(
        *by, F.col(true).alias("true"), *[F.coalesce(F.col(str(k)), F.lit(0)).alias(f"pred_{k}") for k in CLASSES]
    )


def classification_report(df: DataFrame, true: str = "label", pred: str = "pred",
                          by: list[str] | None = None) -> DataFrame:
    """Accuracy, recall and precision per class and the lowest recall, one row per group."""
    hit = F.col(true) == F.col(pred)
    n_true = {k: F.count(F.when(F.col(true) == k, 1)) for k in CLASSES}
    n_pred = {k: F.count(F.when(F.col(pred) == k, 1)) for k in CLASSES}
    n_hit = {k: F.count(F.when(hit & (F.col(true) == k), 1)) for k in CLASSES}
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    recall = [ratio(n_hit[k], n_true[k]) for k in CLASSES]
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(hit.cast("double")).alias("accuracy"),
        *[r.alias(f"recall_{k}") for k, r in enumerate(recall)],
        *[ratio(n_hit[k], n_pred[k]).alias(f"precision_{k}") for k in CLASSES],
        F.least(*recall).alias("min_recall"),
    )


def score_errors(pairs: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """MAE, RMSE and correlation of ``<metric>`` against ``official_<metric>``, long form."""
    own = F.explode(F.array(*[
        F.struct(
            F.lit(m).alias("metric"), F.col(m).cast("double").alias("x"),
            F.col(f"official_{m}").cast("double").alias("y"),
        )
        for m in metrics
    ]))
    long = pairs.select(*(by or []), own.alias("v")).select(*(by or []), "v.*").where("x is not null and y is not null")
    d = F.col("x") - F.col("y")
    return long.groupBy(*(by or []), "metric").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"),
        pearson(F.col("x"), F.col("y")).alias("r"),
    )


def stage_share_error(a: DataFrame, b: DataFrame, keys: list[str] = NIGHT, weighted: bool = False) -> DataFrame:
    """Mean absolute difference of the four stage shares of two summaries of a night;
    ``weighted`` sums them with 2, 1, 1, 1.5 for deep, light, rem, awake."""
    weights = {"deep": 2.0, "light": 1.0, "rem": 1.0, "awake": 1.5}
    other = b.select(*keys, *[F.col(f"{s}_pct").alias(f"o_{s}") for s in weights])
    diff = {s: F.abs(F.col(f"{s}_pct") - F.col(f"o_{s}")) for s in weights}
    total = F.lit(0.0)
    for s, w in weights.items():
        total = total + diff[s] * (w if weighted else 1.0)
    value = total if weighted else F.bround(total / 4, 1)
    return a.join(other, keys).select(*keys, value.alias("error"))


def separation(df: DataFrame, features: list[str], positive: Column) -> DataFrame:
    """Cohen's d of every feature between two groups, strongest first."""
    long = df.select(
        positive.alias("pos"),
        F.explode(F.array(*[
            F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features
        ])).alias("v"),
    ).select("pos", "v.*")
    p, q = F.when(F.col("pos"), F.col("x")), F.when(~F.col("pos"), F.col("x"))
    pooled = F.sqrt((F.var_pop(p) + F.var_pop(q)) / 2)
    d = F.when(pooled > 0, (F.avg(p) - F.avg(q)) / pooled).otherwise(0.0)
    return long.groupBy("feature").agg(d.alias("cohens_d"), F.abs(d).alias("strength"))


# --------------------------------------------------------- sequences of labels


def transition_counts(df: DataFrame, label: str = "label", keys: list[str] = NIGHT) -> DataFrame:
    """Counts of all sixteen class pairs of neighbouring windows of a night."""
    nxt = F.lead(label).over(W.partitionBy(*keys).orderBy("win"))
    seen = df.select(F.col(label).alias("a"), nxt.alias("b")).where("b is not null").groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n")
    )
    return _spine(df).join(seen, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def transition_probabilities(counts: DataFrame, smooth: float = 0.1, awake_boost: float = 1.0,
                             light_boost: float = 1.0) -> DataFrame:
    """Row-normalised transitions with smoothing and boosted self-transitions."""
    own = F.col("a") == F.col("b")
    boost = F.when(own & (F.col("a") == 0), awake_boost).when(own & (F.col("a") == 1), light_boost).otherwise(1.0)
    weight = counts.withColumn("w", (F.col("n") + smooth) * boost)
    p = F.col("w") / F.sum("w").over(W.partitionBy("a"))
    return weight.select("a", "b", "n", p.alias("p"))


def sticky_transitions(counts: DataFrame, smooth: float = 0.1, gain: float = 1.5, most: float = 0.95,
                       forbidden: tuple = ((2, 3), (3, 2), (2, 0), (0, 2))) -> DataFrame:
    """Log transitions with stickier sleep stages and forbidden pairs at -20."""
    base = transition_probabilities(counts, smooth)
    row = W.partitionBy("a")
    own = F.col("a") == F.col("b")
    stay = F.max(F.when(own, F.col("p"))).over(row)
    boosted = F.least(F.lit(most), stay * F.when(F.col("a") == 0, 1.0).otherwise(gain))
    p = F.when(own, boosted).otherwise(F.col("p") * (1 - boosted) / (1 - stay))
    blocked = F.lit(False)
    for i, j in forbidden:
        blocked = blocked | ((F.col("a") == i) & (F.col("b") == j))
    log_p = F.when(blocked, -20.0).otherwise(F.log(F.greatest(F.lit(1e-10), p)))
    return base.select("a", "b", p.alias("p"), log_p.alias("log_p"))


def class_shares(df: DataFrame, label: str = "label", keys: list[str] = NIGHT, smooth: float = 0.1) -> DataFrame:
    """Probability of each class as the first of a night and over all windows."""
    first = df.groupBy(*keys).agg(F.min_by(label, "win").alias("k")).groupBy("k").agg(
        F.count(F.lit(1)).alias("n_first")
    )
    every = df.groupBy(F.col(label).alias("k")).agg(F.count(F.lit(1)).alias("n_all"))
    spine = df.sparkSession.createDataFrame([(k,) for k in CLASSES], "k int")
    joined = spine.join(first, "k", "left").join(every, "k", "left").fillna(0)
    whole = W.partitionBy(F.lit(0))  # four rows
    a, b = F.col("n_first") + smooth, F.col("n_all")
    return joined.select(
        "k", (a / F.sum(a).over(whole)).alias("p_first"), (b / F.sum(b).over(whole)).alias("p_all")
    )


def bin_of(fraction: Column, bins: int = 10) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(fraction * bins))).cast("int")


def position_prior(df: DataFrame, label: str = "label", fraction: str = "fraction_of_night", bins: int = 10,
                   more_than: int = 20) -> DataFrame:
    """``P(stage | night bin) / P(stage)`` per bin, 1 for bins with too few windows."""
    counts = df.groupBy(bin_of(F.col(fraction), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col(label) == k, 1)).alias(f"n{k}") for k in CLASSES]
    )
    whole = W.partitionBy(F.lit(0))  # one row per bin
    ratio = [
        F.when(
            F.col("n") > more_than,
            (F.col(f"n{k}") / F.col("n"))
            / F.greatest(F.sum(f"n{k}").over(whole) / F.sum("n").over(whole), F.lit(1e-6)),
        ).otherwise(1.0).alias(f"r{k}")
        for k in CLASSES
    ]
    return counts.select("bin", "n", *ratio)


def timing_predictor(df: DataFrame, label: str = "label", fraction: str = "fraction_of_night",
                     bins: int = 10) -> DataFrame:
    """Most frequent class per night bin; the lower class number wins a tie."""
    counts = df.groupBy(bin_of(F.col(fraction), bins).alias("bin"), F.col(label).alias("k")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.groupBy("bin").agg(F.max_by("k", F.struct("n", -F.col("k"))).alias("pred"))


def stage_positions(df: DataFrame, label: str = "label", fraction: str = "fraction_of_night") -> DataFrame:
    """Mean night fraction of each class and its median over hundredths of the night."""
    cell = F.floor(F.col(fraction) * 100) / 100
    counted = df.groupBy(F.col(label).alias("k"), cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(fraction).alias("s")
    )
    return counted.groupBy("k").agg(
        (F.sum("s") / F.sum("n")).alias("mean_fraction"), F.percentile("cell", F.lit(0.5), F.col("n")).alias("median_cell")
    )


def segment_statistics(df: DataFrame, label: str = "label", window_min: float = 2.0, keys: list[str] = NIGHT) -> DataFrame:
    """Run lengths per class. Lengths are whole windows of one night, so percentiles
    keep at most one counter per possible length."""
    found = runs(df, label, keys)
    n = F.col("length")
    half, most = F.lit(0.5), F.lit(0.9)
    return found.groupBy(F.col(label).alias("k")).agg(
        F.count(F.lit(1)).alias("segments"),
        (F.percentile(n, half) * window_min).alias("median_min"),
        (F.avg(n) * window_min).alias("mean_min"),
        (F.percentile(n, most) * window_min).alias("p90_min"),
        F.avg((n == 1).cast("double")).alias("single_share"),
    )


def onset_and_waso(df: DataFrame, label: str = "label", window_min: float = 2.0, keys: list[str] = NIGHT) -> DataFrame:
    """Onset latency, awake share after onset and number of awake segments."""
    order = W.partitionBy(*keys).orderBy("win")
    asleep_at = F.min(F.when(F.col(label) != 0, F.col("at"))).over(W.partitionBy(*keys))
    v = df.withColumn("at", F.row_number().over(order) - 1).withColumn("onset", asleep_at)
    new_bout = (F.col(label) == 0) & F.coalesce(F.lag(label).over(order) != 0, F.lit(True))
    v = v.withColumn("bout", new_bout.cast("int"))
    return v.groupBy(*keys).agg(
        (F.coalesce(F.first("onset"), F.count(F.lit(1))) * window_min).alias("latency_min"),
        F.avg(F.when(F.col("at") >= F.col("onset"), (F.col(label) == 0).cast("double"))).alias("waso_share"),
        F.sum("bout").alias("awake_segments"),
    )


def sleep_hours(df: DataFrame, stride_s: int = 60, label: str = "label", keys: list[str] = NIGHT) -> DataFrame:
    asleep = F.sum((F.col(label) != 0).cast("int"))
    return df.groupBy(*keys).agg(F.bround(asleep * stride_s / 3600.0, 2).alias("sleep_hours"))


def night_summary(df: DataFrame, columns: list[str], keys: list[str] = NIGHT) -> DataFrame:
    """Mean, deviation, 90th and 10th percentile of window features per night."""
    aggs = []
    for c in columns:
        aggs += [
            F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_sd"),
            F.percentile(c, F.lit(0.9)).alias(f"{c}_p90"), F.percentile(c, F.lit(0.1)).alias(f"{c}_p10"),
        ]
    return df.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("n_windows"))
