"""Rollups of daily scores (A27-A37, A50-A52) and table idioms (K1-K8).

Daily tables hold one row per user and calendar day, so windows per user are
bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nocturne.functions.scalars import correlation_strength, pearson
from nocturne.operators.joins import next_day


def monthly_averages(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Averages per user and month over the days that have a value."""
    return df.groupBy("user_id", F.date_format("date", "yyyy-MM").alias("month")).agg(
        *[F.bround(F.avg(m), 1).alias(m) for m in metrics], F.count(metrics[0]).alias("days")
    )


def weekday_pattern(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Averages per user and weekday (0 is Monday)."""
    return df.groupBy("user_id", F.weekday("date").alias("weekday")).agg(
        *[F.coalesce(F.bround(F.avg(m), 1), F.lit(0.0)).alias(m) for m in metrics]
    )


def best_weekday(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Weekday with the highest average per metric; the earlier one wins a tie."""
    pattern = weekday_pattern(df, metrics)
    return pattern.groupBy("user_id").agg(
        *[F.max_by("weekday", F.struct(F.col(m), -F.col("weekday"))).alias(f"best_{m}") for m in metrics]
    )


def guarded_correlation(x: str, y: str, at_least: int = 5) -> Column:
    """Pearson r over complete pairs; NULL below ``at_least``, 0 when constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    flat = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    r = F.when(flat, 0.0).otherwise(F.bround(pearson(a, b), 3))
    return F.when(F.count(a) >= at_least, r)


def next_day_correlations(df: DataFrame) -> DataFrame:
    """Sleep hours and strain against the next row's recovery, and strain the same day."""
    pairs = next_day(df, ["recovery"])
    r = {
        "r_sleep": guarded_correlation("sleep_hours", "next_recovery"),
        "r_strain": guarded_correlation("strain", "next_recovery"),
        "r_same": guarded_correlation("strain", "recovery"),
    }
    out = pairs.groupBy("user_id").agg(*[c.alias(n) for n, c in r.items()])
    return out.withColumn("strength", F.when(F.col("r_strain").isNotNull(), correlation_strength(F.col("r_strain"))))


def best_and_worst_day(df: DataFrame, metric: str = "recovery", ignore_zero: bool = False) -> DataFrame:
    """First day with the highest and the lowest value."""
    v = F.col(metric)
    low = F.when(v > 0, v) if ignore_zero else v
    # the earlier day wins a tie
    early = F.datediff(F.lit("1970-01-01").cast("date"), "date")
    return df.where(v.isNotNull()).groupBy("user_id").agg(
        F.max_by("date", F.struct(v, early)).alias("best_date"), F.max(v).alias("best"),
        F.min_by("date", F.when(low.isNotNull(), F.struct(low, F.col("date")))).alias("worst_date"),
        F.min(low).alias("worst"),
    )


def recent(df: DataFrame, days: int) -> DataFrame:
    """Days after ``newest - days`` of each user."""
    newest = F.max("date").over(W.partitionBy("user_id"))
    return df.withColumn("_newest", newest).where(
        F.col("date") > F.date_sub(F.col("_newest"), days)
    ).drop("_newest")


def trend_windows(df: DataFrame, metrics: list[str], spans: tuple[int, ...] = (7, 30, 90)) -> DataFrame:
    """Averages and maxima over the last 7, 30 and 90 days, one row per span."""
    newest = F.max("date").over(W.partitionBy("user_id"))
    aged = df.withColumn("_age", F.datediff(newest, "date"))
    spread = aged.withColumn("span", F.explode(F.array(*[F.lit(s) for s in spans]))).where("_age < span")
    return spread.groupBy("user_id", "span").agg(
        F.count(F.lit(1)).alias("days"),
        *[F.avg(m).alias(f"avg_{m}") for m in metrics], *[F.max(m).alias(f"max_{m}") for m in metrics],
    )


def weekly_report(df: DataFrame, metrics: list[str], days: int = 7) -> DataFrame:
    """Averages over the last seven calendar days; a missing day counts as 0."""
    newest = df.groupBy("user_id").agg(F.max("date").alias("newest"))
    spine = newest.withColumn(
        "date", F.explode(F.sequence(F.date_sub("newest", days - 1), F.col("newest")))
    )
    filled = spine.join(df.select("user_id", "date", *metrics), ["user_id", "date"], "left")
    best = F.struct(F.coalesce("recovery", F.lit(0.0)), F.datediff(F.lit("1970-01-01").cast("date"), "date"))
    return filled.groupBy("user_id").agg(
        *[F.avg(F.coalesce(m, F.lit(0.0))).alias(f"avg_{m}") for m in metrics],
        F.max_by("date", best).alias("best_date"),
    )


def recovery_analysis(df: DataFrame, days: int = 7) -> DataFrame:
    """Average, zone counts and green streak over the last days."""
    r = F.col("recovery")
    order = W.partitionBy("user_id").orderBy(F.desc("date"))
    still = F.min((r >= 67).cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    v = recent(df.where(r.isNotNull()), days).withColumn("_still", still)
    return v.groupBy("user_id").agg(
        F.avg(r).alias("avg_recovery"), F.count(F.lit(1)).alias("days"),
        F.sum((r >= 67).cast("int")).alias("green_days"),
        F.sum(((r >= 34) & (r < 67)).cast("int")).alias("yellow_days"),
        F.sum((r < 34).cast("int")).alias("red_days"),
        F.sum("_still").alias("streak"),
    )


def sleep_analysis(df: DataFrame, days: int = 7) -> DataFrame:
    v = recent(df.where(F.col("sleep").isNotNull()), days)
    return v.groupBy("user_id").agg(
        F.avg("sleep").alias("avg_sleep"), F.max("sleep").alias("best"), F.min("sleep").alias("worst"),
        F.count(F.lit(1)).alias("days"),
    )


def stress_day(df: DataFrame, value: str = "stress") -> DataFrame:
    """Average, peak, lowest and seconds per zone of a day's stress points.

    A point lasts until the next one; a gap above ten minutes counts as five.
    """
    nxt = F.lead("timestamp").over(W.partitionBy("user_id", "date").orderBy("timestamp"))
    v = df.withColumn("_gap", nxt - F.col("timestamp"))
    v = v.withColumn("_gap", F.when(F.col("_gap") > 600, 300).otherwise(F.col("_gap")))
    s = F.col(value)
    zone = lambda c: F.coalesce(F.sum(F.when(c, F.col("_gap"))), F.lit(0))
    return v.groupBy("user_id", "date").agg(
        F.avg(s).alias("avg_stress"), F.max(s).alias("peak"), F.min(s).alias("lowest"),
        zone(s < 34).alias("low_s"), zone((s >= 34) & (s < 67)).alias("moderate_s"), zone(s >= 67).alias("high_s"),
    )


def stress_trend(days: DataFrame) -> DataFrame:
    """Average over days, day with the lowest and the highest average."""
    s = F.col("avg_stress")
    early = F.datediff(F.lit("1970-01-01").cast("date"), "date")
    return days.groupBy("user_id").agg(
        F.avg(s).alias("period_avg"), F.min_by("date", F.struct(s, "date")).alias("lowest_date"),
        F.max_by("date", F.struct(s, early)).alias("highest_date"), F.count(F.lit(1)).alias("days"),
    )


def behaviour_impact(journal: DataFrame, recovery: DataFrame, at_least: int = 3) -> DataFrame:
    """Mean recovery with and without each behaviour a user has used.

    Journal days with a recovery: totals per user minus totals per behaviour give
    the days without it, so nothing is paired with every behaviour.
    """
    days = journal.join(recovery.select("user_id", "date", "recovery"), ["user_id", "date"]).where(
        "recovery is not null"
    )
    total = days.groupBy("user_id").agg(
        F.sum("recovery").alias("sum_all"), F.count(F.lit(1)).alias("n_all")
    )
    used = days.select("user_id", "recovery", F.explode(F.array_distinct("behaviours")).alias("behaviour"))
    per = used.groupBy("user_id", "behaviour").agg(
        F.sum("recovery").alias("sum_with"), F.count(F.lit(1)).alias("n_with")
    )
    n_without = F.col("n_all") - F.col("n_with")
    out = per.join(total, "user_id").where((F.col("n_with") >= at_least) & (n_without >= at_least))
    with_, without = F.col("sum_with") / F.col("n_with"), (F.col("sum_all") - F.col("sum_with")) / n_without
    diff = with_ - without
    return out.select(
        "user_id", "behaviour", with_.alias("avg_with"), without.alias("avg_without"), diff.alias("diff"),
        F.row_number().over(W.partitionBy("user_id").orderBy(F.desc(F.bround(F.abs(diff), 9)), "behaviour")).alias("rank"),
    )


def energy(df: DataFrame) -> DataFrame:
    """Kilocalories per day and their total per user."""
    kcal = F.bround(F.col("kilojoule") / 4.184, 0)
    return df.groupBy("user_id").agg(F.sum(kcal).alias("total_kcal"), F.avg(kcal).alias("avg_kcal"))


def workout_zone_minutes(df: DataFrame, zones: str = "zone_duration") -> DataFrame:
    """Minutes per zone of a map of milliseconds, positive entries only."""
    return df.select("workout_id", F.explode(zones).alias("zone", "ms")).where("ms > 0").select(
        "workout_id", "zone", (F.col("ms") / 60000.0).alias("minutes")
    )


def history_context(days: DataFrame, workouts: DataFrame, span: int = 30, workout_days: int = 7) -> DataFrame:
    """Per user one nested row: scores of the last days, workouts of the last week.

    Both lists are bounded: at most ``span`` days and the workouts of seven days,
    of which a tracked user has at most one per start second.
    """
    recent_days = recent(days, span)
    history = recent_days.groupBy("user_id").agg(
        F.sort_array(
            F.collect_list(F.struct("date", F.round("recovery").alias("recovery"), F.round("hrv").alias("hrv"),
                                    "rhr", F.round("sleep").alias("sleep"), "strain")), False
        ).alias("history"),
        F.max("date").alias("newest"),
    )
    near = workouts.join(history.select("user_id", "newest"), "user_id").where(
        (F.col("date") > F.date_sub("newest", workout_days)) & (F.col("date") <= F.col("newest"))
    )
    listed = near.groupBy("user_id").agg(
        F.sort_array(F.collect_list(F.struct("date", "start_ts", "sport_id", "strain"))).alias("workouts")
    )
    return history.join(listed, "user_id", "left").drop("newest")


# ------------------------------------------------------------- table idioms


def latest(df: DataFrame, n: int = 1, keys: list[str] = ["user_id"], order: list[str] | None = None) -> DataFrame:
    """The newest ``n`` rows per key."""
    by = [F.desc(c) for c in (order or ["timestamp"])]
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*by))).where(F.col("rank") <= n)


def keep_one(df: DataFrame, keys: list[str], order: list[str], keep: str = "first", where: str | None = None) -> DataFrame:
    """One row per key by an explicit order; combined before the shuffle, so a key
    with very many copies stays cheap. Only rows whose column ``where`` is true count: unlike a filter before,
    which Spark would move below the steps that make the column, this needs them once."""
    rest = [c for c in df.columns if c not in keys and c != where]
    by = F.struct(*order)
    pick = F.min_by if keep == "first" else F.max_by
    kept = df.groupBy(*keys).agg(pick(F.struct(*rest), F.when(F.col(where), by) if where else by).alias("_r"))
    kept = kept.where("_r is not null") if where else kept
    return kept.select(*keys, "_r.*").select(*[c for c in df.columns if c != where])


def top_k(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(k)
