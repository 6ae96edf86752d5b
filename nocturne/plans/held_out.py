"""Held-out statistics in one aggregation.

Counts and sums are kept per night or fold. What a model learns without a group is the totals minus
the group's own, so every night is scored by statistics that never saw it, without a fit per night.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nocturne.operators import decoding, joins, positions
from nocturne.operators.evaluate import bin_of
from nocturne.operators.nights import NIGHT
from nocturne.session import cut_lineage

CLASSES = range(4)
# Smoothing of transition counts, log weight of forbidden ones and the smallest probability.
SMOOTH, FORBIDDEN, TINY = 0.1, -20.0, 1e-10
# Fixed values: (classes, largest stay, gain of staying, awake keeps its own stay) of the sticky transitions.
LIGHT_DEEP, ASLEEP, EVERY = ((1, 2), 0.97, 1.4), ((1, 2, 3), 0.96, 1.5), ((0, 1, 2, 3), 0.95, 1.5)
WINDOWS = 25_000  # windows of a task that learns or applies models by night
# Pairs of stages that do not follow each other.
APART = {(2, 3), (3, 2), (2, 0), (0, 2)}


def label_counts(df: DataFrame, by: list[str], label: str = "label", fraction: str = "fraction_of_night", bins: int = 10) -> DataFrame:
    """One row per group: class, first-class, position and transition counts as ``n_…`` columns.

    Transitions are counted between neighbouring labels of a night, for each set of classes with the other
    windows left out. Windows without a label are left out.
    """
    order = W.partitionBy(*NIGHT).orderBy("win")
    here = F.col(label)
    rows = df.where(here.isNotNull()).withColumn("_first", F.row_number().over(order) == 1)
    sets = {"a": LIGHT_DEEP[0], "b": ASLEEP[0], "c": EVERY[0]}
    past = {f"_{s}": F.last(F.when(here.isin(*classes), here), True).over(order.rowsBetween(W.unboundedPreceding, -1)) for s, classes in sets.items()}
    rows = rows.withColumns({**past, "_bin": bin_of(F.col(fraction), bins)})
    n = lambda condition, name: F.count(F.when(condition, 1)).alias(name)
    counts = [n(here == k, f"n_k{k}") for k in CLASSES] + [n(F.col("_first") & (here == k), f"n_f{k}") for k in CLASSES]
    counts += [n((F.col("_bin") == b) & (here == k), f"n_p{b}_{k}") for b in range(bins) for k in CLASSES]
    for s, classes in sets.items():
        counts += [n((F.col(f"_{s}") == i) & (here == j), f"n_{s}{i}{j}") for i, j in itertools.product(classes, classes)]
    return rows.groupBy(*by).agg(*counts)


def without_own(counts: DataFrame) -> DataFrame:
    """Every ``n_…`` column as the total over all groups minus the group's own; the totals are one row of numbers."""
    names = [c for c in counts.columns if c.startswith("n_")]
    total = counts.agg(*[F.sum(c).alias(c) for c in names]).first()
    return counts.withColumns({c: F.lit(total[c] or 0) - F.col(c) for c in names})


def _log(p: Column) -> Column:
    return F.log(F.greatest(F.lit(TINY), F.least(F.lit(1.0), p)))


def _added(parts: list[Column]) -> Column:
    return sum(parts[1:], parts[0])


def _sticky(name: str, kind: tuple) -> Column:
    """Flattened log transitions with longer stays; forbidden pairs get a fixed weight among three classes or more."""
    classes, most, gain = kind
    out = []
    for i in classes:
        row = [F.col(f"n_{name}{i}{j}") + SMOOTH for j in classes]
        total = _added(row)
        stay = F.col(f"n_{name}{i}{i}") + SMOOTH
        kept = F.least(F.lit(most), stay / total * (1.0 if i == 0 else gain))
        for j, weight in zip(classes, row):
            moved = kept if i == j else weight / total * (1 - kept) / ((total - stay) / total)
            out.append(F.lit(FORBIDDEN) if (i, j) in APART and len(classes) > 2 else _log(moved))
    return F.array(*out)


def _shares(names: list[str]) -> list[Column]:
    total = F.greatest(_added([F.col(c) for c in names]), F.lit(1))
    return [F.col(c) / total for c in names]


def decoder_tables(counts: DataFrame, bins: int = 10, more_than: int = 20) -> DataFrame:
    """Parameters of the decoders from ``label_counts`` columns, as arrays.

    ``ld_trans, ld_start`` (light and deep), ``ldr_…`` (asleep) and ``all_…`` are logarithms; ``trans, start`` are the plain
    probabilities; ``prior`` is P(class | bin) / P(class), 1 in bins with too few windows.
    """
    starts = {f"{name}_start": F.array(*map(_log, _shares([f"n_k{k}" for k in kind[0]]))) for name, kind in (("ld", LIGHT_DEEP), ("ldr", ASLEEP), ("all", EVERY))}
    plain = [(F.col(f"n_c{i}{j}") + SMOOTH) / _added([F.col(f"n_c{i}{m}") + SMOOTH for m in CLASSES]) for i in CLASSES for j in CLASSES]
    first = [(F.col(f"n_f{k}") + SMOOTH) / _added([F.col(f"n_f{m}") + SMOOTH for m in CLASSES]) for k in CLASSES]
    every, prior = _shares([f"n_k{k}" for k in CLASSES]), []
    for b in range(bins):
        n = _added([F.col(f"n_p{b}_{k}") for k in CLASSES])
        prior += [F.when(n > more_than, F.col(f"n_p{b}_{k}") / n / F.greatest(every[k], F.lit(1e-6))).otherwise(1.0) for k in CLASSES]
    made = {
        "ld_trans": _sticky("a", LIGHT_DEEP), "ldr_trans": _sticky("b", ASLEEP), "all_trans": _sticky("c", EVERY), **starts,
        "trans": F.array(*plain), "start": F.array(*first), "prior": F.array(*prior),
    }
    return counts.select(*[c for c in counts.columns if not c.startswith("n_")], *[v.alias(k) for k, v in made.items()])


def with_fold_tables(df: DataFrame, fold: str = "fold", **more) -> DataFrame:
    """``df`` with the decoder tables learned from the other folds; there is one row of tables per fold."""
    return df.join(F.broadcast(decoder_tables(without_own(label_counts(df, [fold], **more)))), fold)


# ------------------------------------------------------------------ naive Bayes without the night


def by_night(df: DataFrame) -> DataFrame:
    """Whole nights dealt over tasks of about ``WINDOWS`` rows, so that their memory does not grow with the number of nights."""
    return df.repartition(positions.tasks_for(df.sparkSession, df.count(), WINDOWS), *NIGHT)


def _moments(df: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    sums = F.array(*[F.sum(f) for f in features]).alias("s")
    squares = F.array(*[F.sum(F.col(f) * F.col(f)) for f in features]).alias("q")
    return df.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"), sums, squares)


def _each(a: str | Column, b: str | Column, f) -> Column:
    return F.zip_with(a, b, f)


def night_parameters(df: DataFrame, features: list[str], label: str = "label", share: float = 1e-3) -> DataFrame:
    """Per night: Gaussian naive Bayes ``model`` learned from all other nights, four structs in class order.

    A struct has ``mean`` and ``weight`` (1 / variance) per feature and ``base``, the log prior minus half the log
    variances. Variances get ``share`` of the feature's variance over all classes added. A class that the other nights lack
    has a null base.
    """
    kept = by_night(df.where(F.col(label).isNotNull()))
    zeros = F.array_repeat(F.lit(0.0), len(features))
    sums = _moments(kept, features, [*NIGHT, label])
    own = cut_lineage(sums.groupBy(*NIGHT).agg(F.collect_list(F.struct(label, "n", "s", "q")).alias("own")), "night-moments")
    each = own.select(F.explode("own").alias("o")).select("o.*")
    totals = each.groupBy(label).agg(F.sum("n").alias("n"), *[F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(len(features))]).alias(c) for c in ("s", "q")])
    totals = totals.agg(F.collect_list(F.struct(label, "n", "s", "q")).alias("all"))  # one row of four structs
    of = lambda rows, k: F.get(F.filter(rows, lambda x: x[label] == k), F.lit(0))

    def others(k: int) -> Column:
        mine, every = of("own", k), of("all", k)
        minus = lambda c: _each(F.coalesce(every[c], zeros), F.coalesce(mine[c], zeros), lambda a, b: a - b).alias(c)
        n = F.coalesce(every["n"], F.lit(0.0)) - F.coalesce(mine["n"], F.lit(0.0))
        return F.struct(F.lit(k).alias(label), n.alias("n"), minus("s"), minus("q"))

    night = own.crossJoin(F.broadcast(totals)).select(*NIGHT, F.array(*map(others, CLASSES)).alias("c"))
    total = lambda name: F.aggregate("c", zeros, lambda acc, x: F.zip_with(acc, x[name], lambda a, b: a + b))
    night = night.withColumns({"n": F.aggregate("c", F.lit(0.0), lambda acc, x: acc + x.n), "s": total("s"), "q": total("q")})
    wide = _each("q", "s", lambda q, s: F.greatest(q / F.col("n") - s * s / (F.col("n") * F.col("n")), F.lit(0.0)))
    night = night.withColumn("wide", F.when(F.col("n") > 0, wide).otherwise(zeros))

    def fitted(x: Column) -> Column:
        mean = F.transform(x.s, lambda s: s / F.greatest(x.n, F.lit(1.0)))
        spread = F.zip_with(F.zip_with(x.q, mean, lambda q, m: F.greatest(q / F.greatest(x.n, F.lit(1.0)) - m * m, F.lit(0.0))), F.col("wide"), lambda v, w: v + share * w + 1e-9)
        base = F.when(x.n > 0, F.log(x.n / F.col("n")) - 0.5 * F.aggregate(spread, F.lit(0.0), lambda acc, v: acc + F.log(v)))
        return F.struct(mean.alias("mean"), F.transform(spread, lambda v: 1 / v).alias("weight"), base.alias("base"))

    return night.select(*NIGHT, F.transform("c", fitted).alias("model"))


def finite(df: DataFrame, features: list[str]) -> DataFrame:
    """Missing and infinite features as 0."""
    return df.withColumns({f: F.when(F.isnan(f) | F.col(f).isNull() | (F.abs(f) == float("inf")), 0.0).otherwise(F.col(f).cast("double")) for f in features})


def night_models(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Per night: ``shift`` per feature, ``model`` of ``night_parameters``, ``trans`` and ``start``, learned from all other nights.

    Two aggregations in all, whatever the number of nights.
    """
    df = finite(df, features)
    # any shift gives the same model; one near the mean keeps the squares small
    means = df.agg(*[F.avg(f).alias(f) for f in features]).first()
    shift = {f: float(round(means[f] or 0.0)) for f in features}
    kept = [*NIGHT, "win", label, *(["fraction_of_night"] if "fraction_of_night" not in features else [])]
    moved = cut_lineage(df.select(*kept, *[(F.col(f) - v).alias(f) for f, v in shift.items()]), "moved")
    tables = decoder_tables(without_own(label_counts(by_night(moved.select(*NIGHT, "win", label, "fraction_of_night")), NIGHT, label))).select(*NIGHT, "trans", "start")
    return night_parameters(moved, features, label).join(tables, NIGHT).withColumn("shift", F.array(*[F.lit(v) for v in shift.values()]))


def score_by_night(df: DataFrame, models: DataFrame, features: list[str]) -> DataFrame:
    """``df`` with ``p0`` to ``p3`` by the model of each window's night, and that night's ``trans`` and ``start``."""
    df = finite(df.drop("p0", "p1", "p2", "p3", "trans", "start", "model", "shift"), features)
    x = F.zip_with(F.array(*features), "shift", lambda a, b: a - b)

    def likelihood(m: Column) -> Column:
        terms = F.zip_with(F.zip_with("_x", m["mean"], lambda a, b: a - b), m["weight"], lambda d, w: d * d * w)
        return m["base"] - 0.5 * F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)

    scored = by_night(df).join(models, NIGHT).withColumn("_x", x).withColumn("_l", F.transform("model", likelihood))
    odds = F.transform("_l", lambda v: F.coalesce(F.exp(v - F.array_max("_l")), F.lit(0.0)))
    scored = scored.withColumn("_e", odds).withColumn("_t", F.aggregate("_e", F.lit(0.0), lambda acc, v: acc + v))
    return scored.withColumns({f"p{k}": F.get("_e", F.lit(k)) / F.col("_t") for k in CLASSES}).drop("_x", "_l", "_e", "_t", "model", "shift")


def leave_one_night_out(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """``df`` with each night's class probabilities by naive Bayes over all other nights, see ``night_models``."""
    return score_by_night(df, night_models(df, features, label), features)


# ------------------------------------------------------------------ gains by coordinates


def tune_gains(df: DataFrame, grids: dict[int, list[float]], order: list[int], rounds: int = 3, accuracy_weight: float = 0.03,
               label: str = "label") -> tuple[list[float], list[dict]]:
    """Class gains that raise the smallest recall, one class at a time, and the steps taken.

    ``df`` has ``p0`` to ``p3``, the gates, the fraction of the night and the columns of ``with_fold_tables``. A step decodes all nights
    under all values of one class's grid in one pass; the best score (smallest recall plus a share of the accuracy) is kept if
    it beats all before, the first value on a tie.
    """
    df = cut_lineage(df, "gains")
    best, gains, steps = -1.0, [1.0, 1.0, 1.0, 1.0], []
    names = [f"g{k}" for k in CLASSES]
    for c in order * rounds:
        tried = [{**dict(zip(names, gains)), f"g{c}": float(v), "candidate": float(i)} for i, v in enumerate(grids[c])]
        scores = gain_scores(joins.sweep(df, tried), accuracy_weight, label)
        found = {int(r["candidate"]): r["score"] for r in scores.collect()}  # one number per value of the grid
        for i, v in enumerate(grids[c]):
            if found.get(i, -1.0) > best:
                best = found[i]
                gains = [float(v) if k == c else g for k, g in enumerate(gains)]
        steps.append({"class": c, "score": best, **dict(zip(names, gains))})
    return gains, steps


def gain_scores(df: DataFrame, accuracy_weight: float = 0.03, label: str = "label") -> DataFrame:
    """``(candidate, score)`` of rows that carry gains ``g0`` to ``g3`` and the number of their candidate."""
    keys = [*NIGHT, "candidate"]
    states = decoding.gain_decode(df, [f"g{k}" for k in CLASSES], "prior", "all_trans", "all_start", keys=keys)
    # swept rows look small to the planner, as packed columns hide them, and a broadcast would take them through the driver
    hits = states.join(df.select(*keys, "win", label).hint("merge"), [*keys, "win"])
    right = F.col("state") == F.col(label)
    counts = [F.count(F.when(F.col(label) == k, 1)).alias(f"n{k}") for k in CLASSES] + [F.count(F.when(right & (F.col(label) == k), 1)).alias(f"h{k}") for k in CLASSES]
    recall = [F.when(F.col(f"n{k}") > 0, F.col(f"h{k}") / F.col(f"n{k}")).otherwise(0.0) for k in CLASSES]
    accuracy = _added([F.col(f"h{k}") for k in CLASSES]) / _added([F.col(f"n{k}") for k in CLASSES])
    return hits.groupBy("candidate").agg(*counts).select("candidate", (F.least(*recall) + accuracy_weight * accuracy).alias("score"))


def night_report(df: DataFrame, states: DataFrame, label: str = "label") -> DataFrame:
    """Windows and share of right ones per night, with the states under another column name beside ``pred``."""
    joined = df.join(states, [*NIGHT, "win"])
    return joined.groupBy(*NIGHT).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("pred") == F.col(label)).cast("double")).alias("raw_accuracy"),
        F.avg((F.col("state") == F.col(label)).cast("double")).alias("accuracy"),
    )


