"""Stage and score models with night-wise validation (M4-M14, IO17)."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nocturne.operators import decoding, evaluate, sequence
from nocturne.operators.joins import sweep
from nocturne.operators.nights import NIGHT
from nocturne.operators.positions import tasks_for
from nocturne.operators.window_stats import NIGHT_WIN
from nocturne.session import work_folder

# Class weights of the four stages.
CLASS_WEIGHTS = {0: 6.0, 1: 1.0, 2: 3.0, 3: 2.0}


def class_weight(label: Column, weights: dict[int, float] = CLASS_WEIGHTS) -> Column:
    out = F.lit(1.0)
    for k, w in weights.items():
        out = F.when(label == k, w).otherwise(out)
    return out


def assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="x", handleInvalid="keep")


def finite(df: DataFrame, features: list[str]) -> DataFrame:
    """Missing and infinite features as 0."""
    clean = {
        f: F.when(F.isnan(f) | F.col(f).isNull() | (F.abs(f) == float("inf")), 0.0).otherwise(F.col(f).cast("double"))
        for f in features
    }
    return df.withColumns(clean)


def fit_stages(train: DataFrame, features: list[str], trees: int = 20, depth: int = 5) -> PipelineModel:
    """Four-class forest with class weights."""
    data = finite(train, features).withColumn("w", class_weight(F.col("label")))
    model = RandomForestClassifier(
        featuresCol="x", labelCol="label", weightCol="w", numTrees=trees, maxDepth=depth, seed=42, probabilityCol="p"
    )
    return Pipeline(stages=[assembler(features), model]).fit(data)


def fit_boosted(train: DataFrame, features: list[str], rounds: int = 300, depth: int = 3, classes: tuple[int, ...] = (0, 1, 2, 3)) -> dict[int, PipelineModel]:
    """Boosted trees for each class against the rest, windows weighted by class; the fits run side by side.

    Rounds, depth and step are those of the studied classifier. A class that the training windows lack, or that
    all of them have, gets no model. Errors of the rounds are checkpointed, else their lineage grows with every tree.
    """
    if train.sparkSession.sparkContext.getCheckpointDir() is None:
        train.sparkSession.sparkContext.setCheckpointDir(work_folder(train.sparkSession, "rounds"))
    data = finite(train, features).withColumn("w", class_weight(F.col("label"))).cache()
    seen = {r.label for r in data.select("label").distinct().collect()}  # four at most

    def fit(k: int) -> PipelineModel:
        model = GBTClassifier(featuresCol="x", labelCol="y", weightCol="w", maxIter=rounds, maxDepth=depth, seed=42, stepSize=0.1)
        return Pipeline(stages=[assembler(features), model]).fit(data.withColumn("y", (F.col("label") == k).cast("double")))

    wanted = [k for k in classes if k in seen and len(seen) > 1]
    fitted = dict(zip(wanted, side_by_side([lambda k=k: fit(k) for k in wanted])))
    data.unpersist()
    return fitted


def side_by_side(jobs: list) -> list:
    """Results of independent fits, submitted together so that their Spark jobs share the cluster."""
    if not jobs:
        return []
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(job)) for job in jobs]]


def boosted_probabilities(fitted: dict[int, PipelineModel], df: DataFrame, features: list[str]) -> DataFrame:
    """Columns ``p0`` to ``p3``: the one-against-rest probabilities as shares; classes without a model get none."""
    scored = finite(df, features)
    for k in range(4):
        if k in fitted:
            scored = gate_probability(fitted[k], scored, features, f"p{k}")
        else:
            scored = scored.withColumn(f"p{k}", F.lit(0.0))
    total = F.col("p0") + F.col("p1") + F.col("p2") + F.col("p3")
    return scored.withColumn("_t", total).withColumns({f"p{k}": F.when(F.col("_t") > 0, F.col(f"p{k}") / F.col("_t")).otherwise(0.25) for k in range(4)}).drop("_t")


def fit_gate(train: DataFrame, features: list[str], target: int, weight: float, rounds: int = 10,
             depth: int = 4) -> PipelineModel:
    """Boosted trees for one stage against the rest with a positive weight."""
    positive = F.col("label") == target
    data = finite(train, features).withColumns(
        {"y": positive.cast("double"), "w": F.when(positive, weight).otherwise(1.0)}
    )
    model = GBTClassifier(featuresCol="x", labelCol="y", weightCol="w", maxIter=rounds, maxDepth=depth, seed=42, stepSize=0.1)
    return Pipeline(stages=[assembler(features), model]).fit(data)


def fit_score(train: DataFrame, features: list[str], target: str, rounds: int = 20, depth: int = 3) -> PipelineModel:
    """Scaled features and boosted regression trees for a daily score."""
    stages = [
        assembler(features), StandardScaler(inputCol="x", outputCol="z", withMean=True),
        GBTRegressor(featuresCol="z", labelCol=target, maxIter=rounds, maxDepth=depth, seed=42, stepSize=0.1),
    ]
    return Pipeline(stages=stages).fit(finite(train.where(F.col(target).isNotNull()), features))


def fit_bayes(train: DataFrame, features: list[str]) -> PipelineModel:
    """Gaussian naive Bayes as a weak stand-in classifier."""
    model = NaiveBayes(featuresCol="x", labelCol="label", modelType="gaussian", probabilityCol="p")
    return Pipeline(stages=[assembler(features), model]).fit(finite(train, features))


def stage_probabilities(model: PipelineModel, df: DataFrame, features: list[str], classes: int = 4) -> DataFrame:
    """Columns ``p0`` to ``p3``; classes the model has not seen get a small probability."""
    return class_probabilities(model, finite(df, features), classes)


def class_probabilities(model: PipelineModel | Transformer, df: DataFrame, classes: int = 4) -> DataFrame:
    """``stage_probabilities`` by a model, or the last stage of one, from the columns it takes as they are."""
    scored = model.transform(df).withColumn("_a", vector_to_array("p"))
    probs = {f"p{k}": F.coalesce(F.get("_a", F.lit(k)), F.lit(1e-10)) for k in range(classes)}
    return scored.withColumns(probs).drop("_a", "x", "p", "rawPrediction", "prediction")


def gate_probability(model: PipelineModel, df: DataFrame, features: list[str], out: str) -> DataFrame:
    scored = model.transform(finite(df, features))
    return scored.withColumn(out, F.get(vector_to_array("probability"), F.lit(1))).drop(
        "x", "rawPrediction", "probability", "prediction"
    )


def night_fold(folds: int, keys: list[str] = NIGHT) -> Column:
    """Fold of a night by hash, the same for all its windows."""
    return F.pmod(F.xxhash64(*keys), F.lit(folds)).cast("int")


def out_of_fold(df: DataFrame, features: list[str], folds: int = 3, trees: int = 10, rounds: int = 5) -> DataFrame:
    """Stage and gate probabilities of every window by models that never saw its night."""
    folded = df.withColumn("fold", night_fold(folds))
    parts = []
    for k in range(folds):
        train, test = folded.where(F.col("fold") != k), folded.where(F.col("fold") == k)
        scored = stage_probabilities(fit_stages(train, features, trees), test, features)
        scored = gate_probability(fit_gate(train, features, 0, 12.0, rounds), scored, features, "p_awake")
        parts.append(gate_probability(fit_gate(train, features, 3, 4.0, rounds), scored, features, "p_rem"))
    return reduce(DataFrame.unionByName, parts)


def mean_ensemble(predictions: list[DataFrame], keys: list[str] = NIGHT_WIN) -> DataFrame:
    """Average of the class probabilities of several models."""
    both = reduce(DataFrame.unionByName, [p.select(*keys, "label", *[f"p{k}" for k in range(4)]) for p in predictions])
    return both.groupBy(*keys, "label").agg(*[F.avg(f"p{k}").alias(f"p{k}") for k in range(4)])


def best_class(df: DataFrame, out: str = "pred") -> DataFrame:
    best = F.array_max(F.array(*[F.struct(F.col(f"p{k}").alias("p"), F.lit(-k).alias("r"), F.lit(k).alias("k")) for k in range(4)]))
    return df.withColumn(out, best["k"])


def impurity_importance(model: PipelineModel, features: list[str], spark: SparkSession) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double")


def permuted(df: DataFrame, features: list[str], seed: int = 42) -> DataFrame:
    """Every window once per feature (``feature``, its number), that feature's value taken from another window of its night.

    The windows of a night are numbered twice, by ``win`` and, for each feature, by a seeded hash: the value
    moves from one number to the other, so each feature keeps its values within a night. Bounded by the windows of a night.
    """
    moved = permuted_arrays(df, features, seed)
    return moved.select(*NIGHT_WIN, "label", "feature", *[F.get("x", F.lit(i)).alias(f) for i, f in enumerate(features)])


def permuted_arrays(df: DataFrame, features: list[str], seed: int = 42) -> DataFrame:
    """``permuted`` with the features of a row as one array ``x``: a window has as many rows as features, so columns for each would cost most."""
    row = F.struct("win", "label", F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    nights = df.groupBy(*NIGHT).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    number = F.sequence(F.lit(0), F.lit(len(features) - 1))
    mixed = lambda i: F.transform(F.array_sort(F.transform("rows", lambda r: F.struct(F.xxhash64(F.lit(seed), i, r.win).alias("h"), F.get(r.x, i).alias("v")))), lambda s: s.v)
    nights = nights.withColumn("moved", F.transform(number, mixed))
    windows = nights.select(*NIGHT, "moved", F.posexplode("rows").alias("at", "r"))
    other = windows.select(*NIGHT, "r.*", F.transform("moved", lambda m: F.get(m, F.col("at"))).alias("other"))
    one = other.select(*NIGHT_WIN, "label", "x", F.posexplode("other").alias("feature", "v"))
    i = F.col("feature")
    x = F.concat(F.slice("x", F.lit(1), i), F.array("v"), F.slice("x", i + 2, F.lit(len(features))))
    return one.select(*NIGHT_WIN, "label", "feature", x.alias("x"))


PERMUTED = 5_000  # windows of a task that scores each of them once per feature


def permutation_importance(model: PipelineModel, df: DataFrame, features: list[str], seed: int = 42) -> DataFrame:
    """Accuracy lost for every feature when its values are exchanged within the nights; all features are scored in one pass.

    The exchanged rows go as vectors to the classifier, the last stage of the model.
    """
    right = F.avg((F.col("pred") == F.col("label")).cast("double"))
    base, rows = best_class(stage_probabilities(model, df, features)).agg(right.alias("base"), F.count(F.lit(1))).first()
    dealt = finite(df, features).repartition(tasks_for(df.sparkSession, rows, PERMUTED), *NIGHT)
    moved = permuted_arrays(dealt, features, seed).withColumn("x", array_to_vector("x"))
    scored = best_class(class_probabilities(model.stages[-1], moved)).groupBy("feature").agg(right.alias("accuracy"))
    names = F.array(*[F.lit(f) for f in features])
    return scored.select(F.get(names, F.col("feature")).alias("feature"), (F.lit(base) - F.col("accuracy")).alias("importance"))


def bake_off(train: DataFrame, test: DataFrame, features: list[str], trees: int = 10, rounds: int = 3) -> dict[str, DataFrame]:
    """Held-out class probabilities per model, and ``ensemble``, their mean. The fits run side by side on the same written rows."""
    forest, bayes, boosted = side_by_side([
        lambda: fit_stages(train, features, trees), lambda: fit_bayes(train, features), lambda: fit_boosted(train, features, rounds, 3),
    ])
    scored = {
        "forest": stage_probabilities(forest, test, features), "bayes": stage_probabilities(bayes, test, features),
        "boosted": boosted_probabilities(boosted, test, features),
    }
    return scored | {"ensemble": mean_ensemble(list(scored.values()))}


def bake_off_report(scored: dict[str, DataFrame]) -> DataFrame:
    """One classification report with a row for each model and class."""
    marked = [best_class(df).select(F.lit(name).alias("model"), *NIGHT_WIN, "label", "pred") for name, df in scored.items()]
    return evaluate.classification_report(reduce(DataFrame.unionByName, marked), by=["model"])


def threshold_sweep(df: DataFrame, taus: list[float], protects: list[float]) -> DataFrame:
    """Report of the gate override for every threshold pair, best minimum recall first."""
    swept = sweep(best_class(df), [{"tau": t, "protect": r} for t in taus for r in protects])
    sure = (F.col("p_awake") >= F.col("tau")) & ((F.col("pred") != 3) | (F.col("p_awake") >= F.col("protect")))
    fixed = swept.withColumn("pred", F.when(sure, 0).otherwise(F.col("pred")))
    return evaluate.classification_report(fixed, by=["tau", "protect"])


def gain_sweep(df: DataFrame, gains: list[dict[str, float]]) -> DataFrame:
    """Report of the argmax under class gains ``g0`` to ``g3``."""
    swept = sweep(df, gains)
    scaled = swept.withColumns({f"p{k}": F.col(f"p{k}") * F.col(f"g{k}") for k in range(4)})
    return evaluate.classification_report(best_class(scaled), by=[f"g{k}" for k in range(4)])


def score_sweep(days: DataFrame, grid: list[dict[str, float]]) -> DataFrame:
    """Mean absolute error of the calibrated recovery for weight sets (normalised)."""
    from nocturne.functions.scalars import clamp, sigmoid100

    s = sweep(days, grid)
    total = F.col("w_hrv") + F.col("w_rhr") + F.col("w_sleep") + F.col("w_resp")
    w = {k: F.col(k) / total for k in ("w_hrv", "w_rhr", "w_sleep", "w_resp")}
    raw = (
        w["w_hrv"] * sigmoid100(F.col("hrv") / 90.0, F.col("slope"), F.col("center"))
        + w["w_rhr"] * clamp(50 + (55.0 - F.col("rhr")) * F.col("rhr_scale"), 0.0, 100.0)
        + w["w_sleep"] * F.least(F.lit(100.0), F.col("sleep"))
        + w["w_resp"] * (100 - F.greatest(F.lit(0.0), (F.col("resp") - 16) * 3))
    )
    score = clamp(F.bround(raw, 0), 0.0, 100.0)
    names = list(grid[0])
    return s.groupBy(*names).agg(F.avg(F.abs(score - F.col("official_recovery"))).alias("mae"))


def transition_arrays(df: DataFrame, label: str = "label") -> tuple[np.ndarray, np.ndarray]:
    """Transition matrix and first-class probabilities: sixteen and four numbers."""
    trans = np.zeros((4, 4))
    for r in evaluate.transition_probabilities(evaluate.transition_counts(df, label)).collect():
        trans[r["a"], r["b"]] = r["p"]
    first = np.zeros(4)
    for r in evaluate.class_shares(df, label).collect():
        first[r["k"]] = r["p_first"]
    return trans, first


def save_model(model: PipelineModel, transitions: DataFrame, path: str) -> None:
    """Fitted model and transition table below one path."""
    model.write().save(f"{path}/model")
    transitions.write.parquet(f"{path}/transitions")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/transitions")


def deployed_stages(probabilities: DataFrame, trans: decoding.Table, tau: float = 0.3, rem_protect: float = 0.6, bridge: int = 2) -> DataFrame:
    """Stages of whole nights as a deployed model predicts them.

    ``probabilities`` has ``p0`` to ``p3``, ``p_awake`` and ``hours_since_onset``. They are blended, and the Viterbi path of a night starts
    with the mean of its own probabilities. Then come the architecture rules by window time, the awake gate and the bridge.
    """
    from nocturne.functions.scalars import stage_name

    path = decoding.viterbi(probabilities, trans, None, blend=0.2)
    timed = path.join(probabilities.select(*NIGHT_WIN, "hours_since_onset"), NIGHT_WIN)
    ruled = sequence.architecture_rules(timed.withColumn("phase", stage_name(F.col("state"))))
    gated = ruled.join(probabilities.select(*NIGHT_WIN, "p_awake"), NIGHT_WIN)
    return sequence.gate_override(gated, tau, rem_protect, bridge=bridge)
