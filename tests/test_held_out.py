"""Held-out statistics against fits that really leave the night or fold out."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries in their order
from catalog import held_out_queries
from nocturne.operators import decoding
from nocturne.plans import features, held_out, models

RNG = np.random.default_rng(11)


def rows_of(nights=6, steps=40, unlabelled=True):
    rows = []
    for n in range(nights):
        label = 0
        for w in range(steps):
            label = label if RNG.random() < 0.7 else int(RNG.integers(0, 4 if n != 2 else 3))
            x = [float(RNG.normal(label, 1)), float(RNG.normal(800 + 5 * label, 4)), float("nan") if w == 3 else float(RNG.normal())]
            p = RNG.dirichlet(np.ones(4) + 2 * np.eye(4)[label])
            rows.append((n, "n", w, None if unlabelled and w == 7 else label, *x, *map(float, p), float(RNG.random()), float(RNG.random()), w / steps, n % 3))
    return rows


NAMES = ("user_id long, night string, win int, label int, x double, y double, z double, p0 double, p1 double, p2 double, p3 double, "
         "p_awake double, p_rem double, fraction_of_night double, fold int")


@pytest.fixture(scope="module")
def rows():
    return rows_of()


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, NAMES).repartition(3).cache()


def bayes(train, test):
    """Gaussian naive Bayes with the stated smoothing, fitted on the other nights."""
    clean = lambda r: np.nan_to_num(np.array(r[4:7]))
    x, y = np.array([clean(r) for r in train if r[3] is not None]), np.array([r[3] for r in train if r[3] is not None])
    out = []
    for r in test:
        scores = []
        for k in range(4):
            own = x[y == k]
            if not len(own):
                scores.append(-np.inf)
                continue
            v = own.var(axis=0) + 1e-3 * x.var(axis=0) + 1e-9
            scores.append(np.log(len(own) / len(x)) - 0.5 * np.sum(np.log(v) + (clean(r) - own.mean(axis=0)) ** 2 / v))
        e = np.exp(np.array(scores) - max(scores))
        out.append(e / e.sum())
    return out


def test_every_night_is_scored_by_the_other_nights(frame, rows):
    got = {(r.user_id, r.win): [r.p0, r.p1, r.p2, r.p3] for r in held_out.leave_one_night_out(frame, ["x", "y", "z"]).collect()}
    assert len(got) == len(rows)
    for n in range(6):
        test = [r for r in rows if r[0] == n]
        for r, want in zip(test, bayes([r for r in rows if r[0] != n], test)):
            assert got[(n, r[2])] == pytest.approx(want, abs=1e-7)


def test_a_class_only_the_night_itself_has_gets_no_probability(spark):
    rows = [(n, "n", w, 3 if n == 0 and w < 5 else w % 2, float(w % 2), 0.0, 0.0, .25, .25, .25, .25, .5, .5, w / 10, 0) for n in range(3) for w in range(10)]
    got = held_out.leave_one_night_out(spark.createDataFrame(rows, NAMES), ["x", "y"]).where("user_id = 0").collect()
    assert all(r.p3 == 0 and r.p2 == 0 and r.p0 + r.p1 == pytest.approx(1) for r in got)


def pairs(rows, groups, classes):
    n = np.zeros((4, 4))
    for night in {r[0] for r in rows if r[14] in groups}:
        labels = [r[3] for r in rows if r[0] == night and r[3] in classes]
        for a, b in zip(labels, labels[1:]):
            n[a, b] += 1
    return n[np.ix_(classes, classes)]


def test_fold_tables_are_those_of_the_other_folds(frame, rows):
    tables = held_out.decoder_tables(held_out.without_own(held_out.label_counts(frame, ["fold"])))
    for t in tables.collect():
        others = {0, 1, 2} - {t.fold}
        for name, (classes, most, gain) in (("ld", held_out.LIGHT_DEEP), ("ldr", held_out.ASLEEP), ("all", held_out.EVERY)):
            p = pairs(rows, others, list(classes)) + 0.1
            p = p / p.sum(axis=1, keepdims=True)
            for i, a in enumerate(classes):
                stay = min(most, p[i, i] * (1 if a == 0 else gain))
                rest = 1 - p[i, i]
                p[i] *= (1 - stay) / rest
                p[i, i] = stay
            want = np.log(np.clip(p, 1e-10, 1))
            if len(classes) > 2:
                for i, j in itertools.product(range(len(classes)), repeat=2):
                    if (classes[i], classes[j]) in {(2, 3), (3, 2), (0, 2), (2, 0)}:
                        want[i, j] = -20
            assert np.array(t[f"{name}_trans"]) == pytest.approx(want.ravel(), abs=1e-9)
        labels = [r for r in rows if r[14] in others and r[3] is not None]
        share = np.bincount([r[3] for r in labels], minlength=4) / len(labels)
        assert np.exp(t.all_start) == pytest.approx(share)
        for b in range(10):
            here = [r[3] for r in labels if int(r[13] * 10) == b]
            want = np.bincount(here, minlength=4) / len(here) / share if len(here) > 20 else np.ones(4)
            assert t.prior[4 * b : 4 * b + 4] == pytest.approx(want)


def test_decoders_take_one_table_per_night(frame):
    """Named tables give what fixed arrays give on each fold alone."""
    whole = held_out.with_fold_tables(frame).withColumn("awake_target", F.lit(0.3)).cache()
    calls = {
        "ld": lambda df, *t: decoding.cascade_decode(df, 0.8, 0.8, *t), "ldr": lambda df, *t: decoding.hierarchical_decode(df, 0.8, *t), "all": decoding.quota_decode,
    }
    for name, decode in calls.items():
        k = {"ld": 2, "ldr": 3, "all": 4}[name]
        got = {(r.user_id, r.win): r.state for r in decode(whole, "prior", f"{name}_trans", f"{name}_start").collect()}
        for fold in range(3):
            part = whole.where(F.col("fold") == fold)
            t = part.first()
            fixed = decode(part, np.reshape(t.prior, (10, 4)), np.reshape(t[f"{name}_trans"], (k, k)), np.array(t[f"{name}_start"])).collect()
            assert fixed and all(got[(r.user_id, r.win)] == r.state for r in fixed)


def test_gain_search_walks_like_an_exhaustive_one(frame):
    df = held_out.with_fold_tables(frame.where("label is not null"))
    grids, order = {0: [1, 2, 4], 1: [0.8, 1.0], 2: [1, 1.5], 3: [1, 1.3]}, [0, 3, 1, 2]
    gains, steps = held_out.tune_gains(df, grids, order, rounds=2)
    labels = {(r.user_id, r.win): r.label for r in df.collect()}

    def score(g):
        one = df.withColumns({f"g{k}": F.lit(float(v)) for k, v in enumerate(g)})
        states = decoding.gain_decode(one, [f"g{k}" for k in range(4)], "prior", "all_trans", "all_start").collect()
        hit = [(labels[(r.user_id, r.win)], r.state) for r in states]
        recalls = [np.mean([a == b for a, b in hit if a == k]) for k in range(4)]
        return min(recalls) + 0.03 * np.mean([a == b for a, b in hit])

    every = {g: score(g) for g in itertools.product(*(grids[k] for k in range(4)))}
    best, now = -1.0, (1, 1, 1, 1)
    path = []
    for c in order * 2:
        for v in grids[c]:
            g = tuple(v if k == c else now[k] for k in range(4))
            if every[g] > best:
                best, candidate = every[g], g
            else:
                candidate = None
            now = candidate or now
        path.append(best)
    assert gains == pytest.approx(now) and [s["score"] for s in steps] == pytest.approx(path)
    assert all(a <= b for a, b in zip(path, path[1:]))


def test_deployed_night_starts_with_its_own_mean(spark, frame):
    trans = np.full((4, 4), 0.1) + 0.6 * np.eye(4)
    own = decoding.viterbi(frame, trans, None, blend=0.2).collect()
    blended = decoding.context_blend(frame).cache()
    for n in range(6):
        night = blended.where(F.col("user_id") == n)
        mean = np.array(night.agg(*[F.avg(f"p{k}") for k in range(4)]).first())
        fixed = {r.win: r.state for r in decoding.viterbi(night, trans, mean).collect()}
        assert all(fixed[r.win] == r.state for r in own if r.user_id == n)
    rows = frame.withColumn("hours_since_onset", F.col("win") / 30)
    got = models.deployed_stages(rows, trans, 0.9, 0.95, 2).collect()
    assert len(got) == 240 and not any(r.phase == "rem" and r.win < 30 for r in got)


def test_stage_classifier_learns_all_rounds(spark, monkeypatch):
    """The query asks for the rounds and depth of the studied classifier, with checkpoints between them."""
    rows = [(n, "2024-01-01", w, (n + w) % 4, *map(float, RNG.normal((n + w) % 4, 1, len(features.FEATURES_A)))) for n in range(4) for w in range(12)]
    names = "user_id long, night string, win int, label int, " + ", ".join(f"{f} double" for f in features.FEATURES_A)
    table = spark.createDataFrame(rows, names)
    asked, classifier = [], models.GBTClassifier

    def short(**given):
        asked.append((given["maxIter"], given["maxDepth"], given["stepSize"]))
        return classifier(**given | {"maxIter": 2})

    monkeypatch.setattr(models, "GBTClassifier", short)
    monkeypatch.setattr(held_out_queries, "train_and_test", lambda *_: (table.where("user_id > 0"), table.where("user_id = 0")))
    got = held_out_queries.m4(spark, "").collect()
    assert asked == [(300, 3, 0.1)] * 4 and spark.sparkContext.getCheckpointDir()
    assert {r.label: (r.windows, r.proper, r.shared_nights) for r in got} == {k: (3, 3, 0) for k in range(4)}


def test_exchanged_rows_are_scored_as_vectors(spark, frame, monkeypatch):
    """The losses are those of the exchanged columns scored by the whole model; rows carry one array, in tasks of bounded size."""
    names = ["f", "g", "h"]
    seen = frame.where("label < 3").withColumnsRenamed(dict(zip("xyz", names)))
    model = models.fit_stages(seen, names, 3, 3)
    monkeypatch.setattr(models, "PERMUTED", 20)
    losses = models.permutation_importance(model, seen, names)
    text = losses._jdf.queryExecution().optimizedPlan().toString()
    tasks = -(-seen.count() // 20)
    assert "CASE WHEN (feature" not in text and "RepartitionByExpression [user_id" in text and f", {tasks}" in text
    right = F.avg((F.col("pred") == F.col("label")).cast("double"))
    hit = lambda df: models.best_class(models.stage_probabilities(model, df, names))
    base = hit(seen).agg(right).first()[0]
    want = {names[r.feature]: base - r.a for r in hit(models.permuted(models.finite(seen, names), names)).groupBy("feature").agg(right.alias("a")).collect()}
    got = {r.feature: r.importance for r in losses.collect()}
    assert got == want and len(want) == 3 and max(map(abs, want.values())) > 0


def test_exchange_keeps_the_values_of_a_night(frame):
    """Only the named feature moves, within its night, and by the same hash as ever."""
    names = ["x", "y", "z"]
    clean = models.finite(frame, names)
    own = {(r.user_id, r.win): (r.x, r.y, r.z) for r in clean.collect()}
    rows = models.permuted(clean, names).collect()
    assert len(rows) == 3 * len(own)
    for i in range(3):
        for n in range(6):
            night = [r for r in rows if r.feature == i and r.user_id == n]
            assert sorted(r[names[i]] for r in night) == sorted(v[i] for (u, _), v in own.items() if u == n)
            assert all(r[names[j]] == own[n, r.win][j] for r in night for j in range(3) if j != i)
