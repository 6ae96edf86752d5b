import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nocturne.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n, seed=1, size=6, labels=3):
    """Clustered vectors by label, some close to another label's cluster."""
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(size)] for _ in range(labels)]
    rows = []
    for i in range(n):
        label = r.randrange(labels)
        mix = r.random()
        other = centres[r.randrange(labels)]
        rows.append((i, [float(np.float32(mix * c + (1 - mix) * o + r.gauss(0, 0.2))) for c, o in zip(centres[label], other)], label))
    return rows


def brute(rows, every=100, positives=5, negatives_=10):
    def whole(row):
        return row[2] is not None and row[1] is not None and all(x is not None and math.isfinite(x) for x in row[1])

    rows = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in filter(whole, rows)]
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for at, (anchor, v, label) in enumerate(rows):
        if anchor is None or anchor % every:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), i, other) for k, (i, w, other) in enumerate(rows) if k != at]
        for p, positive, _ in sorted((x for x in scored if x[2] == label), key=key)[:positives]:
            fit = sorted((x for x in scored if x[2] != label and 30 * p <= 100 * x[0] <= 90 * p), key=key)[:negatives_]
            out += [(anchor, positive, rank, i, p, s) for rank, (s, i, _) in enumerate(fit, 1)]
    return Counter(out)


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit(1)).withColumn("anchor", F.lit("x")).withColumn("v", F.lit(0))
    return Counter(map(tuple, negatives.hard_negatives(df.repartition(3), **more).collect()))


def test_like_brute_force(spark):
    rows = vectors(400)
    want = brute(rows, every=20)
    assert len(want) > 200 and found(spark, rows, every=20) == want
    assert found(spark, rows, every=20, rows_per_block=50, anchors_per_block=7, references=3, sample=9) == want


def test_nulls_ties_copies_and_lengths(spark):
    rows = vectors(120, 5)
    bad = [(300, None, 1), (301, [1.0] * 6, None), (302, [1.0, None, 0.0], 1), (303, [float("nan")] * 6, 1), (304, [float("inf")] * 6, 2), (400, [math.inf] * 6, 2)]
    odd = [(None, rows[0][1], rows[0][2]), (None, rows[1][1], 2), (500, [], 0), (501, [0.0] * 6, 1), (600, [0.0] * 6, 0), (700, [2.0], 1), rows[0], rows[0], rows[20], rows[7]]
    ties = [(800 + i, rows[3][1], (rows[3][2] + i % 2) % 3) for i in range(40)]
    again = [(0, rows[9][1], rows[9][2]), (0, rows[0][1], (rows[0][2] + 1) % 3)]
    every = rows + bad + odd + ties + again
    random.Random(2).shuffle(every)
    assert found(spark, every, every=20) == brute(every, every=20)


def test_few_rows_and_none(spark):
    assert found(spark, []) == Counter()
    assert found(spark, vectors(1)) == Counter()
    assert found(spark, vectors(3)) == brute(vectors(3))
    assert found(spark, [(1, [1.0], 1), (None, [1.0], 2)]) == Counter()


def test_bounds_hold_every_score_and_leave_pairs_out():
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 24))
    x = np.floor(256 * (centres[r.integers(0, 12, 600)] + r.normal(scale=0.05, size=(600, 24))))
    x[5] = 0
    x[6] = 3 * x[7]
    refs = negatives.directions(x[:100], 12)
    found_angles, norms = negatives.angles(x, refs), np.linalg.norm(x, axis=1)
    low, high = negatives.bounds(found_angles, norms, found_angles, norms)
    exact = x @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    wanted = negatives.wanted_best(low, high, 5)
    best = np.sort(exact, axis=1)[:, -5:].min(axis=1)
    assert (wanted | (exact < best[:, None])).all()
    assert wanted.mean() < 0.25


def test_scores_are_exact_where_doubles_are_not(spark):
    big = [(0, [2.0**20 + 1] * 3, 1), (1, [2.0**20] * 3, 1), (2, [2.0**19 + 1, 2.0**19, 2.0**19], 2)]
    assert found(spark, big) == brute(big)
    with pytest.raises(Exception, match="overflow|do not fit into a long"):
        found(spark, [(0, [2.0**30] * 3, 1), (1, [2.0**30] * 3, 1)])
