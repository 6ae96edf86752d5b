"""Grouped decoders and spectra against straightforward loops."""

import itertools

import numpy as np
import pytest

from nocturne.operators import decoding, sequence, spectral

RNG = np.random.default_rng(7)
TRANS = np.array([[0.7, 0.1, 0.1, 0.1], [0.1, 0.7, 0.1, 0.1], [0.05, 0.1, 0.8, 0.05], [0.1, 0.1, 0.05, 0.75]])
INIT = np.array([0.4, 0.3, 0.2, 0.1])


def frame(spark, nights=6, steps=30):
    rows = []
    for n in range(nights):
        for w in range(steps):
            p = RNG.dirichlet(np.ones(4))
            rows.append((n, "n", w, *map(float, p), float(RNG.random()), float(RNG.random()), w / steps, 0.25))
    names = "user_id long, night string, win int, p0 double, p1 double, p2 double, p3 double, p_awake double, p_rem double, fraction_of_night double, awake_target double"
    return spark.createDataFrame(rows, names), rows


def test_viterbi_is_the_best_of_all_paths(spark):
    df, rows = frame(spark, 3, 6)
    got = {}
    for r in decoding.viterbi(df, TRANS, INIT).collect():
        got.setdefault(r["user_id"], {})[r["win"]] = r["state"]
    for n in range(3):
        p = np.log([r[3:7] for r in rows if r[0] == n])

        def score(path):
            return np.log(INIT[path[0]]) + sum(p[i][s] for i, s in enumerate(path)) + sum(np.log(TRANS[a, b]) for a, b in zip(path, path[1:]))

        best = max(itertools.product(range(4), repeat=6), key=score)
        assert [got[n][i] for i in range(6)] == list(best)


def blend(p):
    p = p.copy()
    for i in range(1, len(p)):
        p[i] = 0.8 * p[i] + 0.2 * p[max(0, i - 3):i].mean(0)
    return p / p.sum(1, keepdims=True)


def slow_path(e, lt, li):
    best = {s: (li[s] + e[0][s], [s]) for s in range(len(li))}
    for row in e[1:]:
        best = {j: max(((best[i][0] + lt[i][j] + row[j], best[i][1] + [j]) for i in best), key=lambda x: x[0]) for j in best}
    return max(best.values(), key=lambda x: x[0])[1]


def slow_floor(path, floors, mode, light):
    path = list(path)
    for state, least in floors.items():
        i = 0
        while i < len(path):
            j = i
            while j < len(path) and path[j] == path[i]:
                j += 1
            if path[i] == state and j - i < least:
                before = path[i - 1] if i else light
                after = path[j] if j < len(path) else light
                path[i:j] = [before if mode == "before" or before == after else light] * (j - i)
            i = j
    return path


def test_cascade_and_hierarchy(spark):
    df, rows = frame(spark)
    prior = 0.5 + RNG.random((10, 4))
    l2, l3 = np.log([[0.8, 0.2], [0.3, 0.7]]), np.log([[0.8, 0.1, 0.1], [0.2, 0.7, 0.1], [0.2, 0.1, 0.7]])
    i2, i3 = np.log([0.6, 0.4]), np.log([0.5, 0.3, 0.2])
    cascade = {(r["user_id"], r["win"]): r["state"] for r in decoding.cascade_decode(df, 0.7, 0.6, prior, l2, i2).collect()}
    tree = {(r["user_id"], r["win"]): r["state"] for r in decoding.hierarchical_decode(df, 0.7, prior, l3, i3).collect()}
    for n in range(6):
        mine = [r for r in rows if r[0] == n]
        p = np.array([r[3:7] for r in mine])
        pa, pr, f = (np.array([r[k] for r in mine]) for k in (7, 8, 9))
        b = np.clip((f * 10).astype(int), 0, 9)
        out = [0 if a >= 0.7 else 3 if q >= 0.6 else None for a, q in zip(pa, pr)]
        rest = [i for i, o in enumerate(out) if o is None]
        post = p[rest][:, 1:3]
        post = post / post.sum(1, keepdims=True) * prior[b[rest]][:, 1:3] ** 0.6
        path = slow_path(np.log(blend(post / post.sum(1, keepdims=True))), l2, i2)
        for i, s in zip(rest, path):
            out[i] = s + 1
        assert [cascade[n, i] for i in range(len(out))] == slow_floor(out, {2: 4, 3: 3}, "before", 1)
        post = p[:, 1:4].copy()
        post[:, 2] = 0.4 * post[:, 2] + 0.6 * pr
        post = post / post.sum(1, keepdims=True) * prior[b][:, 1:4] ** 0.6
        path = slow_floor(slow_path(np.log(blend(post / post.sum(1, keepdims=True))), l3, i3), {1: 4, 2: 3}, "agree", 0)
        assert [tree[n, i] for i in range(len(out))] == [0 if a >= 0.7 else s + 1 for a, s in zip(pa, path)]


def test_quota_search(spark):
    df, rows = frame(spark, 4, 60)
    prior = 0.5 + RNG.random((10, 4))
    lt, li = np.log(TRANS), np.log(INIT)
    got = {(r["user_id"], r["win"]): r["state"] for r in decoding.quota_decode(df, prior, lt, li).collect()}
    for n in range(4):
        mine = [r for r in rows if r[0] == n]
        p = np.array([r[3:7] for r in mine])
        pa, pr, f = (np.array([r[k] for r in mine]) for k in (7, 8, 9))
        p[:, 0], p[:, 3] = 0.4 * p[:, 0] + 0.6 * pa, 0.4 * p[:, 3] + 0.6 * pr
        p = p / p.sum(1, keepdims=True) * prior[np.clip((f * 10).astype(int), 0, 9)] ** 0.6
        lo, hi = 0.3, 40.0
        for _ in range(14):
            g = (lo * hi) ** 0.5
            q = p * np.array([g, 0.8, 1.0, 1.0])
            path = slow_floor(slow_path(np.log(blend(q / q.sum(1, keepdims=True))), lt, li), {2: 4, 3: 3}, "agree", 1)
            share = path.count(0) / len(path)
            if abs(share - 0.25) < 0.01:
                break
            lo, hi = (g, hi) if share < 0.25 else (lo, g)
        assert [got[n, i] for i in range(len(path))] == path


def test_floor_runs(spark):
    names = ["awake", "light", "deep", "rem"]
    seqs = [[names[k] for k in RNG.integers(0, 4, 40)] for _ in range(5)]
    rows = [(n, "n", i, s) for n, seq in enumerate(seqs) for i, s in enumerate(seq)]
    df = spark.createDataFrame(rows, "user_id long, night string, win int, phase string")
    for mode in ("agree", "before"):
        got = {(r["user_id"], r["win"]): r["phase"] for r in sequence.floor_runs(df, mode=mode).collect()}
        for n, seq in enumerate(seqs):
            assert [got[n, i] for i in range(40)] == slow_floor(seq, {"deep": 4, "rem": 3}, mode, "light")


@pytest.mark.parametrize("segment", [64, 65])
def test_welch_against_the_definition(segment):
    x = RNG.normal(size=200)
    freq, power = spectral.welch(x, segment)
    hop, parts = segment - segment // 2, []
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / segment)
    for s in range(0, len(x) - segment + 1, hop):
        y = (x[s:s + segment] - x[s:s + segment].mean()) * hann
        spec = np.array([abs(sum(y * np.exp(-2j * np.pi * k * np.arange(segment) / segment))) ** 2 for k in range(segment // 2 + 1)])
        spec = spec / (4.0 * (hann**2).sum())
        last = segment // 2 if segment % 2 == 0 else segment // 2 + 1
        spec[1:last] *= 2
        parts.append(spec)
    assert power == pytest.approx(np.mean(parts, axis=0))
    assert freq[1] == pytest.approx(4.0 / segment)


def test_ectopic_beats_repeat_the_last_kept(night_frame):
    from nocturne.operators.series import drop_ectopic

    rr = [float(v) for v in RNG.integers(600, 1200, 50)]
    got = [r["clean_ms"] for r in drop_ectopic(night_frame([60] * 50, rr)).orderBy("timestamp").collect()]
    kept = [rr[0]]
    for v in rr[1:]:
        kept.append(v if abs(v - kept[-1]) / kept[-1] < 0.2 else kept[-1])
    assert got == kept


def test_blocks_of_nights_hold_a_bounded_number_of_windows():
    sizes = np.array([3, 40, 0, 7, 7, 7, 900, 1])
    cut = decoding.blocks(sizes, 50)
    assert [i for b in cut for i in range(b.start, b.stop)] == list(range(8))
    assert all(sizes[b].max() * len(sizes[b]) <= 50 or len(sizes[b]) == 1 for b in cut) and decoding.blocks(sizes[:0], 50) == []


def test_a_batch_of_many_nights_is_decoded_in_blocks_with_the_same_states(spark, monkeypatch):
    df, _ = frame(spark, 40, 12)
    df = df.coalesce(1)
    prior, lt, li = 0.5 + RNG.random((10, 4)), np.log(TRANS), np.log(INIT)
    seen = spark.sparkContext.accumulator(0)
    whole = sorted(map(tuple, decoding.quota_decode(df, prior, lt, li).collect()))
    monkeypatch.setattr(decoding, "BLOCK", 60)
    posterior = decoding.gated_posterior

    def counted(n, *args):
        assert n.used.size <= 60
        seen.add(1)
        return posterior(n, *args)

    monkeypatch.setattr(decoding, "gated_posterior", counted)
    assert sorted(map(tuple, decoding.quota_decode(df, prior, lt, li).collect())) == whole and len(whole) == 480


def test_the_gain_search_takes_no_windows_through_the_driver(spark):
    from pyspark.sql import functions as F

    from nocturne.operators import joins
    from nocturne.plans import held_out

    df, rows = frame(spark, 3, 8)
    array = lambda values: F.array(*[F.lit(float(v)) for v in np.ravel(values)])
    df = df.withColumns({"label": F.col("win") % 4, "prior": array(np.ones((10, 4))), "all_trans": array(np.log(TRANS)), "all_start": array(np.log(INIT))})
    tried = [{"g0": g, "g1": 1.0, "g2": 1.0, "g3": 1.0, "candidate": float(i)} for i, g in enumerate((1, 3))]
    scores = held_out.gain_scores(joins.sweep(df, tried))
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    got = {r.candidate: r.score for r in scores.collect()}
    for i, g in enumerate((1.0, 3.0)):
        one = df.withColumns({"g0": F.lit(g), **{f"g{k}": F.lit(1.0) for k in (1, 2, 3)}})
        states = {(r[0], r[2]): r[3] for r in decoding.gain_decode(one, ["g0", "g1", "g2", "g3"], "prior", "all_trans", "all_start").collect()}
        right = [states[r[0], r[2]] == r[2] % 4 for r in rows]
        recall = [np.mean([x for x, r in zip(right, rows) if r[2] % 4 == k]) for k in range(4)]
        assert got[float(i)] == pytest.approx(min(recall) + 0.03 * np.mean(right))
