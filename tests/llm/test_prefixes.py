import numpy as np
import pytest

from nocturne.llm import prefixes, simhash, work

from .conftest import edited, prose
from .test_simhash import classes, jaccard


def leaders(spark, texts, **kwargs):
    df = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    return {r.doc_id: r.leader for r in simhash.similar_leaders(df, **kwargs).collect()}


def brute(texts):
    linked = [(a, b) for a in texts for b in texts if a < b and jaccard(texts[a], texts[b]) >= 0.8]
    return {d: k for d, k in classes(texts, linked).items() if d != k}


@pytest.mark.parametrize("crowd", [2, 64])
def test_large_families_are_whole(spark, crowd):
    base = prose(700, 343)
    texts = {i: edited(base, 800 + i, 0.012) for i in range(140)}
    assert leaders(spark, texts, crowd=crowd) == brute(texts)


def test_texts_with_a_block_added_cut_or_exchanged_are_linked(spark):
    texts = {}
    for g in range(12):
        words = prose(900 + g, 300).split()
        extra = prose(950 + g, 70).split()
        texts |= {40 * g + k: " ".join(w) for k, w in enumerate([words, words + extra]) if g % 4 == 0}
        texts |= {40 * g + k: " ".join(w) for k, w in enumerate([words, words[:246]]) if g % 4 == 1}
        texts |= {40 * g + k: " ".join(w) for k, w in enumerate([words, words[:120] + extra[:28] + words[148:]]) if g % 4 == 2}
        texts |= {40 * g + k: " ".join(w) for k, w in enumerate([words, words[:150] + extra[:60] + words[150:]]) if g % 4 == 3}
    found = leaders(spark, texts)
    assert found == brute(texts) and len(found) == 12


def test_near_copies_meet_although_their_first_document_is_unlike_both(spark):
    words = prose(990, 200).split()
    swapped = words[:100] + [words[101], words[100]] + words[102:]
    texts = {1: " ".join(sorted(words)), 2: " ".join(words), 3: " ".join(swapped)}
    assert brute(texts) == {3: 2} and leaders(spark, texts) == {3: 2}


@pytest.mark.parametrize("least", [0.8, 0.4])
def test_parity_bits_rule_out_no_similar_pair(spark, least):
    r = np.random.default_rng(3)
    sets = []
    for n in (1, 3, 60, 64, 70, 300):
        base = r.integers(0, 1 << 63, n).astype(np.uint64)
        sets += [np.unique(np.concatenate((base[: n - out], r.integers(0, 1 << 63, more).astype(np.uint64)))) for out in (0, n // 9, n // 3) for more in (0, n // 9, n // 2)]
    rows = [(i, len(s), prefixes.parity(s).tolist()) for i, s in enumerate(sets)]
    heads = spark.createDataFrame(rows, "node long, size int, bits array<long>")
    pairs = [(i, j) for i in range(len(sets)) for j in range(i)]
    got = {tuple(x) for x in prefixes._close(spark.createDataFrame(pairs, "u long, v long"), heads, least).collect()}
    similar = {(i, j) for i, j in pairs if len(np.intersect1d(sets[i], sets[j])) >= least * len(np.union1d(sets[i], sets[j]))}
    assert similar <= got and len(got) < len(pairs) / 2


def test_unlike_sets_at_one_shingle_make_no_pairs(spark):
    r = np.random.default_rng(5)
    near = r.integers(0, 1 << 63, 200).astype(np.uint64)
    sets = [r.integers(0, 1 << 63, 200).astype(np.uint64) for _ in range(150)] + [near, np.append(near[:195], r.integers(0, 1 << 63, 5).astype(np.uint64))]
    heads = spark.createDataFrame([(i, prefixes.parity(s).tolist()) for i, s in enumerate(sets)], "node long, sketch array<long>")
    left = spark.createDataFrame([(i, 200, 0, 7, i) for i in range(len(sets))], "node long, size int, pos int, gram long, root long")
    assert [tuple(x) for x in prefixes._unconnected(left, heads, 0.8).collect()] == [(151, 150)]


def test_narrow_tables_have_few_files(spark):
    df = spark.range(5000).repartition(200)
    found = work.table(df, "narrow", narrow=True)
    assert len(found.inputFiles()) <= max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8) < 200
    assert sorted(r.id for r in found.collect()) == list(range(5000))
