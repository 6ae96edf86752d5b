import math
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from nocturne.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def buckets(words, size):
    def h(*parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p.encode(), seed)
        return (seed - (1 << 64) if seed >> 63 else seed) % size

    return [h(w) for w in words] + [h(a, b) for a, b in zip(words, words[1:])]


def test_rules_and_scores_agree_with_brute_force(spark, hard):
    labels = spark.createDataFrame([(i, 1 if i in (1, 2, 4, 9) else 0, 0) for i in range(12)] + [(None, 1, 0), (4, 1, None)], "doc_id long, quality int, toxic int")
    rows = hard.select("doc_id", "text").collect()
    size = 64
    raw, target = Counter(), Counter()
    for text in {r.text for r in rows}:
        raw.update(buckets(WORD.findall(text or ""), size))
    for text in {r.text for r in rows if r.doc_id in (1, 2, 4, 9)}:
        target.update(buckets(WORD.findall(text or ""), size))
    weight = [math.log((target[b] + 10) / (target.total() + 10 * size)) - math.log((raw[b] + 10) / (raw.total() + 10 * size)) for b in range(size)]
    got = quality.judge(hard, labels, buckets=size, threshold=-0.05)
    assert got.count() == len(rows)
    want = {}
    for r in rows:
        grams = buckets(WORD.findall(r.text or ""), size)
        score = sum(weight[g] for g in grams) / len(grams) if grams else None
        want.setdefault(str((r.doc_id, r.text)), (brute_rules(r.text), score))
    for r in got.collect():
        rules, score = want[str((r.doc_id, r.text))]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == rules
        assert (r.llr is None) == (score is None) and (score is None or abs(r.llr - score) < 1e-9)
        assert r.kept == (not rules[-1] and score >= -0.05)


def test_clashing_names_and_empty_tables(spark, hard, none):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    clash = hard.withColumn("kept", F.lit(7)).withColumn("llr", F.lit("a")).withColumn("n_words", F.lit("b"))
    kept = quality.keep_good(clash, labels)
    assert kept.columns == clash.columns and kept.where("kept = 7 AND llr = 'a' AND n_words = 'b'").count() == kept.count() > 0
    assert quality.judge(none, labels).count() == 0
    assert quality.judge(hard, labels.limit(0)).where("kept = base_failed").count() == 0


def test_main_path_runs_no_python(spark, hard):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    plan = quality.judge(hard.select("doc_id", "text"), labels)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_every_copy_counts_if_asked(hard):
    corpus = hard.select("doc_id", "text").union(hard.where("doc_id = 1").select("doc_id", "text"))
    target = corpus.where("doc_id in (1, 2)")
    rows, chosen, size = corpus.collect(), target.collect(), 64
    raw, good = Counter(), Counter()
    for counter, found in ((raw, rows), (good, chosen)):
        for r in found:
            counter.update(buckets(WORD.findall(r.text or ""), size))
    want = [math.log((good[b] + 10) / (good.total() + 10 * size)) - math.log((raw[b] + 10) / (raw.total() + 10 * size)) for b in range(size)]
    got = quality.weights(corpus, target, buckets=size, copies=True).first().weights
    assert max(abs(a - b) for a, b in zip(got, want)) < 1e-9
    assert got != quality.weights(corpus, target, buckets=size).first().weights
