import numpy as np
from pyspark.sql import functions as F

from nocturne.llm import language

from .conftest import prose

OTHER = "que la de ción os ar ie ado mente ñ".split()


def corpus(spark):
    rows = [(i, prose(i, 60 + i % 50, OTHER if i % 2 else None or ["th", "er", "ing", "and", "of"]), "es" if i % 2 else "en", "s", 1) for i in range(200)]
    rows += [(900, None, "en", "s", 1), (901, "123 !?", "es", "s", 1), (902, "", None, "s", 1), (None, prose(3, 80, OTHER), "en", "s", 1), (904, "é" * 9000, None, "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_held_out_accuracy_and_edge_cases(spark):
    df = corpus(spark).withColumn("score", F.lit("x")).withColumn("held_out", F.lit(3))
    got = {r.doc_id: r for r in language.identify(df).collect()}
    assert len(got) == 205
    tested = [r for i, r in got.items() if i is not None and i < 200 and r.held_out]
    assert len(tested) > 20 and all(r.lang_pred == ("es" if r.doc_id % 2 else "en") for r in tested)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[None].held_out and got[None].lang_pred == "es"
    assert got[904].lang_pred in ("en", "es")
    assert all(0 <= r.score <= 1 for r in got.values())


def test_nothing_is_learned_from_the_held_out_fold_or_from_other_columns(spark):
    df = corpus(spark)
    learned = language.samples(df)
    spoilt = df.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.col("lang"))
    assert language.samples(spoilt) == learned and set(learned) == {"en", "es"}
    assert all(len(t) <= 64 * (512 * 4 + 1) for t in learned.values())


def test_phrases_agree_with_a_plain_cross_parse():
    r = np.random.default_rng(3)
    sample = r.integers(1, 4, 300).tolist()
    text = r.integers(1, 5, 2000)
    steps = language.automaton(sample, 6)
    known = {tuple(sample[i:j]) for i in range(len(sample)) for j in range(i + 1, min(len(sample), i + 40) + 1)}

    def plain(t):
        count, at = 0, 0
        while at < len(t):
            n = 1
            while at + n < len(t) and tuple(t[at : at + n + 1]) in known:
                n += 1
            count, at = count + 1, at + n
        return count

    lengths = np.array([700, 600, 400, 299, 1, 0])
    starts = np.cumsum(lengths) - lengths
    got = language.phrases(text, starts, lengths, steps)
    assert got.tolist() == [plain(text[s : s + n].tolist()) for s, n in zip(starts, lengths)]


def test_empty_table(none):
    assert language.identify(none).count() == 0


def test_a_long_text_is_sampled_anywhere(spark):
    head, body = "x" * 600, "abcdefghij" * 400
    rows = spark.createDataFrame([(i, head + body, "en") for i in range(60)], "doc_id long, text string, lang string")
    taken = language.samples(rows, characters=100)["en"].split(b"\n")
    assert len(taken) > 10 and all(len(t) == 100 and t.decode() in head + body for t in taken)
    assert sum(b"a" in t for t in taken) > len(taken) // 2 and len(set(taken)) > 5
    whole = language.samples(rows.limit(8), characters=10_000)["en"].split(b"\n")
    assert set(whole) == {(head + body).encode()}
