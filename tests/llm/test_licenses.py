import random
import re

import pytest

from nocturne.llm import licenses

from .conftest import prose


def test_base_counts_agree_with_brute_force(hard):
    got = licenses.scan(hard).collect()
    want = []
    for r in hard.select("doc_id", "text").collect():
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").encode().lower())
        places = [(i, label) for i in range(len(words)) for p, label in licenses.BASE.items() if words[i : i + len(p.split())] == p.encode().split()]
        starts = [i for i, _ in places]
        want.append((str(r.doc_id), len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))))
    assert sorted(map(str, want)) == sorted(str((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_templates_are_found_and_told_apart(spark):
    mit = licenses.TEMPLATES[2][1].split()
    texts = {
        "mit": "x y z Released under the MIT License. a b",
        "apache-2.0": "Licensed under the Apache License, Version 2.0.",
        "cc-by,cc-by-nc": "foo Licensed under CC BY-NC 4.0. bar",
        "gpl": "This work is licensed under the GNU General Public License, version 3.",
        "mit ": "some words " * 30 + " ".join(w if i % 23 else "other" for i, w in enumerate(mit)) + " more" * 50,
        "mit  ": " ".join(mit[:20] + ["put", "in"] + mit[20:]),
        "": "Released under the license of the house and licensed under terms",
        " ": " ".join(reversed(mit)),
    }
    df = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert [got[i].labels for i in range(len(texts))] == [k.strip() for k in texts]
    assert got[0].spans[0]["first"] == 3 and got[0].spans[0]["end"] == 8 and got[0].score == 1.0
    assert 0.9 <= got[4].score < 1 and got[6].score == 0


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _next(row, x, b)
    return row[-1]


def _next(row, x, b):
    new = [0]
    for j, y in enumerate(b):
        new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
    return new


def best_stretch(words, template):
    """All stretches of ``words`` tried."""
    found = (len(template), 0, 0, 0)
    for a in range(len(words)):
        for e in range(a + 1, min(len(words), a + 2 * len(template)) + 1):
            c = common(words[a:e], template)
            found = min(found, (len(template) + e - a - 2 * c, a - e, e, c))
    _, minus, end, c = found
    return c / max(len(template), -minus), end + minus, end


def test_spans_are_the_most_alike_stretches_of_the_whole_text(spark):
    r = random.Random(5)
    notices = [licenses.TEMPLATES[i] for i in (0, 3, 5, 9, 13)]
    texts, want = [], []
    for k in range(60):
        label, notice = notices[k % len(notices)]
        words = []
        for w in notice.split():
            kind = r.random()
            words += [] if kind < 0.04 * (k % 3) else ["foreign", w] if kind < 0.08 * (k % 3) else ["other"] if kind < 0.1 * (k % 3) else [w]
        texts.append(f"{prose(k, 9)} {' '.join(words)} {prose(100 + k, 9)}")
        share, first, end = best_stretch(licenses.words_of(texts[-1].encode()), licenses.words_of(notice.encode()))
        want.append((label, first, end, round(share, 9)) if share >= licenses.LEAST else None)
    assert 20 < sum(w is not None for w in want) < 60
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in licenses.scan(df, templates=notices).collect():
        own = {(s.label, s.first, s.end, round(s.share, 9)) for s in row.spans}
        assert own == ({want[row.doc_id]} if want[row.doc_id] else set())


def test_words_between_the_words_of_a_notice_make_no_span(spark):
    mit = licenses.TEMPLATES[2][1].split()
    loose = " ".join(w + (" two more" if i % 3 == 2 else "") for i, w in enumerate(mit))
    heads = " ".join(["permission is hereby granted"] * 4000)
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(1, loose), (2, heads), (3, f"{heads} {' '.join(mit)}")], "doc_id long, text string")).collect()}
    assert got[1].labels == got[2].labels == "" and got[1].score == got[2].score == 0
    assert got[3].labels == "mit" and [(s.first, s.end) for s in got[3].spans] == [(16_000, 16_000 + len(licenses.words_of(" ".join(mit).encode())))]


def test_templates_shorter_than_a_gram_are_refused(spark):
    with pytest.raises(ValueError):
        licenses.template_positions(spark, [("short", "two words")])


def test_empty_table(none):
    assert licenses.scan(none).count() == 0
