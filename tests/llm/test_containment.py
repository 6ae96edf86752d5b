import re

import pytest

from nocturne.llm import containment
from nocturne.llm.work import identity

from .conftest import edited, prose


def words_of(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def shingles(text, size=5):
    words = words_of(text)
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def tables(spark, hard):
    items = [(i, prose(200 + i, 12 + 9 * i)) for i in range(8)] + [(20, None), (21, ""), (22, "one two"), (23, prose(99, 60)), (None, prose(1, 30)), (4, prose(300, 30))]
    docs = [(500 + 3 * i + j, f"{prose(i, 50)} {edited(t, i, s)} {prose(i + 9, 2000)}", None, None, 1) for i, (_, t) in enumerate(items[:8]) for j, s in enumerate((0.0, 0.03, 0.1))]
    extra = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    return hard.select("doc_id", "text", "lang", "source", "n_chars").union(extra), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [1_000_000, 100])
def test_pairs_agree_with_brute_force(spark, hard, block):
    docs, items = tables(spark, hard)
    want = []
    queries = [(r.item_id, size, shingles(r.text, size)) for r in items.collect() for size in [min(5, len(words_of(r.text)))] if size]
    for r in docs.collect():
        own = {size: shingles(r.text, size) for size in range(1, 6)}
        want += [(str(r.doc_id), str(i), len(q), len(q & own[s])) for i, s, q in queries if len(q & own[s]) >= 0.8 * len(q) - 1e-9]
    got = [(str(r.doc_id), str(r.item_id), r.n_shingles, r.n_shared) for r in containment.contained_items(docs, items, block=block).collect()]
    assert any(i == "None" for _, i, *_ in want) and any(n == 1 and i == "22" for _, i, n, _ in want)
    assert sorted(got) == sorted(want) and len(want) > 15


def test_contaminated_documents_go_and_others_stay(spark, hard):
    docs, items = tables(spark, hard)
    leaked = {(r.doc_id, r.tie) for r in containment.contained_items(docs, items).collect()}
    kept = containment.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    named = docs.select("doc_id", identity("doc_id", "text")[1]).collect()
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in named if tuple(r) not in leaked)


def test_items_without_id_and_short_items_are_found(spark):
    docs = spark.createDataFrame([(1, f"{prose(400, 130)} {prose(401, 40)} {prose(402, 130)} Alpha, beta gamma! {prose(403, 20)}")], "doc_id long, text string")
    items = spark.createDataFrame([(None, prose(401, 40)), (2, prose(401, 40)), (3, "alpha BETA gamma"), (4, "beta alpha"), (5, "gamma")], "item_id long, text string")
    got = {(r.item_id, r.n_shingles, r.n_shared) for r in containment.contained_items(docs, items).collect()}
    assert got == {(None, 36, 36), (2, 36, 36), (3, 1, 1), (5, 1, 1)}


def test_empty_tables(spark, hard, none):
    items = spark.createDataFrame([], "item_id long, text string")
    assert containment.contained_items(hard, items).count() == 0
    assert containment.drop_contaminated(hard, items).count() == hard.count()
    assert containment.contained_items(none, none.selectExpr("doc_id AS item_id", "text")).count() == 0
