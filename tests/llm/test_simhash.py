import re

import pytest
import xxhash
from pyspark.sql import functions as F

from nocturne.llm import graph, simhash

from .conftest import edited, prose


def brute_print(text, words=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    tokens = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates_agree_with_brute_force(hard):
    rows = hard.select("doc_id", "text").collect()
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(hard).collect())
    prints = [brute_print(r.text) for r in rows]
    n = len(rows)
    groups = classes(range(n), [(i, j) for i in range(n) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    smallest = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            smallest[groups[i]] = min(r.doc_id, smallest.get(groups[i], r.doc_id))
    assert got == sorted((str(r.doc_id), f"{prints[i]:016x}", smallest.get(groups[i])) for i, r in enumerate(rows))


@pytest.mark.parametrize("crowd", [2, 64])
def test_links_of_crowded_keys_are_exact(spark, crowd):
    import random

    r = random.Random(4)
    centre = r.getrandbits(64)
    values = {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for _ in range(150)} | {r.getrandbits(64) for _ in range(50)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = graph.components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 2, crowd)).collect()
    expected = classes(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2])
    sizes = {v: sum(1 for x in expected.values() if x == v) for v in set(expected.values())}
    assert {r.node: r.root for r in found} == {k: v for k, v in expected.items() if sizes[v] > 1}


def jaccard(a, b):
    x, y = (set(simhash._features((t or "").encode(), 5, False)) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_dropped_documents_repeat_a_kept_one(hard):
    rows = [r for r in hard.select("doc_id", "text").collect()]
    texts = {}
    for r in rows:
        texts.setdefault(r.doc_id, []).append(r.text)
    kept = [r.doc_id for r in simhash.drop_near_duplicates(hard).collect()]
    assert kept.count(None) == 3
    gone = set(texts) - set(kept)
    # exact copies (6 is one of what is listed under 3) and copies with one word in a hundred changed; clean documents stay
    assert {6, 12, 13, 14, 15, 16} <= gone and not {0, 1, 2, 4, 5, 7, 8, 9, 10, 11} & gone
    for g in gone:
        assert any(jaccard(a, b) >= 0.8 for a in texts[g] for k in set(kept) - {None} if k < g for b in texts[k])


@pytest.mark.parametrize("crowd", [1, 64])
def test_groups_are_components_of_verified_links(spark, crowd):
    rows = []
    for g in range(6):
        base = prose(400 + g, 150)
        rows += [(10 * g + k, base if k == 1 else edited(base, k, 0.004 * k)) for k in range(10)]
    texts = dict(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.leader for r in simhash.similar_leaders(df, crowd=crowd).collect()}
    assert not set(found.values()) & set(found)
    whole = classes(texts, [(a, b) for a in texts for b in texts if a < b and jaccard(texts[a], texts[b]) >= 0.8])
    assert all(whole[d] == whole[k] and k < d for d, k in found.items())
    if crowd == 64:
        near = classes(texts, [(a, b) for a in texts for b in texts if a < b and jaccard(texts[a], texts[b]) >= 0.86])
        assert all(d in found for d, k in near.items() if d != k)


def test_empty_table(none):
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.drop_near_duplicates(none).count() == 0


def test_hub_components(spark):
    edges = spark.range(1, 400).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v")).union(spark.range(1000, 1300).select(F.col("id"), F.lit(999)))
    roots = {r.node: r.root for r in graph.components(edges).collect()}
    assert roots == {i: 0 for i in range(400)} | {i: 999 for i in range(999, 1300)}


def test_linked_documents_join_those_of_close_fingerprints(hard):
    df = hard.where("doc_id IS NOT NULL").select("doc_id", "text")
    rows = df.collect()
    prints = [brute_print(r.text) for r in rows]
    pairs = [(rows[i].doc_id, rows[j].doc_id) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    ids = {r.doc_id for r in rows}
    found = [(r.u, r.v) for r in simhash.linked_documents(df).collect()]
    assert found and classes(ids, found) == classes(ids, pairs)


def test_dropped_documents_are_linked_by_fingerprints_first(spark, monkeypatch):
    # three words added at the end: a similar pair whose fingerprints link
    from nocturne.llm import prefixes

    texts = {1: prose(60, 400), 2: prose(60, 400) + " " + " ".join(prose(60, 400).split()[:3]), 3: prose(61, 200)}
    seen = []
    connected = prefixes._connected
    monkeypatch.setattr(prefixes, "_connected", lambda df, heads, edges, *rest: seen.append({(r.u, r.v) for r in edges.collect()}) or connected(df, heads, edges, *rest))
    df = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near_duplicates(df).collect()} == {1, 3}
    assert seen == [{(2, 1)}]
