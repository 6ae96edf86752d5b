import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from nocturne.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own[conv].append(((turn is not None, turn or 0), role, digest, (role, text)))
    own = {c: [t[-1] for t in sorted(turns, key=lambda x: x[:3])] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(c / 20) * 0 - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(rows):
    return brute_of(rebuilt(rows))


def brute_of(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children[path]
        leaves[path] = sum(leaves[p] for p in below) if below else 1
        words = len(WORD.findall(path[-1][1])) if path else 0
        saved[path] = (len(members[path]) - 1) * words + sum(saved[p] for p in below)
    out = Counter()
    for path, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(convs[c]) == len(path))))
        out[(min(who), len(path), min(members[path[:-1]]) if path else None, len(who), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit("x")).withColumn("pos", F.lit(1)).withColumn("len", F.lit(2))
    return Counter(map(tuple, trie.prefix_trie(*trie.with_shared_heads(trie.turns_of(df.repartition(3))), **more).select(*COLUMNS).collect()))


def conversations(n, seed=4, longest=12):
    """Random talk over few texts, so that many prefixes are shared."""
    r = random.Random(seed)
    return [(c, i, r.choice(["user", "assistant"]), r.choice(["yes", "no no", "why  not\tnow", ""])) for c in range(n) for i in range(r.randint(1, longest))]


@pytest.mark.parametrize("widths", [(8, 16, 32), (1, 2), (3,)])
def test_like_brute_force(spark, widths):
    rows = conversations(90)
    assert found(spark, rows, widths=widths) == brute(rows)


def test_nulls_ties_repeats_and_odd_ids(spark):
    rows = conversations(30, 9, 5) + [
        (None, 0, "user", "lost"), (None, None, None, None), (40, None, "user", "first"), (40, 0, None, None), (40, 0, "user", None), (40, 0, "user", "b"), (40, 0, "user", "a"), (40, 0, "user", "a"),
        (41, None, None, "x"), (41, None, None, "x"), (45, 3, "user", "only"), (60, 1, "user", "p"), (61, 1, "user", "q"), (62, 1, "user", "p"), (-20, 0, "user", "minus"), (-23, 0, "user", "minus"),
        (-3, 0, "user", "no base"), (10**15 + 7, 0, "user", "large"), (1003, 2, "a", "bc"), (1004, 2, "ab", "c"),
    ]
    assert found(spark, rows, widths=(2, 3)) == brute(rows)


def test_turnless_conversations_are_members_of_the_root(spark):
    # ids whose crc32 asks for a head, with one turn each and no base
    rows = [(c, 0, "user", "hello") for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 > 0]
    want = brute(rows)
    assert len(want) == 1 and next(iter(want))[3] == len(rows) and found(spark, rows) == want


def test_a_long_conversation_and_many_copies(spark):
    rows = [(c, i, "user", f"turn {i % 7}") for c in (0, 20, 40) for i in range(150 - c)] + [(100 * c, 0, "user", "same words here") for c in range(1, 300)]
    assert found(spark, rows) == brute(rows)


def test_long_texts_and_empty_table(spark):
    rows = [(c, 0, "user", "long words " * 50_000) for c in (0, 20, 40)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == Counter()


def test_all_prefixes_come_from_one_rollup(spark):
    import inspect

    assert "ROLLUP" in inspect.getsource(trie._rolled) and "grouping_id()" in inspect.getsource(trie._rolled)
    with pytest.raises(Exception):
        found(spark, conversations(3), widths=(64,))
