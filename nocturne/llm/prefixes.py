"""Near copies by the Jaccard similarity of shingle sets, found completely through prefixes.

All shingles are put into one order. Two sets of similarity ``least`` share a shingle among
the first ``n - ceil(least * n) + 1`` of each (n shingles), so no such pair is missed,
wherever the texts differ. The order puts shingles that are common in a sample last, which keeps
the groups at a shingle small; any order gives the same pairs.

The sets at a shingle meet their smallest one first. Pairs that are connected by then need no
comparison, as only components are asked for. All others are compared: first by parity bits of
about one per shingle, whose difference is never more than that of the sets, so no similar pair
fails; then, for those left, shingle by shingle from the texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .work import arrow_schema, batch, discard, ints, table, texts

SAMPLE = 10_000
COMMON = 200_000
ROUNDS = 3
SKETCH = 16  # words of parity bits that every set has
SLACK = 1e-9


def features(text: bytes, words: int, unique: bool) -> list[bytes]:
    tokens = text.lower().split()
    if unique:
        tokens = sorted(set(tokens))
    if len(tokens) <= words:
        return [b" ".join(tokens)] if tokens else []
    if words == 1:
        return tokens
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    return [line[a:b] for a, b in zip(starts[: len(tokens) - words + 1].tolist(), (ends[words - 1 :] - 1).tolist())]


def _grams(text: bytes, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    found = features(text, words, False)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(f, 7) for f in found), np.uint64, len(found)))


def parity(grams: np.ndarray) -> np.ndarray:
    """Bits, a power of two of them, 1024 or more and at least one a shingle, each set if its place was hit an odd number of times."""
    n = 64 * SKETCH
    while n < len(grams):
        n *= 2
    hits = np.bincount((grams & np.uint64(n - 1)).astype(np.int64), minlength=n)
    return np.packbits((hits & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _common(df: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found in several documents of a sample and in how many; they only set the order."""
    schema = arrow_schema(gram=pa.int64())

    def run(batches):
        for b in batches:
            for t in texts(b.column(0)):
                yield batch(schema, _grams(t, words).view(np.int64))

    n = df.count()
    if n > SAMPLE:
        df = df.where(F.pmod(F.xxhash64(F.lit(3), "doc_id", "text"), F.lit(1 << 30)) < (SAMPLE << 30) // n)
    counted = df.select("text").mapInArrow(run, "gram long").groupBy("gram").agg(F.count("*").alias("n")).where("n > 2")
    found = counted.orderBy(F.desc("n"), "gram").limit(COMMON).collect()
    grams, counts = np.array([r.gram for r in found], np.int64).view(np.uint64), np.array([r.n for r in found], np.int64)
    order = np.argsort(grams)
    return grams[order], counts[order]


def prefixes(df: DataFrame, words: int, least: float) -> DataFrame:
    """``(doc_id, high, low, size, bits, sketch, grams)``: 128 bits that name the set, its size, its parity bits, whole and brought down to ``SKETCH`` words, and its prefix in order."""
    longs = pa.list_(pa.int64())
    schema = arrow_schema(doc_id=pa.int64(), high=pa.int64(), low=pa.int64(), size=pa.int32(), bits=longs, sketch=longs, grams=longs)
    common = df.sparkSession.sparkContext.broadcast(_common(df, words))

    def run(batches):
        known, counts = common.value
        for b in batches:
            names, sizes, bits, firsts = [], [], [], []
            for t in texts(b.column(1)):
                grams = _grams(t, words)
                names.append(np.frombuffer(xxhash.xxh3_128_digest(grams.tobytes()), np.int64))
                sizes.append(len(grams))
                bits.append(parity(grams))
                count = np.zeros(len(grams), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                    count = np.where(known[at] == grams, counts[at], 0)
                n = len(grams) - math.ceil(least * len(grams) - SLACK) + 1
                firsts.append(grams[np.lexsort((grams, count))[:n]].view(np.int64))
            if names:
                sketches = [np.bitwise_xor.reduce(x.reshape(-1, SKETCH), axis=0) for x in bits]
                yield batch(schema, b.column(0), *np.stack(names, 1), np.array(sizes, np.int32), bits, sketches, firsts)

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, high long, low long, size int, bits array<long>, sketch array<long>, grams array<long>")


def _may(a: tuple[Column, Column], b: tuple[Column, Column], least: float) -> Column:
    """Whether sets ``(size, position)`` that meet at a shingle can be similar: at most all before it in one and all behind it are shared."""
    shared = F.least(a[1], b[1]) + 1 + F.least(a[0] - a[1], b[0] - b[1]) - 1
    return shared * (1 + least) >= least * (a[0] + b[0]) - SLACK


def _folded(bits: str, words: Column, at: Column) -> Column:
    """Word ``at`` of the parity bits brought down to ``words`` words."""
    every = F.sequence(at, F.size(bits) - 1, words)
    return F.aggregate(every, F.lit(0).cast("long"), lambda s, i: s.bitwiseXOR(F.get(bits, i)))


def _in_reach(turned: Column, m: Column, n: Column, least: float) -> Column:
    """Whether sets of ``m`` and ``n`` shingles that differ in ``turned`` parity bits can be similar."""
    return turned * (1 + least) <= (1 - least) * (m + n) + SLACK


def _close(edges: DataFrame, heads: DataFrame, least: float) -> DataFrame:
    """The ``edges`` that sizes and parity bits don't rule out.

    Sets of similarity ``least`` differ in at most ``(1 - least) / (1 + least)`` of their sizes' sum,
    and each differing shingle turns one bit.
    """
    known = heads.select("node", "size", "bits")
    both = edges.join(known.withColumnsRenamed({"node": "u", "size": "m", "bits": "x"}), "u").join(known.withColumnsRenamed({"node": "v", "size": "n", "bits": "y"}), "v")
    near = both.where(F.least("m", "n") >= least * F.greatest("m", "n") - SLACK)
    words = F.least(F.size("x"), F.size("y"))
    turned = F.aggregate(
        F.sequence(F.lit(0), words - 1), F.lit(0),
        lambda s, at: s + F.bit_count(_folded("x", words, at).bitwiseXOR(_folded("y", words, at))),
    )
    return near.where(_in_reach(turned, F.col("m"), F.col("n"), least)).select("u", "v")


def _alike(df: DataFrame, edges: DataFrame, words: int, least: float) -> DataFrame:
    """The ``edges`` whose texts have similar shingle sets, written. Texts are shipped, as they take less room than their shingles."""
    schema = arrow_schema(u=pa.int64(), v=pa.int64())

    def run(batches):
        said, other = None, None
        for b in batches:
            us, vs, keep = ints(b.column(0)), ints(b.column(1)), []
            for i, (s, t) in enumerate(zip(texts(b.column(2)), texts(b.column(3)))):
                if t != said:
                    said, other = t, _grams(t, words)
                mine = _grams(s, words)
                shared = len(mine) + len(other) - len(np.union1d(mine, other))
                if shared >= least * (len(mine) + len(other) - shared) - SLACK:
                    keep.append(i)
            yield batch(schema, us[keep], vs[keep])

    said = df.select("doc_id", "text")
    both = edges.join(said.toDF("u", "x"), "u").join(said.toDF("v", "y"), "v")
    return table(both.select("u", "v", "x", "y").mapInArrow(run, "u long, v long").distinct(), "links", narrow=True)


def _apart(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The ``edges`` whose ends are not connected by ``roots(node, root)``."""
    named = edges.join(roots.toDF("u", "a"), "u", "left").join(roots.toDF("v", "b"), "v", "left")
    return named.where(F.coalesce("a", "u") != F.coalesce("b", "v")).select("u", "v")


def _connected(df: DataFrame, heads: DataFrame, edges: DataFrame, links: DataFrame, words: int, least: float) -> DataFrame:
    """``links`` with the similar ones of ``edges``.

    Each set is compared with its smallest candidate first; candidates connected then need no comparison.
    """
    edges = table(_close(edges.distinct(), heads, least), "candidate-links", narrow=True)
    links = links.unionByName(_alike(df, edges.groupBy("u").agg(F.min("v").alias("v")), words, least))
    others = edges.join(edges.groupBy("u").agg(F.min("v").alias("least")), "u").where("v > least").drop("least")
    if not others.isEmpty():
        others = table(_apart(others, components(links)), "other-links", narrow=True)
        links = links.unionByName(_alike(df, others, words, least))
        discard(others)
    discard(edges)
    return links


def similar_links(df: DataFrame, words: int = 5, least: float = 0.8, crowd: int = 64, candidates: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Edges ``(u, v)`` of ``df(doc_id, text)`` whose components are those of all pairs of similarity ``least``.

    Equal sets are folded to their smallest doc_id. ``candidates`` makes pairs ``(u, v)`` from the texts of those; the
    similar ones are linked first and need no comparison later. In each round the sets at a shingle are
    compared with the smallest among them, which then leaves; a shingle whose remaining sets are
    all connected is done. After the rounds (``ROUNDS``, or as soon as no shingle
    has more than ``crowd`` sets left) all pairs left that are not connected are compared, so the
    number of rounds changes the work and not the result.
    """
    found = table(prefixes(df, words, least), "prefixes")
    alike = [F.count("*").alias("n"), F.min("doc_id").alias("node"), *(F.any_value(c).alias(c) for c in ("size", "bits", "sketch", "grams"))]
    heads = table(found.groupBy("high", "low").agg(*alike), "sets")
    same = found.select("doc_id", "high", "low").join(heads.where("n > 1").select("high", "low", "node"), ["high", "low"])
    same = table(same.where("doc_id != node").select(F.col("doc_id").alias("u"), F.col("node").alias("v")).distinct(), "equal-sets", narrow=True)
    discard(found)
    left = heads.select("node", "size", F.posexplode("grams").alias("pos", "gram"), F.col("node").alias("root"))
    links, before = same.limit(0), ()

    def named(left: DataFrame, links: DataFrame) -> DataFrame:
        return left.drop("root").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))

    if candidates is not None:
        near = candidates(df.join(heads.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi"))
        links = _connected(df, heads, near.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), links, words, least)
        left = named(left, links)
    for last in [False] * ROUNDS + [True]:
        # a shingle is counted with map-side aggregates, and only those of unconnected sets come back by a join, whose hot keys Spark can split
        ends = [F.min(F.struct("node", "root")).alias("hub"), F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n")]
        counted = left.groupBy("gram").agg(*ends).where("a < b").select("gram", F.col("hub.node").alias("first"), F.col("hub.root").alias("met"), "n")
        left = table(left.join(counted, "gram"), "shared-shingles", narrow=True)
        discard(*before)
        before = (left,)
        most = left.agg(F.max("n")).first()[0] or 0
        if not most:
            break
        if last or most <= crowd:
            links = _connected(df, heads, _unconnected(left, heads, least), links, words, least)
            break
        links = _connected(df, heads, left.where("node != first AND root != met").select(F.col("node").alias("u"), F.col("first").alias("v")), links, words, least)
        left = named(left.where("node != first").drop("first", "met", "n"), links)
    discard(heads, *before)
    return same.unionByName(links)


def _unconnected(left: DataFrame, heads: DataFrame, least: float) -> DataFrame:
    """Pairs ``(u, v)`` at a shingle that have different roots: those outside the largest component with the others.

    Sizes, positions and the sketches of parity bits leave out pairs while the sets meet, so that a pair is only made where it may be similar.
    """
    shares = left.groupBy("gram", "root").agg(F.count("*").alias("n"))
    largest = shares.groupBy("gram").agg(F.max(F.struct("n", "root")).getField("root").alias("most"))
    named = left.select("gram", "node", "root", "size", "pos").join(largest, "gram").join(heads.select("node", "sketch"), "node")
    named = table(named, "unconnected")
    few, all_ = named.where("root != most").alias("x"), named.alias("y")
    turned = sum((F.bit_count(F.get("x.sketch", F.lit(i)).bitwiseXOR(F.get("y.sketch", F.lit(i)))) for i in range(SKETCH)), F.lit(0))
    met = few.join(all_, F.col("x.gram") == F.col("y.gram")).where(
        (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.most")) | (F.col("x.node") < F.col("y.node")))
        & _may((F.col("x.size"), F.col("x.pos")), (F.col("y.size"), F.col("y.pos")), least) & _in_reach(turned, F.col("x.size"), F.col("y.size"), least)
    )
    return met.select(F.greatest("x.node", "y.node").alias("u"), F.least("x.node", "y.node").alias("v"))
