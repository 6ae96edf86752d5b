"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint is cut into ``distance // 2 + 1`` segments. Two fingerprints that
differ in at most ``distance`` bits have a segment that differs in at most one bit,
so they share that segment with the bit masked out. The index holds, for each
distinct fingerprint, one key per bit; keys are joined by equality and pairs verified
by counting differing bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .prefixes import features as _features, similar_links
from .work import arrow_schema, batch, fresh, table, texts

BITS = 64
CROWD = 64
_INDEXED = 8_000  # fingerprints for each task that makes index keys
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_FEATURES = 1 << 20


def fingerprint(text: bytes, words: int = 3, seed: int = 42, unique: bool = False) -> int:
    """SimHash of one text: a bit is set if over half the shingle hashes set it."""
    features = _features(text, words, unique)
    ones = np.zeros((8, 8), np.int64)
    for i in range(0, len(features), _FEATURES):
        digests = b"".join([xxhash.xxh64_digest(f, seed) for f in features[i : i + _FEATURES]])
        columns = np.frombuffer(digests, np.uint8).reshape(-1, 8)
        for k in range(8):
            ones[k] += np.bincount(columns[:, k], minlength=256) @ _BYTE_BITS
    return int.from_bytes(np.packbits((2 * ones > len(features)).ravel()).tobytes(), "big")


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, seeds: tuple = (42,), unique: bool = False) -> DataFrame:
    """``(doc_id, fp0, fp1, ...)``, one row per row of ``df`` and one fingerprint per seed.

    Words are separated by ASCII white space and lower-cased in A-Z. A text of fewer
    words than a shingle is one shingle; null, empty and blank texts get zero.
    ``unique`` takes the distinct words in place of the running text.
    """
    schema = arrow_schema(doc_id=pa.int64(), **{f"fp{i}": pa.int64() for i in range(len(seeds))})

    def run(batches):
        for b in batches:
            found = [[] for _ in seeds]
            for t in texts(b.column(1)):
                for out, seed in zip(found, seeds):
                    out.append(fingerprint(t, words, seed, unique))
            yield batch(schema, b.column(0), *(np.array(x, np.uint64).view(np.int64) for x in found))

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {', '.join(f'fp{i} long' for i in range(len(seeds)))}")


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _masks(distance: int) -> list[int]:
    """For each bit the mask that keeps the rest of its segment."""
    parts = distance // 2 + 1
    bounds = [BITS * i // parts for i in range(parts + 1)]
    out = []
    for low, high in zip(bounds[:-1], bounds[1:]):
        segment = (1 << high) - (1 << low)
        out += [_signed(segment & ~(1 << bit)) for bit in range(low, high)]
    return out


def _close(a: Column, b: Column, distance: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def shared_keys(prints: DataFrame, distance: int) -> DataFrame:
    """``(..., bit, key, fp, n)``: the n members of each index key that two or more fingerprints share.

    Columns of ``prints`` besides ``fp`` are part of the key. Every pair within ``distance`` bits
    shares a key.
    """
    prints = table(prints, "prints")
    by = [*(c for c in prints.columns if c != "fp"), "bit", "key"]
    keys = F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in _masks(distance)))
    spread = prints.repartition(max(1, prints.count() // _INDEXED), *prints.columns)
    index = spread.select("*", F.posexplode(keys).alias("bit", "key"))
    by_key = Window.partitionBy(*by).orderBy("fp")
    met = index.select("*", F.coalesce(F.lag("fp").over(by_key), F.lead("fp").over(by_key)).isNotNull().alias("met"))
    members = table(met.where("met").drop("met"), "variants")
    held = table(members.groupBy(*by).agg(F.count("*").alias("n")), "held")
    return table(members.join(held, by), "members")


def links(prints: DataFrame, distance: int = 2, crowd: int = CROWD) -> DataFrame:
    """Edges ``(u, v)`` whose components are those of all pairs within ``distance`` bits.

    ``prints`` has distinct fingerprints ``fp``. A key held by up to ``crowd`` of them gives
    its verified pairs. The members of a larger key are linked without pairs: each one
    stands for itself and for all values one bit away, and those that meet at a value
    are within two bits of each other, so a star there links exactly what the pairs
    would (for two bits; with 0 or 1 a key has two members at most).
    """
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2")
    members = shared_keys(prints.select("fp"), distance)
    few = members.where(F.col("n") <= crowd).select("bit", "key", "fp")
    pairs = (
        few.withColumnRenamed("fp", "u").join(few.withColumnRenamed("fp", "v"), ["bit", "key"])
        .where((F.col("u") < F.col("v")) & _close(F.col("u"), F.col("v"), distance)).select("u", "v").distinct()
    )
    many = members.where(F.col("n") > crowd).select("fp").distinct()
    around = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << bit))) for bit in range(BITS)))
    balls = many.select("fp", F.explode(around).alias("centre"))
    hubs = balls.groupBy("centre").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = balls.join(hubs, "centre").where("fp != v").select(F.col("fp").alias("u"), "v").distinct()
    return pairs.unionByName(stars)


def groups(prints: DataFrame, distance: int = 2, crowd: int = CROWD) -> DataFrame:
    """``(fp, component_id)``: the smallest doc_id reachable from each distinct fingerprint.

    ``prints`` has ``doc_id`` and ``fp``. Rows without a doc_id are linked like others but
    name no component; a component of such rows alone has a null id.
    """
    named = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(named, distance, crowd)).withColumnRenamed("node", "fp")
    named = named.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return named.join(best, "root").select("fp", "component_id")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, distance: int = 2, seed: int = 42, crowd: int = CROWD) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``df``.

    Fingerprints link at ``distance`` or fewer differing bits; see ``fingerprints`` for
    short, empty and null texts and ``groups`` for null ids. Repeated rows stay.
    """
    prints = table(fingerprints(df, doc_id, text, words, (seed,)).withColumnRenamed("fp0", "fp"), "fingerprints")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(groups(prints, distance, crowd), "fp").select("doc_id", hexed, "component_id")


def linked_documents(df: DataFrame, words: int = 3, distance: int = 2, seed: int = 42, crowd: int = CROWD) -> DataFrame:
    """Pairs ``(u, v)`` of doc_ids that join all documents whose fingerprints link at ``distance`` or fewer bits.

    A document is paired with the first one of its fingerprint, and the first ones of linked fingerprints with each other.
    """
    prints = table(fingerprints(df, words=words, seeds=(seed,)).withColumnRenamed("fp0", "fp"), "fingerprints")
    first = table(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "first-documents", narrow=True)
    alike = prints.join(first, "fp").select(F.col("doc_id").alias("u"), F.col("first").alias("v"))
    ends = [first.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_first")) for end in ("u", "v")]
    near = links(first.select("fp"), distance, crowd).join(ends[0], "u").join(ends[1], "v").select(F.col("u_first").alias("u"), F.col("v_first").alias("v"))
    return table(alike.unionByName(near).where("u != v"), "linked-documents", narrow=True)


def similar_leaders(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, least: float = 0.8, crowd: int = CROWD) -> DataFrame:
    """``(doc_id, leader)`` of rows in a group of near copies; the leader, its smallest doc_id, is kept.

    Groups are the components of all pairs whose exact Jaccard similarity of shingles of ``words``
    words is ``least`` or more. Documents whose fingerprints link (``linked_documents``) are compared first. Fingerprints alone
    miss many such pairs, so documents that they did not connect are compared where the prefixes of their shingle sets meet, which
    misses none; ``crowd`` does not change the groups. Rows without an id neither lead nor follow. Rows that share an id
    are one document, linked where one of its texts is.
    """
    df = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id IS NOT NULL")
    found = components(similar_links(df, words, least, crowd, lambda firsts: linked_documents(firsts, crowd=crowd)))
    return found.where("node != root").select(F.col("node").alias("doc_id"), F.col("root").alias("leader"))


def drop_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """Rows of ``df`` with all columns, one document of each group of near copies (``similar_leaders``).

    Rows without an id stay. Rows that share an id are one document, linked where one of its texts
    is: they stay or go together.
    """
    followers = similar_leaders(df, doc_id, text, words, least)
    gone = fresh(df, "gone")
    kept = df.join(followers.select(F.col("doc_id").alias(gone)).distinct(), F.col(doc_id) == F.col(gone), "left_anti")
    return kept
