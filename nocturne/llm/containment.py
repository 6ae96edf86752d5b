"""Benchmark decontamination by size-partitioned containment MinHash.

A short item is contained in a document if at least ``least`` of its distinct shingles occur in
it. Of an item with q shingles a containing document misses at most q - ceil(least * q), so
among any one more than that it holds at least one. The MinHash sketch of an item is its
q - ceil(least * q) + 1 smallest shingle hashes (bottom-k MinHash of the small set, looked up in the
large one). Items are partitioned by the length of their shingles and by q, doubling from partition to partition; a
partition has its own sketches and the number of shingles that a document needs at least, below
which it is not searched. A document that meets no sketch value contains no item, whatever its
length; those that do are verified by comparing the shingles themselves.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import Rolling
from .substring import _Hashes, word_hashes
from .work import arrow_schema, batch, fresh, identity, ints, texts

WORDS = 5
LEAST = 0.8
BLOCK_SHINGLES = 1_000_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def _shingles(words: list[bytes], size: int) -> list[bytes]:
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]


def needed(q: int, least: float = LEAST) -> int:
    """How many of q shingles a containing document holds at least."""
    return max(1, math.ceil(least * q - 1e-9))


def _hashes(words: list[bytes], size: int, known: _Hashes) -> np.ndarray:
    """Hash of each shingle, in order."""
    if not words:
        return np.zeros(0, np.uint64)
    tokens = word_hashes(words, known)
    out = []
    for a in range(0, max(len(tokens) - size + 1, 1), 1 << 17):
        out.append(Rolling(tokens[a : a + (1 << 17) + size - 1]).grams(min(size, len(tokens))))
    return np.concatenate(out)


class Partition:
    """Items of one shingle length and of q in [2**k, 2**(k + 1)): sketches by hash and the fewest shingles a containing document has."""

    def __init__(self, sketches: list[tuple[np.ndarray, int, int]]):
        self.fewest = min(need for *_, need in sketches)
        values = np.concatenate([kept for kept, *_ in sketches])
        owners = np.concatenate([np.full(len(kept), owner) for kept, owner, _ in sketches])
        order = np.argsort(values, kind="stable")
        self.values, self.owners = values[order], owners[order]

    def candidates(self, hashes: np.ndarray) -> set[int]:
        if len(hashes) < self.fewest:
            return set()
        at = np.searchsorted(self.values, hashes)
        met = hashes[self.values[np.minimum(at, len(self.values) - 1)] == hashes]
        low, high = np.searchsorted(self.values, met, "left"), np.searchsorted(self.values, met, "right")
        return {int(o) for a, z in zip(low, high) for o in self.owners[a:z]}


class Items:
    """One block of items: partitions by shingle length, and the shingles to verify with."""

    def __init__(self, rows: list[tuple[int | None, bytes]], size: int, least: float):
        self.items, sketches = [], {}
        known = _Hashes()
        for item, text in rows:
            words = _words(text)
            if not words:
                continue
            length = min(size, len(words))
            shingles = frozenset(_shingles(words, length))
            hashes = np.unique(_hashes(words, length, known))
            need = needed(len(shingles), least)
            sketches.setdefault((length, len(shingles).bit_length()), []).append((hashes[: len(shingles) - need + 1], len(self.items), need))
            self.items.append((item, shingles, need))
        self.partitions: dict[int, list[Partition]] = {}
        for (length, _), held in sorted(sketches.items()):
            self.partitions.setdefault(length, []).append(Partition(held))

    def found(self, words: list[bytes], known: _Hashes):
        """Yields ``(item, q, shared)`` for each item that the words contain."""
        for length, partitions in self.partitions.items():
            if len(words) < length:
                continue
            hashes = np.unique(_hashes(words, length, known))
            candidates = set().union(*(p.candidates(hashes) for p in partitions))
            own = set(_shingles(words, length)) if candidates else set()
            for c in sorted(candidates):
                item, shingles, need = self.items[c]
                shared = len(shingles & own)
                if shared >= need:
                    yield item, len(shingles), shared


def _blocks(items: DataFrame, item_id: str, text: str, limit: int):
    """The items in blocks of about ``limit`` words; each is collected by itself."""
    rows = items.select(F.col(item_id).cast("long").alias("item"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.distinct()
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // 6
    count = total // limit + 1
    for k in range(count):
        block = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k) if count > 1 else rows
        yield [(r.item, r.text.encode()) for r in block.collect()]


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
                    words: int = WORDS, least: float = LEAST, block: int = BLOCK_SHINGLES) -> DataFrame:
    """``(doc_id, tie, item_id, n_shingles, n_shared, containment)`` of every item that a document contains.

    Words are runs of letters and digits (any byte above ASCII counts as one), A-Z
    lower-cased. An item of fewer words than a shingle is one shingle of its own length, found where its words stand
    side by side in a document. A null or empty text has no shingle and takes part in no pair. Items are a stated set of
    queries: they go to all documents in blocks of about ``block`` shingles, which bounds what is broadcast.
    Items of one id and several texts count each text. Items and documents without an id take part and keep a null id;
    repeated rows give one pair each. ``tie`` is that of ``work.identity``.
    """
    schema = arrow_schema(doc_id=pa.int64(), tie=pa.int64(), item_id=pa.int64(), n_shingles=pa.int64(), n_shared=pa.int64(), containment=pa.float64())
    ddl = "doc_id long, tie long, item_id long, n_shingles long, n_shared long, containment double"
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), identity(doc_id, text)[1], F.col(text).cast("string").alias("text"))

    def search(sent):
        def run(batches):
            block, known = sent.value, _Hashes()
            for b in batches:
                out = []
                for doc, tie, t in zip(b.column(0).to_pylist(), ints(b.column(1)).tolist(), texts(b.column(2))):
                    out += [(doc, tie, item, q, n, n / q) for item, q, n in block.found(_words(t), known)]
                if out:
                    yield batch(schema, *zip(*out))

        return run

    found = None
    for part in _blocks(items, item_id, item_text, block):
        held = Items(part, words, least)
        if held.items:
            pairs = rows.mapInArrow(search(spark.sparkContext.broadcast(held)), ddl)
            found = pairs if found is None else found.unionByName(pairs)
    return found if found is not None else spark.createDataFrame([], ddl)


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item. Rows with null or empty text stay."""
    id_, tie = fresh(docs, "leaked_doc"), fresh(docs, "leaked_tie")
    pairs = contained_items(docs, items, doc_id, text, **options)
    leaked = pairs.select(F.col("doc_id").alias(id_), F.col("tie").alias(tie)).distinct()
    same = F.col(doc_id).cast("long").eqNullSafe(F.col(id_)) & (identity(doc_id, text)[1] == F.col(tie))
    return docs.join(leaked, same, "left_anti")
