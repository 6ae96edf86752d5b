"""Cutting token sequences into pieces whose repeats can be found by equality joins.

A window is ``window`` consecutive tokens. Its anchor is the leftmost of its
``gram``-token substrings with the smallest hash. A piece is a maximal run of windows of one
document with the same anchor. Equal windows have equal anchors at equal offsets, so
a window can only repeat where its piece's anchor repeats, and a window inside a long repeat
lies in pieces that are equal as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import table

BLOCK = 1 << 17
_LOW = np.uint64(22)  # bits of a position inside a block
_BASE = 0x9E3779B97F4A7C15 | 1
PIECE = "doc long, tie long, start int, n int, anchor long, body long"


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))))


_POW = _powers(_BASE, 2 * BLOCK)
_INV = _powers(pow(_BASE, -1, 1 << 64), 2 * BLOCK)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of any substring of up to ``2 * BLOCK`` token hashes, by prefix sums modulo 2**64."""

    def __init__(self, tokens: np.ndarray):
        self.sums = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(tokens * _POW[: len(tokens)], out=self.sums[1:])

    def between(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * _INV[starts] + (ends - starts).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * _INV[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, in log(width) passes."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def cut(tokens: np.ndarray, left: np.ndarray, window: int, gram: int):
    """Pieces of one block: ``(start, windows, anchor hash, body hash, anchor offset)`` arrays.

    ``left[i]`` is the number of tokens from i to the end of i's document. Pieces end at the
    block's ends, which costs a comparison more and no match.
    """
    n = len(tokens) - window + 1
    if n <= 0:
        return None
    rolling = Rolling(tokens)
    hashes = rolling.grams(gram)
    order = (hashes >> _LOW << _LOW) | np.arange(len(hashes), dtype=np.uint64)
    anchors = (sliding_min(order, window - gram + 1) & np.uint64((1 << 22) - 1)).astype(np.int64)
    whole = left[:n] >= window
    opens = whole.copy()
    opens[1:] &= ~whole[:-1] | (anchors[1:] != anchors[:-1])
    starts = np.flatnonzero(opens)
    if not len(starts):
        return None
    # a piece ends where the next one opens or where windows leave their document
    closes = np.flatnonzero(whole & np.append(opens[1:] | ~whole[1:], True))
    counts = closes - starts + 1
    where = anchors[starts]
    return starts, counts, hashes[where], rolling.between(starts, starts + counts + window - 1), where - starts


def blocks(total: int, window: int) -> Iterator[tuple[int, int]]:
    """Bounds of overlapping blocks that hold every window once."""
    for a in range(0, max(total - window + 1, 0), BLOCK):
        yield a, min(a + BLOCK + window - 1, total)


def repeated(pieces: DataFrame) -> DataFrame:
    """The pieces whose anchor occurs twice or more, with ``mixed``: whether in pieces that differ.

    Anchors are counted with map-side aggregates; the counted keys come back by a join of two
    tables, whose hot keys Spark can split.
    """
    counted = table(
        pieces.groupBy("anchor").agg(F.count("*").alias("times"), F.min("body").alias("low"), F.max("body").alias("high"))
        .where("times > 1").select("anchor", (F.col("low") != F.col("high")).alias("mixed")),
        "shared-anchors",
    )
    return pieces.join(counted, "anchor")


def first_places(pieces: DataFrame) -> DataFrame:
    """``(anchor, body, mixed, first)`` of each distinct piece; ``first`` is its smallest place."""
    place = F.struct("doc", "tie", "start", *(c for c in pieces.columns if c in ("n", "lead")))
    return pieces.groupBy("anchor", "body").agg(F.min(place).alias("first"), F.first("mixed").alias("mixed"))


def places_by_document(places: DataFrame) -> DataFrame:
    """``(doc, tie, spans)``: all places of a document, no more than it has tokens."""
    return places.groupBy("doc", "tie").agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("spans"))


def earlier_windows(windows: DataFrame) -> DataFrame:
    """The rows of ``(digest, doc, tie, start)`` whose digest has a smaller place."""
    place = F.struct("doc", "tie", "start")
    first = windows.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1")
    first = table(first.drop("times"), "first-windows")
    return windows.join(first, "digest").where(place > F.col("first")).select("doc", "tie", "start")


def merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open ranges as sorted disjoint ranges that do not touch."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    opens = np.append(True, starts[1:] > reach[:-1])
    return starts[opens], reach[np.append(opens[1:], True)]
