"""Removal of repeated byte strings with a distributed sparse suffix array.

Suffixes are taken at the pieces (see ``pieces``) whose anchor occurs twice or more; all
others are provably unique. Copies of one piece are folded before the shuffle, the distinct ones
are range-partitioned by their leading bytes with splitters that Spark samples, and each bucket
is sorted by multikey quicksort. Suffixes that stay together for ``window`` bytes are equal;
all but the smallest place of each group are repeats. The splitters are the anchor's own
bytes, so equal strings never fall on both sides of a boundary. An anchor with more pieces than
a bucket holds has its windows compared by digest, through map-side aggregates, across buckets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces as P
from .work import arrow_schema, batch, fresh, identity, ints, table, texts, utf8

GRAM = 32
BUCKET = 20_000
_ROWS = 1 << 14
_PIECES = arrow_schema(doc=pa.int64(), tie=pa.int64(), start=pa.int32(), n=pa.int32(), anchor=pa.int64(), body=pa.int64(), lead=pa.int32())
# one random 64-bit number per byte value
_BYTES = P.mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_pieces(df: DataFrame, window: int, gram: int) -> DataFrame:
    """Pieces of ``df(doc, tie, text)`` over UTF-8 bytes."""

    def run(batches):
        for b in batches:
            docs, ties = ints(b.column(0)), ints(b.column(1))
            data, bounds = utf8(b.column(2))
            for a, z in P.blocks(int(bounds[-1]), window):
                if z <= bounds[0]:
                    continue
                first = int(np.searchsorted(bounds, a, side="right")) - 1
                last = int(np.searchsorted(bounds, z, side="left"))
                own = bounds[first : last + 1].astype(np.int64)
                lengths = np.minimum(own[1:], z) - np.maximum(own[:-1], a)
                lengths = np.maximum(lengths, 0)
                owner = np.repeat(np.arange(first, last), lengths)
                left = np.repeat(own[1:], lengths) - np.arange(a, z)
                found = P.cut(_BYTES[data[a:z]], left, window, gram)
                if found is not None:
                    starts, counts, anchors, bodies, leads = found
                    who = owner[starts]
                    yield batch(_PIECES, docs[who], ties[who], starts + a - bounds[who], counts, anchors.view(np.int64), bodies.view(np.int64), leads)

    return df.mapInArrow(run, P.PIECE + ", lead int")


def _bodies(docs: DataFrame, places: DataFrame, window: int, gram: int) -> DataFrame:
    """``(anchor, suffix, doc, tie, start, n, body)``: the bytes of each place, read from its document.

    ``suffix`` are the first ``gram`` bytes of its suffix, the anchor itself.
    """
    schema = arrow_schema(anchor=pa.int64(), suffix=pa.binary(), doc=pa.int64(), tie=pa.int64(), start=pa.int32(), n=pa.int32(), body=pa.binary())

    def run(batches):
        for b in batches:
            rows = []
            for doc, tie, text, at in zip(ints(b.column("doc")).tolist(), ints(b.column("tie")).tolist(), texts(b.column("text")), b.column("places").to_pylist()):
                rows += [(p["anchor"], text[p["start"] + p["lead"] : p["start"] + p["lead"] + gram], doc, tie, p["start"], p["n"], text[p["start"] : p["start"] + p["n"] + window - 1]) for p in at]
                if len(rows) >= _ROWS:
                    yield batch(schema, *zip(*rows))
                    rows = []
            if rows:
                yield batch(schema, *zip(*rows))

    by_doc = places.groupBy("doc", "tie").agg(F.collect_set(F.struct("anchor", "start", "n", "lead")).alias("places"))
    return docs.join(by_doc, ["doc", "tie"]).select("doc", "tie", "text", "places").mapInArrow(
        run, "anchor long, suffix binary, doc long, tie long, start int, n int, body binary"
    )


def multikey_groups(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the strings of ``length`` bytes at ``at`` and groups equal ones.

    Multikey quicksort on eight bytes at a time: strings are ordered by one word, split
    where it differs, and only parts of two or more go on to the next word. Returns the indices
    into ``at`` that share their string, and a group number for each.
    """
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    words = np.zeros(len(data) + 1, np.uint64)
    for k in range(8):
        words |= padded[k : k + len(words)] << np.uint64(56 - 8 * k)
    alive, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    steps = [*range(0, length - 7, 8)]
    if steps[-1] + 8 < length:
        steps.append(length - 8)
    for step in steps:
        if not len(alive):
            break
        key = words[at[alive] + step]
        order = np.lexsort((key, group))
        alive, group, key = alive[order], group[order], key[order]
        opens = np.append(True, (group[1:] != group[:-1]) | (key[1:] != key[:-1]))
        single = opens & np.append(opens[1:], True)
        group = np.cumsum(opens)[~single]
        alive = alive[~single]
    return alive, group


def _repeats_in(rows: pa.Table, window: int):
    """``(doc, tie, start, n)`` arrays of the windows of one bucket that have a smaller place in it."""
    data, bounds = utf8(rows.column("body").combine_chunks())
    data, bounds = data[bounds[0] : bounds[-1]], bounds - bounds[0]
    doc, tie, start, n = (ints(rows.column(c).combine_chunks()).astype(np.int64) for c in ("doc", "tie", "start", "n"))
    row = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    alive, group = multikey_groups(data, bounds[:-1][row] + offset, window)
    row, place = row[alive], start[row[alive]] + offset[alive]
    order = np.lexsort((place, tie[row], doc[row], group))
    row, place, group = row[order], place[order], group[order]
    opens = np.append(True, group[1:] != group[:-1])[: len(group)]
    head = np.flatnonzero(opens)[np.cumsum(opens) - 1] if len(group) else row
    # a place listed twice is no repeat of itself
    later = (doc[row] != doc[row[head]]) | (tie[row] != tie[row[head]]) | (place != place[head])
    row, place = row[later], place[later]
    order = np.lexsort((place, tie[row], doc[row]))
    row, place = row[order], place[order]
    if not len(row):
        return None
    opens = np.append(True, (doc[row][1:] != doc[row][:-1]) | (tie[row][1:] != tie[row][:-1]) | (place[1:] > place[:-1] + 1))
    begin = np.flatnonzero(opens)
    end = np.append(begin[1:], len(row)) - 1
    return doc[row][begin], tie[row][begin], place[begin], place[end] - place[begin] + 1


_REPEATS = arrow_schema(doc=pa.int64(), tie=pa.int64(), start=pa.int32(), n=pa.int32())


def _sorted_buckets(bodies: DataFrame, window: int, bucket: int) -> DataFrame:
    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            found = _repeats_in(pa.Table.from_batches(held), window)
            if found is not None:
                yield batch(_REPEATS, *found)

    buckets = max(1, -(-bodies.count() // bucket))
    spread = bodies.repartitionByRange(buckets, "suffix")
    return spread.select("doc", "tie", "start", "n", "body").mapInArrow(run, "doc long, tie long, start int, n int")


def _by_digest(bodies: DataFrame, window: int) -> DataFrame:
    schema = arrow_schema(digest=pa.binary(), doc=pa.int64(), tie=pa.int64(), start=pa.int32())

    def run(batches):
        for b in batches:
            rows = []
            for doc, tie, start, body in zip(ints(b.column(0)).tolist(), ints(b.column(1)).tolist(), ints(b.column(2)).tolist(), texts(b.column(3))):
                rows += [(xxhash.xxh3_128_digest(body[i : i + window]), doc, tie, start + i) for i in range(len(body) - window + 1)]
                if len(rows) >= _ROWS:
                    yield batch(schema, *zip(*rows))
                    rows = []
            if rows:
                yield batch(schema, *zip(*rows))

    digests = bodies.select("doc", "tie", "start", "body").mapInArrow(run, "digest binary, doc long, tie long, start int")
    return P.earlier_windows(digests).withColumn("n", F.lit(1))


def repeated_strings(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 100, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """``(doc, tie, start, n)``: n strings of ``window`` bytes from byte ``start`` on that also start earlier.

    ``doc`` and ``tie`` are those of ``work.identity``, which also settles null and repeated ids;
    null texts are empty, and texts shorter than a window have no row.
    """
    if not 8 <= gram <= window:
        raise ValueError("gram must lie between 8 and window")
    docs = df.select(*identity(doc_id, text), F.col(text).cast("string").alias("text"))
    suffixes = table(byte_pieces(docs, window, gram), "suffixes")
    shared = table(P.repeated(suffixes), "repeated-suffixes")
    firsts = table(P.first_places(shared), "first-suffixes")
    place = F.struct("doc", "tie", "start")
    source = F.struct("first.doc", "first.tie", "first.start")
    copies = shared.join(firsts.select("anchor", "body", "first"), ["anchor", "body"]).where(place > source).select("doc", "tie", "start", "n")
    distinct = firsts.where("mixed").select("anchor", "first.doc", "first.tie", "first.start", "first.n", "first.lead")
    crowded = distinct.groupBy("anchor").agg(F.count("*").alias("pieces")).where(F.col("pieces") > bucket).select("anchor")
    bodies = table(_bodies(docs, distinct, window, gram), "suffix-bodies")
    crowded = table(crowded, "crowded")
    in_buckets = _sorted_buckets(bodies.join(crowded, "anchor", "left_anti"), window, bucket)
    across = _by_digest(bodies.join(crowded, "anchor", "left_semi"), window)
    return copies.unionByName(in_buckets).unionByName(across)


def _covered(n_bytes: int, spans: list[dict], window: int):
    starts = np.array([s["start"] for s in spans], np.int64)
    return P.merge(starts, np.minimum(starts + np.array([s["n"] for s in spans], np.int64) + window - 1, n_bytes))


def _kept(text: bytes, spans: list[dict] | None, window: int) -> tuple[bytes, int]:
    if not spans:
        return text, 0
    kept, at = [], 0
    begins, ends = (x.tolist() for x in _covered(len(text), spans, window))
    for a, z in zip(begins, ends):
        kept.append(text[at:a])
        at = z
    return b"".join([*kept, text[at:]]), len(begins)


def remove_repeated_strings(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 100, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """``(doc_id, kept, n_bytes, n_removed, n_spans, kept_sha256)``, one row per row of ``df``.

    ``kept`` are the remaining bytes; a cut may fall inside a character, so they are binary.
    """
    schema = arrow_schema(doc_id=pa.int64(), kept=pa.binary(), n_bytes=pa.int64(), n_removed=pa.int64(), n_spans=pa.int64(), kept_sha256=pa.string())

    def run(batches):
        for b in batches:
            rows = []
            for i, t, spans in zip(b.column(0).to_pylist(), texts(b.column(1)), b.column(2).to_pylist()):
                kept, n_spans = _kept(t, spans, window)
                rows.append((i, kept, len(t), len(t) - len(kept), n_spans, hashlib.sha256(kept).hexdigest()))
            yield batch(schema, *zip(*rows)) if rows else batch(schema, *[[]] * 6)

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    spans = table(P.places_by_document(repeated_strings(rows, "doc_id", "text", window, gram, bucket)), "removed")
    keyed = rows.select("doc_id", "text", *identity("doc_id", "text")).join(spans, ["doc", "tie"], "left")
    return keyed.select("doc_id", "text", "spans").mapInArrow(
        run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
