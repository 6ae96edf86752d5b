"""Removal of repeated word windows by compacting a De Bruijn graph.

Edges of the graph are windows of ``window`` consecutive words. ``pieces`` holds each
document's walk as short paths (runs of edges with one anchor); an edge whose anchor occurs
once is unique and leaves. Paths that repeat as a whole are joined to their first occurrence,
and neighbours whose sources are neighbours too are compacted into one span. Where paths
branch (same anchor, different path) their edges are compared one by one. The words of every
compacted span are then read at its place and at its source and compared.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pieces as P
from .work import arrow_schema, batch, fresh, identity, ints, table, texts

GRAM = 6
_CHUNK = 1 << 16
_KNOWN = 1 << 20
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_PIECES = arrow_schema(doc=pa.int64(), tie=pa.int64(), start=pa.int32(), n=pa.int32(), anchor=pa.int64(), body=pa.int64())


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _KNOWN:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 11)
        return h


def word_hashes(words: list[bytes], known: _Hashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def word_pieces(df: DataFrame, window: int, gram: int) -> DataFrame:
    """Pieces of ``df(doc, tie, text)`` over words."""

    def flush(docs, hashes):
        lengths = np.array([len(h) for h in hashes])
        tokens = np.concatenate(hashes)
        bounds = np.cumsum(lengths)
        begins = bounds - lengths
        owner = np.repeat(np.arange(len(docs)), lengths)
        left = bounds[owner] - np.arange(len(tokens))
        for a, b in P.blocks(len(tokens), window):
            found = P.cut(tokens[a:b], left[a:b], window, gram)
            if found is not None:
                starts, counts, anchors, bodies, _ = found
                who = owner[starts + a]
                ids = np.array(docs, np.int64)[who]
                yield batch(_PIECES, ids[:, 0], ids[:, 1], starts + a - begins[who], counts, anchors.view(np.int64), bodies.view(np.int64))

    def run(batches):
        known, docs, hashes, size = _Hashes(), [], [], 0
        for b in batches:
            for doc, tie, text in zip(ints(b.column(0)).tolist(), ints(b.column(1)).tolist(), texts(b.column(2))):
                words = text.split()
                if len(words) >= window:
                    docs.append((doc, tie))
                    hashes.append(word_hashes(words, known))
                    size += len(words)
                    if size >= _CHUNK:
                        yield from flush(docs, hashes)
                        docs, hashes, size = [], [], 0
        if docs:
            yield from flush(docs, hashes)

    return df.mapInArrow(run, P.PIECE)


def _spans_with_words(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """Digests of the wanted places: one for a compacted span, one for each edge of a branching path."""
    schema = arrow_schema(digest=pa.binary(), doc=pa.int64(), tie=pa.int64(), start=pa.int32(), span=pa.int64())

    def run(batches):
        for b in batches:
            out = []
            for doc, tie, text, places in zip(ints(b.column("doc")).tolist(), ints(b.column("tie")).tolist(), texts(b.column("text")), b.column("places").to_pylist()):
                words = text.split()
                for p in places:
                    if p["span"] is not None:
                        out.append((xxhash.xxh3_128_digest(b" ".join(words[p["start"] : p["start"] + p["n"] + window - 1])), doc, tie, p["start"], p["span"]))
                    else:
                        out += [(xxhash.xxh3_128_digest(b" ".join(words[i : i + window])), doc, tie, i, None) for i in range(p["start"], p["start"] + p["n"])]
                if len(out) > _CHUNK:
                    yield batch(schema, *zip(*out))
                    out = []
            if out:
                yield batch(schema, *zip(*out))

    places = wanted.groupBy("doc", "tie").agg(F.collect_set(F.struct("start", "n", "span")).alias("places"))
    rows = docs.join(places, ["doc", "tie"]).select("doc", "tie", "text", "places")
    return rows.mapInArrow(run, "digest binary, doc long, tie long, start int, span long")


def compacted(whole: DataFrame) -> DataFrame:
    """Joins neighbouring repeated paths whose sources are neighbours into ``(doc, tie, start, n, source)`` spans."""
    walk = Window.partitionBy("doc", "tie").orderBy("start")
    last = {c: F.lag(c).over(walk) for c in ("start", "n", "from_doc", "from_tie", "from_start")}
    goes_on = (
        (F.col("start") == last["start"] + last["n"]) & (F.col("from_doc") == last["from_doc"]) & (F.col("from_tie") == last["from_tie"])
        & (F.col("from_start") == last["from_start"] + last["n"])
    )
    runs = whole.withColumn("opens", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("opens").over(walk))
    return runs.groupBy("doc", "tie", "run").agg(
        F.min("start").alias("start"), F.sum("n").cast("int").alias("n"), F.first("from_doc").alias("from_doc"),
        F.first("from_tie").alias("from_tie"), F.min("from_start").alias("from_start"),
    ).withColumn("span", F.monotonically_increasing_id())


def repeated_spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 20, gram: int = GRAM) -> DataFrame:
    """``(doc, tie, start, n)``: n windows from word ``start`` on that also start earlier.

    Words are runs of bytes other than ASCII white space, unchanged. ``doc`` and ``tie`` are
    those of ``work.identity``, which also settles null and repeated ids; null and empty texts and
    texts shorter than a window have no row.
    """
    docs = df.select(*identity(doc_id, text), F.col(text).cast("string").alias("text"))
    walks = table(word_pieces(docs, window, gram), "paths")
    shared = table(P.repeated(walks), "repeated-paths")
    firsts = table(P.first_places(shared), "first-paths")
    place = F.struct("doc", "tie", "start")
    source = F.struct("first.doc", "first.tie", "first.start")
    whole = (
        shared.select("anchor", "body", "doc", "tie", "start", "n").distinct().join(firsts.select("anchor", "body", "first"), ["anchor", "body"]).where(place > source)
        .select("doc", "tie", "start", "n", F.col("first.doc").alias("from_doc"), F.col("first.tie").alias("from_tie"), F.col("first.start").alias("from_start"))
    )
    spans = table(compacted(whole), "spans")
    both = F.explode(F.array(
        F.struct("doc", "tie", "start"), F.struct(F.col("from_doc").alias("doc"), F.col("from_tie").alias("tie"), F.col("from_start").alias("start"))
    ))
    ends = spans.select(both.alias("p"), "n", "span").select("p.doc", "p.tie", "p.start", "n", "span")
    branching = firsts.where("mixed").select("first.doc", "first.tie", "first.start", "first.n", F.lit(None).cast("long").alias("span"))
    read = table(_spans_with_words(docs, ends.unionByName(branching), window), "words")
    proved = read.where("span IS NOT NULL").groupBy("span").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low = high")
    long_ones = spans.join(proved.select("span"), "span", "left_semi").select("doc", "tie", "start", "n")
    edges = P.earlier_windows(read.where("span IS NULL").select("digest", "doc", "tie", "start").distinct()).withColumn("n", F.lit(1))
    return long_ones.unionByName(edges)


def _covered(n_words: int, spans: list[dict], window: int) -> tuple[np.ndarray, np.ndarray]:
    starts = np.array([s["start"] for s in spans], np.int64)
    return P.merge(starts, np.minimum(starts + np.array([s["n"] for s in spans], np.int64) + window - 1, n_words))


def _with_spans(df: DataFrame, doc_id: str, text: str, window: int, gram: int) -> tuple[DataFrame, str]:
    spans = table(P.places_by_document(repeated_spans(df, doc_id, text, window, gram)), "removed")
    doc, tie, name = fresh(df, "doc"), fresh(df, "tie"), fresh(df, "spans")
    key, second = identity(doc_id, text)
    rows = df.withColumns({doc: key, tie: second})
    spans = spans.select(F.col("doc").alias(doc), F.col("tie").alias(tie), F.col("spans").alias(name))
    return rows.join(spans, [doc, tie], "left").drop(doc, tie), name


def removal_digests(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 20, gram: int = GRAM) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)``, one row per row of ``df``."""
    schema = arrow_schema(doc_id=pa.int64(), n_words=pa.int64(), n_removed=pa.int64(), kept_sha256=pa.string())

    def run(batches):
        for b in batches:
            n_words, n_removed, digests = [], [], []
            for t, spans in zip(texts(b.column(1)), b.column(2).to_pylist()):
                words = t.split()
                n_words.append(len(words))
                kept = words
                if spans:
                    kept, at = [], 0
                    for a, z in zip(*(x.tolist() for x in _covered(len(words), spans, window))):
                        kept += words[at:a]
                        at = z
                    kept += words[at:]
                n_removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield batch(schema, b.column(0), n_words, n_removed, digests)

    rows, spans = _with_spans(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), "doc_id", "text", window, gram)
    return rows.select("doc_id", "text", spans).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _cut(text: bytes, spans: list[dict], window: int) -> str:
    words = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    for a, z in zip(*(x.tolist() for x in _covered(len(words), spans, window))):
        kept.append(text[at : words[a][0]])
        at = words[z][0] if z < len(words) else len(text)
    return b"".join([*kept, text[at:]]).decode("utf-8")


def drop_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 20, gram: int = GRAM) -> DataFrame:
    """``df`` with all columns, repeated words cut from ``text`` with the white space behind them.

    Every row stays, also one whose text becomes empty; null stays null.
    """

    @F.pandas_udf("string")
    def cut(texts, spans):
        return texts.combine(spans, lambda t, s: t if s is None or t is None or not len(s) else _cut(t.encode(), s, window))

    rows, spans = _with_spans(df, doc_id, text, window, gram)
    return rows.withColumn(text, F.when(F.col(spans).isNull(), F.col(text)).otherwise(cut(F.col(text).cast("string"), spans))).select(*df.columns)
