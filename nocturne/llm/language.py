"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of labelled text. A text is parsed into the longest
phrases that occur in a language's text; a foreign text falls into more and shorter ones.
Phrases times the logarithm of the sample's size, per byte, estimate the cross entropy, and the
smallest wins. Many stretches of text are parsed side by side, one byte at a time.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import arrow_schema, batch, utf8

TEXTS = 64
CHARACTERS = 512
STRETCH = 2048
FOLDS = 5
_LANES = 1 << 14
_LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Whether a row is kept from learning; rows without an id are."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def samples(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", texts: int = TEXTS, characters: int = CHARACTERS) -> dict[str, bytes]:
    """Text of each language, ``texts`` times ``characters`` characters at most.

    Each language's rows are dealt by hash into ``texts`` classes and the row with the smallest
    hash of each class is taken, so the choice is combined before the shuffle and does not
    depend on the layout. Of a longer text the ``characters`` from a hashed offset are taken, anywhere in
    it, so a header or licence at the top is not all that is learned. Only rows with a language
    and outside the held-out fold are read. Rows that are repeated, or share id and text, count once.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("doc_id")))
    rows = rows.withColumn("key", F.xxhash64(F.lit(5), "doc_id", "text"))
    least = rows.groupBy("lang", F.pmod("key", F.lit(texts)).alias("class")).agg(F.min("key").alias("key"))
    chosen = [r.key for r in least.select("key").collect()]
    offset = (F.pmod(F.xxhash64(F.lit(6), "key"), F.greatest(F.length("text") - characters, F.lit(0)) + 1) + 1).cast("int")
    taken = rows.where(F.col("key").isin(chosen)).select("lang", "key", F.substring(F.col("text"), offset, F.lit(characters)).alias("text")).distinct() if chosen else rows.limit(0)
    out: dict[str, list] = {}
    for r in taken.collect():
        out.setdefault(r.lang, []).append((r.key, r.text.encode()))
    return {name: b"\n".join(t for _, t in sorted(found)) for name, found in sorted(out.items())}


def _classes(sample: bytes) -> np.ndarray:
    """Symbols of bytes: letters without case, one for all other ASCII, one for each other byte seen, 0 for the rest."""
    symbol = np.zeros(256, np.uint8)
    symbol[:128] = 1
    for i in range(26):
        symbol[[65 + i, 97 + i]] = 2 + i
    high = sorted({b for b in sample if b >= 128})
    symbol[high] = np.arange(28, 28 + len(high))
    return symbol


def automaton(symbols: list[int], alphabet: int) -> np.ndarray:
    """Transitions of the suffix automaton, one row per state and -1 where there is none."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    steps = np.full((len(follow), alphabet), -1, np.int32)
    for state, out in enumerate(follow):
        for c, to in out.items():
            steps[state, c] = to
    return steps


@lru_cache(maxsize=4)
def _model(learned: tuple[tuple[str, bytes], ...]):
    """Byte symbols, and the automaton and size of each language; built once in a worker."""
    symbol = _classes(b"".join(t for _, t in learned))
    alphabet = int(symbol.max()) + 1
    return symbol, [(name, automaton(symbol[np.frombuffer(t, np.uint8)].tolist(), alphabet), len(t)) for name, t in learned]


def phrases(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Number of longest-match phrases in each stretch; lengths must not increase."""
    alphabet = steps.shape[1]
    flat, root = steps.ravel(), steps[0]
    state, count = np.zeros(len(starts), np.int32), np.zeros(len(starts), np.int64)
    live = len(starts)
    for t in range(int(lengths[0]) if len(lengths) else 0):
        while lengths[live - 1] <= t:
            live -= 1
        c = symbols[starts[:live] + t]
        to = flat[state[:live].astype(np.int64) * alphabet + c]
        ended = np.flatnonzero(to < 0)
        if len(ended):
            again = root[c[ended]]
            count[ended] += 1
            # a byte the language does not have at all is a phrase of its own
            count[ended[(again < 0) & (state[ended] != 0)]] += 1
            to[ended] = np.maximum(again, 0)
        state[:live] = to
    return count + (state != 0)


def predict(df: DataFrame, learned: dict[str, bytes], text: str = "text") -> DataFrame:
    """``df(doc_id, held_out, text)`` with ``lang_pred`` and ``score`` in place of the text.

    Texts are parsed in stretches of ``STRETCH`` bytes, all of them. ``score`` is one less the ratio of
    the smallest to the second smallest cross entropy (1 with one language). Null texts and texts
    without a letter are ``und`` with score 0, and so are all if nothing could be learned.
    Equal entropies go to the first language by name.
    """
    model = tuple(learned.items())
    schema = arrow_schema(doc_id=pa.int64(), held_out=pa.bool_(), lang_pred=pa.string(), score=pa.float64())

    def judge(column):
        data, bounds = utf8(column)
        symbol, languages = _model(model)
        sizes = np.diff(bounds)
        pieces = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = bounds[:-1][owner] + nth * STRETCH
        lengths = np.minimum(sizes[owner] - nth * STRETCH, STRETCH)
        order = np.argsort(-lengths, kind="stable")
        symbols = symbol[data]
        bits = np.zeros((len(languages), len(sizes)))
        for k, (_, steps, size) in enumerate(languages):
            for a in range(0, len(order), _LANES):
                lanes = order[a : a + _LANES]
                found = phrases(symbols, starts[lanes], lengths[lanes], steps)
                bits[k] += np.bincount(owner[lanes], found, len(sizes)) * np.log2(size + 1)
        return bits / np.maximum(sizes, 1)

    def run(batches):
        names = [name for name, _ in model]
        for b in batches:
            column = b.column(2)
            letters = np.array([t is not None and _LETTER.search(t) is not None for t in column.to_pylist()], bool)
            if not names:
                yield batch(schema, b.column(0), b.column(1), ["und"] * len(column), [0.0] * len(column))
                continue
            bits = judge(column)
            best = bits.argmin(0)
            ranked = np.sort(bits, axis=0)
            score = np.where(ranked[-1] > 0, 1 - ranked[0] / np.maximum(ranked[min(1, len(names) - 1)], 1e-12), 0.0) if len(names) > 1 else np.ones(len(column))
            said = [names[i] if ok else "und" for i, ok in zip(best.tolist(), letters.tolist())]
            yield batch(schema, b.column(0), b.column(1), said, np.where(letters, score, 0.0))

    rows = df.select("doc_id", "held_out", F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", texts: int = TEXTS, characters: int = CHARACTERS) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``, one row per row of ``docs``; see ``samples`` and ``predict``."""
    learned = samples(docs, doc_id, text, lang, texts, characters)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return predict(rows, learned)
