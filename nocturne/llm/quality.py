"""Document quality: fixed rules, then a hashed n-gram likelihood ratio, all in SQL functions.

Words and pairs of neighbouring words are hashed into ``BUCKETS`` buckets. Two multinomials
over the buckets are counted, one over trusted texts and one over the whole corpus, and a
document scores the mean log ratio of its n-grams. Every document is held against the same
threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import fresh, table

BUCKETS = 1 << 14
TRUSTED_ROWS = 20_000
THRESHOLD = -0.15
SMOOTHING = 10.0
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """Words between ASCII white space; none for null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), _SPACES, " " * len(_SPACES))
    return F.array_remove(F.split(spaced, " "), "")


def _with(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Number of words in 3-word windows found twice or more in the text, first ones included.

    Window hashes are sorted with their positions in the low bits, so equal windows become
    neighbours; neighbours are then compared word by word.
    """
    n = F.size(words)
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n))) - 1
    return _with(mask, lambda low: _repeated_words(words, n, low))


def _repeated_words(words: Column, n: Column, low: Column) -> Column:
    at = lambda i: F.get(words, i)
    codes = F.when(n < 4, F.array().cast("array<bigint>")).otherwise(F.sort_array(F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))
    )))

    def equal(a: Column, b: Column) -> Column:
        i, j = a.bitwiseAND(low).cast("int"), b.bitwiseAND(low).cast("int")
        same = a.bitwiseAND(F.bitwise_not(low)) == b.bitwiseAND(F.bitwise_not(low))
        return F.when(same, (at(i) == at(j)) & (at(i + 1) == at(j + 1)) & (at(i + 2) == at(j + 2))).otherwise(False)

    def covered(sorted_codes: Column) -> Column:
        twice = F.filter(sorted_codes, lambda x, k: F.coalesce(equal(x, F.get(sorted_codes, k - 1)), F.lit(False)) | F.coalesce(equal(x, F.get(sorted_codes, k + 1)), F.lit(False)))
        starts = F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(low)))
        return _with(starts, lambda s: F.aggregate(
            F.transform(s, lambda x, k: F.least(F.lit(3).cast("long"), F.coalesce(F.get(s, k + 1) - x, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda acc, x: acc + x
        ))

    return _with(codes, covered)


def _figures(text: Column, words: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, _SPACES, "")) > 0)
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(text, _SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long"),
        "n_dup_lines": _with(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def verdict(text: Column, weights: Column, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> Column:
    """A struct of ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``, ``llr``, ``kept``.

    Null texts are empty: no words, and they fail. ``llr`` is the mean weight of the text's words and
    word pairs, null without words. The words are split once for each row, whatever the plan
    does with the expression.
    """

    def ratio(words: Column) -> Column:
        each = F.transform(words, lambda x, i: F.get(weights, _bucket(x, buckets=buckets)) + F.coalesce(
            F.when(i + 1 < F.size(words), F.get(weights, _bucket(x, F.get(words, i + 1), buckets=buckets))), F.lit(0.0)
        ))
        return F.when(F.size(words) > 0, F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x) / (2 * F.size(words) - 1))

    def decide(words: Column, repeats: Column, llr: Column) -> Column:
        n = F.size(words)
        failed = (n < 50) | (100 * repeats > 50 * n)
        figures = [c.alias(name) for name, c in _figures(t, words).items()]
        return F.struct(*figures, repeats.alias("n_repeat_words"), failed.alias("base_failed"), llr.alias("llr"), (~failed & (F.coalesce(llr, F.lit(0.0)) >= threshold)).alias("kept"))

    t = F.coalesce(text.cast("string"), F.lit(""))
    return _with(words_of(t), lambda words: _with(
        F.struct(repeated_words(words).alias("repeats"), ratio(words).alias("llr")), lambda x: decide(words, x.getField("repeats"), x.getField("llr"))
    ))


def _bucket(*parts: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")


def _counts(texts: DataFrame, buckets: int) -> DataFrame:
    """``(bucket, n)`` over words and word pairs of ``texts(text)``, combined before the shuffle."""
    words = texts.select(words_of(F.col("text")).alias("words"))
    each = words.select("words", F.posexplode("words").alias("i", "word"))
    pair = F.when(F.col("i") + 1 < F.size("words"), _bucket("word", F.get("words", F.col("i") + 1), buckets=buckets))
    grams = each.select(F.explode(F.array(_bucket("word", buckets=buckets), pair)).alias("bucket"))
    return grams.where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"))


def trusted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", rows: int = TRUSTED_ROWS) -> DataFrame:
    """Up to ``rows`` documents labelled of good quality and not toxic, the same ones on each run.

    The bound keeps the list of their ids small enough to broadcast.
    """
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("trusted_id")).where("trusted_id IS NOT NULL").distinct()
    chosen = good.orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(rows)
    return docs.join(F.broadcast(chosen), F.col(doc_id).cast("long") == F.col("trusted_id"), "left_semi")


def weights(corpus: DataFrame, target: DataFrame, text: str = "text", buckets: int = BUCKETS, copies: bool = False) -> DataFrame:
    """One row ``(weights)``: log p(bucket | target) - log p(bucket | corpus), both smoothed by ``SMOOTHING`` a bucket.

    On both sides all texts count: with ``copies`` every row, else each distinct text once.
    Without a target text all weights are zero.
    """
    said = lambda df: df.select(F.col(text).cast("string").alias("text"))
    counted = lambda df: _counts(said(df) if copies else said(df).distinct(), buckets)
    both = counted(corpus).select("bucket", F.lit(0).cast("long").alias("t"), F.col("n").alias("r")).unionByName(
        counted(target).select("bucket", F.col("n").alias("t"), F.lit(0).cast("long").alias("r"))
    ).unionByName(corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("r")))
    counts = table(both.groupBy("bucket").agg(F.sum("t").alias("t"), F.sum("r").alias("r")), "grams")
    total = counts.agg(F.sum("t").alias("all_t"), F.sum("r").alias("all_r"))
    smoothed = lambda c: F.log((F.col(c) + SMOOTHING) / (F.col(f"all_{c}") + SMOOTHING * buckets))
    ratio = F.when(F.col("all_t") > 0, smoothed("t") - smoothed("r")).otherwise(0.0)
    one = counts.join(F.broadcast(total)).select("bucket", ratio.alias("w"))
    return one.agg(F.sort_array(F.collect_list(F.struct("bucket", "w"))).getField("w").alias("weights"))


def _constant(model: DataFrame) -> Column:
    """The ``buckets`` weights, spelt as text so that the plan holds one constant."""
    return F.split(F.lit(",".join(map(repr, model.first()["weights"]))), ",").cast("array<double>")


def _verdicts(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, threshold: float, buckets: int, trusted_rows: int, copies: bool) -> Column:
    model = table(weights(docs, trusted(docs, labels, doc_id, trusted_rows), text, buckets, copies), "weights")
    return verdict(F.col(text), _constant(model), threshold, buckets)


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS,
          trusted_rows: int = TRUSTED_ROWS, copies: bool = False) -> DataFrame:
    """``docs`` with the columns of ``verdict``, one row per row; columns of these names are replaced.

    A document is kept if it passes the fixed rules and its mean log ratio is ``threshold`` or
    more. The corpus counts cover every text of ``docs``, with ``copies`` every row. A null text has no words and fails; rows that
    share an id are judged each by their own text.
    """
    found = fresh(docs, "verdict")
    judged = docs.withColumn(found, _verdicts(docs, labels, doc_id, text, threshold, buckets, trusted_rows, copies))
    names = judged.schema[found].dataType.names
    return judged.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in names), *(F.col(found).getField(n).alias(n) for n in names))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS,
              trusted_rows: int = TRUSTED_ROWS, copies: bool = False) -> DataFrame:
    """The kept rows of ``docs`` with its own columns, values unchanged."""
    return docs.where(_verdicts(docs, labels, doc_id, text, threshold, buckets, trusted_rows, copies).getField("kept"))
