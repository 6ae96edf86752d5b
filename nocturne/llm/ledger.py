"""Secret scans with a ledger of contents, so that each content is scanned once for each rule version.

Every version of every path is named by the SHA-256 of its text. The ledger, one Parquet table, has a
row for each blob and update: the (rule, version) pairs the blob was scanned for and the spans found.
An update scans only pairs that the ledger lacks; findings come back to all paths by a join on the digest.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import fresh, shuffles_dropped, table


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``, kept if ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    version: int = 1


# The base rules, then kinds that hold a secret by their own form. A run of hex digits
# contains no second match, so ``hex`` may ask for 24 at once; the further rules bound what comes before their first
# certain character, so long runs of letters take linear time.
BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{5,200}\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("login", r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._~-]{1,64}:([^\x00-\x20@/:]{6,128})@", 6, 1),
)
RULES = BASE + MORE

PAIRS = "array<struct<kind: string, version: int>>"
SPANS = "array<struct<kind: string, version: int, start: int, end: int>>"
LEDGER = f"blob binary, pairs {PAIRS}, spans {SPANS}"
_PAIR = pa.struct([("kind", pa.string()), ("version", pa.int32())])
_SPAN = pa.struct([("kind", pa.string()), ("version", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_SCHEMA = pa.schema([("blob", pa.binary()), ("pairs", pa.list_(_PAIR)), ("spans", pa.list_(_SPAN))])


def spans_of(text: str, rules) -> list[tuple[str, int, int, int]]:
    """``(kind, version, start, end)`` in code points, end exclusive; ``rules`` holds ``(Rule, compiled)``."""
    return [
        (rule.kind, rule.version, m.start(), m.end())
        for rule, found in rules for m in found.finditer(text) if len(m[rule.group]) >= rule.least
    ]


def _compiled(rules) -> list[tuple[Rule, re.Pattern]]:
    if len({r.kind for r in rules}) < len(rules):
        raise ValueError("a kind has one rule")
    return [(r, re.compile(r.pattern)) for r in rules]


def _pairs(rules) -> Column:
    return F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).cast("int").alias("version")) for r in rules))


def _text(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def _blob(text: str) -> Column:
    return F.unhex(F.sha2(_text(text), 256))


def create(spark: SparkSession, path: str) -> str:
    """An empty ledger at ``path``."""
    spark.createDataFrame([], LEDGER).write.parquet(path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(path)


def unseen(versions: DataFrame, path: str, text: str = "text", rules=RULES) -> DataFrame:
    """``(blob, text, todo)``: each distinct content once, with the (rule, version) pairs the ledger lacks.

    Contents are folded before the shuffle, so a content in many versions is shuffled a few times.
    """
    blobs = versions.select(_blob(text).alias("blob"), _text(text).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    seen = read(versions.sparkSession, path).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("seen"))
    todo = F.array_except(_pairs(rules), F.coalesce("seen", F.array().cast(PAIRS)))
    return blobs.join(seen, "blob", "left").select("blob", "text", todo.alias("todo")).where(F.size("todo") > 0)


def update(versions: DataFrame, path: str, text: str = "text", rules=RULES) -> None:
    """Scans what is new in ``versions`` and appends it to the ledger.

    ``versions`` has a row for each path and historical version; null text is empty text, and repeated rows are one
    blob. An update that was cut short or runs twice scans only the pairs still missing.
    """
    compiled = _compiled(rules)

    def run(batches):
        for b in batches:
            out = []
            for blob, said, todo in zip(*b.columns):
                asked = {(p["kind"], p["version"]) for p in todo.as_py()}
                wanted = [(r, found) for r, found in compiled if (r.kind, r.version) in asked]
                spans = [dict(zip(("kind", "version", "start", "end"), s)) for s in spans_of(said.as_py(), wanted)]
                out.append({"blob": blob.as_py(), "pairs": todo.as_py(), "spans": spans})
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    with shuffles_dropped(versions.sparkSession):
        unseen(versions, path, text, rules).mapInArrow(run, LEDGER).write.mode("append").parquet(path)


def findings(versions: DataFrame, path: str, text: str = "text", rules=RULES, into: str = "found") -> DataFrame:
    """``versions`` with ``into``, the spans of each one's content under ``rules``, by start, then by the rules' order.

    Null where the content was never scanned. A content's spans meet in one row, no more than its text can hold.
    """
    now = _pairs(rules)
    kept = F.filter("spans", lambda s: F.array_contains(now, F.struct(s.kind, s.version)))
    order = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))))
    by_blob = read(versions.sparkSession, path).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list(kept))).alias("all"))
    ranked = F.array_sort(F.transform("all", lambda s: F.struct(s.start.alias("start"), F.element_at(order, s.kind).alias("rank"), s.kind.alias("kind"), s.end.alias("end"))))
    by_blob = by_blob.select("blob", F.transform(ranked, lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"))).alias(into))
    key = fresh(versions, "blob")
    rows = versions.drop(into).withColumn(key, _blob(text))
    # as a table of its own, so that Spark can split the paths of a hot blob
    return rows.join(table(by_blob, "blob-findings").withColumnRenamed("blob", key), key, "left").drop(key)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def secret_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)``, one row per row of ``docs``, from the ledger at ``path``.

    Each row is a path with one version, null text is empty. Null and repeated ids and extra columns make no difference.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), _text(text).alias("text"))
    kinds = [r.kind for r in BASE]
    # the digest alone goes through the join, not the text
    rows = findings(rows, path, "text", rules).drop("text")
    of = lambda *names: F.filter("found", lambda s: s.kind.isin(*names))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds]
    return rows.select("doc_id", *counts, F.sha2(_joined(of(*kinds)), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))
