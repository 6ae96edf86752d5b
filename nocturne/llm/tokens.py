"""Byte-level BPE with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import arrow_schema, batch, fresh

LONG = 1 << 14
# between a character that is no white space and a single space before another such character no
# match of the pattern can go on: only the first character of a match may be a space
_SAFE = regex.compile(r"(?<=\S)(?= \S)")


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file; without special tokens. Built once in each Python worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = LONG):
    """Cuts a text at safe boundaries, at the first one behind each ``size`` characters."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(coder: tiktoken.Encoding, pattern: regex.Pattern, text: str) -> list[int]:
    """Ids of a whole text: each match of the pattern is encoded by itself."""
    ids: list[int] = []
    for part in parts(text):
        if len(part) <= 4 * LONG:
            ids += coder.encode_ordinary(part)
            continue
        # no safe boundary for long, where the library's own splitting runs out of stack: the
        # matches themselves are the parts
        for match in pattern.finditer(part):
            ids += coder._encode_single_piece(match.group().encode())
    return ids


def tokenized(df: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with ``token_ids``, the ids of each text; null is empty. A column of that name is replaced."""

    @F.pandas_udf("array<int>")
    def ids(column):
        coder, matches = encoding(path, pattern), regex.compile(pattern)
        return column.map(lambda t: encode(coder, matches, t or ""))

    return df.withColumn("token_ids", ids(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def decoded(df: DataFrame, path: str, pattern: str, ids: str = "token_ids") -> DataFrame:
    """``df`` with ``decoded``, the raw bytes of each list of ids; null is empty."""

    @F.pandas_udf("binary")
    def back(column):
        coder = encoding(path, pattern)
        return column.map(lambda x: b"" if x is None else coder.decode_bytes(list(x)))

    return df.withColumn("decoded", back(F.col(ids)))


def token_digests(df: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, one row per row of ``df``.

    Each text is encoded, its ids digested and decoded again in one pass, so no list of ids
    leaves its task.
    """
    schema = arrow_schema(doc_id=pa.int64(), n_tokens=pa.int64(), ids_sha256=pa.string(), decoded_sha256=pa.string())

    def run(batches):
        coder, matches = encoding(path, pattern), regex.compile(pattern)
        spelt = [b"%d" % i for i in range(coder.n_vocab)]
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids = encode(coder, matches, t.as_py() or "")
                line = b" ".join(map(spelt.__getitem__, ids))
                rows.append((i, len(ids), hashlib.sha256(line).hexdigest(), hashlib.sha256(coder.decode_bytes(ids)).hexdigest()))
            yield batch(schema, *zip(*rows)) if rows else batch(schema, *[[]] * 4)

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
