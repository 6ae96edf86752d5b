"""Hard negatives for anchors, found through angles to reference directions.

Each row keeps its angles to a few reference directions. By the triangle inequality on the
sphere, the angle between two rows lies between the largest difference and the smallest sum
of their angles to one reference. The cosines of these two, times both norms, bound the score.
Only pairs whose bounds overlap a window of wanted scores are scored, in integers.

Rows and anchors are dealt into blocks of a set size; a task holds one block of each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .work import LAST_ID, arrow_schema, table

ROWS, ANCHORS = 4096, 8192  # of a block
CHUNK = 256  # anchors whose bounds are held at once
REFERENCES, SAMPLE = 16, 512
SLACK = 4e-6  # radians; stored angles are single precision
_NONE = np.iinfo(np.int64).min
_EXACT = 2.0**53


def directions(vectors: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` unit vectors among ``vectors``, each the farthest from those before it."""
    norms = np.linalg.norm(vectors, axis=1)
    units = vectors[norms > 0] / norms[norms > 0, None]
    if not len(units):
        return np.zeros((0, vectors.shape[1]))
    chosen = [0]
    nearest = units @ units[0]
    while len(chosen) < count and nearest.min() < 1 - 1e-9:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
    return units[chosen]


def angles(vectors: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles of each row to each reference; zero for a row of zeros, whose scores are all zero."""
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    cosines = (vectors @ references.T) / np.where(norms > 0, norms, 1)
    return np.where(norms > 0, np.arccos(np.clip(cosines, -1, 1)), 0).astype(np.float32)


def bounds(a: np.ndarray, a_norms: np.ndarray, b: np.ndarray, b_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integers that no score of the rows with angles ``a`` and ``b`` is below or above."""
    least, most = np.zeros((len(a), len(b)), np.float32), np.full((len(a), len(b)), np.pi, np.float32)
    for x, y in zip(a.T, b.T):
        x, y = x[:, None], y[None, :]
        np.maximum(least, np.abs(x - y), out=least)
        both = x + y
        np.minimum(most, np.minimum(both, np.float32(2 * np.pi) - both), out=most)
    norms = a_norms[:, None] * b_norms[None, :]
    room = 1 + norms * 1e-9
    low = np.floor(norms * np.cos(np.minimum(most.astype(np.float64) + SLACK, np.pi)) - room)
    high = np.ceil(norms * np.cos(np.maximum(least.astype(np.float64) - SLACK, 0)) + room)
    return low, high


def kth_largest(x: np.ndarray, k: int, none) -> np.ndarray:
    """The k-th largest of each row, ``none`` where a row is shorter."""
    if x.shape[1] < k:
        return np.full(len(x), none, x.dtype)
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k]


def score(a: np.ndarray, b: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Exact inner products of the ``wanted`` pairs, ``_NONE`` elsewhere; columns that nobody wants are left out."""
    out = np.full(wanted.shape, _NONE)
    columns = np.flatnonzero(wanted.any(axis=0))
    if not len(columns):
        return out
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most >= 2.0**62:
        raise ValueError("inner products of these vectors do not fit into a long")
    picked = wanted[:, columns]
    if picked.mean() < 0.05:
        i, j = np.nonzero(picked)
        out[i, columns[j]] = np.einsum("ij,ij->i", a[i], b[columns[j]])
        return out
    kind = np.float64 if most < _EXACT else np.int64
    products = (a.astype(kind) @ b[columns].astype(kind).T).astype(np.int64)
    out[:, columns] = np.where(picked, products, _NONE)
    return out


def _matrix(column, width: int, kind=np.int64) -> np.ndarray:
    """List rows as one matrix, short ones filled with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), width), kind)
    out[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _width(*columns) -> int:
    return max((max(np.diff(c.combine_chunks().offsets.to_numpy()), default=0) for c in columns), default=0)


def _ints(column) -> np.ndarray:
    return column.combine_chunks().fill_null(LAST_ID).to_numpy(zero_copy_only=False)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the ``k`` best of each row by score, then id."""
    least = np.maximum(kth_largest(scores, k, _NONE), _NONE + 1)
    i, j = np.nonzero(scores >= least[:, None])
    order = np.lexsort((ids[j], -scores[i, j], i))
    i, j = i[order], j[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k]


class _Block:
    """Anchors and rows of one task as arrays."""

    def __init__(self, anchors: pa.Table, rows: pa.Table):
        width = _width(anchors["v"], rows["v"])
        self.a, self.b = (_matrix(t["v"], width) for t in (anchors, rows))
        self.a_angles, self.b_angles = (_matrix(t["angles"], _width(t["angles"]), np.float32) for t in (anchors, rows))
        self.a_norms, self.b_norms = (np.linalg.norm(x.astype(np.float64), axis=1) for x in (self.a, self.b))
        self.a_labels, self.b_labels = (t["label"].to_numpy() for t in (anchors, rows))
        self.ids = _ints(rows["id"])

    def chunks(self, rows: np.ndarray, anchors: np.ndarray):
        for s in range(0, len(anchors), CHUNK):
            at = anchors[s : s + CHUNK]
            yield at, *bounds(self.a_angles[at], self.a_norms[at], self.b_angles[rows], self.b_norms[rows])


def wanted_best(low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Pairs that may be among the ``k`` best of their row."""
    return high >= kth_largest(low, k, -np.inf)[:, None]


def wanted_inside(low, high, least, most, k: int) -> np.ndarray:
    """Pairs that may be among the ``k`` best scores from ``least`` to ``most`` of their row."""
    least, most = least[:, None], most[:, None]
    sure = kth_largest(np.where((low >= least) & (high <= most), low, -np.inf), k, -np.inf)
    return (high >= least) & (low <= most) & (high >= sure[:, None])


_FOUND = arrow_schema(anchor=pa.int64(), id=pa.int64(), score=pa.int64(), k=pa.int32())
_FOUND_DDL = "anchor long, id long, score long, k int"


def _result(parts: list) -> pa.Table:
    if not parts:
        return _FOUND.empty_table()
    anchor, ids, scores, k = (np.concatenate(x) for x in zip(*parts))
    return pa.Table.from_arrays([pa.array(anchor), pa.array(ids, mask=ids == LAST_ID), pa.array(scores), pa.array(k, pa.int32())], schema=_FOUND)


def _same_label(count: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        x, names, parts = _Block(anchors, rows), anchors["anchor"].to_numpy(), []
        for label in np.unique(x.a_labels):
            near = np.flatnonzero(x.b_labels == label)
            for at, low, high in x.chunks(near, np.flatnonzero(x.a_labels == label)):
                scores = score(x.a[at], x.b[near], wanted_best(low, high, count))
                i, j = _best(scores, x.ids[near], count)
                parts.append((names[at[i]], x.ids[near[j]], scores[i, j], np.zeros(len(i), np.int32)))
        return _result(parts)

    return run


def _percent(x: np.ndarray, share: int) -> np.ndarray:
    """``share`` percent of ``x``, rounded down, within 64 bits."""
    return x // 100 * share + x % 100 * share // 100


def _other_label(count: int, low_share: int, high_share: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        x, names, parts = _Block(anchors, rows), anchors["anchor"].to_numpy(), []
        width = _width(anchors["positives"])
        p = _matrix(anchors["positives"], width)
        have = np.arange(width)[None, :] < np.diff(anchors["positives"].combine_chunks().offsets.to_numpy())[:, None]
        least, most = -_percent(-p, low_share), _percent(p, high_share)
        most = np.where(have, most, _NONE)  # no window
        for at, low, high in x.chunks(np.arange(len(x.ids)), np.arange(len(names))):
            other = x.a_labels[at][:, None] != x.b_labels[None, :]
            low, high = np.where(other, low, -np.inf), np.where(other, high, -np.inf)
            wanted = np.zeros(other.shape, bool)
            for k in range(width):
                wanted |= wanted_inside(low, high, least[at, k], most[at, k], count)
            scores = score(x.a[at], x.b, wanted & other)
            for k in range(width):
                inside = np.where((scores >= least[at, k][:, None]) & (scores <= most[at, k][:, None]), scores, _NONE)
                i, j = _best(inside, x.ids, count)
                parts.append((names[at[i]], x.ids[j], scores[i, j], np.full(len(i), k + 1, np.int32)))
        return _result(parts)

    return run


def usable(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``(id, label, v)`` of the rows that take part, ``v`` the floor of 256 times each component.

    Rows with a null label or vector, or with a null or non-finite component, take no part.
    """
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("label").isNotNull() & F.col("v").isNotNull()).where(finite).withColumn("v", F.transform("v", lambda x: F.floor(x * 256)))


def with_angles(rows: DataFrame, references: int = REFERENCES, sample: int = SAMPLE) -> DataFrame:
    """``rows`` with ``angles`` to reference directions picked from ``sample`` of them, in hash order."""
    picked = rows.select("v").orderBy(F.xxhash64("v"), "v").limit(sample).collect()
    width = max((len(r.v) for r in picked), default=0)
    chosen = directions(np.array([r.v + [0] * (width - len(r.v)) for r in picked], np.float64).reshape(len(picked), width), references)

    def run(batches):
        for b in batches:
            size = max(width, _width(pa.chunked_array([b.column("v")])))
            vectors = _matrix(b.column("v"), size).astype(np.float64)
            found = angles(vectors, np.pad(chosen, ((0, 0), (0, size - width))))
            lists = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1], found.ravel())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("v"), lists], names=["id", "label", "v", "angles"])

    return rows.mapInArrow(run, "id long, label long, v array<long>, angles array<float>")


def _cells(anchors: DataFrame, rows: DataFrame, run) -> DataFrame:
    """``run`` on every block of anchors with every block of rows."""
    spans = lambda df, by: F.explode(F.sequence(F.lit(0), F.lit((df.agg(F.max(by)).first()[0] or 0)))).alias(by)
    left = anchors.select("*", spans(rows, "row_block"))
    right = rows.select("*", spans(anchors, "anchor_block"))
    both = ("anchor_block", "row_block")
    return left.groupBy(*both).cogroup(right.groupBy(*both)).applyInArrow(run, _FOUND_DDL)


def _dealt(df: DataFrame, name: str, size: int, block: str, key: str) -> DataFrame:
    """``df`` written with a number ``key`` for each row and dealt into blocks of about ``size`` rows."""
    df = table(df.withColumn(key, F.monotonically_increasing_id()), name)
    return df.withColumn(block, F.pmod(F.xxhash64(key), F.lit(-(-df.count() // size) or 1)).cast("int"))


def hard_negatives(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 100, positives: int = 5,
                   negatives: int = 10, low_share: int = 30, high_share: int = 90, references: int = REFERENCES, sample: int = SAMPLE,
                   rows_per_block: int = ROWS, anchors_per_block: int = ANCHORS) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are the rows whose id is divisible by ``every``. A score is the inner product of the integer
    vectors of ``usable``; higher scores come first, ties by smaller id, rows without an id last. The positives of
    an anchor are its first ``positives`` other rows of the same label; for each of them the first ``negatives`` rows of
    another label are returned whose score lies between ``low_share`` and ``high_share`` percent of the positive's.

    Repeated rows count each by itself: a copy of an anchor is an anchor and may be its positive. A row without an id
    is no anchor but may be found, with a null id. A shorter vector counts as filled up with
    zeros. Scores beyond 64 bits raise an error. The sample sets how many pairs are scored, never the result.
    """
    rows = _dealt(with_angles(usable(df, vec_id, vector, label), references, sample), "vectors", rows_per_block, "row_block", "row")
    named = rows.where(F.col("id") % every == 0).groupBy("id", "label", "v").agg(F.first("angles").alias("angles"), F.count("*").alias("copies"))
    own = F.aggregate(F.zip_with("v", "v", lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
    anchors = _dealt(named.withColumn("own", own), "anchors", anchors_per_block, "anchor_block", "anchor")
    ask = anchors.select("anchor", "anchor_block", "label", "v", "angles")
    rows = rows.select("id", "row_block", "label", "v", "angles")

    last = F.coalesce("id", F.lit(LAST_ID))
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), last)
    near = _cells(ask, rows, _same_label(positives + 1)).drop("k").withColumn("n", F.row_number().over(best)).where(F.col("n") <= positives + 1)
    itself = near.join(anchors.select("anchor", F.col("id").alias("anchor_id"), "own"), "anchor").withColumn("self", (F.col("score") == F.col("own")) & F.coalesce(F.col("id") == F.col("anchor_id"), F.lit(False)))
    # the anchor is one of its own copies, which stand next to each other
    first = F.col("self") & ~F.coalesce(F.lag("self").over(Window.partitionBy("anchor").orderBy("n")), F.lit(False))
    before = F.sum(F.col("first").cast("int")).over(Window.partitionBy("anchor").orderBy("n"))
    kept = itself.withColumn("first", first).withColumn("k", (F.col("n") - before).cast("int")).where(~F.col("first") & (F.col("k") <= positives))
    good = table(kept.select("anchor", "anchor_id", "k", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    listed = good.groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "positive_score"))), lambda x: x.positive_score).alias("positives"))
    far = _cells(ask.join(listed, "anchor"), rows, _other_label(negatives, low_share, high_share))
    found = far.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "k").orderBy(F.desc("score"), last))).where(F.col("rank") <= negatives)
    copies = anchors.select("anchor", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")
    return found.join(good, ["anchor", "k"]).join(copies, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
