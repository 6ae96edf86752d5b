"""Prefix trie of conversations by ROLLUP over positional turn columns.

A conversation is a row of turn ids, one column per position. ``GROUP BY ROLLUP`` over these columns
aggregates all prefixes together, and ``grouping_id`` tells how long each is. Conversations longer
than the columns go on in a further block of columns, keyed by their node at the end of the block before.
Sums over subtrees are a ROLLUP over the nodes, from the last block back to the first.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import arrow_schema, table

WIDTHS = (8, 16, 32)
_WORDS = r"[^\x20\x09-\x0D]+"


def turns_of(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, pos, turn)``: turns numbered from 1; ``turn`` holds 128 bits that name (role, text) and the words of the text.

    Turns are ordered by turn number, null first, then role, then the digest of role and text. Null role or
    text is empty. Rows without a conv_id belong to no conversation and are left out. Sorted as ranges, so a
    conversation of many turns lies in many tasks.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(said(role)).cast("string"), F.lit(":"), said(role), said(text)), 256)
    rows = df.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("at"), said(role).alias("role"),
        F.struct(F.unhex(F.substring(digest, 1, 32)).alias("id"), F.regexp_count(said(text), F.lit(_WORDS)).cast("long").alias("words")).alias("turn"),
    )
    order = ["conv_id", F.asc_nulls_first("at"), "role", "turn"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = table(rows.select("conv_id", "turn", F.monotonically_increasing_id().alias("row")), "turns").withColumn("task", F.shiftright("row", 33))
    parts = rows.groupBy("conv_id", "task").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("conv_id", "task", (before - F.col("first") + 1).alias("shift"))
    return rows.join(starts, ["conv_id", "task"]).select("conv_id", (F.col("row") + F.col("shift")).alias("pos"), "turn")


def with_shared_heads(turns: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations ``(conv_id, pos, turn)`` and ``(conv_id, len)`` of all, turnless ones too.

    Conversation c begins with the first h turns of conversation c - c % ``group`` (all if it has fewer, none if it is
    absent) and goes on with its own turns after its first h; h is crc32(c) % ``heads``.
    """
    turns = table(turns, "numbered")
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    base = (F.col("conv_id") - F.col("conv_id") % group).alias("base")
    known = lengths.select("conv_id", "n", h.alias("h"), base)
    known = known.join(lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    known = table(known.withColumn("take", F.least("h", F.coalesce("base_n", F.lit(0)))), "conversations")
    lent = turns.where(F.col("pos") < heads).withColumnRenamed("conv_id", "base")
    taken = known.where("take > 0").join(lent, "base").where("pos <= take").select("conv_id", "pos", "turn")
    own = turns.join(known.select("conv_id", "h", "take"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("take")).alias("pos"), "turn")
    lengths = known.select("conv_id", (F.col("take") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))
    return own.unionByName(taken), lengths


def _columns(width: int) -> list[str]:
    return [f"t{i}" for i in range(1, width + 1)]


def _level(width: int) -> Column:
    """How many turn columns a row of the ROLLUP keeps: grouping_id has a bit for each column rolled up."""
    return F.lit(width) - F.bit_count("rolled")


def _reached(width: int) -> Column:
    """Whether the last turn column that a row keeps is a turn at all."""
    last = F.coalesce(*(F.when(F.col("level") == i, F.col(f"t{i}.words")) for i in range(1, width + 1)))
    return (F.col("level") == 0) | last.isNotNull()


def _rolled(df: DataFrame, width: int, values: str) -> DataFrame:
    """``values`` of every prefix of t1 to t``width`` within ``node``, with its ``level``."""
    names = ", ".join(_columns(width))
    spark = df.sparkSession
    out = spark.sql(f"SELECT node, {names}, grouping_id() AS rolled, {values} FROM {{rows}} GROUP BY node, ROLLUP({names})", rows=df)
    out = out.withColumn("rolled", F.col("rolled").bitwiseAND(F.lit((1 << width) - 1)))
    return out.withColumn("level", _level(width).cast("int")).drop("rolled").where(_reached(width))


def _path(width: int, size) -> Column:
    return F.slice(F.array(*(F.col(f"t{i}.id") for i in range(1, width + 1))), 1, size)


def _block(turns: DataFrame, at: DataFrame, depth: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of the depths ``depth + 1`` to ``depth + width`` and where their conversations stand then.

    ``at`` has ``(conv_id, len, node)``, the conversations longer than ``depth`` with their node there. At depth 0 all
    conversations come and the root is a node too.
    """
    place = F.col("pos") - depth
    these = turns.where(place.between(1, width))
    cells = [F.first(F.when(place == i, F.col("turn")), ignorenulls=True).alias(f"t{i}") for i in range(1, width + 1)]
    rows = table(at.join(these.groupBy("conv_id").agg(*cells), "conv_id", "left"), "positions")
    nodes = _rolled(rows, width, "min(conv_id) AS conv_id, count(*) AS n_convs, max(len) AS longest")
    nodes = table(nodes if depth == 0 else nodes.where("level > 0"), "prefixes")
    upper = nodes.select("node", F.col("level").alias("up"), _path(width, F.col("level")).alias("path"), F.col("conv_id").alias("parent_conv_id"))
    lower = nodes.withColumns({"up": F.col("level") - 1, "path": _path(width, F.greatest(F.col("level") - 1, F.lit(0)))})
    joined = lower.join(upper, ["node", "up", "path"], "left")
    parent = F.col("parent_conv_id") if depth == 0 else F.coalesce("parent_conv_id", "node")  # a block's first nodes hang below the block before
    last = F.coalesce(*(F.when(F.col("level") == i, F.col(f"t{i}.words")) for i in range(1, width + 1)), F.lit(0))
    nodes = table(joined.select(
        "node", *_columns(width), "level", "conv_id", "n_convs", (F.col("level") + depth).cast("long").alias("depth"), parent.alias("parent_conv_id"),
        (F.col("longest") == F.col("level") + depth).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * last).alias("saved"),
    ), "nodes")
    stands = rows.withColumn("level", F.least(F.col("len") - depth, F.lit(width)).cast("int"))
    stands = stands.select("conv_id", "len", "node", "level", _path(width, F.col("level")).alias("path"))
    ends = nodes.select("node", "level", _path(width, F.col("level")).alias("path"), F.col("conv_id").alias("now"))
    return nodes, table(stands.join(ends, ["node", "level", "path"]).select("conv_id", "len", F.col("now").alias("node")), "stands")


def end_digests(ends: DataFrame) -> DataFrame:
    """``(conv_id, depth, ends_sha256)`` of each node ``(node, len)`` at which conversations end.

    The ids of a node pass through one task, as the digest wants them in order; they are sorted by Spark and read as a stream.
    """
    schema = arrow_schema(conv_id=pa.int64(), depth=pa.int64(), ends_sha256=pa.string())

    def run(batches):
        now, digest = None, None
        for b in batches:
            out = []
            for node, depth, conv in zip(*(c.to_pylist() for c in b.columns)):
                if (node, depth) != now:
                    if now:
                        out.append((*now, digest.hexdigest()))
                    now, digest = (node, depth), hashlib.sha256(str(conv).encode())
                else:
                    digest.update(b",%d" % conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*now, digest.hexdigest()), schema.types)], schema=schema)

    sorted_ends = ends.select("node", "len", "conv_id").repartition("node", "len").sortWithinPartitions("node", "len", "conv_id")
    return sorted_ends.mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """One row per node: ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``.

    A node is a distinct sequence of first turns, from the root without turns; conversations that start with it are its members
    and its conv_id is the smallest of them. Without a conversation there is no node. ``widths`` are the
    numbers of columns of the blocks, the last one for all further blocks (63 at most); they change no result.
    """
    turns, depth, block, done = table(turns, "rebuilt"), 0, 0, []
    at = table(lengths.select("conv_id", "len", F.lit(0).cast("long").alias("node")), "stands")
    ends = []
    longest = lengths.agg(F.max("len")).first()[0]
    while longest is not None and (block == 0 or depth < longest):
        width = widths[min(block, len(widths) - 1)]
        nodes, stands = _block(turns, at, depth, width)
        done.append((nodes, width))
        depth, block = depth + width, block + 1
        ends.append(stands.where(F.col("len") <= depth))
        at = stands.where(F.col("len") > depth)
    if not done:
        return _empty(turns)
    sums, deeper = None, None
    for nodes, width in reversed(done):
        values = nodes.select("node", *_columns(width), "level", "conv_id", "leaf", "saved")
        if deeper is not None:
            below = deeper.where("level = 0").select(F.col("node").alias("conv_id"), F.lit(width).alias("level"), F.col("n_leaves").alias("more_leaves"), F.col("saved_tokens").alias("more_saved"))
            values = values.join(below, ["conv_id", "level"], "left").withColumns({
                "leaf": F.col("leaf") + F.coalesce("more_leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0)),
            })
        deeper = table(_rolled(values, width, "min(conv_id) AS conv_id, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens"), "subtrees")
        # the smallest conversation below a node is its own; with the level it names the node
        part = deeper.select("level", "conv_id", "n_leaves", "saved_tokens").join(nodes.select("level", "conv_id", "depth", "parent_conv_id", "n_convs"), ["conv_id", "level"]).drop("level")
        sums = part if sums is None else sums.unionByName(part)
    return _reported(table(sums, "sums"), ends)


def _reported(sums: DataFrame, ends: list[DataFrame]) -> DataFrame:
    ended = ends[0]
    for more in ends[1:]:
        ended = ended.unionByName(more)
    children = sums.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    out = sums.join(children, ["conv_id", "depth"], "left").join(end_digests(ended), ["conv_id", "depth"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def _empty(df: DataFrame) -> DataFrame:
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens".split()
    return df.where("false").select(*(F.lit(0).cast("long").alias(c) for c in names), F.lit("").alias("ends_sha256"))
