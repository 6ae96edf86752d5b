"""Uniform shuffle of a table into shards: a two-pass external shuffle in DataFrame functions.

Pass one scatters whole records into memory-sized buckets by a seeded hash, in one shuffle. Pass two
gives each bucket's records the places of a seeded Fisher-Yates shuffle of its positions
(``shuffle`` over a sequence of integers; no record is held in an array) and deals them out in turn,
so the shards' counts are at most one apart. A bucket is a run of positions, so the task that
sorted it also writes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nocturne.session import work_folder

from .work import fresh, shuffles_dropped, table

BUCKET_ROWS = 50_000
BUCKET_BYTES = 64 << 20
#: Equal rows travel as one counted row if they fill an eighth of a bucket; at most twice so many groups do, at any size of the table.
HEAVY = 100_000
_RUN = 10_000
_SLICES = 4096


def _whole(c: str) -> Column:
    return F.col(f"`{c}`")


def _width(df: DataFrame) -> Column:
    """Bytes of a row's strings and binaries."""
    wide = [F.coalesce(F.octet_length(_whole(f.name)), F.lit(0)).cast("long") for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    return sum(wide, F.lit(0).cast("long"))


def _copies(counted: DataFrame, columns: list[Column], n: str, copy: str) -> DataFrame:
    """``columns`` of every row of ``counted``, ``n`` times, numbered in ``copy``; long runs are dealt to several tasks."""
    start = fresh(counted, "start")
    starts = F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(_RUN).cast("long"))
    parts = counted.select(*columns, n, F.explode(starts).alias(start)).repartition(start, *columns)
    return parts.select(*columns, F.explode(F.sequence(F.col(start), F.least(F.col(start) + _RUN, F.col(n)) - 1)).alias(copy))


def _permutations(df: DataFrame, bucket: str, order: str, buckets: int, longest: int, seed: int) -> DataFrame:
    """``(bucket, order)``: a Fisher-Yates shuffle of 0 to longest - 1 for every bucket.

    The rows of a range lie in the same slices on each run, so the seed alone decides. What is
    left of a uniform permutation after taking away the values from n on is one of n values.
    """
    ids = df.sparkSession.range(0, buckets, 1, min(buckets, _SLICES))
    return ids.select(F.col("id").alias(bucket), F.shuffle(F.sequence(F.lit(0), F.lit(longest - 1)), seed).alias(order))


def shuffled(df: DataFrame, shards: int = 8, seed: int = 42, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (from 0, without gaps, in each shard).

    The same rows and seed give the same result however the table is laid out. Repeated rows
    count each by itself; nulls are values like others; an empty table gives none. Columns must
    be comparable (no maps). Columns named shard or slot are replaced. Rows are told apart by two
    64-bit hashes, and by their columns where these agree. Sizes count strings and binaries.

    Only hashes are counted first. Rows of which there are many copies are then counted as such, with
    combining before the shuffle, and their copies scattered one by one; all others go straight to
    the bucket that their hash names.
    """
    df = df.drop("shard", "slot")
    copy, bucket, key, mixed, at, n, size, before, order = (fresh(df, c) for c in ("copy", "bucket", "key", "mixed", "at", "n", "size", "before", "order"))
    columns = [_whole(c) for c in df.columns]
    hashes = [F.xxhash64(F.lit(seed), F.lit(i), *columns).alias(name) for i, name in enumerate((key, mixed))]
    kinds = table(df.select(*hashes, _width(df).alias(size)).groupBy(key, mixed).agg(F.count("*").alias(n), F.sum(size).alias(size)), "kinds")
    rows, width = (x or 0 for x in kinds.agg(F.sum(n), F.sum(size)).first())
    buckets = max(1, -(-rows // bucket_rows), -(-width // BUCKET_BYTES))
    many = (F.col(n) > max(bucket_rows // 8, rows // HEAVY)) | (F.col(size) > max(BUCKET_BYTES // 8, width // HEAVY))
    heavy = F.broadcast(kinds.where((F.col(n) > 1) & many).select(key, mixed))

    hashed = df.select(*columns, *hashes)
    light = hashed.join(heavy, [key, mixed], "left_anti").select(*columns, key, mixed, F.lit(0).cast("long").alias(copy))
    counted = table(hashed.join(heavy, [key, mixed], "left_semi").groupBy(*columns, key, mixed).agg(F.count("*").alias(n)), "counted")
    whole = [*columns, F.col(key), F.col(mixed)]
    home = F.pmod(F.when(F.col(copy) > 0, F.xxhash64(F.lit(seed), key, mixed, copy)).otherwise(F.col(key)), F.lit(buckets)).alias(bucket)
    scattered = light.unionByName(_copies(counted, whole, n, copy)).select("*", home)

    few = kinds.where(~((F.col(n) > 1) & many)).select(F.lit(0).cast("long").alias(copy), key, mixed, n)
    each = _copies(counted, [F.col(key), F.col(mixed)], n, copy).select(copy, key, mixed, F.lit(1).cast("long").alias(n))
    held = table(few.unionByName(each).select(home, n).groupBy(bucket).agg(F.sum(n).alias(n)), "held")
    longest = held.agg(F.max(n)).first()[0] or 1
    # a row for each bucket, so the running sum in one task covers a table of fixed row size
    earlier = F.coalesce(F.sum(n).over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    starts = held.select(bucket, n, earlier.alias(before))
    places = _permutations(df, bucket, order, buckets, longest, seed).join(starts, bucket).select(
        bucket, before, F.filter(order, lambda x: x < F.col(n)).alias(order)
    )
    within = Window.partitionBy(bucket).orderBy(key, mixed, copy, *columns)
    ranked = scattered.withColumn(at, F.row_number().over(within) - 1)
    position = F.col(before) + F.get(F.col(order), F.col(at))
    return ranked.join(places, bucket).select(
        *columns, (position % shards).cast("int").alias("shard"), F.floor(position / shards).cast("long").alias("slot")
    )


def write_shards(placed: DataFrame, path: str, files: int | None = None) -> None:
    """Writes ``shuffled`` rows as ``path/shard=k``, sorted by slot in each file.

    Each task writes the buckets it holds. With ``files``, whole shards are sorted into so many ranges, by one more shuffle.
    """
    dealt = placed.repartitionByRange(files, "shard", "slot") if files else placed
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def document_shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = 8, seed: int = 42, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` under the law ``rows``.

    The whole documents are shuffled and written as shards; the columns are those of the shards read back.
    """
    path = work_folder(docs.sparkSession, "shards")
    placed = shuffled(docs, shards, seed, bucket_rows)
    with shuffles_dropped(docs.sparkSession):
        write_shards(placed, path)
    back = docs.sparkSession.read.schema(placed.schema).parquet(path)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return back.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
