"""Sharding by a two-pass external shuffle, DataFrame functions only.

Pass one scatters whole rows, by a seeded hash of their content, over buckets that fit in memory; pass
two shuffles each bucket (Spark's ``shuffle`` is a Fisher-Yates shuffle) and gives its rows the places
after those of the buckets before it. The places form one random order of all rows; cut into equal
runs it gives shards whose counts are at most one apart.

A row's place follows from content and seed: buckets are sorted before they are shuffled, so a task
that runs again, after a lost executor, gives the same places. Rows alike in every column have one hash;
where they would overfill a bucket, each is scattered by its number among them, and as they are alike it
does not matter which of them takes which place.

Defined results: nulls are ordinary content, a null text has no bytes; texts of any length are moved whole,
each in one bucket; repeated rows each get a place, in any order; columns that are named like an added one give way to it; an empty table gives an empty
table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import row_digest, staged, unused
from kinfold.operators import skew
from kinfold.operators.workspace import Workspace

#: Bytes of a row beside its text.
ROW_BYTES = 16
#: Most buckets, and so tasks; of more bytes the buckets grow.
MAX_BUCKETS = 250_000


def row_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def shard(docs: DataFrame, n_shards: int, seed: int = 1, bucket_bytes: int = 16 << 20) -> DataFrame:
    """All rows with ``shard`` and ``slot``, gapless from 0 in each shard.

    ``bucket_bytes``: expected bytes of a bucket, which one task holds; more if there would be over
    ``MAX_BUCKETS`` buckets.
    """
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in ("shard", "slot")])
    bucket, digest, rows = unused(docs, "bucket"), unused(docs, "digest"), unused(docs, "bucket_rows")
    copy = unused(docs, "copy_number")
    total = docs.agg(F.sum(row_bytes(F.col("text")))).first()[0] or 0
    n_buckets = min(max(n_shards, -(-total // bucket_bytes)), max(n_shards, MAX_BUCKETS))
    bucket_bytes = max(bucket_bytes, -(-total // n_buckets))

    def scattered(rows: DataFrame, *by: str) -> DataFrame:
        return rows.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(n_buckets)).cast("int"))

    def counted(rows: DataFrame) -> DataFrame:
        """One row per bucket."""
        sizes = F.count("*").alias("n"), F.sum(row_bytes(F.col("text"))).alias("bytes")
        return staged(rows.groupBy(bucket).agg(*sizes), "buckets")

    plain = docs.withColumn(digest, row_digest(docs))
    dealt = scattered(plain, digest)
    counts = counted(dealt)
    overfull = counts.where(F.col("bytes") > 2 * bucket_bytes)
    if not overfull.isEmpty():  # by rows that are alike, or by single texts
        repeated = repeated_digests(dealt, overfull, bucket, digest, bucket_bytes)
        dealt = scattered(number_copies(plain, repeated, digest, copy), digest, copy).drop(copy)
        counts = counted(dealt)
    before = F.coalesce(
        F.sum("n").over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    offsets = counts.select(bucket, before.alias("before"))
    if skew.broadcastable(offsets):  # else the shuffled buckets move once more
        offsets = F.broadcast(offsets)
    n = counts.agg(F.sum("n")).first()[0] or 0
    own = F.expr(f"cast((before + at) * {n_shards}L div {max(n, 1)}L as int)")
    slot = F.expr(f"before + at - (own * {n}L + {n_shards - 1}L) div {n_shards}L")
    return (
        dealt.repartitionById(n_buckets, bucket)  # a task for each bucket
        .sortWithinPartitions(bucket, digest)
        .groupBy(bucket)
        .agg(F.collect_list(F.struct(*[f"`{c}`" for c in docs.columns])).alias(rows))
        # shuffled where the bucket was made, as the order depends on the task's number
        .select(bucket, F.shuffle(rows, seed).alias(rows))
        .join(offsets, bucket)
        .select("before", F.posexplode(rows).alias("at", "row"))
        .select("row", own.alias("own"), "before", "at")
        .select("row.*", F.col("own").alias("shard"), slot.alias("slot"))
    )


def repeated_digests(dealt: DataFrame, overfull: DataFrame, bucket: str, digest: str, bucket_bytes: int) -> DataFrame:
    """The digests, one row each, whose rows hold over a quarter of a bucket."""
    few = overfull.select(bucket)
    inside = dealt.join(F.broadcast(few) if skew.broadcastable(few) else few, bucket)
    sizes = inside.groupBy(digest).agg(F.count("*").alias("n"), F.sum(row_bytes(F.col("text"))).alias("bytes"))
    return staged(sizes.where((F.col("n") > 1) & (F.col("bytes") > bucket_bytes // 4)).select(digest), "repeated-rows")


def number_copies(rows: DataFrame, repeated: DataFrame, digest: str, copy: str) -> DataFrame:
    """``rows`` with ``copy``: their number among the rows of a repeated digest, 0 for all others. Copies
    are numbered over ranges of tasks, not in one."""
    marked, place, first = unused(rows, "is_repeated"), unused(rows, "place_number"), unused(rows, "first_number")
    flagged = repeated.withColumn(marked, F.lit(True))
    if skew.broadcastable(repeated):
        joined = rows.join(F.broadcast(flagged), digest, "left")
    else:
        joined = skew.salted_join(rows, flagged, [digest], "left")
    copies = joined.where(F.col(marked)).drop(marked).withColumn(place, F.monotonically_increasing_id())
    numbered = skew.number_rows(copies, [digest, place], Workspace(rows.sparkSession), copy).drop(place)
    numbered = staged(numbered, "copies")
    starts = numbered.groupBy(digest).agg(F.min(copy).alias(first))
    starts = F.broadcast(starts) if skew.broadcastable(starts) else starts
    own = numbered.join(starts, digest).withColumn(copy, F.col(copy) - F.col(first)).drop(first)
    others = joined.where(F.col(marked).isNull()).drop(marked).withColumn(copy, F.lit(0).cast("long"))
    return others.unionByName(own)


def write_shards(docs: DataFrame, path: str, n_shards: int, seed: int = 1, bucket_bytes: int = 16 << 20) -> None:
    """One folder per shard, rows of a file in order of ``slot``."""
    sharded = shard(docs, n_shards, seed, bucket_bytes)
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest(sharded: DataFrame) -> DataFrame:
    """The contract columns."""
    text = F.coalesce("text", F.lit(""))
    return sharded.select(
        "doc_id",
        row_bytes(F.col("text")).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
