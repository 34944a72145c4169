"""Blocks and the evidence that links records inside a block.

Two records of one block link when they share an email, a well-formed phone or a contact name.
Each shared value is a hub that its records point to, so the evidence is linear in the number of
records however large a block is; pairs are never listed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions import fixed_values as fixed
from kinfold.functions.tags import DEFAULT_TAGS, SourceTags
from kinfold.operators import skew
from kinfold.operators.standardize import node_record_id
from kinfold.operators.workspace import Workspace

HUB = ("block_key", "key_type", "key_value")


def link_keys(records: DataFrame) -> DataFrame:
    """One row per record and non-blank linking value."""
    values = {
        "email": F.col("email"),
        "phone": F.when(F.col("phone").rlike(fixed.PHONE_SHAPE), F.col("phone")),
        "contact": F.lower("contactName"),
    }
    pairs = F.array(
        *[F.struct(F.lit(t).alias("key_type"), v.alias("key_value")) for t, v in values.items()]
    )
    return records.select("node", "block_key", F.inline(pairs)).where(F.col("key_value") != "")


def link_edges(records: DataFrame, n_records: int, heavy_rows: int | None = None) -> DataFrame:
    """Record -> hub edges ``(block_key, key_type, key_value, hub_size, anchor, node)``.

    A hub is a value that at least two records of a block share; its anchor is the first of them.
    An ordinary block's records move once and find their hubs in place. In a heavy block one value
    may be as hot as the block, so there the hubs are aggregated first and joined back.
    """
    ordinary, heavy = skew.split_heavy(records, "block_key", n_records, heavy_rows)
    same_value = Window.partitionBy(*HUB)
    parts = [
        link_keys(ordinary)
        .withColumn("anchor", F.min("node").over(same_value))
        .withColumn("hub_size", F.count("*").over(same_value))
    ]
    if heavy is not None:
        keys = link_keys(heavy)
        hubs = keys.groupBy(*HUB).agg(F.min("node").alias("anchor"), F.count("*").alias("hub_size"))
        shared = hubs.where("hub_size > 1").withColumn("_rows", F.col("hub_size"))
        parts.append(
            skew.lookup_join(keys, shared, HUB, "_rows", 3 * n_records, heavy_rows=heavy_rows)
        )
    return reduce(DataFrame.unionByName, parts).where("hub_size > 1")


def block_sizes(records: DataFrame, tags: SourceTags = DEFAULT_TAGS) -> DataFrame:
    """Per block: records, sources, first record, and the pairs that linking by hubs avoids."""
    n = F.col("n_records").cast("double")
    sources = [
        F.count_if(F.col("source") == s).alias(f"n_{s.lower()}") for s in tags.tags
    ]
    return (
        records.groupBy("block_key")
        .agg(F.count("*").alias("n_records"), *sources, F.min("node").alias("first_node"))
        .withColumn("first_id", node_record_id(F.col("first_node"), tags))
        .withColumn("n_pairs", n * (n - 1) / 2)
    )


def block_histogram(records: DataFrame, tags: SourceTags = DEFAULT_TAGS) -> DataFrame:
    """How many blocks have each size, and how many records they hold."""
    return (
        block_sizes(records, tags)
        .groupBy(F.col("n_records").alias("block_size"))
        .agg(
            F.count("*").alias("n_blocks"),
            F.sum("n_records").alias("n_records"),
            F.sum("n_pairs").alias("n_pairs"),
        )
    )


def block_candidates(
    records: DataFrame, n_records: int, heavy_rows: int | None = None, tags: SourceTags = DEFAULT_TAGS
) -> DataFrame:
    """Each record of a block next to the block's first record, with the evidence they share."""
    rows = records.select("node", "block_key", "email", "phone", "contactName")
    first = F.min(F.struct("node", "email", "phone", "contactName"))
    ordinary, heavy = skew.split_heavy(rows, "block_key", n_records, heavy_rows)
    parts = [ordinary.withColumn("anchor", first.over(Window.partitionBy("block_key")))]
    if heavy is not None:
        anchors = heavy.groupBy("block_key").agg(first.alias("anchor"))
        parts.append(skew.join_heavy(heavy, anchors, ["block_key"]))
    paired = reduce(DataFrame.unionByName, parts).where(F.col("node") != F.col("anchor.node"))

    def same(field: str) -> Column:
        mine, theirs = F.col(field), F.col(f"anchor.{field}")
        if field == "contactName":
            mine, theirs = F.lower(mine), F.lower(theirs)
        shared = (mine == theirs) & (mine != "")
        return shared & mine.rlike(fixed.PHONE_SHAPE) if field == "phone" else shared

    return paired.select(
        "block_key",
        node_record_id(F.col("anchor.node"), tags).alias("anchor_id"),
        node_record_id(F.col("node"), tags).alias("record_id"),
        same("email").cast("int").alias("same_email"),
        same("phone").cast("int").alias("same_phone"),
        same("contactName").cast("int").alias("same_contact"),
    )


def block_batches(
    records: DataFrame, workspace: Workspace, size: int = fixed.BLOCKS_PER_BATCH, tags: SourceTags = DEFAULT_TAGS
) -> DataFrame:
    """Blocks in first-seen order, cut into batches of ``size`` blocks."""
    blocks = block_sizes(records, tags).select("block_key", "first_node", "n_records")
    ranked = skew.number_rows(blocks, ["first_node"], workspace, "block_no")
    return ranked.withColumn("batch", F.floor((F.col("block_no") - 1) / size) + 1)

