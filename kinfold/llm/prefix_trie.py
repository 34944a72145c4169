"""Conversation prefix trie by whole-sequence collapse.

Conversations are rebuilt (below), and identical ones are grouped into one weighted sequence with the
list of the conversations that end there. Only distinct sequences are followed further: each is
spread into its weighted prefixes, sequences that are proper prefixes of others are dropped by an
anti-join, which leaves the leaves, and prefixes are aggregated into nodes.

Rebuilding: conversation ``c`` is the first ``h`` turns of conversation ``c - c % 5`` (all if it has
fewer, none if it is absent) and then its own turns after its first ``h``; ``h`` is ``crc32(c) % 9`` of
the decimal id. ``%`` takes the sign of ``c``.

A prefix is known by its depth and 128 bits: the exclusive or, over its turns, of two seeded hashes of
place, role and text. So texts move once, to be put in order, and never again, and a conversation of
any length is cut into blocks whose hashes combine. Sums over a subtree are sums over the sequences
that pass through its top: a node belongs to the sequence of its smallest member, which owns all nodes
of its path from some depth on, so that each node is counted once without walking the tree.

No task holds a conversation or a group: turns are ordered by ranges, prefixes meet in aggregates that
combine before they shuffle. Ids of an end list are sorted and joined in pieces by many tasks; the
pieces, some per list, stream through one task in order, as their digest asks.

Defined results: null roles and texts are empty; turns of equal number are ordered by role, then text,
and repeated rows are all kept; null turns come first; rows without ``conv_id`` belong to no
conversation and are left out; texts of any length are hashed whole; other columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import staged
from kinfold.operators import skew
from kinfold.operators.workspace import Workspace

#: Turns of a conversation that are hashed in one window.
BLOCK = 4096
#: Conversations of one family share the beginning of the family's first one.
FAMILY, LONGEST_SHARED = 5, 8
KEY = ["depth", "a", "b"]

SEQUENCES = "c long, depth long, a long, b long, total long, weight long, ends_sha256 string"
SEQUENCES_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("c", "depth", "a", "b", "total", "weight")] + [("ends_sha256", pa.string())]
)
PIECES = "depth long, a long, b long, total long, first long, n long, ids string"
PIECES_ARROW = pa.schema(
    [(n, pa.int64()) for n in (*KEY, "total", "first", "n")] + [("ids", pa.string())]
)
#: Ids of an end list that are joined into one text.
PIECE = 8192
NO_ENDS = hashlib.sha256().hexdigest()


@dataclass(frozen=True)
class Trie:
    """``sequences``: one row per distinct rebuilt conversation, by its smallest id ``c``, with weight and
    digest of its end list; ``ends``: each conversation with the key of its sequence; ``paths``: the
    prefixes of the sequences."""

    sequences: DataFrame
    ends: DataFrame
    paths: DataFrame


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, unit, at, bytes, x, y)``: turns in order of ``at`` within a unit, texts as hashes."""
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    in_order = rows.repartitionByRange("conv_id", "turn", F.substring("role", 1, 32)).sortWithinPartitions(
        "conv_id", "turn", "role", "text"
    )
    at = F.monotonically_increasing_id()
    return in_order.select(
        "conv_id",
        F.octet_length("text").cast("long").alias("bytes"),
        F.xxhash64(F.lit(1), "role", "text").alias("x"),
        F.xxhash64(F.lit(2), "role", "text").alias("y"),
        at.alias("at"),
        F.shiftright(at, 33).alias("unit"),
    )


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its family."""
    return F.crc32(conv_id.cast("string").cast("binary")) % (LONGEST_SHARED + 1)


def rebuilt(turns: DataFrame, units: DataFrame, convs: DataFrame) -> DataFrame:
    """``(c, depth, bytes, x, y)``: the turns of the rebuilt conversations."""
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    family = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn(
        "h", F.when(F.col("conv_id") == F.col("base"), F.lit(0)).otherwise(shared_turns(F.col("conv_id")))
    )
    missing = F.greatest(F.col("h") - F.coalesce("n_base", F.lit(0)), F.lit(0))
    own = family.join(lengths, "base", "left").select("conv_id", "h", missing.alias("missing"))
    # a family has at most eight others, four on either side of zero
    others = (
        family.where("h > 0")
        .groupBy("base")
        .agg(F.collect_list(F.struct(F.col("conv_id").alias("c"), "h")).alias("others"))
        .withColumnRenamed("base", "conv_id")
    )
    known = units.join(own, "conv_id").join(others, "conv_id", "left")
    place = F.col("at") - F.col("first") + F.col("before") + 1
    kept = F.when(
        F.col("place") > F.col("h"),
        F.array(F.struct(F.col("conv_id").alias("c"), (F.col("place") - F.col("missing")).alias("depth"))),
    ).otherwise(F.array())
    lent = F.transform(
        F.filter(F.coalesce("others", F.array()), lambda o: F.col("place") <= o["h"]),
        lambda o: F.struct(o["c"].alias("c"), F.col("place").alias("depth")),
    )
    placed = turns.join(known, ["conv_id", "unit"]).withColumn("place", place)
    return placed.select(F.inline(F.concat(kept, lent)), "bytes", "x", "y")


def hashed_prefixes(turns: DataFrame) -> DataFrame:
    """Turns with the prefix hashes ``a``, ``b`` and bytes ``through`` of their block so far."""
    placed = turns.select(
        "c",
        "depth",
        F.expr(f"(depth - 1) div {BLOCK}").alias("block"),
        "bytes",
        F.xxhash64(F.lit(1), "depth", "x", "y").alias("u"),
        F.xxhash64(F.lit(2), "depth", "x", "y").alias("v"),
    )
    so_far = Window.partitionBy("c", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumns(
        {
            "a": F.bit_xor("u").over(so_far),
            "b": F.bit_xor("v").over(so_far),
            "through": F.sum("bytes").over(so_far),
        }
    )


def chain_blocks(prefixes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Hashes and bytes of the earlier blocks of a conversation put before those of its later ones."""
    earlier = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    later = blocks.select(
        "c",
        "block",
        F.bit_xor("a").over(earlier).alias("a0"),
        F.bit_xor("b").over(earlier).alias("b0"),
        F.sum("total").over(earlier).alias("through0"),
    ).where("block > 0")
    columns = prefixes.columns
    chained = (
        prefixes.where("block > 0")
        .join(later, ["c", "block"])
        .withColumns(
            {
                "a": F.col("a").bitwiseXOR(F.col("a0")),
                "b": F.col("b").bitwiseXOR(F.col("b0")),
                "through": F.col("through") + F.col("through0"),
            }
        )
    )
    return prefixes.where("block = 0").unionByName(chained.select(*columns))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by sequence and id -> runs of ids of one sequence, each joined into one text."""
    open_key, ids = None, []
    for batch in batches:
        done = []
        for *key, c in zip(*(batch.column(n).to_pylist() for n in (*KEY, "total", "conv_id"))):
            if ids and (key != open_key or len(ids) == PIECE):
                done.append((*open_key, ids[0], len(ids), ",".join(map(str, ids))))
                ids = []
            open_key = key
            ids.append(c)
        if done:
            yield as_batch(done, PIECES_ARROW)
    if ids:
        yield as_batch([(*open_key, ids[0], len(ids), ",".join(map(str, ids)))], PIECES_ARROW)


def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by sequence and id -> one row per sequence; its end list is hashed as it passes."""
    open_key, row, digest = None, None, None
    for batch in batches:
        done = []
        for *key, total, c, n, ids in zip(*(column.to_pylist() for column in batch.columns)):
            if key == open_key:
                row[5] += n
                digest.update(b"," + ids.encode())
                continue
            if row:
                done.append((*row, digest.hexdigest()))
            open_key, row, digest = key, [c, *key, total, n], hashlib.sha256(ids.encode())
        if done:
            yield as_batch(done, SEQUENCES_ARROW)
    if row:
        yield as_batch([(*row, digest.hexdigest())], SEQUENCES_ARROW)


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def by_block(sequences: DataFrame) -> DataFrame:
    """One row per sequence and block of it, so that a long sequence is joined block by block."""
    last = F.expr(f"greatest(depth - 1, 0) div {BLOCK}")
    return sequences.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))


def build_trie(conversations: DataFrame) -> Trie:
    """Rebuild, collapse and spread conversations ``(conv_id, turn, role, text)``."""
    turns = staged(ordered_turns(conversations), "turns")
    units = turns.groupBy("conv_id", "unit").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy("conv_id").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    # at most one row per conversation and task
    units = staged(units.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "units")
    convs = units.groupBy("conv_id").agg(F.sum("n").alias("n"))
    prefixes = staged(hashed_prefixes(rebuilt(turns, units.drop("n"), convs)), "prefixes")
    blocks = prefixes.groupBy("c", "block").agg(
        F.bit_xor("u").alias("a"), F.bit_xor("v").alias("b"), F.sum("bytes").alias("total"), F.count("*").alias("depth")
    )
    blocks = staged(blocks, "blocks")
    whole = blocks.groupBy(F.col("c").alias("conv_id")).agg(
        F.sum("depth").alias("depth"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("total").alias("total")
    )
    nothing = F.lit(0).cast("long")
    ends = staged(
        convs.select("conv_id")
        .join(whole, "conv_id", "left")
        .select("conv_id", *[F.coalesce(c, nothing).alias(c) for c in (*KEY, "total")]),
        "ends",
    )
    # ids of a large end list are sorted and joined by many tasks, and one hashes what they joined
    in_order = ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    joined = in_order.mapInArrow(pieces, PIECES).repartition(*KEY).sortWithinPartitions(*KEY, "first")
    sequences = staged(joined.mapInArrow(collapse, SEQUENCES), "sequences")
    info = by_block(sequences.select("c", "depth", "total", "weight")).withColumnRenamed("depth", "length")
    paths = chain_blocks(prefixes, blocks).join(info, ["c", "block"]).select(
        "c",
        "block",
        *KEY,
        F.col("a").bitwiseXOR(F.col("u")).alias("parent_a"),
        F.col("b").bitwiseXOR(F.col("v")).alias("parent_b"),
        "bytes",
        (F.col("total") - F.col("through") + F.col("bytes")).alias("rest"),
        "weight",
        "length",
    )
    tops = sequences.select(
        "c",
        nothing.alias("block"),
        *[nothing.alias(k) for k in (*KEY, "parent_a", "parent_b", "bytes")],
        F.col("total").alias("rest"),
        "weight",
        F.col("depth").alias("length"),
    )
    return Trie(sequences, ends, staged(paths.unionByName(tops), "paths"))


def leaves(trie: Trie) -> DataFrame:
    """The sequences that no other one continues."""
    proper = trie.paths.where("depth < length").select(*KEY).distinct()
    return trie.sequences.join(proper, KEY, "left_anti")


def nodes(trie: Trie) -> DataFrame:
    """One row per distinct prefix: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``."""
    weighted = staged(
        trie.paths.groupBy(*KEY).agg(
            F.min("c").alias("conv_id"),
            F.sum("weight").alias("n_convs"),
            F.sum(F.col("weight") * F.col("rest")).alias("passed"),
            F.max("parent_a").alias("parent_a"),
            F.max("parent_b").alias("parent_b"),
            F.max("bytes").alias("bytes"),
        ),
        "nodes",
    )
    owned = weighted.groupBy(F.col("conv_id").alias("c")).agg(
        F.min("depth").alias("top"), F.sum("bytes").alias("owned")
    )
    info = (
        trie.sequences.select("c", "depth")
        .join(owned, "c", "left")
        .join(leaves(trie).select("c", F.lit(1).alias("leaf")), "c", "left")
    )
    counted = trie.paths.join(by_block(info).drop("depth"), ["c", "block"])
    first_kept = F.when(F.col("depth") >= F.col("top"), F.col("rest")).otherwise(F.coalesce("owned", F.lit(0)))
    below = counted.groupBy(*KEY).agg(
        F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"),
        F.count_if((F.col("depth") < F.col("length")) & (F.col("depth") + 1 >= F.col("top"))).alias("n_children"),
        F.sum(first_kept).alias("once"),
        F.coalesce(F.max(F.col("depth") == F.col("top")), F.lit(False)).alias("is_top"),
    )
    ends = trie.sequences.select(*KEY, "ends_sha256")
    full = staged(weighted.join(below, KEY).join(ends, KEY, "left"), "counted-nodes")
    # a node that its sequence does not begin with has a parent of the same sequence
    starts = full.where("is_top and depth > 0").withColumn("parent_depth", F.col("depth") - 1)
    parents = full.where("n_children > 0").select(
        F.col("depth").alias("parent_depth"),
        F.col("a").alias("parent_a"),
        F.col("b").alias("parent_b"),
        F.col("conv_id").alias("parent_conv_id"),
        F.col("n_children").alias("rows"),
    )
    upper = ["parent_depth", "parent_a", "parent_b"]
    n_starts = starts.count()
    looked_up = skew.lookup_join(starts, parents, upper, "rows", n_starts)
    same = full.where("depth = 0 or not is_top").withColumn(
        "parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id"))
    )
    return looked_up.drop("parent_depth").unionByName(same).select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        (F.col("passed") - F.col("once")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
