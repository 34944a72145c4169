"""Merkle manifest of a dataset, stored as aligned subtrees in van Emde Boas order.

Every row is a leaf. Per ``lang`` the leaves stand in order of ``doc_id``, and while more than one node
remains every eight neighbours become one, the last run as it is, even of one. The languages' roots, in
order of ``lang``, become the root in the same way.

A tree is stored as blocks: aligned subtrees of up to ``levels`` levels of runs, each one value that holds
its nodes in van Emde Boas order (cut at half height, the top part first, then the parts below it, each
cut again). The address of a node is arithmetic on its level and number alone; it says where construction
puts a digest and where retrieval finds the siblings. The roots of the blocks are the leaves of the next
layer of blocks, up to a single one, and the languages' roots are the leaves of one more such tree.

Blocks are built and read by streaming tasks that hold one block, of 8 ** levels leaves at most, whatever
the size of a language. Siblings above a block are found once for the block, layer by layer from the
root, and handed down to it. Texts are hashed where they are read and never move.

Defined results: a null field is ``-``; null ``lang`` comes first, an empty one next; null ``doc_id``
comes first and its row is never tampered with; rows of equal ``doc_id`` stand in order of their leaves,
and repeated rows are leaves each; texts of any length are hashed whole; other columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.standard import fold_ascii
from kinfold.llm.common import staged
from kinfold.operators import skew
from kinfold.operators.workspace import Workspace

RUN, RUN_BITS = 8, 3
#: Runs from the leaves of a full block to its root: 4096 leaves, 150 kB.
LEVELS = 4
DIGEST = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

BLOCK = "tree string, height int, block long, levels int, n_leaves int, root binary, nodes binary"
ABOVE = "tree string, block long, upper binary, subroot binary, tree_place long"
PROOF = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string,"
    " verified boolean"
)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {
        "string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()
    }
    return pa.schema([(n, kinds[k]) for n, k in (column.split() for column in ddl.split(","))])


@dataclass(frozen=True)
class Manifest:
    """``leaves``: every row's digest and place in its tree. ``layers``: the blocks of the languages' trees,
    from the leaves up. ``top_layers``: those of the tree over the languages, ``subroots`` its leaves."""

    leaves: DataFrame
    layers: list[DataFrame]
    subroots: DataFrame
    top_layers: list[DataFrame]
    root: bytes | None
    levels: int


# --- digests and addresses -----------------------------------------------------------------


def joined(digests: bytes) -> bytes:
    """The digest of digests, taken as hexadecimal text."""
    return hashlib.sha256(digests.hex().encode()).digest()


def height_of(n: int) -> int:
    """Levels of runs until one of ``n`` nodes remains."""
    height = 0
    while RUN**height < n:
        height += 1
    return height


def size_of(levels: int) -> int:
    """Nodes of a full tree that has ``levels`` levels of nodes."""
    return (RUN**levels - 1) // (RUN - 1)


def address(levels: int, depth: int, number):
    """Place, in van Emde Boas order, of a node of a full tree: of one number or of an array of numbers."""
    place = 0
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        below, depth = levels - top, depth - top
        inside = RUN_BITS * depth
        place = place + size_of(top) + (number >> inside) * size_of(below)
        number, levels = number & ((1 << inside) - 1), below
    return place + number * 0


@lru_cache(maxsize=None)
def addresses(levels: int, depth: int) -> np.ndarray:
    """The places of all nodes of one depth."""
    return address(levels, depth, np.arange(RUN**depth))


def build_block(leaves: bytes, levels: int) -> tuple[bytes, bytes]:
    """``(root, nodes)`` of a block: its nodes in van Emde Boas order, up to the last place in use."""
    level, rows, last = leaves, [], 0
    for depth in range(levels, -1, -1):
        digests = np.frombuffer(level, np.uint8).reshape(-1, DIGEST)
        places = addresses(levels + 1, depth)[: len(digests)]
        rows.append((places, digests))
        last = max(last, int(places.max()))
        if depth:
            level = b"".join(joined(level[at : at + RUN * DIGEST]) for at in range(0, len(level), RUN * DIGEST))
    nodes = np.zeros((last + 1, DIGEST), np.uint8)
    for places, digests in rows:
        nodes[places] = digests
    return level, nodes.tobytes()


def block_levels(nodes: bytes, levels: int, n_leaves: int) -> list[bytes]:
    """The nodes of a block level by level from the leaves, without its root."""
    stored = np.frombuffer(nodes, np.uint8).reshape(-1, DIGEST)
    found, width = [], n_leaves
    for depth in range(levels, 0, -1):
        found.append(stored[addresses(levels + 1, depth)[:width]].tobytes())
        width = -(-width // RUN)
    return found


def siblings(levels: list[bytes], slot: int) -> bytes:
    """The others of the run of leaf ``slot`` and of each run above it, within a block."""
    parts = []
    for level in levels:
        start = (slot - slot % RUN) * DIGEST
        own = slot * DIGEST
        parts += [level[start:own], level[own + DIGEST : start + RUN * DIGEST]]
        slot //= RUN
    return b"".join(parts)


def fold(digest: bytes, path: bytes, at: int, n: int, place: int) -> tuple[bytes, int]:
    """The root of a tree of ``n`` leaves from the leaf at ``place`` and its siblings from ``at`` on."""
    while n > 1:
        left = place % RUN
        others = min(RUN, n - place + left) - 1
        before = path[at : at + left * DIGEST]
        digest = joined(before + digest + path[at + left * DIGEST : at + others * DIGEST])
        at, n, place = at + others * DIGEST, -(-n // RUN), place // RUN
    return digest, at


# --- leaves --------------------------------------------------------------------------------


def leaf_digest(text: Column) -> Column:
    """Digest of a row's fields, each by its length and value."""
    parts = []
    for name in FIELDS:
        value = text if name == "text" else F.col(f"`{name}`").cast("string")
        counted = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
        parts.append(F.coalesce(counted, F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def tampered(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def tree_name(lang: Column) -> Column:
    """Names whose order is that of the languages, null first."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


def number_leaves(docs: DataFrame) -> DataFrame:
    """``(tree, n, height, place, doc_id, leaf, changed)``, stored."""
    lowered = fold_ascii(F.col("text"))
    differs = tampered(F.col("doc_id")) & (F.col("text") != lowered)
    hashed = docs.select(
        tree_name(F.col("lang").cast("string")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_digest(F.col("text")).alias("leaf"),
        F.when(differs, leaf_digest(lowered)).alias("changed"),
    )
    hashed = staged(hashed, "leaves")
    ordered = skew.number_rows(hashed, ["tree", "doc_id", "leaf"], Workspace(docs.sparkSession))
    trees = ordered.groupBy("tree").agg(
        F.min("position").alias("first"), F.count("*").alias("n"), F.count("*").alias("rows")
    )
    trees = staged(trees, "trees")
    total = trees.agg(F.sum("n")).first()[0] or 0
    placed = skew.lookup_join(ordered, trees.withColumn("height", height_column()), ["tree"], "rows", total)
    place = (F.col("position") - F.col("first")).alias("place")
    return staged(placed.select("tree", "n", "height", place, "doc_id", "leaf", "changed"), "placed")


def height_column() -> Column:
    """``height_of`` of column ``n``."""
    heights = [F.when(F.col("n") <= RUN**h, F.lit(h)) for h in range(21)]
    return F.coalesce(*heights, F.lit(21))


# --- construction --------------------------------------------------------------------------


def in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows sorted by tree and block, one block's at a time."""
    open_key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = row["tree"], row["block"]
            if key != open_key and rows:
                yield open_key, rows
                rows = []
            open_key = key
            rows.append(row)
    if rows:
        yield open_key, rows


def build_blocks(most: int):
    """Sorted nodes -> their blocks, of at most ``most`` levels."""

    def run(batches):
        schema = arrow_schema(BLOCK)
        for (tree, block), rows in in_groups(batches):
            levels = min(most, rows[0]["height"])
            root, nodes = build_block(b"".join(r["digest"] for r in rows), levels)
            made = (tree, rows[0]["height"], block, levels, len(rows), root, nodes)
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(made, schema)], schema=schema)

    return run


def block_of(levels: int) -> Column:
    return F.expr(f"shiftright(place, {RUN_BITS} * least({levels}, height))")


def build_layers(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Layers of blocks over ``nodes(tree, height, place, digest)``, as deep as the highest tree asks."""
    layers = []
    tallest = nodes.agg(F.max("height")).first()[0]
    for _ in range(max(1, -(-(tallest or 0) // levels))):
        grouped = nodes.withColumn("block", block_of(levels)).repartition("tree", "block")
        sorted_nodes = grouped.sortWithinPartitions("tree", "block", "place")
        layers.append(staged(sorted_nodes.mapInArrow(build_blocks(levels), BLOCK), "blocks"))
        nodes = layers[-1].where(F.col("height") > levels).select(
            "tree", (F.col("height") - levels).alias("height"), F.col("block").alias("place"), F.col("root").alias("digest")
        )
    return layers


def last_blocks(layer: DataFrame) -> DataFrame:
    """The blocks of a layer that end their trees."""
    return layer.where(F.col("height") <= F.col("levels"))


def tree_roots(layers: list[DataFrame]) -> DataFrame:
    """``(tree, digest)``: each tree's root is that of its only block in its last layer."""
    parts = [last_blocks(layer).select("tree", F.col("root").alias("digest")) for layer in layers]
    roots = parts[0]
    for part in parts[1:]:
        roots = roots.unionByName(part)
    return roots


def build_manifest(docs: DataFrame, levels: int = LEVELS) -> Manifest:
    """Digests of all rows of ``docs(doc_id, source, lang, n_chars, text)`` in blocks of ``levels`` levels."""
    leaves = number_leaves(docs)
    layers = build_layers(leaves.select("tree", "height", "place", F.col("leaf").alias("digest")), levels)
    numbered = skew.number_rows(tree_roots(layers), ["tree"], Workspace(docs.sparkSession))
    subroots = staged(numbered.select("tree", (F.col("position") - 1).alias("place"), "digest"), "subroots")
    n = subroots.count()
    top = subroots.select(F.lit("").alias("tree"), F.lit(height_of(n)).alias("height"), "place", "digest")
    top_layers = build_layers(top, levels)
    root = tree_roots(top_layers).first()
    return Manifest(leaves, layers, subroots, top_layers, bytes(root.digest) if root else None, levels)


# --- retrieval -----------------------------------------------------------------------------


def hand_down(is_top: bool):
    """Blocks with what is above them -> the same for each of their leaves."""

    def run(batches):
        schema = arrow_schema(ABOVE)
        for batch in batches:
            for row in batch.to_pylist():
                levels = block_levels(row["nodes"], row["levels"], row["n_leaves"])
                leaves = levels[0] if levels else row["root"]
                first = row["block"] << RUN_BITS * row["levels"]
                made = []
                for slot in range(row["n_leaves"]):
                    own = leaves[slot * DIGEST : (slot + 1) * DIGEST]
                    path = siblings(levels, slot) + row["upper"]
                    above = (own, first + slot) if is_top else (row["subroot"], row["tree_place"])
                    made.append((row["tree"], first + slot, path, *above))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*made), schema)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def descend(layers: list[DataFrame], above: DataFrame, is_top: bool) -> DataFrame:
    """From what is above the trees (``tree, block = 0``) to what is above the blocks of the lowest layer."""
    handed = None
    for layer in reversed(layers):
        ends = last_blocks(layer).select("tree", "block").join(above, ["tree", "block"])
        known = ends if handed is None else ends.unionByName(handed)
        if layer is layers[0] and not is_top:
            return known
        handed = staged(layer.join(known, ["tree", "block"]).mapInArrow(hand_down(is_top), ABOVE), "above")
    return handed


def prove(n_trees: int, root: bytes):
    """Blocks, each followed by its rows, -> the rows with their proofs checked."""

    def run(batches):
        schema, rows, block, levels = arrow_schema(PROOF), [], None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    block, levels = row, block_levels(row["nodes"], row["levels"], row["n_leaves"])
                    continue
                leaf, place = row["leaf"], row["place"]
                path = siblings(levels, place % RUN ** block["levels"]) + block["upper"]
                digest, at = fold(row["changed"] or leaf, path, 0, row["n"], place)
                folded, _ = fold(digest, path, at, n_trees, block["tree_place"])
                hashed = hashlib.sha256(path.hex().encode()).hexdigest()
                rows.append(
                    (row["doc_id"], leaf.hex(), block["subroot"].hex(), root.hex(), hashed, folded.hex(), folded == root)
                )
            if rows:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
                rows = []

    return run


def proofs(manifest: Manifest) -> DataFrame:
    """Every row's leaf, its roots, the digest of its siblings, and the root folded from its leaf as it is
    after tampering: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``."""
    spark = manifest.leaves.sparkSession
    if manifest.root is None:
        return spark.createDataFrame([], PROOF)
    nothing = F.lit(b"")
    over_all = spark.range(1).select(
        F.lit("").alias("tree"),
        F.lit(0).cast("long").alias("block"),
        nothing.alias("upper"),
        nothing.alias("subroot"),
        F.lit(0).cast("long").alias("tree_place"),
    )
    over_trees = descend(manifest.top_layers, over_all, True).drop("tree", "block")
    named = manifest.subroots.select("tree", F.lit(0).cast("long").alias("block"), F.col("place").alias("tree_place"))
    above = descend(manifest.layers, named.join(over_trees, "tree_place"), False)
    blocks = manifest.layers[0].join(above, ["tree", "block"]).drop("height", "root").withColumn("kind", F.lit(0))
    rows = manifest.leaves.withColumn("block", block_of(manifest.levels)).drop("height").withColumn("kind", F.lit(1))
    together = (
        rows.unionByName(blocks, allowMissingColumns=True)
        .repartition("tree", "block")
        .sortWithinPartitions("tree", "block", "kind", "place")
    )
    return together.mapInArrow(prove(manifest.subroots.count(), manifest.root), PROOF)
