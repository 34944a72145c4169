"""Clusters: connected components of the link evidence.

Alternating small-star / large-star contraction (Kiveris et al., SoCC 2014): every edge points from
a node to a smaller one, and each round replaces targets by the smallest neighbour seen, until the
edges form stars. The number of rounds grows with the logarithm of the longest chain, not with its
length. Node numbers are longs, so each step is a hash aggregate plus an equi-join.

Records link inside their block, so most of the work needs no rounds: where a block's evidence lies
together, every record first points at the smallest node within two hubs. Rounds then only run on the nodes
that are not leaves of such a star, few but for long chains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators import skew
from kinfold.operators.workspace import Workspace


def inner_nodes(edges: DataFrame) -> DataFrame:
    """``(u, n)`` of the nodes that are in the way of a star forest: with several targets, or with one and
    pointed at themselves. ``n`` is their number of targets."""
    ends = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")),
                F.struct(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")),
            )
        )
    )
    out, into = F.sum("out"), F.max("into")
    inner = ends.groupBy("x").agg(out.alias("n"), into.alias("i")).where("n > 1 or n + i > 1")
    return inner.select(F.col("x").alias("u"), "n")


def is_star_forest(edges: DataFrame) -> bool:
    """True when every node has one target and no target has a target itself."""
    return inner_nodes(edges).isEmpty()


def small_star(edges: DataFrame, n_edges: int, heavy_rows: int | None) -> DataFrame:
    """Point every node, and each of its smaller neighbours, at its smallest neighbour."""
    nodes = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    several = nodes.where("n > 1")
    moved = skew.lookup_join(edges, several, ["u"], "n", n_edges, heavy_rows=heavy_rows)
    kept = nodes.select("u", F.col("m").alias("v"))
    return kept.union(moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def large_star(edges: DataFrame, n_edges: int, heavy_rows: int | None) -> DataFrame:
    """Point every node at the smallest neighbour of its target."""
    lowest = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
    if skew.heavy_bound(n_edges, heavy_rows) is None:
        moved = edges.join(lowest, "v", "left")
    else:
        fan_in = edges.groupBy("v").agg(F.count("*").alias("n"))
        targets = fan_in.join(lowest, "v", "left")
        moved = skew.lookup_join(edges, targets, ["v"], "n", n_edges, heavy_rows=heavy_rows)
    return moved.select("u", F.coalesce("m", "v").alias("v")).distinct()


def contract(stars: DataFrame, workspace: Workspace, heavy_rows: int | None = None) -> DataFrame:
    """The star forest of staged edges, by rounds."""
    while not is_star_forest(stars):
        # a small-star output has at most two edges per input edge
        n_edges = stars.count()
        smaller = workspace.stage(small_star(stars, n_edges, heavy_rows), "smaller")
        workspace.release(stars)
        stars = workspace.stage(large_star(smaller, 2 * n_edges, heavy_rows), "edges")
        workspace.release(smaller)
    return stars


def connected_components(
    edges: DataFrame, workspace: Workspace, heavy_rows: int | None = None
) -> DataFrame:
    """``(node, root)`` for every node that has an edge; the root is the smallest node reached.

    ``edges`` holds ``(u, v)`` with ``v < u``. Leaves, nodes with one target that no node points at, are
    left out of the rounds and follow their target afterwards.
    """
    stars = workspace.stage(edges.distinct(), "edges")
    inner = workspace.stage(inner_nodes(stars), "inner")
    if not inner.isEmpty():
        n_edges = stars.count()
        inner = inner.withColumn("inner", F.lit(True))
        marked = skew.lookup_join(stars, inner, ["u"], "n", n_edges, "left", heavy_rows)
        marked = workspace.stage(marked, "marked")
        workspace.release(stars)
        core = contract(workspace.stage(marked.where("inner").select("u", "v"), "edges"), workspace, heavy_rows)
        leaves = marked.where("inner is null").select("u", "v")
        moves = core.select(F.col("u").alias("v"), F.col("v").alias("m"))
        fan_in = leaves.groupBy("v").agg(F.count("*").alias("n")).join(moves, "v")
        moved = skew.lookup_join(leaves, fan_in, ["v"], "n", n_edges, "left", heavy_rows)
        stars = moved.select("u", F.coalesce("m", "v").alias("v")).unionByName(core)
    # a root is pointed at by some node
    roots = stars.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def near_edges(link_edges: DataFrame, heavy_rows: int | None = None) -> DataFrame:
    """Edges ``(u, v)``, ``v < u``, with the components of the evidence: every record points at the
    smallest node within two hubs, that one and the anchor at the smallest that the hub's records know.

    Rows that lie together by block, as ``linking.link_edges`` leaves them, do not move. Rows of a heavy
    hub only pass on what their own record knows, so that no task holds such a hub.
    """
    bound = skew.HEAVY_ROWS if heavy_rows is None else heavy_rows
    rows = link_edges.groupBy("block_key", "node", "anchor").agg((F.max("hub_size") > bound).alias("heavy"))
    rows = rows.withColumn("hub", F.when(~F.col("heavy"), F.col("anchor")))
    rows = rows.withColumn("alone", F.when(F.col("heavy"), F.col("node")))
    by_node = Window.partitionBy("block_key", "node")
    by_hub = Window.partitionBy("block_key", "hub", "alone")
    rows = rows.withColumn("low", F.min("anchor").over(by_node))
    rows = rows.withColumn("low", F.min("low").over(by_hub))
    rows = rows.withColumn("low", F.min("low").over(by_node))
    rows = rows.withColumn("next", F.min("low").over(by_hub))
    ends = [("node", "low"), ("low", "next"), ("anchor", "next")]
    pairs = F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in ends])
    return rows.select(F.inline(pairs)).where("u <> v")


def cluster(
    records: DataFrame,
    link_edges: DataFrame,
    workspace: Workspace,
    heavy_rows: int | None = None,
) -> DataFrame:
    """Records with the ``root`` node of their cluster; unlinked records are their own root."""
    labels = connected_components(near_edges(link_edges, heavy_rows), workspace, heavy_rows)
    return (
        records.join(labels, "node", "left")
        .withColumn("linked", F.col("root").isNotNull())
        .withColumn("root", F.coalesce("root", "node"))
    )
