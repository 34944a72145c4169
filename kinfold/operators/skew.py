"""Joins and rankings that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.workspace import Workspace

# A key with more rows than this is heavy: its rows never meet in one task, whatever the table's size.
HEAVY_ROWS = 500_000
# What one row per heavy key may measure to be broadcast; beyond it, salted joins take over.
BROADCAST_BYTES = 64 << 20
SALTS = 16


def heavy_bound(rows: int, heavy_rows: int | None = None) -> int | None:
    """Row count above which a key is heavy, or None when ``rows`` is too small for any."""
    heavy_rows = HEAVY_ROWS if heavy_rows is None else heavy_rows
    return None if rows <= heavy_rows else heavy_rows


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows, and the bytes that they have as text."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))
    n, n_bytes = df.agg(F.count("*"), size).first()
    return n, n_bytes or 0


def broadcastable(df: DataFrame) -> bool:
    """Whether all rows, measured as text, fit ``BROADCAST_BYTES``."""
    return measured(df)[1] <= BROADCAST_BYTES


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join to one row per key, each key's rows of ``left`` dealt over ``SALTS`` tasks. All of a key's
    copies on the right are alike, so it does not matter which row goes where."""
    salted = left.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def join_heavy(left: DataFrame, heavy: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of heavy keys with their one match: by broadcast if that is proven small, else salted."""
    if broadcastable(heavy):
        return left.join(F.broadcast(heavy), list(keys))
    return salted_join(left, heavy, keys)


def split_heavy(
    df: DataFrame, key: str, rows: int, heavy_rows: int | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys, partitioned by the key, and rows of heavy keys where they are.

    Ordinary keys move once, as whole rows, and every later aggregate or window by that key runs in
    place. Rows of heavy keys should only meet aggregates that combine before they shuffle, or
    ``join_heavy``. ``df`` must be stored. The second part is None when ``rows`` is too small for a
    heavy key, or no key is found to be heavy: then the rows are read once and nothing is joined.
    """
    bound = heavy_bound(rows, heavy_rows)
    if bound is None:
        return df.repartition(key), None
    sizes = df.groupBy(key).agg(F.count("*").alias("_rows"))
    heavy = sizes.where(F.col("_rows") > bound).select(key)
    n_heavy, n_bytes = measured(heavy)
    if not n_heavy:
        return df.repartition(key), None
    if n_bytes <= BROADCAST_BYTES:
        few = F.broadcast(heavy)
        return df.join(few, key, "left_anti").repartition(key), df.join(few, key, "left_semi")
    marked = salted_join(df, heavy.withColumn("_heavy", F.lit(True)), [key], "left")
    return (
        marked.where("_heavy is null").drop("_heavy").repartition(key),
        marked.where("_heavy").drop("_heavy"),
    )


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    rows_column: str,
    left_rows: int,
    how: str = "inner",
    heavy_rows: int | None = None,
) -> DataFrame:
    """Join ``left`` to ``right``, which has one row per key, without funnelling a hot key.

    ``right.rows_column`` says how many rows of ``left`` have the key. Rows of heavy keys meet their
    match by a broadcast of the heavy rows of ``right``, if these measure little enough, and never
    shuffle; all other rows join by key, where no key is heavy. With too many heavy rows to broadcast
    the whole join is salted. While ``left`` is no larger than ``heavy_rows`` no key can be heavy; then,
    and where none is found to be, one plain join is planned. ``rows_column`` is dropped.
    """
    keys = list(keys)
    bound = heavy_bound(left_rows, heavy_rows)
    if bound is None:
        return left.join(right.drop(rows_column), keys, how)
    is_heavy = F.col(rows_column) > bound
    heavy = right.where(is_heavy).drop(rows_column)
    n_heavy, n_bytes = measured(heavy)
    if not n_heavy:
        return left.join(right.drop(rows_column), keys, how)
    if n_bytes > BROADCAST_BYTES:
        return salted_join(left, right.drop(rows_column), keys, how)
    light = right.where(~is_heavy).drop(rows_column)
    by_broadcast = left.join(F.broadcast(heavy), keys)
    by_shuffle = left.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(
        light, keys, how
    )
    return by_broadcast.unionByName(by_shuffle)


def number_rows(
    df: DataFrame, order: Sequence[str], workspace: Workspace, name: str = "position"
) -> DataFrame:
    """1-based position of every row in a total order, without a one-task window.

    Rows are range-partitioned and sorted, each partition numbers its own rows, and the
    partitions' row counts (one row per partition) give the offsets.
    """
    local = F.monotonically_increasing_id()
    parts = workspace.stage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", local),
        "ordered",
    )
    return offset_units(
        parts.withColumn("_unit", F.shiftright("_at", 33)), ["_unit"], "_at", name, workspace
    )


def sums_before(
    df: DataFrame, order: Sequence[str], value: Column, name: str, workspace: Workspace
) -> DataFrame:
    """Sum of ``value`` over all rows that come before, in any number of rows.

    Rows are range-partitioned by ``order``; each partition sums its own, and one row per partition
    gives what the partitions before it hold.
    """
    order = list(order)
    parts = workspace.stage(
        df.withColumn("_value", value)
        .repartitionByRange(*order)
        .withColumn("_part", F.spark_partition_id()),
        "ranges",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        parts.groupBy("_part")
        .agg(F.sum("_value").alias("_sum"))
        .select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    )
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        parts.withColumn("_within", F.coalesce(F.sum("_value").over(within), F.lit(0)))
        .join(F.broadcast(totals), "_part")  # one row per shuffle partition
        .withColumn(name, F.col("_offset") + F.col("_within"))
        .drop("_value", "_part", "_within", "_offset")
    )


def offset_units(
    df: DataFrame,
    units: Sequence[str],
    at: str,
    name: str,
    workspace: Workspace,
    skip: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Turn per-unit increasing numbers ``at`` into one dense numbering across ordered units.

    ``skip`` adds ``_skip``, the number of leading rows of a unit (a header line) that are dropped and
    take no number, to the table of units; other columns that it adds are passed on to the unit's
    rows. ``df`` must be stored, so that both reads see the same numbers. A unit is a file, a file
    split or a partition.
    """
    units = list(units)
    sizes = df.groupBy(*units).agg(F.count("*").alias("_n"), F.min(at).alias("_first"))
    sizes = skip(sizes) if skip else sizes.withColumn("_skip", F.lit(0))
    offsets = sums_before(sizes, units, F.col("_n") - F.col("_skip"), "_before", workspace).drop("_n")
    row = F.col(at) - F.col("_first")
    return (
        df.join(offsets, units)
        .where(row >= F.col("_skip"))
        .withColumn(name, F.col("_before") + row - F.col("_skip") + 1)
        .drop(*units, at, "_first", "_skip", "_before")
    )


def running_total(df: DataFrame, number: str, value: Column, name: str, width: int = 4096) -> DataFrame:
    """Running total of ``value`` over a dense 1-based ``number``, in groups of ``width`` numbers.

    Each group is summed in its own window; the totals before it come from one row per group.
    """
    grouped = df.withColumn("_value", value).withColumn(
        "_group", F.floor((F.col(number) - 1) / width)
    )
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        grouped.groupBy("_group")
        .agg(F.sum("_value").alias("_sum"))
        .select("_group", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    )
    within = Window.partitionBy("_group").orderBy(number)
    return (
        grouped.withColumn("_within", F.sum("_value").over(within))
        .join(offsets, "_group")
        .withColumn(name, F.col("_offset") + F.col("_within"))
        .drop("_value", "_group", "_within", "_offset")
    )
