"""Batch-by-batch progress of a run, as data.

Batches of blocks are what a run reports on while it advances; Spark schedules the work itself, so
here they are numbers attached to blocks, and progress is a running total over them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions import fixed_values as fixed
from kinfold.operators import linking, skew
from kinfold.operators.workspace import Workspace


def batch_progress(
    resolved: DataFrame, workspace: Workspace, size: int = fixed.BLOCKS_PER_BATCH
) -> DataFrame:
    """``(batch, total_batches, n_entities, entities_so_far)`` in batch order."""
    blocks = linking.block_batches(resolved, workspace, size).select("block_key", "batch")
    per_block = (
        resolved.where("node = root").groupBy("block_key").agg(F.count("*").alias("n_entities"))
    )
    per_batch = workspace.stage(
        blocks.join(per_block, "block_key")
        .groupBy("batch")
        .agg(F.sum("n_entities").alias("n_entities")),
        "batches",
    )
    total = per_batch.agg(F.max("batch")).scalar()
    running = skew.running_total(per_batch, "batch", F.col("n_entities"), "entities_so_far")
    return running.withColumn("total_batches", total)
