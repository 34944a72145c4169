"""Stored tables laid out for the reports that join them: bucketed, sorted, with Bloom filters.

Tables that meet on a key are dealt into the same number of buckets by it, and sorted: their joins read
bucket by bucket, without moving a row. Files hold Bloom filters of the ids and of ``state``, so that a
lookup of one entity, record or state skips row groups that can't hold it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import fixed_values as fixed
from kinfold.operators import merging
from kinfold.plans.unify import Unified

N_BUCKETS = 64
#: Table -> bucket key, and the columns beside it that get a Bloom filter.
LAYOUT = {
    "entities": ("entity_id", ["state"]),
    "field_provenance": ("entity_id", []),
    "members_by_record": ("record_id", ["entity_id"]),
    "records_by_id": ("record_id", ["state"]),
}


def write_lookup_tables(unified: Unified, path: str, name: str, n_buckets: int = N_BUCKETS) -> dict[str, DataFrame]:
    """Write the tables under ``path`` and enter them in the session's catalog as ``name_<table>``.

    ``n_buckets``: so many that a bucket of the largest table is some files at most.
    """
    records = unified.records.select(F.col("id").alias("record_id"), "source", "raw", *fixed.UNIFIED_FIELDS)
    rows = {
        "entities": merging.entities(unified.merged),
        "field_provenance": merging.field_provenance(unified.merged, unified.tags),
        "members_by_record": merging.entity_members(unified.resolved, unified.tags),
        "records_by_id": records,
    }
    for table, (key, filtered) in LAYOUT.items():
        # one task for each bucket, so that it is one sorted file
        writer = rows[table].repartition(n_buckets, key).write.option("path", f"{path}/{table}")
        for column in (key, *filtered):
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.bucketBy(n_buckets, key).sortBy(key).mode("errorifexists").saveAsTable(f"{name}_{table}")
    return read_lookup_tables(unified.merged.sparkSession, name)


def read_lookup_tables(spark: SparkSession, name: str) -> dict[str, DataFrame]:
    return {table: spark.table(f"{name}_{table}") for table in LAYOUT}


def field_winner(tables: dict[str, DataFrame], field: str) -> DataFrame:
    """Which source won one field of each entity: both tables are read in buckets of entities."""
    won = tables["field_provenance"].where(F.col("field") == field)
    return won.join(tables["entities"].select("entity_id", "company"), "entity_id").select(
        "entity_id", "company", "source", "value"
    )


def entity_lineage(tables: dict[str, DataFrame]) -> DataFrame:
    """Which raw records fed each entity: both tables are read in buckets of records."""
    fed = tables["records_by_id"].select("record_id", "source", "raw")
    return tables["members_by_record"].join(fed, "record_id").select("entity_id", "record_id", "source", "raw")
