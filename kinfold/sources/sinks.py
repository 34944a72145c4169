"""Stored results: source records and the three entity tables, published as whole versions."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import fixed_values as fixed
from kinfold.functions import standard
from kinfold.functions.tags import SourceTags
from kinfold.operators import merging, quality
from kinfold.operators.standardize import raw_from_json, raw_to_json, upsert_latest
from kinfold.operators.workspace import Workspace
from kinfold.plans.unify import Unified
from kinfold.sources.store import Change, Store
from kinfold.sources.versions import DIGITS, VersionLog

STORED_RECORD = "id string, raw_json string, company string, contactName string, email string, phone string, state string, source string"


def observed(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``rows``, and what is counted of them while they are written: all rows, and null values."""
    seen = Observation(name)
    nulls = reduce(add, [F.col(f"`{c}`").isNull().cast("int") for c in rows.columns])
    n_nulls = F.coalesce(F.sum(nulls), F.lit(0)).alias("n_nulls")
    return rows.observe(seen, F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), n_nulls), seen


def write_source_records(records: DataFrame, path: str) -> dict:
    """Source records by source, raw payload as JSON; of an id's loads the last, if loads are numbered.
    Returns what was counted."""
    if "load" in records.columns:
        records = upsert_latest(records, "id", "load")
    columns = ["id", "raw_json", *fixed.UNIFIED_FIELDS, "source"]
    rows, seen = observed(raw_to_json(records).select(*columns), "source_records")
    rows.write.mode("errorifexists").partitionBy("source").parquet(path)
    return seen.get


def record_store(spark: SparkSession, root: str, n_buckets: int = 64) -> Store:
    """A store of source records by id, which later loads change in place."""
    return Store(spark, root, {"source_records": ("id", n_buckets)})


def upsert_source_records(store: Store, records: DataFrame, workspace: Workspace) -> int:
    """Put records with a ``load`` number into the store: of an id the last load stays, whatever the order
    in which loads come. Only buckets that hold an id of ``records`` are read and written."""
    columns = ["id", "raw_json", *fixed.UNIFIED_FIELDS, "source", "load"]
    rows = workspace.stage(raw_to_json(records).select(*columns), "load")
    version, touched = store.version(), store.buckets(rows, "source_records")
    if version is not None:
        rows = rows.unionByName(store.read("source_records", version, touched))
    return store.commit({"source_records": Change(rows, touched, "load")}, version)


def read_source_records(spark: SparkSession, path: str) -> DataFrame:
    return raw_from_json(spark.read.schema(STORED_RECORD).parquet(path))


def write_entity_tables(unified: Unified, path: str) -> list[dict]:
    """Entities, field provenance and membership, all from the one stored merge result; what was counted."""
    tables = {
        "entities": merging.entities(unified.merged),
        "field_provenance": merging.field_provenance(unified.merged, unified.tags),
        "entity_members": merging.entity_members(unified.resolved, unified.tags),
    }
    counted = []
    for name, rows in tables.items():
        rows, seen = observed(rows, name)
        rows.write.parquet(f"{path}/{name}")
        counted.append(seen.get)
    return counted


class PublishRefused(Exception):
    """The tables written contradict each other; they were not announced."""


def publish(unified: Unified, root: str, keep: int | None = None) -> str:
    """Write a complete new version under ``root``, check it, then announce it.

    Rows are counted while they are written, and the written tables must pass all integrity checks; a
    version that doesn't is not announced. Readers follow the announcements, so a failed or refused run
    leaves the previous version in place. ``keep``: how many versions stay, all unless given.
    """
    spark = unified.merged.sparkSession
    log = VersionLog(spark, root)
    number = -1 if (last := log.latest()) is None else last
    version = f"{number + 1:0{DIGITS}d}-{uuid.uuid4().hex}"
    path = f"{root}/version={version}"
    seen = write_source_records(unified.records, f"{path}/source_records"), *write_entity_tables(unified, path)
    counts = {o["table_name"]: o["n_rows"] for o in seen}
    refuse_faults(spark, path, seen, unified.tags)
    log.announce(number + 1, {"version": version, "rows": counts})
    for old in log.numbers()[:-keep] if keep else []:
        if announced := log.read(old):
            log.delete(f"version={announced['version']}")
        log.forget(old)
    return version


def refuse_faults(spark: SparkSession, path: str, seen: Sequence[Mapping], tags: SourceTags) -> None:
    """Raise ``PublishRefused`` unless the tables written to ``path`` are whole and agree."""
    tables = stored_tables(spark, path)
    records, entities = tables["source_records"], tables["entities"]
    members, provenance = tables["entity_members"], tables["field_provenance"]
    records = records.withColumn("block_key", standard.block_key(F.col("company"), F.col("email")))
    faults = {f"{o['table_name']} nulls": o["n_nulls"] for o in seen if o["n_nulls"]}
    checks = {
        **quality.bad_domains(records, entities, provenance, tags),
        **quality.orphans(records, entities, members, provenance),
        **quality.bad_keys(records, entities, members, provenance),
        **quality.bad_partition(records, members),
        **quality.bad_provenance(records, entities, members, provenance),
    }
    faults |= {r.check_name: r.n_violations for r in quality.counts(checks).where("n_violations > 0").collect()}
    if faults:
        raise PublishRefused(", ".join(f"{name}: {n}" for name, n in sorted(faults.items())))


def published_path(spark: SparkSession, root: str) -> str:
    """Folder of the version announced last."""
    log = VersionLog(spark, root)
    return f"{root}/version={log.read(log.latest())['version']}"


def announced_rows(spark: SparkSession, root: str) -> dict[str, int]:
    """Rows per table of the version announced last, as counted while it was written."""
    log = VersionLog(spark, root)
    return log.read(log.latest())["rows"]


def read_published(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return stored_tables(spark, published_path(spark, root))


def stored_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    tables = {
        t: spark.read.parquet(f"{path}/{t}")
        for t in ("entities", "field_provenance", "entity_members")
    }
    return {"source_records": read_source_records(spark, f"{path}/source_records"), **tables}
