"""The whole job: raw sources -> standard records -> clusters -> merged entities."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from kinfold.functions import fixed_values as fixed
from kinfold.functions.tags import DEFAULT_TAGS, SourceTags
from kinfold.operators import clustering, linking, merging
from kinfold.operators.standardize import standardize_all, upsert_latest
from kinfold.operators.workspace import Workspace

LINKING_COLUMNS = (
    "node", "id", "source", "ordinal", *fixed.UNIFIED_FIELDS, "canonical", "block_key",
)


@dataclass(frozen=True)
class Unified:
    """The tables of one run, all stored in its workspace."""

    workspace: Workspace
    records: DataFrame
    n_records: int
    resolved: DataFrame
    merged: DataFrame
    tags: SourceTags = DEFAULT_TAGS


def unify_records(
    records: DataFrame,
    workspace: Workspace,
    priority: Mapping[str, int] | None = None,
    heavy_rows: int | None = None,
    tags: SourceTags = DEFAULT_TAGS,
) -> Unified:
    """Link, cluster and merge standard records.

    The regex-heavy standardisation runs once; the raw payload stays out of the later shuffles. Where
    records have a ``load`` number, the last load of a record replaces earlier ones before linking.
    """
    if "load" in records.columns:
        records = upsert_latest(workspace.stage(records, "loads"), "node", "load").drop("load")
    records = workspace.stage(records, "records")
    n_records = records.count()
    slim = records.select(*LINKING_COLUMNS)
    edges = linking.link_edges(slim, n_records, heavy_rows)
    resolved = workspace.stage(clustering.cluster(slim, edges, workspace, heavy_rows), "resolved")
    merged = workspace.stage(merging.merge(resolved, n_records, priority, heavy_rows, tags), "merged")
    return Unified(workspace, records, n_records, resolved, merged, tags)


def unify_sources(
    raws: Mapping[str, DataFrame],
    workspace: Workspace,
    mappings: Mapping[str, Mapping[str, str]] | None = None,
    priority: Mapping[str, int] | None = None,
    heavy_rows: int | None = None,
    tags: SourceTags = DEFAULT_TAGS,
) -> Unified:
    """``tags``: the sources there are, if others than the default three; ``mappings`` has one for each."""
    return unify_records(standardize_all(raws, mappings, tags), workspace, priority, heavy_rows, tags)
