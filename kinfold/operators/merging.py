"""One merged entity per cluster, with provenance and confidence.

Conflict rule per field: filled before blank, then the more complete value, then the more
authoritative source, then the earlier row.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import fixed_values as fixed
from kinfold.functions import standard
from kinfold.functions.tags import DEFAULT_TAGS, SourceTags
from kinfold.operators import skew
from kinfold.operators.standardize import node_record_id, node_source

LONG_WORD = r"[^ ]*\p{L}[^ ]*\p{L}[^ ]*"


def completeness(field: str) -> Column:
    """Larger for the fuller value of a field."""
    value = F.col(field)
    if field == "company":
        words = F.size(F.split("canonical", " "))
        return F.when(F.col("canonical") == "", 0).otherwise(words)
    if field == "contactName":
        return F.regexp_count(value, F.lit(LONG_WORD))
    if field == "email":
        return value.rlike(fixed.EMAIL_SHAPE).cast("int")
    if field == "phone":
        return value.rlike(fixed.PHONE_SHAPE).cast("int")
    return standard.is_state_code(value).cast("int")


def compared(field: str, prefix: str = "") -> Column:
    """The form in which two values of a field count as equal."""
    if field == "company":
        return F.col(f"{prefix}canonical")
    value = F.col(prefix + field)
    return F.lower(value) if field == "contactName" else value


def candidate(field: str, priority: Mapping[str, int]) -> Column:
    """A record's offer for a field; the smallest offer under struct order wins."""
    value = F.col(field)
    authority = F.coalesce(
        *[F.when(F.col("source") == s, F.lit(p)) for s, p in priority.items()],
        F.lit(len(priority) + 1),
    )
    length = F.length(value) if field == "contactName" else F.lit(0)
    return F.struct(
        (value == "").cast("int").alias("blank"),
        (-completeness(field)).alias("less_complete"),
        (-length).alias("shorter"),
        authority.alias("authority"),
        F.col("node").alias("node"),
        value.alias("value"),
    )


def offers(priority: Mapping[str, int]) -> Column:
    """A record's five offers as ``(field, form, offer)``."""
    return F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                compared(f).alias("form"),
                candidate(f, priority).alias("offer"),
            )
            for f in fixed.UNIFIED_FIELDS
        ]
    )


def distinct_values(resolved: DataFrame, priority: Mapping[str, int]) -> DataFrame:
    """Per entity, field and compared value: how many members carry it, and the best offer."""
    return (
        resolved.select("root", F.inline(offers(priority)))
        .groupBy("root", "field", "form", F.col("offer.blank").alias("blank"))
        .agg(F.count("*").alias("n"), F.min("offer").alias("offer"))
    )


def _joined(parts: list[Column]) -> Column:
    return F.concat_ws(", ", *parts)


def merge_linked(linked: DataFrame, priority: Mapping[str, int]) -> DataFrame:
    """Merge clusters of two or more records, by two aggregations."""
    values = distinct_values(linked, priority)
    filled = F.col("blank") == 0
    aggregates = [F.sum(F.when(F.col("field") == "company", F.col("n"))).alias("member_count")]
    for f in fixed.UNIFIED_FIELDS:
        here = F.col("field") == f
        shared = here & filled
        if f == "phone":
            shared = shared & F.col("form").rlike(fixed.PHONE_SHAPE)
        aggregates += [
            F.min(F.when(here, F.struct("offer", "n"))).alias(f"{f}_best"),
            F.sum(F.when(here & filled, F.col("n"))).alias(f"{f}_filled"),
            F.count_if(here & filled).alias(f"{f}_values"),
            F.max(F.when(shared, F.col("n"))).alias(f"{f}_shared"),
        ]
    wide = values.groupBy("root").agg(*aggregates)

    def share(f: str) -> Column:
        agreeing = F.col(f"{f}_best.n").cast("double")
        return F.when(F.col(f"{f}_filled").isNull(), 1.0).otherwise(
            agreeing / F.col(f"{f}_filled").cast("double")
        )

    agreement = reduce(add, [share(f) for f in fixed.UNIFIED_FIELDS])
    keys = _joined(
        [
            F.when(F.col(f"{f}_shared") > 1, F.lit(name))
            for f, name in (("email", "email"), ("phone", "phone"), ("contactName", "contact"))
        ]
    )
    conflicts = _joined(
        [F.when(F.col(f"{f}_values") > 1, F.lit(f)) for f in fixed.UNIFIED_FIELDS]
    )
    columns = []
    for f in fixed.UNIFIED_FIELDS:
        columns.append(F.col(f"{f}_best.offer.value").alias(f))
        columns.append(F.col(f"{f}_best.offer.node").alias(f"{f}_node"))
    return wide.select(
        "root",
        "member_count",
        *columns,
        (F.floor((F.lit(0.5) + F.lit(0.1) * agreement) * 10000 + 0.5) / 10000.0).alias("confidence"),
        F.concat(
            F.col("member_count").cast("string"),
            F.lit(" records share "),
            keys,
            F.lit("; conflicting: "),
            F.coalesce(F.nullif(conflicts, F.lit("")), F.lit("none")),
        ).alias("reasoning"),
    )


def merge_single(single: DataFrame) -> DataFrame:
    """A record that links to nothing is its own entity; no shuffle needed."""
    columns = []
    for f in fixed.UNIFIED_FIELDS:
        columns += [F.col(f), F.col("node").alias(f"{f}_node")]
    return single.select(
        "root",
        F.lit(1).cast("long").alias("member_count"),
        *columns,
        F.lit(1.0).alias("confidence"),
        F.concat(F.lit("Single record from source "), "source").alias("reasoning"),
    )


def merge(
    resolved: DataFrame,
    n_records: int,
    priority: Mapping[str, int] | None = None,
    heavy_rows: int | None = None,
    tags: SourceTags = DEFAULT_TAGS,
) -> DataFrame:
    """One row per entity: values, the node each value came from, confidence, reasoning."""
    priority = tags.priority if priority is None else priority
    linked = skew.split_heavy(resolved.where("linked"), "root", n_records, heavy_rows)
    parts = [merge_linked(part, priority) for part in linked if part is not None]
    parts.append(merge_single(resolved.where("not linked")))
    merged = reduce(DataFrame.unionByName, parts)
    return merged.withColumn("entity_id", node_record_id(F.col("root"), tags))


def entities(merged: DataFrame) -> DataFrame:
    return merged.select("entity_id", *fixed.UNIFIED_FIELDS, "confidence", "reasoning")


def provenance_array(tags: SourceTags = DEFAULT_TAGS) -> Column:
    """The five ``(field, source, value)`` entries of an entity, in field order."""
    return F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                node_source(F.col(f"{f}_node"), tags).alias("source"),
                F.col(f).alias("value"),
            )
            for f in fixed.UNIFIED_FIELDS
        ]
    )


def field_provenance(merged: DataFrame, tags: SourceTags = DEFAULT_TAGS) -> DataFrame:
    return merged.select("entity_id", F.inline(provenance_array(tags)))


def entity_members(resolved: DataFrame, tags: SourceTags = DEFAULT_TAGS) -> DataFrame:
    """Membership rows, each once."""
    rows = resolved.select(
        node_record_id(F.col("root"), tags).alias("entity_id"), F.col("id").alias("record_id")
    )
    return rows.dropDuplicates(["entity_id", "record_id"])


def field_winners(merged: DataFrame, tags: SourceTags = DEFAULT_TAGS) -> DataFrame:
    """Winner per entity and field, in long form, with the record it came from."""
    won = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                node_source(F.col(f"{f}_node"), tags).alias("source"),
                node_record_id(F.col(f"{f}_node"), tags).alias("record_id"),
                F.col(f).alias("value"),
            )
            for f in fixed.UNIFIED_FIELDS
        ]
    )
    return merged.select("entity_id", F.inline(won))
