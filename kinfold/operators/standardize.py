"""From raw rows of any source to standard records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions import fixed_values as fixed
from kinfold.functions import standard
from kinfold.functions.tags import DEFAULT_TAGS, SourceTags

# A record's node number: its source's place in the load order above its ordinal. Node order is
# load order, and a node converts back to its record id without a join.
ORDINAL_BITS = 52


def node_number(source: Column, ordinal: Column, tags: SourceTags = DEFAULT_TAGS) -> Column:
    """Fails the run on an ordinal that is null, negative or has over ``ORDINAL_BITS`` bits."""
    place = F.array_position(F.array(*[F.lit(s) for s in tags.tags]), source)
    ordinal = ordinal.cast("long")
    unfit = F.raise_error(F.concat(F.lit("unfit ordinal: "), F.coalesce(ordinal.cast("string"), F.lit("null"))))
    node = F.shiftleft(place, ORDINAL_BITS).bitwiseOR(ordinal)
    return F.when(ordinal.between(0, (1 << ORDINAL_BITS) - 1), node).otherwise(unfit.cast("long"))


def node_source(node: Column, tags: SourceTags = DEFAULT_TAGS) -> Column:
    place = F.shiftright(node, ORDINAL_BITS).cast("int")
    return F.element_at(F.array(*[F.lit(s) for s in tags.tags]), place)


def node_record_id(node: Column, tags: SourceTags = DEFAULT_TAGS) -> Column:
    ordinal = node.bitwiseAND(F.lit((1 << ORDINAL_BITS) - 1))
    return F.concat(node_source(node, tags), ordinal.cast("string"))


def raw_map(columns: Sequence[str]) -> Column:
    """The source's own columns, verbatim, as one string map."""
    return F.create_map(
        *[x for c in columns for x in (F.lit(c), standard.filled(F.col(f"`{c}`").cast("string")))]
    )


def raw_fields(
    raw: DataFrame,
    source: str,
    mapping: Mapping[str, str] | None = None,
    ordinal: str = "ordinal",
    tags: SourceTags = DEFAULT_TAGS,
) -> DataFrame:
    """Keys, raw payload and the mapped raw value of each canonical field ("" if unmapped)."""
    if source not in tags:
        raise ValueError(f"unknown source: {source}")
    mapping = fixed.DEFAULT_MAPPINGS[source] if mapping is None else mapping
    by_field = {field: column for column, field in mapping.items()}

    def mapped(field: str) -> Column:
        value = F.col(f"`{by_field[field]}`") if field in by_field else F.lit("")
        return value.cast("string").alias(field)

    number = F.col(ordinal).cast("long")
    return raw.select(
        node_number(F.lit(source), number, tags).alias("node"),
        F.concat(F.lit(source), number.cast("string")).alias("id"),
        F.lit(source).alias("source"),
        number.alias("ordinal"),
        raw_map([c for c in raw.columns if c != ordinal]).alias("raw"),
        *[mapped(f) for f in fixed.UNIFIED_FIELDS],
    )


def standard_fields(rows: DataFrame) -> DataFrame:
    """Standard values in place of the raw ones, with the block key.

    ``canonical`` keeps the company's significant words, which blocking and merging compare. It is
    projected in steps, so that no regex runs twice on a value.
    """
    standard_values = [standard.STANDARDISERS[f](F.col(f)).alias(f) for f in fixed.UNIFIED_FIELDS]
    canonical = standard.canonical_company(F.col("company"))
    block_key = standard.block_key_of(F.col("canonical"), F.col("email"))
    return (
        rows.select("node", "id", "source", "ordinal", "raw", *standard_values)
        .withColumn("canonical", canonical)
        .withColumn("block_key", block_key)
    )


def standardize(
    raw: DataFrame,
    source: str,
    mapping: Mapping[str, str] | None = None,
    ordinal: str = "ordinal",
    tags: SourceTags = DEFAULT_TAGS,
) -> DataFrame:
    """Standard records of one source."""
    return standard_fields(raw_fields(raw, source, mapping, ordinal, tags))


def standardize_all(
    raws: Mapping[str, DataFrame],
    mappings: Mapping[str, Mapping[str, str]] | None = None,
    tags: SourceTags = DEFAULT_TAGS,
) -> DataFrame:
    """Standard records of all sources, in one bag."""
    mappings = fixed.DEFAULT_MAPPINGS if mappings is None else mappings
    parts = [raw_fields(df, tag, mappings[tag], tags=tags) for tag, df in raws.items()]
    return standard_fields(reduce(DataFrame.unionByName, parts))


def raw_to_json(records: DataFrame) -> DataFrame:
    return records.withColumn("raw_json", F.to_json("raw")).drop("raw")


def raw_from_json(stored: DataFrame) -> DataFrame:
    return stored.withColumn("raw", F.from_json("raw_json", "map<string,string>")).drop("raw_json")


def upsert_latest(records: DataFrame, key: str, version: str, within: Sequence[str] = ()) -> DataFrame:
    """One row per key: that of the highest version, null the lowest; of rows alike in both, the one with
    the greatest contents, column by column, nulls lowest. Rows without a key replace nothing and all stay.

    The order is total, so the result does not depend on the order of rows or loads. Every task keeps its
    own first row of a key before the rows move. ``within``: columns that follow from the key and by which the
    rows lie together already, so that they do not move.
    """
    others = [
        F.sort_array(F.map_entries(F.col(f"`{name}`"))) if kind.startswith("map<") else F.col(f"`{name}`")
        for name, kind in records.dtypes
        if name not in (key, version, *within)
    ]
    own = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    order = [c.desc_nulls_last() for c in (F.col(version), *others)]
    ranked = records.withColumn("_own", own).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*within, key, "_own").orderBy(*order))
    )
    return ranked.where("_rank = 1").drop("_own", "_rank")
