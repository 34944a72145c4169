"""Reports over the fragmented records and the unified entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions import fixed_values as fixed
from kinfold.functions import standard
from kinfold.functions.tags import DEFAULT_TAGS, SourceTags
from kinfold.operators import merging, skew
from kinfold.operators.standardize import node_record_id, raw_from_json
from kinfold.operators.workspace import Workspace

# Members of one list.
LIST_ROWS = 1024


def member_lists(
    resolved: DataFrame,
    n_records: int,
    workspace: Workspace,
    heavy_rows: int | None = None,
    list_rows: int = LIST_ROWS,
    tags: SourceTags = DEFAULT_TAGS,
) -> DataFrame:
    """``(entity_id, part, n_parts, members)``: member ids in load order, ``list_rows`` to a list.

    Every entity is cut alike, whatever counts as heavy. Only the rows of entities with several lists
    are numbered, in one sort by entity and node that no entity's size unbalances.
    """
    rows = resolved.select("root", "node", "id")
    sizes = rows.groupBy("root").agg(F.count("*").alias("n"), F.count("*").alias("_rows"))
    sized = skew.lookup_join(rows, sizes, ["root"], "_rows", n_records, "inner", heavy_rows)
    several = sized.where(F.col("n") > list_rows)
    numbered = workspace.stage(skew.number_rows(several, ["root", "node"], workspace), "members")
    first = numbered.groupBy("root").agg(F.min("position").alias("first"), F.count("*").alias("_rows"))
    placed = skew.lookup_join(numbered, first, ["root"], "_rows", n_records, "inner", heavy_rows)
    part = F.floor((F.col("position") - F.col("first")) / list_rows)
    columns = ["root", "node", "id", "n"]
    parts = (
        sized.where(F.col("n") <= list_rows)
        .select(*columns, F.lit(0).cast("long").alias("part"))
        .unionByName(placed.select(*columns, part.cast("long").alias("part")))
    )
    return (
        parts.groupBy("root", "part", "n")
        .agg(F.sort_array(F.collect_list(F.struct("node", "id"))).alias("own"))
        .select(
            node_record_id(F.col("root"), tags).alias("entity_id"),
            "part",
            F.ceil(F.col("n") / list_rows).alias("n_parts"),
            F.col("own.id").alias("members"),
        )
    )


def unified_view(merged: DataFrame, tags: SourceTags = DEFAULT_TAGS) -> DataFrame:
    """Entities by company, with nested provenance: one row each, whatever their size. Their members
    are in ``member_lists``."""
    return merged.withColumn("provenance", merging.provenance_array(tags)).select(
        "entity_id",
        *fixed.UNIFIED_FIELDS,
        "confidence",
        "reasoning",
        "provenance",
        "member_count",
    ).orderBy("company", "entity_id")


def fragmented_view(stored: DataFrame) -> DataFrame:
    """Stored source records, raw payload parsed, by source and id."""
    return (
        raw_from_json(stored)
        .select("source", "id", "raw", *fixed.UNIFIED_FIELDS)
        .orderBy("source", "id")
    )


def entity_lineage(members: DataFrame, records: DataFrame) -> DataFrame:
    """Which raw records fed each entity."""
    fed = records.select(F.col("id").alias("record_id"), "source", "raw")
    return members.join(fed, "record_id")


def field_winner(provenance: DataFrame, entities: DataFrame, field: str) -> DataFrame:
    """Which source won one field of each entity."""
    won = provenance.where(F.col("field") == field)
    return won.join(entities.select("entity_id", "company"), "entity_id").select(
        "entity_id", "company", "source", "value"
    )


def provenance_wide(provenance: DataFrame) -> DataFrame:
    """One column per field with the source that won it."""
    return provenance.groupBy("entity_id").pivot("field", list(fixed.UNIFIED_FIELDS)).agg(F.min("source"))


def source_bits(source: Column, tags: SourceTags = DEFAULT_TAGS) -> Column:
    """One bit per source, of at most 62."""
    if len(tags.tags) > 62:
        raise ValueError("combinations of over 62 sources are not reported")
    return F.coalesce(
        *[F.when(source == s, F.lit(1 << i).cast("long")) for i, s in enumerate(tags.tags)], F.lit(0)
    )


def source_names(bits: Column, tags: SourceTags = DEFAULT_TAGS) -> Column:
    return F.concat_ws(
        "+",
        *[F.when(bits.bitwiseAND(F.lit(1 << i).cast("long")) > 0, F.lit(s)) for i, s in enumerate(tags.tags)],
    )


def source_overlap(resolved: DataFrame, tags: SourceTags = DEFAULT_TAGS) -> DataFrame:
    """How many entities each combination of sources shares."""
    per_entity = resolved.groupBy("root").agg(
        F.bit_or(source_bits(F.col("source"), tags)).alias("bits"), F.count("*").alias("n")
    )
    return per_entity.groupBy("bits").agg(
        F.count("*").alias("n_entities"), F.sum("n").alias("n_records")
    ).select(source_names(F.col("bits"), tags).alias("sources"), "n_entities", "n_records")


def run_summary(resolved: DataFrame, tags: SourceTags = DEFAULT_TAGS) -> DataFrame:
    """Counts of a run: records, records per source, entities (their root records)."""
    by_source = [
        F.count_if(F.col("source") == s).alias(f"records_{s.lower()}") for s in tags.tags
    ]
    entities = F.count_if(F.col("node") == F.col("root")).alias("unified_entities")
    return resolved.agg(F.count("*").alias("source_records"), *by_source, entities)


def field_conflicts(
    resolved: DataFrame, n_records: int, heavy_rows: int | None = None, tags: SourceTags = DEFAULT_TAGS
) -> DataFrame:
    """Distinct non-blank values, and who says so, of every field on which members disagree."""

    def values(records: DataFrame) -> DataFrame:
        pairs = F.array(
            *[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fixed.UNIFIED_FIELDS]
        )
        return (
            records.select("root", source_bits(F.col("source"), tags).alias("bits"), F.inline(pairs))
            .where("value <> ''")
            .groupBy("root", "field", "value")
            .agg(F.count("*").alias("n_records"), F.bit_or("bits").alias("bits"))
        )

    ordinary, heavy = skew.split_heavy(resolved.where("linked"), "root", n_records, heavy_rows)
    together = Window.partitionBy("root", "field")
    parts = [values(ordinary).withColumn("n_values", F.count("*").over(together))]
    if heavy is not None:
        found = values(heavy)
        counted = found.groupBy("root", "field").agg(F.count("*").alias("n_values"))
        counted = counted.withColumn("_rows", F.col("n_values"))
        left_rows = len(fixed.UNIFIED_FIELDS) * n_records
        parts.append(
            skew.lookup_join(found, counted, ["root", "field"], "_rows", left_rows, "inner", heavy_rows)
        )
    return reduce(DataFrame.unionByName, parts).where("n_values > 1").select(
        node_record_id(F.col("root"), tags).alias("entity_id"),
        "field",
        "value",
        "n_values",
        "n_records",
        source_names(F.col("bits"), tags).alias("sources"),
    )


def member_scores(
    resolved: DataFrame, merged: DataFrame, n_records: int, heavy_rows: int | None = None
) -> DataFrame:
    """Evidence for review: every linked record against its merged entity, linear in records."""
    golden = merged.select(
        "root",
        "entity_id",
        *[F.col(f).alias(f"won_{f}") for f in fixed.UNIFIED_FIELDS],
        standard.canonical_company(F.col("company")).alias("won_canonical"),
        F.col("member_count").alias("_rows"),
    )
    rows = resolved.where("linked").select(
        "root", F.col("id").alias("record_id"), *fixed.UNIFIED_FIELDS, "canonical"
    )
    paired = skew.lookup_join(rows, golden, ["root"], "_rows", n_records, "inner", heavy_rows)

    def same(f: str) -> Column:
        equal = merging.compared(f) == merging.compared(f, "won_")
        return (equal & (F.col(f) != "")).cast("int").alias(f"same_{f}")

    def words(canonical: str) -> Column:
        return F.array_distinct(F.array_remove(F.split(canonical, " "), ""))

    mine, won = words("canonical"), words("won_canonical")
    either = F.size(F.array_union(mine, won))
    return paired.select(
        "entity_id",
        "record_id",
        *[same(f) for f in fixed.UNIFIED_FIELDS],
        F.when(either == 0, 0.0)
        .otherwise(F.size(F.array_intersect(mine, won)).cast("double") / either.cast("double"))
        .alias("company_jaccard"),
        F.levenshtein(F.lower("contactName"), F.lower("won_contactName")).alias("name_distance"),
    )


def source_samples(records: DataFrame, rows: int = fixed.SAMPLE_ROWS) -> DataFrame:
    """The first rows of every source; each task keeps only its own first rows before the shuffle."""
    first = Window.partitionBy("source").orderBy("ordinal")
    return (
        records.select("source", "id", "ordinal", "raw")
        .withColumn("position", F.row_number().over(first))
        .where(F.col("position") <= rows)
        .drop("ordinal")
    )


# kind -> (text that every match contains, pattern); the possessive ++ keeps long words linear
CONTACT_PATTERNS = {
    "email": ("@", r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "phone": ("+1 (", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"),
}


# Phones as people write them: +1, 1 or neither in front, the area code in brackets or not, and a dot, a
# hyphen, a blank or nothing between the parts; no word character on either side.
_START, _END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_COUNTRY, _AREA = rf"(?:\+1|{_START}1)[-. ]?", r"[0-9]{3}[-. ]?"
_NUMBER = rf"[0-9]{{3}}[-. ]?[0-9]{{4}}{_END}"
PHONE_LAYOUTS = rf"(?:(?:{_COUNTRY})?\([0-9]{{3}}\)[-. ]?|(?:{_COUNTRY}|{_START}){_AREA}){_NUMBER}"


def phones_in_text(documents: DataFrame) -> DataFrame:
    """Phones of all layouts found in whole texts, leftmost first and not overlapping, in standard form:
    ``(value, n_mentions, n_documents, n_layouts)``."""
    found = F.regexp_extract_all("text", F.lit(PHONE_LAYOUTS), F.lit(0))
    numbers = F.when(F.col("text").rlike("[0-9]{4}"), found).otherwise(F.array().cast("array<string>"))
    each = documents.select("doc_id", F.explode(numbers).alias("found"))
    layout = F.regexp_replace("found", "[0-9]", "9")
    per_document = each.groupBy(standard.phone(F.col("found")).alias("value"), layout.alias("layout"), "doc_id").agg(
        F.count("*").alias("n")
    )
    # two levels, so that no value's documents meet in one task
    by_document = per_document.groupBy("value", "doc_id").agg(F.sum("n").alias("n"), F.collect_set("layout").alias("layouts"))
    return by_document.groupBy("value").agg(
        F.sum("n").alias("n_mentions"),
        F.count("*").alias("n_documents"),
        F.size(F.array_distinct(F.flatten(F.collect_set("layouts")))).alias("n_layouts"),
    )


def contacts_in_text(documents: DataFrame) -> DataFrame:
    """Standardised emails and phones found in whole texts, with how often each occurs."""

    def matches(kind: str) -> Column:
        needle, pattern = CONTACT_PATTERNS[kind]
        hits = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        hits = F.when(F.col("text").contains(needle), hits).otherwise(F.array().cast("array<string>"))
        return F.transform(hits, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("found")))

    found = F.concat(*[matches(kind) for kind in CONTACT_PATTERNS])
    value = F.when(F.col("kind") == "email", standard.email(F.col("found"))).otherwise(
        standard.phone(F.col("found"))
    )
    per_document = (
        documents.select("doc_id", F.inline(found))
        .groupBy("kind", value.alias("value"), "doc_id")
        .agg(F.count("*").alias("n"))
    )
    return per_document.groupBy("kind", "value").agg(
        F.sum("n").alias("n_mentions"), F.count("*").alias("n_documents")
    )


