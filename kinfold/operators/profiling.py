"""What the columns of each source hold, which canonical field each maps to, and the joint schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import fixed_values as fixed
from kinfold.functions import standard

LETTER = r"\p{L}"
VALUE_WEIGHT, NAME_WEIGHT, LEAST_SCORE = 0.6, 0.4, 0.3
RATE_OF_FIELD = {
    "company": "name_rate",
    "contactName": "name_rate",
    "email": "email_rate",
    "phone": "phone_rate",
    "state": "state_rate",
}


def column_profile(records: DataFrame) -> DataFrame:
    """Per source and raw column: fill, distinct values, mean length and share of each shape.

    Equal values are counted first, by a 128-bit digest and what the detectors say of them, so that
    no text is shuffled; the last aggregation, which has a handful of groups, combines map-side.
    """
    values = records.select("source", F.explode("raw").alias("column_name", "value"))
    value = F.col("value")
    probed = values.select(
        "*",
        standard.is_state_code(standard.state(value)).alias("known_state"),
        F.length(F.regexp_replace(value, "[^0-9]", "")).alias("digits"),
        value.rlike(LETTER).alias("has_letter"),
    )
    has_letter, known_state = F.col("has_letter"), F.col("known_state")
    detected = probed.select(
        "source",
        "column_name",
        F.xxhash64(value).alias("h1"),
        F.xxhash64(value, F.lit(1)).alias("h2"),
        F.length(value).alias("length"),
        (standard.trim_space(value) != "").alias("is_filled"),
        standard.email(value).rlike(fixed.EMAIL_SHAPE).alias("email"),
        (F.col("digits").between(10, 11) & ~has_letter).alias("phone"),
        known_state.alias("state"),
        F.lower(value).rlike(standard.SUFFIX_PATTERN).alias("suffix"),
        (has_letter & ~value.contains("@") & ~known_state).alias("name"),
    )
    shapes = ("email", "phone", "state", "suffix", "name")
    counted = detected.groupBy("source", "column_name", "h1", "h2", "length", "is_filled", *shapes).agg(
        F.count("*").alias("n")
    )
    filled_rows = F.sum(F.when(F.col("is_filled"), F.col("n")).otherwise(0))

    def rate(shape: str) -> Column:
        hits = F.sum(F.when(F.col("is_filled") & F.col(shape), F.col("n")).otherwise(0))
        share = F.when(filled_rows == 0, 0.0).otherwise(
            hits.cast("double") / filled_rows.cast("double")
        )
        return share.alias(f"{shape}_rate")

    total_length = F.sum(F.col("length") * F.col("n")).cast("double")
    return counted.groupBy("source", "column_name").agg(
        F.sum("n").alias("n_rows"),
        filled_rows.alias("n_filled"),
        F.count_if("is_filled").alias("n_distinct"),
        (total_length / F.sum("n").cast("double")).alias("avg_length"),
        *[rate(s) for s in shapes],
    )


def name_words(column: Column) -> Column:
    """Lower-case words of a column name, split on case changes and non-letters."""
    spaced = F.regexp_replace(column, "([a-z])([A-Z])", "$1 $2")
    return F.split(F.lower(F.regexp_replace(spaced, "[^A-Za-z]+", " ")), " ")


def field_mapping(profile: DataFrame) -> DataFrame:
    """Best canonical field of each raw column, or null: by its values first, then by its name."""
    words = name_words(F.col("column_name"))
    options = []
    for order, (field, rate) in enumerate(RATE_OF_FIELD.items()):
        hints = F.array(*[F.lit(w) for w in fixed.NAME_TOKENS[field]])
        named = F.arrays_overlap(words, hints).cast("double")
        score = F.lit(VALUE_WEIGHT) * F.col(rate) + F.lit(NAME_WEIGHT) * named
        options.append(
            F.struct(score.alias("score"), F.lit(-order).alias("order"), F.lit(field).alias("field"), named.alias("named"))
        )
    best = profile.select(
        "source", F.col("column_name").alias("source_field"), F.array_max(F.array(*options)).alias("best")
    )
    fits = F.col("best.score") >= LEAST_SCORE
    note = (
        F.when(~fits, "no match")
        .when(F.col("best.named") == 0, "by values")
        .when(F.col("best.score") > NAME_WEIGHT, "by values and name")
        .otherwise("by name")
    )
    return best.select(
        "source",
        "source_field",
        F.when(fits, F.col("best.field")).alias("unified_field"),
        F.col("best.score").alias("score"),
        note.alias("note"),
    )


def mapping_by_source(mapping: DataFrame) -> dict[str, dict[str, str]]:
    """Mapping rows as ``{source: {raw column: field}}``; the best-scoring column wins a field.

    One row per raw column of each source: catalogue-sized, whatever the data size.
    """
    rows = mapping.where(F.col("unified_field").isNotNull()).orderBy("score", "source_field").collect()
    by_field: dict[str, dict[str, str]] = {}
    for row in rows:
        by_field.setdefault(row.source, {})[row.unified_field] = row.source_field
    return {s: {column: f for f, column in fields.items()} for s, fields in by_field.items()}


def unified_schema(profile: DataFrame, mapping: DataFrame) -> DataFrame:
    """Proposed schema: each mapped field with type, description, sources and fill rate."""
    columns = profile.select("source", F.col("column_name").alias("source_field"), "n_rows", "n_filled")
    mapped = mapping.where(F.col("unified_field").isNotNull()).join(columns, ["source", "source_field"])

    def described(place: int) -> Column:
        return F.coalesce(
            *[F.when(F.col("name") == f, F.lit(note[place])) for f, note in fixed.FIELD_NOTES.items()]
        )

    return (
        mapped.groupBy(F.col("unified_field").alias("name"))
        .agg(
            F.count_distinct("source").alias("n_sources"),
            (F.sum("n_filled").cast("double") / F.sum("n_rows").cast("double")).alias("fill_rate"),
        )
        .select("name", described(0).alias("type"), described(1).alias("description"), "n_sources", "fill_rate")
    )
