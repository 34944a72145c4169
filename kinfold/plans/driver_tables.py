"""The three sources, derived from the customer, supplier and orders tables.

The column expressions are SQL text that means the same in Spark and in an ANSI engine, so that
results can be checked side by side. ``e`` is the true entity: for scoring only, never for linking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import fixed_values as fixed

FIRST = "Dana,Priya,Arthur,Milton,Grace,Ravi,Pilar,Lucius,Nadia,Oren"
LAST = "Marsh,Raman,Olsen,Frye,Okoro,Chand,Vega,Foxley,Reed,Tamm"
NOUN = "Robotics,Traders,Foods,Health,Freight,Media,Energy,Capital"
ENDING = "| Inc|, Inc.| LLC| Corp| Group"
STATE = "CA,California,Calif.,NY,New York,TX,Tex.,WA,Washington,IL"

# source -> (table, row key, entity)
BINDINGS = {
    "A": ("customer", "c_custkey", "(c_custkey - case when c_custkey % 5 = 4 then 1 else 0 end)"),
    "B": ("supplier", "s_suppkey", "(s_suppkey * 3)"),
    "C": ("orders", "o_orderkey", "o_custkey"),
}


def _pick(words: str, index: str, separator: str = ",") -> str:
    return f"split_part('{words}', '{separator}', cast({index} as int) + 1)"


def fragment_columns(source: str) -> dict[str, str]:
    """Column name -> SQL expression of one source's rows over its driver table."""
    _, k, e = BINDINGS[source]
    first, last = _pick(FIRST, f"{e} % 10"), _pick(LAST, f"floor({e} / 10) % 10")
    area = f"cast(200 + {e} % 700 as string)"
    line = f"lpad(cast({e} + case when {k} % 11 = 0 then 5000000 else 0 end as string), 7, '0')"
    front, back = f"substr({line}, 1, 3)", f"substr({line}, 4, 4)"
    full = f"{first} || ' ' || {last}"
    initial = f"substr({first}, 1, 1)"
    short = f"when {k} % 3 = 0 then {initial} || '. ' || {last}" if source == "C" else ""
    state = _pick(STATE, f"({e} + case when {k} % 19 = 0 then 3 else 0 end) % 10")
    return {
        "ordinal": k,
        "e": e,
        "company": f"'Firm' || cast({e} - {e} % 3 as string) || ' ' || "
        + _pick(NOUN, f"floor({e} / 3) % 8")
        + " || "
        + _pick(ENDING, f"{k} % 6", "|"),
        "contact": f"case when {k} % 7 = 0 then lower({full}) {short} else {full} end",
        "phone": f"case when {k} % 13 = 5 then '' else case {k} % 5"
        f" when 0 then '(' || {area} || ') ' || {front} || '-' || {back}"
        f" when 1 then {area} || '.' || {front} || '.' || {back}"
        f" when 2 then {area} || {line}"
        f" when 3 then '+1 ' || {area} || '-' || {front} || '-' || {back}"
        f" else '1-' || {area} || '-' || {front} || '-' || {back} end end",
        "email": f"case when {k} % 17 = 3 then ' ' else case when {k} % 4 = 0 then upper({first})"
        f" else {initial} end || '.' || {last} || cast({e} as string)"
        f" || '@firm' || cast({e} as string) || '.example.com' end",
        "state": ("'Springfield, ' || " if source == "C" else "") + state,
    }


def spread(df: DataFrame) -> DataFrame:
    """Over all cores, if the scan has fewer splits than cores (small files); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fragments(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """Rows of one source under neutral column names, with the truth label."""
    table, key, _ = BINDINGS[source]
    columns = fragment_columns(source)
    used = [key] + ["o_custkey"] * (source == "C")
    rows = spread(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*used))
    return rows.selectExpr(*[f"{sql} as {name}" for name, sql in columns.items()])


NEUTRAL = {"company": "company", "contactName": "contact", "email": "email", "phone": "phone", "state": "state"}


def raw_source(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """Rows of one source under that source's own column names."""
    named = [
        F.col(NEUTRAL[field]).alias(column)
        for column, field in fixed.DEFAULT_MAPPINGS[source].items()
    ]
    return fragments(spark, sf_dir, source).select("ordinal", *named)


def raw_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {s: raw_source(spark, sf_dir, s) for s in BINDINGS}
