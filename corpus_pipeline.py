"""The corpus pipeline: five stages, each written and read again as the next one's documents.

1. toxicity: texts that the classifier rejects go; it is fitted on the run's own documents and labels.
2. SimHash near-duplicates: of each group the document of the smallest id stays.
3. benchmark decontamination: texts that hold a test item go.
4. mixing: sources are weighted by temperature; every text is used at least once, small sources up to
   ``MAX_REPEATS`` times.
5. sharding: a global shuffle into ``SHARDS`` shards, with ``shard`` and ``slot`` added.

All columns of documents are kept; any named ``shard`` or ``slot`` go on as ``shard_`` and ``slot_``. Nulls and empty texts pass as the operators define; an empty table
passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm import decontaminate, mixing, sharding, simhash, toxicity
from kinfold.llm.common import staged, table, unused

SHARDS = 40
TARGET_ENTROPY = 0.95
MAX_REPEATS = 2.0


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_rows(docs, TARGET_ENTROPY, MAX_REPEATS)


def shard_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    for name in [c for c in docs.columns if c.lower() in ("shard", "slot")]:
        docs = docs.withColumnRenamed(name, unused(docs, name))
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard_documents),
]
#: The stages fit models and shuffle at random, which SQL can't express; tests/llm compares instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
