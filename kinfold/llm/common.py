"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators.workspace import Workspace

#: White space of the text contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors."""
    return Workspace(df.sparkSession).stage(df, name)


def strings(column: pa.Array) -> Iterator[str]:
    """The values one by one, null as the empty text, so that a batch is never held twice."""
    for value in column:
        yield value.as_py() or ""


def map_batches(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str
) -> DataFrame:
    """Apply a per-batch function, built once per task by ``make``."""

    def run(batches):
        work = make()
        for batch in batches:
            yield work(batch)

    return df.mapInArrow(run, schema)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def row_digest(df: DataFrame, *seed: int) -> Column:
    """A number that depends on every column of a row, nulls and their places included."""
    parts = [F.lit(s) for s in seed]
    for i, (name, kind) in enumerate(df.dtypes):
        c = F.col(f"`{name}`")
        parts += [F.when(c.isNull(), F.lit(i)), F.to_json(F.struct(c)) if "map<" in kind else c]
    return F.xxhash64(*parts)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of all ids that no model may learn labels from; null ids are not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def lookup(rows: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with ``value`` of the ``table(key, value, heavy)`` row that has their key; rows without
    one are dropped. Keys marked ``heavy``, at most ``HEAVY_KEYS``, are broadcast, so their rows stay
    where they are; the rest meet by key."""
    hot, found = unused(rows, "hot_value"), unused(rows, "is_hot")
    few = F.broadcast(
        table.where("heavy").select(key, F.col(value).alias(hot), F.lit(True).alias(found))
    )
    marked = rows.join(few, key, "left")
    columns = [f"`{c}`" for c in rows.columns]
    heavy = marked.where(F.col(found)).select(*columns, F.col(hot).alias(value))
    rest = marked.where(F.col(found).isNull()).select(*columns)
    light = table.where(~F.col("heavy")).select(key, value)
    return rest.join(light, key).select(*columns, value).unionByName(heavy)


#: Most keys that ``is_heavy`` can mark.
HEAVY_KEYS = 10_000


def is_heavy(n: Column, rows: int) -> Column:
    """Whether a key has over 10,000 of ``rows`` rows, and over one in ``HEAVY_KEYS``."""
    return n > max(10_000, rows // HEAVY_KEYS)
