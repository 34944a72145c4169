"""SimHash near-duplicates through pivot distance tables.

Every distinct fingerprint gets its Hamming distances to ``REFERENCES``, kept per quarter of the 64
bits: one long of packed distances for each quarter. Two fingerprints that differ in at most two bits
agree in at least two of the four quarters, so they have the same distances there. Candidates are the
pairs that meet under one of the six pairs of quarters; those whose distance to any reference differs
by more than the bound are discarded, and the bits of the rest are compared.

A table entry that more than ``crowd`` fingerprints share lists no pairs. Its members are instead
named by their one-bit neighbours: two fingerprints are within two bits exactly if they share a point
at most one bit from each, so pointing all at the smallest that names the same point links them all.
At most 65 fingerprints can name one point, whatever the size of the crowd.

Defined results: null or empty texts, and texts without words, have fingerprint zero and link like
any other; repeated rows have one row each; a null id never becomes a component's id unless all are
null; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import WORD, is_heavy, lookup, map_batches, row_digest, staged, strings, unused
from kinfold.operators.clustering import connected_components
from kinfold.operators.workspace import Workspace

WORDS = re.compile(WORD)
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
SEED = 42
MAX_BITS = 2
QUARTERS = 4
QUARTER_BITS = 16
PAIRS = tuple(combinations(range(QUARTERS), QUARTERS - MAX_BITS))
#: Fingerprints of hashed counters; twelve distances of five bits fill a long.
REFERENCES = tuple(xxhash.xxh64_intdigest(f"reference {i}", SEED) for i in range(12))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str, shingle: int) -> int:
    """Majority of each bit over the hashes of all word shingles, repeats included; signed."""
    words = WORDS.findall(text.translate(ASCII_LOWER) if not text.islower() else text)
    if not words:
        return 0
    runs = zip(*(words[k:] for k in range(shingle))) if len(words) >= shingle else (words,)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(x, SEED) for x in map(" ".join, runs)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int32)
    majority = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(majority.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int, carried: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id, fp`` (a signed long) and the carried columns, longs as well."""
    names = ["doc_id", *(carried or {})]
    schema = pa.schema([(n, pa.int64()) for n in [*names, "fp"]])

    def work(batch):
        fps = pa.array([fingerprint(t, shingle) for t in strings(batch.column("text"))], pa.int64())
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), fps], schema=schema)

    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[c.alias(n) for n, c in (carried or {}).items()],
        F.col("text").alias("text"),
    )
    return map_batches(source, lambda: work, ", ".join(f"{n} long" for n in [*names, "fp"]))


def quarter(fp: Column, q: int) -> Column:
    return fp.bitwiseAND(F.lit(signed(0xFFFF << QUARTER_BITS * q)))


def distance_table(fps: DataFrame) -> DataFrame:
    """``fp`` with ``d0`` to ``d3``: its distances to all references within each quarter, packed."""
    columns = []
    for q in range(QUARTERS):
        packed = None
        for r, reference in enumerate(REFERENCES):
            part = signed(reference & 0xFFFF << QUARTER_BITS * q)
            d = F.shiftleft(F.bit_count(quarter(F.col("fp"), q).bitwiseXOR(F.lit(part))).cast("long"), 5 * r)
            packed = d if packed is None else packed.bitwiseOR(d)
        columns.append(packed.alias(f"d{q}"))
    return fps.select("fp", *columns)


def coordinate(side: str, r: int) -> Column:
    """Distance to reference ``r``, from the packed distances of the quarters."""
    return sum(F.shiftright(F.col(f"{side}.d{q}"), 5 * r).bitwiseAND(F.lit(31)) for q in range(QUARTERS))


def links(fps: DataFrame, crowd: int) -> DataFrame:
    """``(u, v)``, ``v < u``: enough links to connect all fingerprints within ``MAX_BITS``."""
    table = distance_table(fps)
    entry = F.inline(
        F.array(
            *[
                F.struct(F.lit(k).alias("k"), F.col(f"d{a}").alias("x"), F.col(f"d{b}").alias("y"))
                for k, (a, b) in enumerate(PAIRS)
            ]
        )
    )
    entries = table.select("fp", *[f"d{q}" for q in range(QUARTERS)], entry)
    shared = entries.groupBy("k", "x", "y").agg(F.count("*").alias("n")).where("n > 1")
    # both sides are dealt by the table entry; adaptive execution splits an entry that is too large
    met = staged(entries.join(shared, ["k", "x", "y"]), "entries")
    few = met.where(F.col("n") <= crowd)
    a, b = few.alias("a"), few.alias("b")
    near = (F.col("a.k") == F.col("b.k")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y"))
    near = near & (F.col("a.fp") > F.col("b.fp"))
    for r in range(len(REFERENCES)):
        near = near & (F.abs(coordinate("a", r) - coordinate("b", r)) <= MAX_BITS)
    verified = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= MAX_BITS
    pairs = a.join(b, near & verified).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))

    crowded = met.where(F.col("n") > crowd).select("fp").distinct()
    points = [F.lit(0).cast("long"), *[F.lit(signed(1 << i)) for i in range(64)]]
    named = crowded.select("fp", F.explode(F.transform(F.array(*points), lambda m: F.col("fp").bitwiseXOR(m))).alias("p"))
    least = named.groupBy("p").agg(F.min("fp").alias("v"), F.max("fp").alias("last")).where("v < last")
    stars = named.join(least.select("p", "v"), "p").where("fp > v").select(F.col("fp").alias("u"), "v")
    return pairs.unionByName(stars).distinct()


def components(fps: DataFrame, crowd: int = 64) -> DataFrame:
    """``(fp, component)`` of the distinct fingerprints that link to another one."""
    edges = links(fps, crowd)
    return connected_components(edges, Workspace(fps.sparkSession)).select(
        F.col("node").alias("fp"), F.col("root").alias("component")
    )


def by_component(fps: DataFrame, crowd: int) -> DataFrame:
    """Distinct fingerprints with ``component`` and ``heavy``, whether very many rows share it."""
    distinct = staged(fps.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")), "distinct")
    rows = distinct.agg(F.sum("n")).first()[0] or 0
    linked = components(distinct.select("fp"), crowd)
    joined = distinct.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    return joined.withColumn("heavy", is_heavy(F.col("n"), rows))


def near_duplicates(docs: DataFrame, shingle: int = 3, crowd: int = 64) -> DataFrame:
    """``doc_id, fingerprint`` (hex) and ``component_id``, the smallest id of all documents reachable
    over fingerprints within two bits."""
    fps = staged(fingerprints(docs, shingle), "fingerprints")
    classes = staged(by_component(fps, crowd), "classes")
    smallest = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = staged(classes.join(smallest, "component").select("fp", "heavy", "component_id"), "class-ids")
    return lookup(fps, ids, "fp", "component_id").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, shingle: int = 3, crowd: int = 64) -> DataFrame:
    """One row of each group: the smallest id, null ids last; all columns kept. Of rows that are alike
    in every column one stays."""
    place = unused(docs, "place")
    # a row is known by two digests of all its columns
    digests = [unused(docs, "row_digest"), unused(docs, "other_digest")]
    own = [row_digest(docs), row_digest(docs, 1)]
    fps = staged(fingerprints(docs, shingle, {"digest": own[0], "other": own[1]}), "fingerprints")
    classes = staged(by_component(fps.select("doc_id", "fp"), crowd), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "digest", "other")
    # combined per fingerprint before the classes join, so a hot one is moved as one row
    leads = fps.groupBy("fp").agg(F.min(order).alias("lead"))
    kept = (
        leads.join(classes.select("fp", "component"), "fp")
        .groupBy("component")
        .agg(F.min("lead").alias("lead"))
        .select(F.col("lead.digest").alias(digests[0]), F.col("lead.other").alias(digests[1]))
        .distinct()
    )
    kept = staged(kept, "kept-rows")
    joined = docs.withColumns(dict(zip(digests, own))).join(kept, digests)
    once = F.row_number().over(Window.partitionBy(*digests).orderBy(digests[0]))
    return joined.withColumn(place, once).where(F.col(place) == 1).select(*[f"`{c}`" for c in docs.columns])
