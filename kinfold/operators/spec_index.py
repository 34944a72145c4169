"""Counts of thousands of specs in one scan, by an index over their predicates.

Every spec is entered under one of its predicates, its access: an equality under its value; else its range
on one column under the dyadic intervals that cover it, between the sorted bounds of all ranges of that
column. A row finds its place between the bounds by binary search and meets, in one hash join, the
entries of its values and of the intervals around its place; what else a spec asks is then checked on
the row. Specs that ask nothing else are not listed per row at all: rows are counted per entry. Specs
without an equality or a range (only LIKE and !=) are evaluated in blocks, one aggregate for each block.

The specs themselves, at most ``MAX_SPECS``, pass through the driver, which checks them as it does single
ones; rows of the table never do.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import standard
from kinfold.operators.query import ASCII_LOWER, Filter, QuerySpec, count_specs, numeric

MAX_SPECS = 100_000
#: Specs without an access that one aggregate evaluates.
BLOCK_SPECS = 100
#: Columns in the order in which they tell rows apart, best first.
ACCESS_COLUMNS = ("email", "phone", "contactName", "company", "confidence", "state")
RANGES = (">", ">=", "<", "<=")

SPEC_TABLE = "question string, filters array<struct<column:string,op:string,value:string>>"
PREDICATE = "struct<column:string,op:string,value:string,number:double>"
ENTRY = f"key string, alone boolean, specs array<struct<spec:int,rest:array<{PREDICATE}>>>"


def read_specs(table: DataFrame) -> dict[str, QuerySpec]:
    """Count specs from rows ``(question, filters)``, checked one by one."""
    rows = table.select("question", "filters").limit(MAX_SPECS + 1).collect()
    if len(rows) > MAX_SPECS:
        raise ValueError(f"over {MAX_SPECS} specs")
    specs = {r.question: QuerySpec("count", tuple(Filter(*f) for f in r.filters or ())) for r in rows}
    if len(specs) < len(rows):
        raise ValueError("a question is asked twice")
    return specs


def bound(f: Filter) -> float | bytes | None:
    """A filter's value in the order of its column: numbers, or the bytes of a text."""
    return numeric(f.value) if f.column == "confidence" else f.value.encode()


def is_range(f: Filter) -> bool:
    return f.op in RANGES or (f.op == "=" and f.column == "confidence")


class SpecIndex:
    """Which entries a row's values meet, and what is left to check there."""

    def __init__(self, specs: dict[str, QuerySpec]):
        self.questions = list(specs)
        self.unanswerable, self.unindexed = [], []
        self.entries: dict[str, list] = defaultdict(list)  # key -> (spec number, filters left)
        self.equal_columns: set[str] = set()
        self.bounds: dict[str, list] = {}
        ranged = []
        for number, spec in enumerate(specs.values()):
            if any(f.column == "confidence" and f.op != "LIKE" and numeric(f.value) is None for f in spec.filters):
                self.unanswerable.append(number)  # compared with no number: matches nothing
                continue
            access = self._access(spec)
            if access is None:
                self.unindexed.append(number)
            elif isinstance(access, Filter):
                self.equal_columns.add(access.column)
                left = [f for f in spec.filters if f is not access]
                self.entries[f"{access.column}={access.value}"].append((number, left))
            else:
                ranged.append((number, access, spec))
        for column in {c for _, c, _ in ranged}:
            asked = {bound(f) for _, c, spec in ranged if c == column for f in spec.filters if f.column == column and is_range(f)}
            self.bounds[column] = sorted(asked)
        for number, column, spec in ranged:
            used = [f for f in spec.filters if f.column == column and is_range(f)]
            left = [f for f in spec.filters if f not in used]
            for level, node in dyadic(*self._cells(column, used)):
                self.entries[f"{column}:{level}:{node}"].append((number, left))

    @staticmethod
    def _access(spec: QuerySpec) -> Filter | str | None:
        """The equality, or the column of a range, that a spec is entered under."""
        for column in ACCESS_COLUMNS:
            for f in spec.filters:
                if f.column == column and f.op == "=" and column != "confidence":
                    return f
        return next((c for c in ACCESS_COLUMNS if any(f.column == c and is_range(f) for f in spec.filters)), None)

    def _cells(self, column: str, filters: list[Filter]) -> tuple[int, int]:
        """First and last cell of a range: cell 2k + 1 is bound k itself, even ones lie between bounds."""
        bounds = self.bounds[column]
        low, high = 0, 2 * len(bounds)
        for f in filters:
            own = 2 * bisect_left(bounds, bound(f)) + 1
            low = max(low, {">": own + 1, ">=": own, "=": own}.get(f.op, low))
            high = min(high, {"<": own - 1, "<=": own, "=": own}.get(f.op, high))
        return low, high

    def levels(self, column: str) -> int:
        return (2 * len(self.bounds[column])).bit_length()

    def cells(self) -> dict[str, Column]:
        """A row's places between the bounds, one column each."""
        return {f"_cell_{c}": cell_of(c, bounds) for c, bounds in sorted(self.bounds.items())}

    def keys(self) -> Column:
        """All entries that a row's values, and its cells, may meet."""
        parts = [F.concat(F.lit(f"{c}="), F.col(c)) for c in sorted(self.equal_columns)]
        for column in sorted(self.bounds):
            cell = F.col(f"_cell_{column}")
            parts += [
                F.concat(F.lit(f"{column}:{level}:"), F.shiftright(cell, level).cast("string"))
                for level in range(self.levels(column) + 1)
            ]
        return F.array_compact(F.array(*parts))

    def folded(self) -> dict[str, Column]:
        """The lower-case texts that LIKE predicates of entries look at, one column each."""
        asked = {f.column for entered in self.entries.values() for _, left in entered for f in left if f.op == "LIKE"}
        return {f"_low_{c}": standard.fold_ascii(F.col(c).cast("string")) for c in sorted(asked)}

    def table(self, spark) -> DataFrame:
        """One row per entry: whether a spec asks nothing else, and the specs that do."""
        rows = []
        for key, entered in self.entries.items():
            more = [(n, [predicate(f) for f in left]) for n, left in entered if left]
            rows.append((key, len(more) < len(entered), more))
        return spark.createDataFrame(rows, ENTRY)

    def alone(self, spark) -> DataFrame:
        """``(key, spec)`` of the specs that ask nothing but their access."""
        rows = [(key, n) for key, entered in self.entries.items() for n, left in entered if not left]
        return spark.createDataFrame(rows, "key string, spec int")


def dyadic(low: int, high: int) -> list[tuple[int, int]]:
    """``(level, node)`` of the fewest aligned intervals of 2 ** level cells that make up low..high."""
    found = []
    while low <= high:
        level = 0
        while low % (2 << level) == 0 and low + (2 << level) - 1 <= high:
            level += 1
        found.append((level, low >> level))
        low += 1 << level
    return found


def cell_of(column: str, bounds: list) -> Column:
    """The cell of a value, by binary search; null for null."""
    numbers = column == "confidence"
    listed = F.array(*[F.lit(b if numbers else b.decode()) for b in bounds])
    value = F.col(column)
    steps = F.array(*[F.lit(1 << s) for s in range(len(bounds).bit_length() - 1, -1, -1)])

    def step(passed: Column, width: Column) -> Column:
        fits = F.coalesce(F.get(listed, passed + width - 1) <= value, F.lit(False))
        return F.when(fits, passed + width).otherwise(passed)

    not_above = F.aggregate(steps, F.lit(0), step)
    on_bound = F.coalesce(F.get(listed, not_above - 1) == value, F.lit(False))
    return F.when(value.isNotNull(), not_above * 2 - on_bound.cast("int"))


def predicate(f: Filter) -> tuple[str, str, str, float | None]:
    """A filter as data: ``(column, op, value, number)``. LIKE becomes HAS, a plain search, where its value
    has no wildcard."""
    if f.op != "LIKE":
        return f.column, f.op, f.value, numeric(f.value)
    value = f.value.translate(ASCII_LOWER)
    if not re.search(r"[%_\\]", value):
        return f.column, "HAS", value, None
    return f.column, "LIKE", "%" + value.replace("\\", "\\\\") + "%", None


def holds(p: Column, folded: Collection[str]) -> Column:
    """Whether a row satisfies a predicate given as data; ``folded`` are its columns of lower-case texts."""

    def compared(left: Column, right: Column) -> Column:
        return (
            F.when(p["op"] == "=", left == right)
            .when(p["op"] == "!=", left != right)
            .when(p["op"] == ">", left > right)
            .when(p["op"] == ">=", left >= right)
            .when(p["op"] == "<", left < right)
            .when(p["op"] == "<=", left <= right)
        )

    text = F.coalesce(*[F.when(p["column"] == c, F.col(c)) for c in ACCESS_COLUMNS if c != "confidence"])
    matched = F.when(p["column"] == "confidence", compared(F.col("confidence"), p["number"])).otherwise(
        compared(text, p["value"])
    )
    if folded:
        low = F.coalesce(*[F.when(p["column"] == c.removeprefix("_low_"), F.col(c)) for c in folded])
        matched = (
            F.when(p["op"] == "HAS", F.contains(low, p["value"]))
            .when(p["op"] == "LIKE", F.like(low, p["value"]))
            .otherwise(matched)
        )
    return F.coalesce(matched, F.lit(False))


def count_spec_table(entities: DataFrame, table: DataFrame) -> DataFrame:
    """``(question, count)`` of every row of a table of count specs."""
    spark, specs = entities.sparkSession, read_specs(table)
    index = SpecIndex(specs)
    questions = spark.createDataFrame(list(enumerate(index.questions)), "spec int, question string")
    parts = []
    if index.entries:
        columns = [F.col(c) for c in ACCESS_COLUMNS]
        folded = index.folded()
        placed = entities.select(*columns).withColumns(index.cells() | folded)
        met = placed.select(*columns, *folded, F.explode(index.keys()).alias("key")).join(
            F.broadcast(index.table(spark)), "key"  # of at most MAX_SPECS specs
        )
        kept = F.filter("specs", lambda s: F.forall(s["rest"], lambda p: holds(p, folded)))
        marks = F.concat(
            F.when(F.col("alone"), F.array(F.struct("key", F.lit(None).cast("int").alias("spec")))).otherwise(F.array()),
            F.transform(kept, lambda s: F.struct(F.lit(None).cast("string").alias("key"), s["spec"].alias("spec"))),
        )
        hits = met.select(F.inline(marks)).groupBy("key", "spec").agg(F.count("*").alias("n"))
        # at most one row per entry and spec from here on
        hits = hits.join(
            F.broadcast(index.alone(spark).withColumnRenamed("spec", "by_key")), "key", "left"
        )
        parts.append(hits.select(F.coalesce("spec", "by_key").alias("spec"), "n"))
    for at in range(0, len(index.unindexed), BLOCK_SPECS):
        block = index.unindexed[at : at + BLOCK_SPECS]
        counted = count_specs(entities, {str(n): specs[index.questions[n]] for n in block})
        parts.append(counted.select(F.col("question").cast("int").alias("spec"), F.col("count").alias("n")))
    if not parts:
        return questions.select("question", F.lit(0).cast("long").alias("count"))
    counts = reduce(DataFrame.unionByName, parts).groupBy("spec").agg(F.sum("n").alias("n"))
    found = questions.join(counts, "spec", "left")
    return found.select("question", F.coalesce("n", F.lit(0)).cast("long").alias("count"))
