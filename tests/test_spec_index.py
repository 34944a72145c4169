"""Counts by the predicate index against one plan per spec."""

import random

import pytest
from pyspark.sql import functions as F

from kinfold.functions import fixed_values as fixed
from kinfold.operators import spec_index
from kinfold.operators.query import Filter, QuerySpec, run_spec
from kinfold.operators.spec_index import SPEC_TABLE, count_spec_table, dyadic

COLUMNS = "entity_id string, company string, contactName string, email string, phone string, state string, confidence double"
WORDS = ["", "a", "A", "b", "B%", "a_", "ab", "é", "\\", "b\\", "Ab", "zz"]


@pytest.fixture(scope="module")
def entities(spark):
    rng = random.Random(2)
    rows = []
    for i in range(150):
        texts = [rng.choice([*WORDS, None]) for _ in range(5)]
        rows.append((f"A{i}", *texts, rng.choice([0.5, 0.75, 0.9, 0.9001, 1.0, None])))
    return spark.createDataFrame(rows, COLUMNS).cache()


def made_up(rng):
    filters = []
    for _ in range(rng.randrange(4)):
        column = rng.choice(fixed.QUERY_COLUMNS)
        numbers = ["0.75", " 0.9 ", "0.9001", "high", "", "1", "0x1", "2"]
        value = rng.choice(numbers if column == "confidence" else WORDS)
        filters.append((column, rng.choice(fixed.QUERY_OPERATORS), value))
    return filters


def test_like_single_specs(spark, entities):
    rng = random.Random(4)
    specs = {f"q{i}": made_up(rng) for i in range(220)}
    got = {r.question: r["count"] for r in count_spec_table(entities, spark.createDataFrame(list(specs.items()), SPEC_TABLE)).collect()}
    index = spec_index.SpecIndex({q: QuerySpec("count", tuple(Filter(*f) for f in fs)) for q, fs in specs.items()})
    assert index.entries and index.unindexed and index.unanswerable and len(index.bounds) >= 4
    want = {}
    for question, filters in specs.items():
        spec = QuerySpec("count", tuple(Filter(*f) for f in filters))
        want[question] = run_spec(entities, spec).first()[0]
    assert got == want


def test_blocks_and_empty_tables(spark, entities, monkeypatch):
    monkeypatch.setattr(spec_index, "BLOCK_SPECS", 2)
    specs = [(f"q{i}", [("company", "LIKE", w)]) for i, w in enumerate(WORDS[1:6])] + [("all", []), ("none", None)]
    table = spark.createDataFrame(specs, SPEC_TABLE)
    got = {r.question: r["count"] for r in count_spec_table(entities, table).collect()}
    assert got["all"] == got["none"] == 150 and got["q0"] == run_spec(entities, QuerySpec("count", (Filter("company", "LIKE", "a"),))).first()[0]
    assert count_spec_table(entities, table.limit(0)).collect() == []
    one = spark.createDataFrame([("s", [("state", "=", "a")]), ("r", [("confidence", ">", "0")])], SPEC_TABLE)
    assert {r.question: r["count"] for r in count_spec_table(entities.limit(0), one).collect()} == {"s": 0, "r": 0}


@pytest.mark.parametrize("rows", [
    [("q", [("zipcode", "=", "1")])], [("q", [("state", "in", "1")])], [("q", [("state", "=", None)])], [("q", []), ("q", [])],
])
def test_refused_tables(spark, entities, rows):
    with pytest.raises(ValueError):
        count_spec_table(entities, spark.createDataFrame(rows, SPEC_TABLE))


def test_plain_searches_need_no_pattern():
    assert spec_index.predicate(Filter("phone", "LIKE", "A1")) == ("phone", "HAS", "a1", None)
    assert spec_index.predicate(Filter("phone", "LIKE", "")) == ("phone", "HAS", "", None)
    assert spec_index.predicate(Filter("company", "LIKE", "B%_\\")) == ("company", "LIKE", "%b%_\\\\%", None)
    assert spec_index.predicate(Filter("confidence", ">", "0.5")) == ("confidence", ">", "0.5", 0.5)


def test_dyadic_intervals_cover_exactly():
    for low in range(20):
        for high in range(low - 1, 40):
            cells = [c for level, node in dyadic(low, high) for c in range(node << level, (node + 1) << level)]
            assert cells == list(range(low, high + 1)) and len(dyadic(low, high)) <= 11


def test_rows_are_read_once(spark, entities):
    specs = [(f"q{i}", [("state", "=", WORDS[i % 12]), ("confidence", ">=", f"0.{i:04d}")]) for i in range(2000)]
    specs += [(f"r{i}", [("confidence", "<", f"0.{i:04d}")]) for i in range(3000)]
    counts = count_spec_table(entities, spark.createDataFrame(specs, SPEC_TABLE))
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") <= 1
    total = entities.where("state is not null and confidence >= 0.1").count()
    assert counts.where("question like 'q%'").agg(F.sum("count")).first()[0] > total
