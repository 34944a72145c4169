"""Sorted neighbourhood: pairs against brute force, borders of runs, and recall of the true entities."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kinfold.operators import neighbours
from kinfold.operators.standardize import standardize_all
from kinfold.plans import driver_tables
from tests.test_unify import as_records, made_up

SF = "/root/testdata/sf0.001"


def brute_force(plain, window):
    """Pairs of ids that are close in one of the orders."""
    rows = [r | {"canonical": r["canonical"]} for r in plain]
    orders = {
        "company": lambda r: r["canonical"] and f"{r['canonical']}|{r['contactName'].lower().split(' ')[-1]}|{r['contactName'].lower()}",
        "phone": lambda r: len(r["phone"]) == 12 and f"{r['phone']}|{r['canonical']}",
        "email": lambda r: "@" in r["email"] and f"{r['email'].split('@')[-1]}|{r['email'].split('@')[0]}",
    }
    found = defaultdict(set)
    for name, key in orders.items():
        order = sorted((key(r).encode(), r["source"], r["ordinal"], r["id"]) for r in rows if key(r))
        for i, a in enumerate(order):
            for b in order[i + 1 : i + window]:
                first, second = sorted((a, b), key=lambda x: x[1:3])
                found[first[3], second[3]].add(name)
    return {pair: "+".join(n for n in orders if n in names) for pair, names in found.items()}


@pytest.mark.parametrize("run_rows", [4, 7, 4096])
def test_pairs_like_brute_force(spark, workspace, run_rows):
    plain, df = as_records(spark, made_up(9, 160))
    canonical = {r.id: r.canonical for r in df.select("id", "canonical").collect()}
    want = brute_force([r | {"canonical": canonical[r["id"]]} for r in plain], 4)
    got = neighbours.neighbour_pairs(df.repartition(3), workspace, window=4, run_rows=run_rows).collect()
    assert {(r.first_id, r.second_id): r.orders for r in got} == want and len(got) == len(want)
    values = {r["id"]: r for r in plain}
    for r in got:
        a, b = values[r.first_id], values[r.second_id]
        assert r.same_email == (a["email"] == b["email"] != "") and 0 <= r.score <= 1
        assert r.same_contact == (a["contactName"].lower() == b["contactName"].lower() != "")


def test_one_value_for_all_records_stays_linear(spark, workspace):
    rows = [("A", i, "Hot Firm", "Ann Lee", "a@x.org", "+12125550100", "NY") for i in range(500)]
    _, df = as_records(spark, rows)
    pairs = neighbours.neighbour_pairs(df, workspace, window=5)
    assert pairs.count() == 4 * 500 - 10
    assert {r.score for r in pairs.select("score").distinct().collect()} == {1.0}


def test_pairs_are_compiled_and_equal_names_are_not_taken_apart(spark, workspace):
    _, df = as_records(spark, made_up(9, 40))
    rows = neighbours.sorted_rows(df, neighbours.sort_keys(), workspace)
    plan = neighbours.close_pairs(rows, 5, 4096)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
    names = [("", ""), (" ", " "), ("a b", "a b"), ("a b", "b c"), ("", "a"), (None, "a"), (None, None)]
    pairs = spark.createDataFrame([((x, "Ann"), (y, "ann")) for x, y in names], "a struct<canonical:string,contactName:string>, b struct<canonical:string,contactName:string>")
    found = neighbours.evidence()
    got = pairs.select(found["company_jaccard"], found["name_distance"]).collect()
    assert [r[0] for r in got[:5]] == [0.0, 0.0, 1.0, 1 / 3, 0.0] and {r[1] for r in got} == {0}


def test_recall_of_the_true_entities(spark, workspace):
    """Records joined by pairs of one entity: at least nine of ten records reach their entity's others."""
    records = standardize_all(driver_tables.raw_sources(spark, SF))
    parts = [
        driver_tables.fragments(spark, SF, s).select(F.concat(F.lit(s), F.col("ordinal").cast("string")).alias("id"), "e")
        for s in driver_tables.BINDINGS
    ]
    truth = {r.id: r.e for p in parts for r in p.collect()}
    pairs = neighbours.neighbour_pairs(records, workspace).collect()
    label = {i: i for i in truth}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    true = [r for r in pairs if truth[r.first_id] == truth[r.second_id]]
    for r in true:
        label[root(r.first_id)] = root(r.second_id)
    n_entities = len(set(truth.values()))
    reached = len(truth) - len({root(i) for i in truth})
    recall = reached / (len(truth) - n_entities)
    strong = [r for r in pairs if r.score >= 0.5]
    precision = sum(truth[r.first_id] == truth[r.second_id] for r in strong) / len(strong)
    assert recall >= 0.99 and precision >= 0.9, (recall, precision)
    assert len(pairs) <= 3 * 4 * len(truth)


def test_no_records(spark, workspace):
    _, df = as_records(spark, made_up(1, 3))
    assert neighbours.neighbour_pairs(df.limit(0), workspace).collect() == []
