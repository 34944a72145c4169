"""Clusters and merged entities against brute force, with and without the hot-key paths."""

import random

import pytest
from pyspark.sql import functions as F

from kinfold.functions import fixed_values as fixed
from kinfold.functions import standard
from kinfold.operators import clustering, linking, merging, quality, skew, views
from kinfold.operators.standardize import node_number, node_record_id, node_source
from kinfold.operators.workspace import Workspace
from kinfold.plans import driver_tables, queries
from kinfold.plans.unify import unify_records
from kinfold.streaming.progress import batch_progress
from tests import brute_force

SCHEMA = (
    "source string, ordinal long, id string, company string, contactName string,"
    " email string, phone string, state string"
)
HEAVY = [None, 3]


def as_records(spark, rows):
    """Records of already standard values, as dicts for brute force and as a DataFrame."""
    full = [
        {"source": r[0], "ordinal": r[1], "id": f"{r[0]}{r[1]}", **dict(zip(fixed.UNIFIED_FIELDS, r[2:]))}
        for r in rows
    ]
    df = (
        spark.createDataFrame([tuple(r.values()) for r in full], SCHEMA)
        .withColumn("node", node_number(F.col("source"), F.col("ordinal")))
        .withColumn("canonical", standard.canonical_company(F.col("company")))
        .withColumn("block_key", standard.block_key(F.col("company"), F.col("email")))
        .withColumn("raw", F.create_map(F.lit("company"), F.col("company")))
    )
    keys = {r.id: r.block_key for r in df.select("id", "block_key").collect()}
    return [{**r, "block_key": keys[r["id"]]} for r in full], df


def made_up(seed, n):
    """Random records: few distinct values, many blanks, one hot block, email and contact."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = rng.random() < 0.35
        company = "Hot Stuff" if hot else rng.choice(["", "Zen Tools", "Zen Tools Inc", "Zen Tools & Sons Ltd", "Big Co", "Dog LLC"])
        first = rng.choice(["Ann", "ann", "A.", "Bob", "Cy", ""])
        contact = f"{first} {rng.choice(['Lee', 'Poe', 'lee'])}".strip() if first else ""
        email = rng.choice(["", "hot@x.org"] if hot else ["", f"u{rng.randrange(12)}@x.org", f"v{rng.randrange(5)}@y.org", "odd"])
        phone = rng.choice(["", "5550100", f"+1212555{rng.randrange(20):04d}", f"+1212555{rng.randrange(400):04d}"])
        rows.append((rng.choice("ABC"), i, company, contact, email, phone, rng.choice(["", "NY", "NJ", "ATLANTIS"])))
    return rows


def merged_as_dict(unified, heavy_rows=None):
    lists = views.member_lists(unified.resolved, unified.n_records, unified.workspace, heavy_rows)
    members = {r.entity_id: sorted(r.members) for r in lists.collect()}
    out = {}
    for r in views.unified_view(unified.merged).collect():
        assert r.entity_id not in out and r.member_count == len(members[r.entity_id])
        out[r.entity_id] = {
            **{f: r[f] for f in fixed.UNIFIED_FIELDS},
            "provenance": [tuple(p) for p in r.provenance],
            "confidence": r.confidence,
            "reasoning": r.reasoning,
            "members": members[r.entity_id],
        }
    return out


@pytest.mark.parametrize("heavy_rows", HEAVY)
def test_unify_like_brute_force(spark, workspace, heavy_rows):
    plain, df = as_records(spark, made_up(1, 150))
    unified = unify_records(df, workspace, heavy_rows=heavy_rows)
    assert merged_as_dict(unified, heavy_rows) == brute_force.merge(plain)


def test_row_order_does_not_matter(spark, tmp_path):
    rows = made_up(3, 90)
    results = []
    for arranged in (rows, sorted(rows, key=str, reverse=True)):
        _, df = as_records(spark, arranged)
        workspace = Workspace(spark, str(tmp_path / str(len(results))))
        results.append(merged_as_dict(unify_records(df.repartition(len(results) + 2), workspace)))
    assert results[0] == results[1]


def test_chain_in_the_worst_order(spark, workspace):
    """Neighbours share an email or a phone in turn; the ends share nothing."""
    n = 24
    order = list(range(n))
    random.Random(7).shuffle(order)
    rows = []
    for at, ordinal in enumerate(order):
        email, phone = f"e{at // 2}@x.org", f"+1212555{(at + 1) // 2:04d}"
        rows.append(("A", ordinal, "Chain Gang", "", email, phone, ""))
    plain, df = as_records(spark, rows)
    got = unify_records(df, workspace).resolved
    labels = {r.id: r.c for r in got.select("id", node_record_id(F.col("root")).alias("c")).collect()}
    assert labels == brute_force.clusters(plain)
    assert set(labels.values()) == {"A0"}


@pytest.mark.parametrize("heavy_rows", HEAVY)
def test_components_of_random_graphs(spark, workspace, heavy_rows):
    rng = random.Random(11)
    edges = [(rng.randrange(1, 300), rng.randrange(300)) for _ in range(220)]
    edges += [(i + 1, i) for i in range(400, 520)] + [(600 + i, 599) for i in range(60)]
    edges = [(max(e), min(e)) for e in edges if e[0] != e[1]]
    label = {x: x for e in edges for x in e}
    for _ in range(400):
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    df = spark.createDataFrame(edges, "u long, v long")
    got = clustering.connected_components(df, workspace, heavy_rows).collect()
    assert len(got) == len(label)
    assert {r.node: r.root for r in got} == label


def test_rounds_run_on_long_chains_only(spark, workspace, monkeypatch):
    """Records within two hubs of their entity's first need no round, however many; heavy hubs neither."""
    rows = []
    for e in range(200):
        shared = [(f"a{e}@x.org", ""), (f"a{e}@x.org", f"n{e}"), ("", f"n{e}")]
        rows += [("A", 10 * e + i, f"Firm{e % 7} Foods", name, email, "", "") for i, (email, name) in enumerate(shared)]
    chain = [(f"c{i // 2}@x.org", f"m{(i + 1) // 2}") for i in range(16)]
    rows += [("B", i, "Chain Media", name, email, "", "") for i, (email, name) in enumerate(chain)]
    plain, df = as_records(spark, rows)
    given = []
    original = clustering.small_star

    def spied(edges, n_edges, heavy_rows):
        given.append(n_edges)
        return original(edges, n_edges, heavy_rows)

    monkeypatch.setattr(clustering, "small_star", spied)
    unified = unify_records(df, workspace)
    assert merged_as_dict(unified) == brute_force.merge(plain)
    assert max(given) <= 2 * len(chain)
    given.clear()
    assert merged_as_dict(unify_records(df.where("source = 'A'"), workspace)) == brute_force.merge(plain[:600])
    assert not given


def test_nothing_heavy_is_planned_where_no_key_is(spark):
    df = spark.range(200).selectExpr("id % 50 as k", "id").cache()
    ordinary, heavy = skew.split_heavy(df, "k", 200, heavy_rows=4)
    assert heavy is None and ordinary.count() == 200
    right = df.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    joined = skew.lookup_join(df, right, ["k"], "n", 200, heavy_rows=4)
    assert joined._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert skew.split_heavy(df, "k", 200, heavy_rows=3)[1].count() == 200


def test_what_links_and_what_does_not(spark, workspace):
    rows = [
        ("A", 1, "Zen Tools", "Ann Lee", "a@x.org", "", ""),
        ("B", 1, "Zen Tools Inc", "ANN LEE", "", "", ""),
        ("C", 1, "Big Co", "Ann Lee", "a@x.org", "", ""),  # same values, other block
        ("A", 2, "Zen Tools", "", "", "5550100", ""),  # malformed phones do not link
        ("B", 2, "Zen Tools", "", "", "5550100", ""),
        ("A", 3, "", "", "", "", ""),  # blanks do not link
        ("B", 3, "", "", "", "", ""),
    ]
    _, df = as_records(spark, rows)
    unified = unify_records(df, workspace)
    labels = {r.id: r.c for r in unified.resolved.select("id", node_record_id(F.col("root")).alias("c")).collect()}
    assert labels == {"A1": "A1", "B1": "A1", "C1": "C1", "A2": "A2", "B2": "B2", "A3": "A3", "B3": "B3"}


@pytest.mark.parametrize(
    "field, offers, expected",
    [
        ("company", {"A": "Zen Tools Holdings Inc", "C": "Zen Tools & Sons"}, ("C", "Zen Tools & Sons")),
        ("company", {"A": "Zen Tools Inc", "B": "Zen Tools"}, ("B", "Zen Tools")),
        ("contactName", {"B": "A. Lee", "C": "Ann Lee"}, ("C", "Ann Lee")),
        ("contactName", {"B": "Al Lee", "C": "Alan Lee"}, ("C", "Alan Lee")),
        ("email", {"B": "", "C": "a@x.org"}, ("C", "a@x.org")),
        ("email", {"B": "nonsense", "C": "a@x.org"}, ("C", "a@x.org")),
        ("phone", {"B": "5550100", "A": "+12125550100"}, ("A", "+12125550100")),
        ("state", {"A": "NY", "B": "NJ"}, ("B", "NJ")),
        ("state", {"A": "NY", "C": "NJ"}, ("A", "NY")),
        ("state", {"A": "NY", "B": "ATLANTIS"}, ("A", "NY")),
        ("state", {"A": "", "B": "", "C": ""}, ("B", "")),
    ],
)
def test_conflict_rule(field, offers, expected):
    """The rule's order, on the brute-force form that the Spark result is compared with."""
    base = {f: "" for f in fixed.UNIFIED_FIELDS}
    members = [{**base, "source": s, "ordinal": 1, field: v} for s, v in offers.items()]
    best = min(members, key=lambda r: brute_force.rank(field, r))
    assert (best["source"], best[field]) == expected


def test_conflict_rule_in_spark(spark, workspace):
    rows = [
        ("A", 1, "Zen Tools Holdings Inc", "A. Lee", "a@x.org", "+12125550100", "NY"),
        ("C", 1, "Zen Tools & Sons", "Ann Lee", "a@x.org", "", "NJ"),
        ("B", 1, "Zen Tools", "A. Lee", "a@x.org", "5550100", "ATLANTIS"),
    ]
    plain, df = as_records(spark, rows)
    unified = unify_records(df, workspace)
    assert merged_as_dict(unified) == brute_force.merge(plain)
    won = {r.field: (r.source, r.value) for r in merging.field_winners(unified.merged).collect()}
    assert won == {
        "company": ("C", "Zen Tools & Sons"),
        "contactName": ("C", "Ann Lee"),
        "email": ("B", "a@x.org"),
        "phone": ("A", "+12125550100"),
        "state": ("A", "NY"),
    }


@pytest.mark.parametrize("n", [1024, 1025])
def test_member_lists_do_not_depend_on_what_is_heavy(spark, workspace, n):
    rows = [("ABC"[i % 3], i, "Hot Stuff", "", "hot@x.org", "", "") for i in range(n)]
    rows += [("A", 9000 + i, "Big Co", "", f"u{i}@x.org", "", "") for i in range(5)]
    _, df = as_records(spark, rows)
    found = []
    for heavy_rows in (None, 100):
        unified = unify_records(df, workspace, heavy_rows=heavy_rows)
        assert views.unified_view(unified.merged).count() == 6
        lists = views.member_lists(unified.resolved, unified.n_records, workspace, heavy_rows).collect()
        found.append(sorted((r.entity_id, r.part, r.n_parts, tuple(r.members)) for r in lists))
    assert found[0] == found[1]
    hot = [x for x in found[0] if x[0] == "A0"]
    in_load_order = [f"{s}{i}" for s in "ABC" for i in range(n) if "ABC"[i % 3] == s]
    assert [x[1:3] for x in hot] == [(k, -(-n // 1024)) for k in range(-(-n // 1024))]
    assert [m for x in hot for m in x[3]] == in_load_order
    assert len(found[0]) == len(hot) + 5


def test_the_last_load_replaces_before_linking(spark, workspace):
    first = [("A", 1, "Acme", "", "old@x.org", "", ""), ("A", 2, "Acme", "", "old@x.org", "", ""), ("B", 1, "Acme", "", "new@x.org", "", "")]
    second = [("A", 1, "Acme", "", "new@x.org", "", "")]
    loads = [as_records(spark, rows)[1].withColumn("load", F.lit(k)) for k, rows in enumerate((first, second))]
    both = loads[0].unionByName(loads[1])
    unified = unify_records(both, workspace)
    ids = sorted(r.entity_id for r in merging.entities(unified.merged).collect())
    assert ids == ["A1", "A2"]
    members = {(r.entity_id, r.record_id) for r in merging.entity_members(unified.resolved).collect()}
    assert members == {("A1", "A1"), ("A1", "B1"), ("A2", "A2")}


def test_unify_when_nothing_may_be_broadcast(spark, workspace, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", -1)
    plain, df = as_records(spark, made_up(1, 150))
    assert merged_as_dict(unify_records(df, workspace, heavy_rows=8), 8) == brute_force.merge(plain)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_equals_plain_join(spark, how):
    left = spark.range(300).selectExpr("case when id % 3 = 0 then -1 else id % 40 end as k", "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")).where("k <> 7")
    got = skew.lookup_join(left, right, ["k"], "n", 300, how, heavy_rows=5)
    want = left.join(right.drop("n"), "k", how)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_numbering_and_running_total(spark, workspace):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(5)
    numbered = skew.number_rows(df, ["x"], workspace, "no")
    assert numbered.where("no <> x + 1").isEmpty()
    totals = skew.running_total(numbered, "no", F.col("x"), "total", width=64)
    assert totals.count() == 1000
    assert totals.where("total <> x * (x + 1) / 2").isEmpty()


def test_batches_and_progress(spark, workspace):
    plain, df = as_records(spark, made_up(5, 120))
    unified = unify_records(df, workspace)
    order = sorted(plain, key=lambda r: (r["source"], r["ordinal"]))
    seen = list(dict.fromkeys(r["block_key"] for r in order))
    got = linking.block_batches(df, workspace, size=4).collect()
    assert {r.block_key: (r.block_no, r.batch) for r in got} == {
        k: (i + 1, i // 4 + 1) for i, k in enumerate(seen)
    }
    label = brute_force.clusters(plain)
    block = {r["id"]: r["block_key"] for r in plain}
    per_batch = {}
    for entity in set(label.values()):
        batch = seen.index(block[entity]) // 4 + 1
        per_batch[batch] = per_batch.get(batch, 0) + 1
    progress = batch_progress(unified.resolved, workspace, size=4).orderBy("batch").collect()
    assert [r.entities_so_far for r in progress] == [
        sum(n for b, n in per_batch.items() if b <= r.batch) for r in progress
    ]
    assert {r.total_batches for r in progress} == {len(progress)}


@pytest.mark.parametrize("heavy_rows", HEAVY)
def test_block_candidates(spark, heavy_rows):
    plain, df = as_records(spark, made_up(6, 100))
    order = sorted(plain, key=lambda r: (r["source"], r["ordinal"]))
    first, expected = {}, set()
    for r in order:
        a = first.setdefault(r["block_key"], r)
        if a is not r:
            shared = set(brute_force.link_values(a)) & set(brute_force.link_values(r))
            kinds = {k for k, _ in shared}
            expected.add((a["id"], r["id"], *[int(k in kinds) for k in ("email", "phone", "contact")]))
    got = linking.block_candidates(df, len(plain), heavy_rows).drop("block_key").collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


@pytest.mark.parametrize("heavy_rows", HEAVY[1:])
def test_conflicts_and_scores(spark, workspace, heavy_rows):
    plain, df = as_records(spark, made_up(8, 100))
    unified = unify_records(df, workspace)
    label = brute_force.clusters(plain)
    said = {}
    for r in plain:
        for f in fixed.UNIFIED_FIELDS:
            if r[f]:
                said.setdefault((label[r["id"]], f), {}).setdefault(r[f], []).append(r["source"])
    expected = {
        (e, f, v, len(values), len(sources), "+".join(sorted(set(sources))))
        for (e, f), values in said.items()
        if len(values) > 1
        for v, sources in values.items()
    }
    got = views.field_conflicts(unified.resolved, unified.n_records, heavy_rows).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)
    merged = brute_force.merge(plain)
    scores = views.member_scores(unified.resolved, unified.merged, unified.n_records, heavy_rows).collect()
    by_id = {r["id"]: r for r in plain}
    sizes = {e: len(m["members"]) for e, m in merged.items()}
    assert len(scores) == sum(n for n in sizes.values() if n > 1)
    for s in scores:
        mine, won = by_id[s.record_id], merged[s.entity_id]
        for f in fixed.UNIFIED_FIELDS:
            same = mine[f] != "" and brute_force.form(f, mine[f]) == brute_force.form(f, won[f])
            assert s[f"same_{f}"] == int(same)


def test_driver_fixture_never_over_merges(spark, tmp_path):
    """Against the truth label: clusters are pure, and nearly all true entities are found whole."""
    sf_dir = "/root/testdata/sf0.001"
    unified, _ = queries.run(spark, sf_dir)
    truth = None
    for s in driver_tables.BINDINGS:
        part = driver_tables.fragments(spark, sf_dir, s).select(F.concat(F.lit(s), "ordinal").alias("id"), "e")
        truth = part if truth is None else truth.union(part)
    labelled = unified.resolved.join(truth, "id")
    assert labelled.groupBy("root").agg(F.count_distinct("e").alias("n")).where("n > 1").isEmpty()
    found = labelled.agg(F.count_distinct("root"), F.count_distinct("e")).first()
    assert found[0] <= found[1] * 1.05


def test_node_numbers(spark):
    df = spark.createDataFrame([("A", 0), ("B", 2), ("C", (1 << 52) - 1)], "s string, o long")
    got = df.withColumn("n", node_number(F.col("s"), F.col("o"))).select(
        "s", "o", node_source(F.col("n")).alias("s2"), node_record_id(F.col("n")).alias("id"), "n"
    ).collect()
    assert all(r.s == r.s2 and r.id == f"{r.s}{r.o}" for r in got)
    assert [r.n for r in got] == sorted(r.n for r in got)


def test_checks_are_clean_and_find_planted_faults(spark, workspace):
    _, df = as_records(spark, made_up(9, 60))
    unified = unify_records(df, workspace)
    entities, provenance = merging.entities(unified.merged), merging.field_provenance(unified.merged)
    members = merging.entity_members(unified.resolved)
    records = unified.records.select("id", "source", "block_key", *fixed.UNIFIED_FIELDS)

    def report(r, e, m, p):
        checks = {
            **quality.bad_domains(r, e, p),
            **quality.orphans(r, e, m, p),
            **quality.bad_keys(r, e, m, p),
            **quality.bad_partition(r, m),
            **quality.bad_provenance(r, e, m, p),
        }
        return {x.check_name for x in quality.counts(checks).where("n_violations > 0").collect()}

    assert report(records, entities, members, provenance) == set()
    bad_entities = entities.withColumn("confidence", F.lit(1.7))
    assert report(records, bad_entities, members, provenance) == {"entity confidence"}
    first = members.orderBy("record_id").limit(1)
    other = entities.join(first, "entity_id", "left_anti").orderBy("entity_id").limit(1).select("entity_id")
    stray = members.union(other.withColumn("record_id", F.lit("Z9")))
    assert report(records, entities, stray, provenance) == {"member record"}
    assert "record in one entity" in report(records, entities, members.join(first, "record_id", "left_anti"), provenance)
    assert report(records, entities, members.union(members.limit(1)), provenance) >= {"entity member"}
    wrong = provenance.withColumn("field", F.when(F.col("field") == "state", "zipcode").otherwise(F.col("field")))
    assert report(records, entities, members, wrong) >= {"provenance field", "provenance rows"}
    lied = provenance.withColumn("value", F.concat("value", F.lit("!")))
    assert report(records, entities, members, lied) == {"entity value", "member value"}
    twice = records.union(records.orderBy("id").limit(1))
    assert "record id" in report(twice, entities, members, provenance)
    assert "entity id" in report(records, entities.union(entities.limit(1)), members, provenance)
    assert "record source" in report(records.withColumn("source", F.lit("Q")), entities, members, provenance)
    strange = provenance.withColumn("source", F.when(F.col("field") == "email", "Q").otherwise(F.col("source")))
    assert "provenance source" in report(records, entities, members, strange)
    fewer = entities.join(first, "entity_id", "left_anti")
    assert report(records, fewer, members, provenance) >= {"member entity", "provenance entity"}
    doubled = provenance.union(provenance.orderBy("entity_id", "field").limit(1))
    assert "provenance key" in report(records, entities, members, doubled)
    moved = records.withColumn("block_key", F.col("id"))
    assert "entity in one block" in report(moved, entities, members, provenance)
    nulls = quality.blanks(records.withColumn("email", F.nullif("email", F.lit(""))), "records")
    email = nulls.where("column_name = 'email'").first()
    assert email.n_null > 0 and email.n_blank == 0 and email.n_rows == 60
