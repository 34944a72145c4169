"""Stored tables that loads change: what stays, what is rewritten, and equality with whole runs."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kinfold.functions import fixed_values as fixed
from kinfold.operators import skew
from kinfold.operators.standardize import raw_to_json, upsert_latest
from kinfold.operators.workspace import Workspace
from kinfold.plans import incremental
from kinfold.plans.unify import unify_records
from kinfold.sources import sinks
from kinfold.sources.store import Change, Store
from kinfold.sources.versions import StaleVersion
from tests import brute_force
from tests.test_unify import as_records, made_up, merged_as_dict


def files(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}


def test_last_version_of_a_key(spark):
    """Null versions are the lowest, not lost; ties go by contents; rows without a key all stay."""
    rows = [
        (1, None, "a"), (2, 0, "b"), (2, 1, "c"), (3, 1, "x"), (3, 1, "y"), (3, None, "z"), (4, None, "p"), (4, None, None),
        (5, 2, None), (5, 2, None), (None, 1, "k"), (None, 2, "l"), (None, 1, "k"),
    ]
    for arranged in (rows, rows[::-1]):
        df = spark.createDataFrame(arranged, "key int, version int, value string").repartition(3)
        got = sorted((tuple(r) for r in upsert_latest(df, "key", "version").collect()), key=str)
        want = [(1, None, "a"), (2, 1, "c"), (3, 1, "y"), (4, None, "p"), (5, 2, None), (None, 1, "k"), (None, 1, "k"), (None, 2, "l")]
        assert got == sorted(want, key=str)


def test_a_hot_key_leaves_each_task_as_one_row(spark):
    df = spark.range(10_000).select(F.floor(F.col("id") / 20_000).alias("key"), F.col("id").alias("version"), F.lit("x").alias("value"))
    latest = upsert_latest(df, "key", "version")
    assert [tuple(r) for r in latest.collect()] == [(0, 9_999, "x")]
    plan = latest._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("WindowGroupLimit") == 2, "one before the shuffle, one after"


def numbered(df, load):
    return df.withColumn("load", F.lit(load).cast("int"))


def test_records_are_upserted_and_other_files_stay(spark, workspace, tmp_path):
    root = str(tmp_path / "store")
    store = sinks.record_store(spark, root, n_buckets=16)
    _, df = as_records(spark, made_up(1, 60))
    first = sinks.upsert_source_records(store, numbered(df, 1), workspace)
    before = files(root)
    some = df.where("ordinal = 7").withColumn("company", F.lit("New"))
    older = df.where("ordinal = 8").withColumn("company", F.lit("Older"))
    added = df.where("ordinal = 9").withColumn("id", F.lit("Z9"))
    load = numbered(some, 2).unionByName(numbered(older, None)).unionByName(numbered(added, None))
    second = sinks.upsert_source_records(store, load, workspace)
    assert (first, second) == (0, 1) and store.version() == 1
    rows = {r.id: r for r in store.read("source_records", second).collect()}
    want = {r.id: r.company for r in df.collect()}
    own = {r.id for r in some.collect()}
    assert {i: r.company for i, r in rows.items()} == want | dict.fromkeys(own, "New") | {"Z9": rows["Z9"].company}
    assert rows["Z9"].load is None and len(rows) == 61
    # no file was changed, and only touched buckets point to new ones
    after = files(root)
    assert {p: t for p, t in after.items() if p in before} == before
    old, new = (store.state("source_records", v).folders for v in (first, second))
    moved = {b for b in new if new[b] != old.get(b)}
    assert moved == set(store.buckets(load, "source_records")) and 0 < len(moved) <= 3
    # the first version reads as before
    assert store.read("source_records", first).count() == 60
    assert store.read("source_records", second, sorted(moved)).count() < 61


def test_a_load_moves_once_on_its_way_into_the_store(spark, workspace, tmp_path, monkeypatch):
    """Versions of an id meet where their bucket is written: nothing is staged but the load, whatever is hot."""
    _, df = as_records(spark, made_up(3, 80))
    lost = numbered(df.where("ordinal < 3").withColumn("id", F.lit(None).cast("string")), 1)
    again = numbered(df.where("ordinal % 3 = 0").withColumn("state", F.lit("NY")), 2)
    loads = [numbered(df, 1).unionByName(lost), again.unionByName(again).unionByName(numbered(df.where("ordinal % 4 = 0"), None))]
    staged, results = [], []
    original = Workspace.stage

    def spied(self, rows, name):
        staged.append(name)
        return original(self, rows, name)

    monkeypatch.setattr(Workspace, "stage", spied)
    for heavy_rows in (skew.HEAVY_ROWS, 1):
        monkeypatch.setattr(skew, "HEAVY_ROWS", heavy_rows)
        store = sinks.record_store(spark, str(tmp_path / f"store{heavy_rows}"), n_buckets=4)
        for load in loads:
            version = sinks.upsert_source_records(store, load, workspace)
        results.append(store.read("source_records", version))
    assert staged == ["load"] * 4
    want = upsert_latest(raw_to_json(loads[0].unionByName(loads[1])).select(results[0].columns), "id", "load")
    for got in results:
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_two_writers_cannot_both_win(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), {"t": ("k", 4)})
    rows = spark.range(20).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    every = store.buckets(rows, "t")
    version = store.commit({"t": Change(rows, every)}, None)
    one, other = (rows.withColumn("v", F.lit(v)) for v in "bc")
    store.commit({"t": Change(one, every)}, version)
    with pytest.raises(StaleVersion):
        store.commit({"t": Change(other, every)}, version)
    assert {r.v for r in store.read("t", store.version()).collect()} == {"b"}


def test_a_failed_change_leaves_the_last_version(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), {"t": ("k", 4)})
    rows = spark.range(20).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    version = store.commit({"t": Change(rows, store.buckets(rows, "t"))}, None)
    broken = rows.withColumn("v", F.when(F.col("k") == 7, F.raise_error(F.lit("broken")).cast("string")).otherwise("b"))
    with pytest.raises(Exception, match="broken"):
        store.commit({"t": Change(broken, store.buckets(rows, "t"))}, version)
    with pytest.raises(ValueError, match="not touched"):
        store.commit({"t": Change(rows, [0])}, version)
    (tmp_path / "s" / "_versions" / "000000000001").write_text("")  # announced, but not whole
    assert store.version() == version and {r.v for r in store.read("t", version).collect()} == {"a"}


def test_vacuum_keeps_what_recent_versions_read(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), {"t": ("k", 4)})
    version = None
    for value in "abc":
        rows = spark.range(40).select(F.col("id").alias("k"), F.lit(value).alias("v"))
        if version is not None:
            rows = rows.where("k % 7 = 0 or k % 2 = 1").unionByName(rows.where("k % 7 > 0 and k % 2 = 0"))
        version = store.commit({"t": Change(rows, store.buckets(rows, "t"))}, version)
    assert len(store.vacuum(keep=1)) == 2
    assert store.version() == version and store.read("t", version).count() == 40
    assert store.vacuum(keep=1) == []


def test_empty_store_and_bucket_that_empties(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), {"t": ("k", 2)})
    none = spark.createDataFrame([], "k long, v string")
    assert store.version() is None and store.buckets(none, "t") == []
    version = store.commit({"t": Change(none, [])}, None)
    assert store.read("t", version).collect() == []
    rows = spark.range(9).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    version = store.commit({"t": Change(rows, [0, 1])}, version)
    kept = rows.where(F.pmod(F.xxhash64(F.lit(11), "k"), F.lit(2)) == 0)
    version = store.commit({"t": Change(kept.limit(0), [1])}, version)
    assert sorted(r.k for r in store.read("t", version).collect()) == sorted(r.k for r in kept.collect())


def test_a_written_change_is_read_back_committed_or_discarded(spark, tmp_path):
    """Columns aside are in what was written, not in the table; what is discarded leaves no file."""
    store = Store(spark, str(tmp_path / "s"), {"t": ("k", 4)})
    rows = spark.range(20).select(F.col("id").alias("k"), F.lit(0).alias("load"), (F.col("id") % 2).alias("mark"))
    every = store.buckets(rows, "t")
    written = store.write("t", Change(rows.unionByName(rows), every, "load", ("mark",)))
    assert store.version() is None and store.read_written(written).where("mark = 1").count() == 10
    version = store.commit({"t": written}, None)
    assert store.read("t", version).columns == ["k", "load"] and store.read("t", version).count() == 20
    before = files(tmp_path)
    store.discard(store.write("t", Change(rows, every, "load", ("mark",))))
    assert files(tmp_path) == before
    with pytest.raises(ValueError, match="not touched"):
        store.write("t", Change(rows, [0]))
    none = store.write("t", Change(rows.limit(0), [], "load", ("mark",)))
    assert store.read_written(none).columns == ["k", "load", "mark"] and store.read_written(none).isEmpty()


def test_a_load_writes_its_records_once(spark, tmp_path, monkeypatch):
    """Payloads are staged as the load, then only written into the store; a load without news leaves no file."""
    workspace = Workspace(spark, str(tmp_path / "w"))
    staged, original = [], Workspace.stage
    monkeypatch.setattr(Workspace, "stage", lambda self, df, name: staged.append((name, df.columns)) or original(self, df, name))
    store = incremental.open_store(spark, str(tmp_path / "store"), n_buckets=4)
    plain, df = as_records(spark, [("A", i, f"Firm{i // 4} Tools", f"P{i}", f"m{i // 2}@x.org", "", "NY") for i in range(40)])
    incremental.apply_load(store, numbered(df, 0), workspace)
    assert [name for name, columns in staged if "raw" in columns] == ["load"]
    assert "again" not in [name for name, _ in staged]  # the first load's records are stored as they differ
    assert store.read("records", store.version()).columns == numbered(df, 0).columns
    assert unified_of(store, workspace) == brute_force.merge(plain)
    before = files(tmp_path / "store")
    assert incremental.apply_load(store, numbered(df, 0), workspace).n_changed == 0
    assert files(tmp_path / "store") == before


def unified_of(store, workspace):
    version = store.version()
    resolved = store.read("resolved", version)
    merged = store.read("merged", version)
    return merged_as_dict(type("U", (), dict(resolved=resolved, merged=merged, n_records=resolved.count(), workspace=workspace))())


@pytest.mark.parametrize("heavy_rows", [None, 3])
def test_loads_equal_a_whole_run(spark, tmp_path, heavy_rows):
    """New, changed, moved, repeated and older records in random loads; after each, as if run whole."""
    rng = random.Random(5)
    workspace = Workspace(spark, str(tmp_path))
    store = incremental.open_store(spark, str(tmp_path / "store"), n_buckets=8)
    known = {}
    for load in (1, 3, 2):
        rows = [(s, o % 60, *values) for s, o, *values in made_up(load, 50 if load == 1 else 12)]
        last = {}
        for r in rows:
            last[r[:2]] = max(last.get(r[:2], r), r, key=str)
        rows = list(last.values())
        for r in rows:
            before = known.get(r[:2])
            known[r[:2]] = (load, r) if before is None or before[0] < load else before
        if load == 2:  # some of them unchanged: nothing to do for these
            rows += [r for n, r in known.values() if n == 3][:2]
        _, df = as_records(spark, rows)
        report = incremental.apply_load(store, numbered(df, load), workspace, heavy_rows=heavy_rows)
        plain, whole = as_records(spark, [r for _, r in known.values()])
        assert unified_of(store, workspace) == brute_force.merge(plain)
        assert report.n_linked <= len(known) and report.n_given == len(rows)
    again = incremental.apply_load(store, numbered(df, load), workspace, heavy_rows=heavy_rows)
    assert (again.n_changed, again.n_buckets) == (0, {}) and again.version == store.version()
    assert rng  # seeds are fixed above


def test_a_small_load_touches_its_blocks_only(spark, tmp_path):
    workspace = Workspace(spark, str(tmp_path))
    root = str(tmp_path / "store")
    store = incremental.open_store(spark, root, n_buckets=32)
    rows = [("A", i, f"Firm{i // 4} Tools{i // 4}", f"P{i}", f"m{i // 2}@x.org", "", "NY") for i in range(400)]
    plain, df = as_records(spark, rows)
    incremental.apply_load(store, numbered(df, 0), workspace)
    before = files(root)
    rows[8] = ("A", 8, "Firm50 Tools50", "P8", "m8@x.org", "", "CA")
    _, changed = as_records(spark, rows[8:9])
    report = incremental.apply_load(store, numbered(changed, 1), workspace)
    assert (report.n_changed, report.n_blocks, report.n_linked) == (1, 2, 8)
    assert report.n_buckets["records"] == 1 and report.n_buckets["merged"] <= 2
    assert {p: t for p, t in files(root).items() if p in before} == before
    plain, whole = as_records(spark, rows)
    assert unified_of(store, workspace) == brute_force.merge(plain)
    tables = incremental.entity_tables(store)
    full = unify_records(whole, workspace)
    assert tables["entities"].count() == full.merged.count()
    assert {r.field for r in tables["field_provenance"].collect()} == set(fixed.UNIFIED_FIELDS)
    assert incremental.entity_tables(store, 0)["source_records"].where("state = 'CA'").count() == 0
