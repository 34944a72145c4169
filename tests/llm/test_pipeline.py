"""The registered corpus queries and the pipeline, whole, on the smallest tables."""

from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from kinfold.llm import decontaminate, queries, toxicity
from tests.llm.test_simhash import brute_fingerprint, classes
from tests.oracle_check import difference, duck

SF = "/root/testdata/sf0.001"


def test_one_query_per_operator_and_the_pipeline():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
    assert "pipeline" in names and [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity"


@pytest.mark.parametrize("name", ["op1_url_filter", "op3_chat", "op11_prefix_trie", "op13_merkle"])
def test_query_equals_its_sql(spark, name):
    assert difference(spark, duck(SF), SF, name) is None


def test_stages_against_brute_force(spark):
    """Each stage's output from its own input, by other means."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    outputs = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = f"{spark.conf.get('spark.checkpoint.dir')}/pipeline-{name}"
        stage(spark, outputs[-1], SF).write.mode("overwrite").parquet(path)
        outputs.append(spark.read.parquet(path))
    rows = [o.collect() for o in outputs]
    assert all(o.columns == docs.columns for o in outputs[:-1])

    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    score = toxicity.scorer(model)
    assert {r.doc_id for r in rows[1]} == {r.doc_id for r in rows[0] if score(r.text or "") < 0.5}

    fps = {r.doc_id: brute_fingerprint(r.text) for r in rows[1]}
    label = classes(sorted(set(fps.values())))
    first = {}
    for doc_id in sorted(fps):
        first.setdefault(label[fps[doc_id]], doc_id)
    assert sorted(r.doc_id for r in rows[2]) == sorted(first.values())

    items = [f" {' '.join(decontaminate.words_of(r.text))} " for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r.doc_id for r in rows[2] if not any(i in f" {' '.join(decontaminate.words_of(r.text or ''))} " for i in items)]
    assert sorted(r.doc_id for r in rows[3]) == sorted(clean)

    uses = Counter(r.doc_id for r in rows[4])
    assert set(uses) == set(clean) and max(uses.values()) <= corpus_pipeline.MAX_REPEATS + 1
    assert sorted(r.doc_id for r in rows[5]) == sorted(r.doc_id for r in rows[4])
    slots = defaultdict(list)
    for r in rows[5]:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    texts = {r.doc_id: tuple(r) for r in rows[0]}
    assert all(texts[r.doc_id] == tuple(r)[: len(docs.columns)] for r in rows[5])


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_of_odd_rows(spark, tmp_path, odd_texts):
    """Nulls in every column, odd and repeated texts, repeated rows, ties of ids, and clashing names."""
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = [(100_000 + i, t, "en", None if i % 2 else "s", None) for i, t in enumerate(odd_texts)]
    odd += [(None, None, None, None, None)] * 3 + [(100_000, "another text under the same id", "en", "s", 1), (None, "no id here", None, "s", 2)]
    docs = base.unionByName(spark.createDataFrame(odd, base.schema))
    docs = docs.selectExpr("*", "'a' as shard", "'b' as slot", "'c' as fp", "'d' as digest", "'e' as row_digest", "'f' as place")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns[:5], "shard_", "slot_", *docs.columns[7:], "shard", "slot"]
    rows = out.collect()
    assert {(r["shard_"], r["slot_"], r.fp, r.digest, r.row_digest, r.place) for r in rows} == {tuple("abcdef")}
    kept = {r.doc_id for r in rows}
    empties = {100_000, 100_001, 100_002, None}  # null, empty and blank texts: one group, its least id stays
    assert min(i for i in kept if i is not None and i >= 100_000) == 100_000 and len(kept & empties) >= 1
    assert 100_004 in kept and 100_005 not in kept  # a text twice
    assert len({(r.doc_id, r.text) for r in rows if r.doc_id in (100_003, 100_006)}) == 2
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run_on_the_smallest_tables(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0
