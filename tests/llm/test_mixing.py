import math
from collections import Counter, defaultdict

import pytest

from kinfold.llm import mixing as m
from tests.llm.conftest import prose

SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    rows, i = [], 0
    for source, n in (("big", 700), ("mid", 150), ("small", 60), (None, 40), ("tiny", 25)):
        for _ in range(n):
            rows.append((i, prose(i, 5 + i % 23) if i % 50 else None, source))
            i += 1
    return spark.createDataFrame(rows, SCHEMA)


def totals(rows):
    out = Counter()
    for r in rows:
        out[r.source] += len((r.text or "").split()) + 1
    return out


def brute_exponent(sizes, target, repeats, budget):
    """The rule by a fine scan."""
    def weights(x):
        w = {s: n**x for s, n in sizes.items()}
        z = sum(w.values())
        return {s: v / z for s, v in w.items()}

    def fits(x):
        w = weights(x)
        b = budget or max(n / w[s] for s, n in sizes.items())
        return max(w[s] * b / n for s, n in sizes.items()) <= repeats + 1e-9

    def entropy(x):
        return -sum(p * math.log(p) for p in weights(x).values())

    grid = [k / 20000 for k in range(20001)]
    by_entropy = max((x for x in grid if entropy(x) >= target * math.log(len(sizes))), default=0)
    by_repeats = min((x for x in grid if fits(x)), default=1)
    return weights(max(by_entropy, by_repeats))


@pytest.mark.parametrize("target, repeats, budget", [(0.95, 2.0, None), (0.8, 50.0, None), (0.9, 3.0, 9000), (0.0, 2.0, 3000)])
def test_weights_and_realised_shares(docs, target, repeats, budget):
    rows = m.mix(docs, target, repeats, budget).collect()
    sizes, got = totals(docs.collect()), totals(rows)
    want = brute_exponent(sizes, target, repeats, budget)
    weight = {r.source: r.weight for r in rows}
    for s in sizes:
        assert weight[s] == pytest.approx(want[s], abs=2e-4)
    given = budget or max(n / want[s] for s, n in sizes.items())
    longest = 28
    for s in sizes:
        assert -longest - 0.01 * sizes[s] <= got[s] - weight[s] * given <= 0.01 * sizes[s] + 1
    # whole passes: every text is in each pass but the last
    uses = Counter(r.doc_id for r in rows)
    by_source = defaultdict(set)
    for r in docs.collect():
        by_source[r.source].add(uses[r.doc_id])
    assert all(max(v) - min(v) <= 1 for v in by_source.values())
    if budget is None:
        assert min(uses[r.doc_id] for r in docs.collect()) == 1 and max(uses.values()) <= math.ceil(repeats + 0.01)


def test_small_blocks_cut_at_the_same_row(docs, monkeypatch):
    want = sorted((r.doc_id, r.epoch) for r in m.mix(docs, 0.9, 3.0, 9000).collect())
    monkeypatch.setattr(m, "BLOCK_ROWS", 8)
    rows = m.mix(docs, 0.9, 3.0, 9000).collect()
    assert sorted((r.doc_id, r.epoch) for r in rows) == want
    assert max(Counter((r.source, r.epoch, r.block) for r in rows).values()) < 40


def test_passes_are_permutations_of_their_own(docs):
    rows = m.mix(docs, 1.0, 30.0).collect()
    orders = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.block_key):
        if r.source == "tiny":
            orders[r.epoch].append(r.doc_id)
    assert len(orders) > 5 and orders[0] != orders[1] and sorted(orders[0]) == sorted(orders[1])


def test_positions(docs):
    mixed = m.sequence(m.mix(docs))
    seen = defaultdict(list)
    for r in mixed.collect():
        seen[r.source, r.epoch, r.block].append(r.position)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in seen.values())


def test_odd_tables(spark):
    schema = "doc_id long, text string, source string, epoch string, own_place int, times int, weight int, mix_source int"
    assert m.mix(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, None, None, "e", 1, 1, 1, 1)] * 3 + [(None, "", "a", "e", 2, 2, 2, 2), (2, "w " * 90_000, "b", None, None, None, None, None)]
    out = m.mix(spark.createDataFrame(rows, schema), max_repeats=1.0)
    assert sorted(Counter((r.doc_id, r.source) for r in out.collect()).values()) == [1, 1, 3]
    same = m.repeat_rows(spark.createDataFrame(rows, schema), max_repeats=1.0)
    assert sorted(map(str, same.collect())) == sorted(map(str, spark.createDataFrame(rows, schema).collect()))
    assert out.columns == ["doc_id", "text", "source", "own_place", "times", "mix_source", "epoch", "block", "block_key", "weight"]


def test_no_python_on_the_main_path(docs):
    plan = m.sequence(m.mix(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
