import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from kinfold.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_force(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        base, h = c - (abs(c) % 5) * (1 if c >= 0 else -1), zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children = defaultdict(list)
    for s in members:
        if s:
            children[s[:-1]].append(s)

    def saved(s):
        own_bytes = len(s[-1][1].encode()) if s else 0
        return (len(members[s]) - 1) * own_bytes

    out = []
    below = {}
    for s in sorted(members, key=len, reverse=True):
        total, n_leaves = saved(s), 0 if children[s] else 1
        for child in children[s]:
            total, n_leaves = total + below[child][0], n_leaves + below[child][1]
        below[s] = total, n_leaves
        ends = ",".join(str(c) for c in sorted(members[s]) if built[c] == s)
        parent = min(members[s[:-1]]) if s else None
        row = (min(members[s]), len(s), parent, len(members[s]), len(children[s]), n_leaves, total)
        out.append((*row, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def result(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema)
    got = prefix_trie.nodes(prefix_trie.build_trie(df))
    return sorted((tuple(r) for r in got.collect()), key=str)


def made_up(seed, n_convs, texts=3):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 120), n_convs):
        for turn in range(rng.randrange(1, 14)):
            rows.append((c, turn, rng.choice(["user", "assistant"]) if turn % 3 else "user", rng.choice(["a", "bé", "ccc", "日本"][:texts])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, seed):
    rows = made_up(seed, 70, texts=1 + seed)
    assert result(spark, rows) == brute_force(rows)


def test_odd_rows(spark):
    long = "x" * 300_000
    rows = [
        (None, 1, "user", "no conversation"), (5, None, None, None), (5, 1, "user", "a"), (5, 1, "user", "a"),
        (5, 1, "assistant", "z"), (6, 1, "user", ""), (7, 0, "user", long), (8, 0, "user", long), (9, 0, None, long),
        (12, 0, "user", "absent family"), (-3, 0, "user", "a"), (-3, 0, "user", "a"), (0, 0, "user", "a"),
    ]
    assert result(spark, rows) == brute_force(rows)


def test_shorter_than_what_they_share(spark):
    """Turnless conversations are members of the root alone and end there."""
    rows = [(c, 0, "user", f"only {c}") for c in range(1, 60) if c % 5]
    got = result(spark, rows)
    assert got == brute_force(rows)
    root = next(r for r in got if r[1] == 0)
    assert root[7] != prefix_trie.NO_ENDS and root[3] == 48


def test_long_conversations_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    rows = [(c, t, "user", "ab"[(t == c) + 0]) for c in (10, 11, 20, 21, 25) for t in range(23 + c % 3)]
    rows += [(30, t, "user", "a") for t in range(40)]
    assert result(spark, rows) == brute_force(rows)


def test_many_children_and_copies(spark, monkeypatch):
    from kinfold.operators import skew

    monkeypatch.setattr(skew, "HEAVY_ROWS", 20)
    rows = [(5 * c, 0, "user", "hello") for c in range(300)]
    rows += [(5 * c, 1, "user", f"t{c % 90}") for c in range(300)]
    want = brute_force(rows)
    assert result(spark, rows) == want
    monkeypatch.setattr(skew, "BROADCAST_BYTES", -1)
    assert result(spark, rows) == want


def test_empty_table_and_clashing_names(spark):
    assert result(spark, []) == []
    names = "depth", "a", "b", "c", "block", "unit", "at", "place", "weight", "total"
    rows = made_up(4, 12)
    wide = [(*r, *["x"] * len(names)) for r in rows]
    schema = SCHEMA + "".join(f", {n} string" for n in names)
    assert result(spark, wide, schema) == brute_force(rows)


def test_leaves_and_weights(spark):
    rows = [(5, 0, "u", "a"), (10, 0, "u", "a"), (15, 0, "u", "a"), (15, 1, "u", "b")]
    trie = prefix_trie.build_trie(spark.createDataFrame(rows, SCHEMA))
    assert {(r.c, r.depth, r.weight) for r in trie.sequences.collect()} == {(5, 1, 2), (15, 2, 1)}
    assert [r.c for r in prefix_trie.leaves(trie).collect()] == [15]
