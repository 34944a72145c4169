import random

import xxhash

from kinfold.llm import simhash as s
from tests.llm.conftest import prose


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps):
    """Smallest member reachable over links of at most two bits."""
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 2 and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def near(seed, n, spread):
    """Random fingerprints and chains of neighbours of them."""
    r = random.Random(seed)
    out = {r.getrandbits(64) for _ in range(n)}
    for f in list(out)[: n // 2]:
        for _ in range(spread):
            f ^= (1 << r.randrange(64)) | (1 << r.randrange(64))
            out.add(f)
    return sorted(out)


def linked(spark, fps, crowd):
    frame = spark.createDataFrame([(s.signed(f),) for f in fps], "fp long")
    found = {r.fp % 2**64: r.component % 2**64 for r in s.components(frame, crowd).collect()}
    return {f: found.get(f, f) for f in fps}


def partition(labels):
    groups = {}
    for k, v in labels.items():
        groups.setdefault(v, set()).add(k)
    return sorted(sorted(g) for g in groups.values())


def test_components_equal_brute_force(spark):
    fps = near(1, 120, 4)
    assert partition(linked(spark, fps, 64)) == partition(classes(fps))


def test_crowded_table_entries_lose_no_link(spark):
    r = random.Random(2)
    base = r.getrandbits(64)
    fps = sorted({base ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(150)})
    want = partition(classes(fps))
    assert partition(linked(spark, fps, 2)) == want
    assert partition(linked(spark, fps, 64)) == want


def test_documents(make_docs, odd_texts):
    text = prose(9, 300)
    texts = [*odd_texts, text, text + " end", text.upper(), prose(10, 300), text.replace(" ", "\x0b")]
    docs = make_docs(texts)
    rows = {r.doc_id: r for r in s.near_duplicates(docs).collect()}
    want = [brute_fingerprint(t) for t in texts]
    assert [int(rows[i].fingerprint, 16) for i in range(len(texts))] == want
    label = classes(sorted(set(want)))
    for i, f in enumerate(want):
        assert rows[i].component_id == min(j for j, g in enumerate(want) if label[g] == label[f])
    assert rows[0].component_id == 0 and rows[2].component_id == 0  # texts without words
    kept = s.keep_first(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in rows.values()})
    assert kept.columns == docs.columns


def test_one_row_of_each_group_stays(spark):
    schema = "doc_id long, text string, place string, row_digest string, first_digest string, fp int"
    a, b = prose(1, 50), prose(2, 50)
    rows = [(5, a, "x", None, "q", 1)] * 3 + [(7, a, "x", None, "q", 1), (None, a, None, "r", "q", 1), (None, b, "y", None, None, 2), (9, "", "", "", "", 0)]
    kept = s.keep_first(spark.createDataFrame(rows, schema)).collect()
    assert sorted(((r.doc_id or -1), r.text, r.place) for r in kept) == [(-1, b, "y"), (5, a, "x"), (9, "", "")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, component string")
    assert s.near_duplicates(docs).collect() == [] and s.keep_first(docs).collect() == []
