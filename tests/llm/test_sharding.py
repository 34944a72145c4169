import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from kinfold.llm import sharding as s
from kinfold.operators import skew
from tests.llm.conftest import prose


def checked(rows, n, shards):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert len(rows) == n and set(slots) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    counts = [len(slots.get(k, [])) for k in range(shards)]
    assert max(counts) - min(counts) <= 1


def test_shards_are_level_and_whole(make_docs, odd_texts):
    texts = odd_texts + [prose(i, 5 + i % 40) for i in range(300)]
    docs = make_docs(texts)
    for shards, size in ((7, 4096), (40, 1 << 20), (1, 1 << 20)):
        out = s.shard(docs, shards, bucket_bytes=size)
        rows = out.collect()
        checked(rows, len(texts), shards)
        assert sorted((r.doc_id, r.text or "", r.lang) for r in rows) == sorted((i, t or "", "en") for i, t in enumerate(texts))


def test_digest(make_docs, odd_texts):
    rows = s.digest(s.shard(make_docs(odd_texts), 4)).collect()
    for r in rows:
        raw = (odd_texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)


def test_same_seed_same_places_other_seed_other(make_docs):
    docs = make_docs([prose(i, 9) for i in range(200)])

    def places(frame, seed):
        return {r.doc_id: (r.shard, r.slot) for r in s.shard(frame, 5, seed, 2048).collect()}

    assert places(docs, 1) == places(docs.repartition(5), 1) != places(docs, 2)


def test_places_look_random(make_docs):
    docs = make_docs([prose(i, 9) for i in range(2000)])
    rows = s.shard(docs, 10, bucket_bytes=8192).collect()
    halves = Counter((r.shard, r.doc_id < 1000) for r in rows)
    assert all(60 <= halves[k, True] <= 140 for k in range(10))
    firsts = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert 800 < sum(a < b for a, b in zip(firsts, firsts[1:])) < 1200


def test_written_shards(make_docs, spark, tmp_path):
    s.write_shards(make_docs([prose(i, 9) for i in range(50)]), str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    checked(back.collect(), 50, 3)


def test_repeated_rows_empty_table_and_clashing_names(spark):
    schema = "doc_id long, text string, shard string, bucket string, digest int, at int, own int, before int, row int"
    assert s.shard(spark.createDataFrame([], schema), 4).collect() == []
    rows = [(None, None, None, None, None, None, None, None, None)] * 5 + [(1, "a", "x", "y", 1, 2, 3, 4, 5)] * 6
    out = s.shard(spark.createDataFrame(rows, schema), 4)
    checked(out.collect(), 11, 4)
    assert out.columns == ["doc_id", "text", "bucket", "digest", "at", "own", "before", "row", "shard", "slot"]


def test_no_python_on_the_main_path(make_docs):
    plan = s.digest(s.shard(make_docs(["a"]), 4))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rows_alike_are_spread_over_buckets(spark, monkeypatch):
    """A third of all rows alike in every column: no bucket holds them all, and places follow from content."""
    same = [(7, "x" * 40, "en")] * 3000
    rows = same + [(1000 + i, prose(i, 6), "en") for i in range(600)] + [(None, None, None)] * 900
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = []
    original = s.number_copies

    def spied(*args):
        held.append(original(*args))
        return held[-1]

    monkeypatch.setattr(s, "number_copies", spied)
    first = s.shard(df.repartition(3), 6, bucket_bytes=4096).collect()
    checked(first, len(rows), 6)
    assert Counter((r.doc_id, r.text) for r in first) == Counter((r[0], r[1]) for r in rows)
    copies = Counter(r["copy_number"] for r in held[0].where("doc_id = 7").collect())
    assert copies == dict.fromkeys(range(3000), 1)
    buckets = held[0].where("doc_id = 7").selectExpr(f"pmod(xxhash64(1, digest, copy_number), {-(-(3000 * 56 + 600 * 60 + 900 * 16) // 4096)}) as b")
    assert max(r["count"] for r in buckets.groupBy("b").count().collect()) < 150
    again = s.shard(df.repartition(7), 6, bucket_bytes=4096).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    assert min(Counter(r.shard for r in first if r.doc_id == 7).values()) > 400


def test_a_row_a_hundred_thousand_times(spark):
    df = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.repeat(F.lit("y"), F.lit(1000)).alias("text"))
    out = s.shard(df, 8, bucket_bytes=1 << 20).select("shard", "slot")
    found = out.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("a"), F.max("slot").alias("b"), F.countDistinct("slot").alias("d"))
    assert [(r.n, r.a, r.b, r.d) for r in found.collect()] == [(12_500, 0, 12_499, 12_500)] * 8


def test_places_do_not_depend_on_broadcasts(make_docs, monkeypatch, spark):
    docs = make_docs([prose(i % 700, 9) for i in range(900)])

    def places():
        return sorted(map(str, s.shard(docs, 5, bucket_bytes=2048).collect()))

    first = places()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(skew, "BROADCAST_BYTES", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert places() == first
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_very_long_texts_and_few_tasks(make_docs, monkeypatch):
    texts = ["z" * 200_000, prose(1, 5), "", None] + [prose(i, 9) for i in range(60)]
    monkeypatch.setattr(s, "MAX_BUCKETS", 3)
    rows = s.shard(make_docs(texts), 2, bucket_bytes=512).collect()
    checked(rows, len(texts), 2)
    assert sorted(len(r.text or "") for r in rows) == sorted(len(t or "") for t in texts)
