import random
import re

from pyspark.sql import functions as F

from kinfold.llm import queries
from kinfold.llm import url_filter as u

RULES = queries.URL_RULES
SCHEMA = "page_id long, url string"


def parts(url):
    if url is None or "://" not in url:
        return "", "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    query = re.match(r"\?([^#]*)", rest[len(host) + len(path) :])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path, query[1] if query else ""


def canonical(url):
    host, path, query = parts(url)
    if not host:
        return None
    kept = sorted(p for p in query.split("&") if p and not re.match(u.TRACKING, p))
    return re.sub(r"^www\.", "", host) + path.rstrip("/") + ("?" + "&".join(kept) if kept else "")


def verdict(url, listed):
    host, path, _ = parts(url)
    best = None
    for text, what in RULES:
        own, _, rest = text.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest) and (best is None or len(text) > len(best[0])):
            best = (text, what)
    if best:
        return (host, path, *best)
    return host, path, None, "block" if canonical(url) in listed and canonical(url) else "allow"


def urls(seed, n):
    r = random.Random(seed)
    hosts = ["example.org", "www.Example.ORG", "a.example.org", "notexample.org", "x.com", "com", "WWW.site.net", "site.net", "org", "é.net", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12/", "/fr/a", "/de/", "/page//", "/En/1"]
    tails = ["", "?b=2&a=1", "?a=1&b=2", "?utm_x=1", "#f", "?ref=q#f?z", "?", "#/es/"]
    out = [f"{r.choice(['http', 'https', 'x'])}://{r.choice(hosts)}{r.choice(paths)}{r.choice(tails)}" for _ in range(n)]
    return [*out, None, "", "no scheme", "://", "http://a://b/c", "h\n://x.net/p\nq"]


def test_verdicts_equal_brute_force(spark):
    own, block = urls(1, 500), urls(2, 40)
    listed = {canonical(x) for x in block}
    pages = spark.createDataFrame(list(enumerate(own)), SCHEMA)
    rows = u.judge(pages, spark.createDataFrame([(x,) for x in block + block], "url string"), RULES).collect()
    assert {r.page_id: tuple(r)[2:] for r in rows} == {i: verdict(x, listed) for i, x in enumerate(own)}
    assert len(rows) == len(own)


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("k"))
    n_blocks = 4000 * u.BITS_PER_KEY // 512
    filled = u.bloom(keys, "k", n_blocks)
    probe = spark.range(8000).select("id", F.concat(F.lit("k"), "id").alias("k")).withColumn("block", u.block_of(F.col("k"), n_blocks))
    hit = F.lit(True)
    for i in range(u.WORDS):
        hit = hit & (F.col(f"w{i}").bitwiseAND(u.bit_of(F.col("k"), i)) != 0)
    ids = {r.id for r in probe.join(filled, "block").where(hit).collect()}
    assert set(range(4000)) <= ids and len(ids) < 4000 + 80


def test_a_filter_too_large_to_broadcast_judges_alike(spark, monkeypatch):
    pages = spark.createDataFrame(list(enumerate(urls(3, 200))), SCHEMA)
    listed = spark.createDataFrame([(x,) for x in urls(4, 60)], "url string")
    want = sorted(map(str, u.judge(pages, listed, RULES).collect()))
    monkeypatch.setattr(u, "BROADCAST_BYTES", 0)
    assert sorted(map(str, u.judge(pages, listed, RULES).collect())) == want


def test_empty_tables_and_clashing_names(spark):
    schema = "host string, url string, verdict int, canonical_url string, filter_block int, listed_url int, w0 int"
    listed = spark.createDataFrame([], "url string")
    assert u.judge(spark.createDataFrame([], schema), listed, RULES).collect() == []
    rows = u.judge(spark.createDataFrame([("h", "http://x.net/a", 1, "c", 2, 3, 4)], schema), listed, []).collect()
    assert rows[0].asDict() == {"url": "http://x.net/a", "canonical_url": "c", "filter_block": 2, "listed_url": 3, "w0": 4, "host": "x.net", "path": "/a", "rule": None, "verdict": "allow"}


def test_no_python_on_the_main_path(spark):
    pages = spark.createDataFrame(list(enumerate(urls(1, 5))), SCHEMA)
    judged = u.judge(pages, pages.select("url"), RULES)
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
