"""URL filters: rules, then a blocked Bloom filter of listed URLs and an exact join. DataFrame only.

A URL is first judged by the longest fitting rule. All others are compared, in canonical form, with
the list: a key of the list sets one bit in each of the eight longs of one block of the filter, so a
probe reads one block. URLs whose bits are all set may be listed; only those go on to a hash join with
the listed URLs themselves, which removes the false positives.

Defined results: null URLs and those without ``://`` have empty host and path, fit no rule, are never
listed and are allowed; nulls and repeats in the list count for nothing; repeated rows are repeated;
added columns take the place of like-named ones; an empty list allows all that no rule blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import is_heavy, lookup, staged, unused

ALLOW, BLOCK = "allow", "block"
WORDS = 8
BITS_PER_KEY = 16
#: Largest filter that is broadcast; a larger one is joined by block, and Spark splits skewed blocks.
BROADCAST_BYTES = 32 << 20
#: Longest URL that can be broadcast as a heavy key, so that all of them stay small.
LONGEST_HEAVY = 1024
#: Query parameters that name no other page.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)="
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def host_of(url: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without trailing slashes, parameters sorted and without tracking;
    null for a URL without host."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    parts = F.filter(F.split(F.regexp_extract(url, PARTS, 3), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.array_sort(parts), "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def ruled(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does. A rule is ``host/path``."""
    rule = verdict = F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def block_of(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(n_blocks))


def bit_of(key: Column, word: int) -> Column:
    """One of 64 bits: six bits of the key's second hash for each word."""
    at = F.shiftright(F.xxhash64(key, F.lit("bits")), 6 * word).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def bloom(listed: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """``block, w0 .. w7`` of the blocks that hold a key."""
    words = [F.bit_or(bit_of(F.col(key), i)).alias(f"w{i}") for i in range(WORDS)]
    return listed.groupBy(block_of(F.col(key), n_blocks).alias("block")).agg(*words)


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """All rows with ``host``, ``path``, ``rule`` and ``verdict``; ``listed(url)`` are the URLs to block."""
    added = ("host", "path", "rule", "verdict")
    source = F.col(f"`{url}`")
    key, block, hit = unused(pages, "canonical_url"), unused(pages, "filter_block"), unused(pages, "listed_url")
    keys = staged(listed.select(canonical(F.col("url")).alias(key)).where(F.col(key).isNotNull()).distinct(), "listed")
    n_keys = keys.count()
    n_blocks = max(1, -(-n_keys * BITS_PER_KEY // (64 * WORDS)))
    filled = bloom(keys, key, n_blocks)
    if n_blocks * 8 * (WORDS + 1) <= BROADCAST_BYTES:
        filled = F.broadcast(filled)

    host, path = host_of(source), path_of(source)
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    kept = [f"`{c}`" for c in pages.columns if c.lower() not in added]
    split = pages.select(*kept, canonical(source).alias(key), host.alias("host"), path.alias("path"))
    split = split.withColumn("rule", rule).withColumn("verdict", verdict)
    probe = split.withColumn(block, F.when(F.col("verdict").isNull(), block_of(F.col(key), n_blocks)))
    words = unused(pages, "filter_words")
    maybe = F.lit(True)
    for i in range(WORDS):
        maybe = maybe & (F.col(words)[i].bitwiseAND(bit_of(F.col(key), i)) != 0)
    tested = filled.select(F.col("block").alias(block), F.array(*[f"w{i}" for i in range(WORDS)]).alias(words))
    result = [*kept, "host", "path", "rule"]

    open_rows = probe.where(F.col("verdict").isNull() & F.col(key).isNotNull())
    closed = probe.where(F.col("verdict").isNotNull() | F.col(key).isNull())
    passed = open_rows.join(tested, block, "left").withColumn(hit, F.coalesce(maybe, F.lit(False)))
    allowed = passed.where(~F.col(hit))
    possible = passed.where(F.col(hit)).drop(hit)
    # each possible URL once, so the join with the list moves no page; then back by URL, hot ones by broadcast
    counts = staged(possible.groupBy(key).agg(F.count("*").alias("n")), "possible")
    rows = counts.agg(F.sum("n")).first()[0] or 0
    exact = keys.withColumn(hit, F.lit(True)).hint("shuffle_hash")
    proven = counts.join(exact, key, "left").select(
        key,
        (is_heavy(F.col("n"), rows) & (F.length(key) <= LONGEST_HEAVY)).alias("heavy"),
        F.when(F.col(hit), F.lit(BLOCK)).otherwise(F.lit(ALLOW)).alias("verdict"),
    )
    decided = lookup(possible.drop("verdict"), staged(proven, "proven"), key, "verdict")
    return (
        closed.select(*result, F.coalesce("verdict", F.lit(ALLOW)).alias("verdict"))
        .unionByName(allowed.select(*result, F.lit(ALLOW).alias("verdict")))
        .unionByName(decided.select(*result, "verdict"))
    )
