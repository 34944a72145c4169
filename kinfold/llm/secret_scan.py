"""Secrets: fixed patterns, and a battery of randomness tests on every other long token.

A token that fits a known encoding is read as a sequence of symbols and tested against the
hypothesis "uniformly random": a chi-squared test of alphabet uniformity, a runs test, a lag-1
serial-correlation test and a serial test of repeated pairs, joined by Fisher's method. Random tokens have uniform p-values, ordinary
ones small ones. A run of token characters is cut at every ``=`` that does not end it; what stands
between is tested whole, by its segments between slashes, and by theirs between other marks, so that
a key is not diluted by the name or path before it. The outermost accepted one is the span. Tokens
without digits are read in alphabets of their own. For each encoding and length class the corpus-wide p-value histogram says how many
tokens are random (Storey's estimate from the upper half), and the smallest p-value is accepted at
which the estimated share of ordinary tokens among the accepted stays under ``max_false``. Where a
class holds too few tokens for that, its neighbours are counted with it, and other encodings only if
its own has few tokens at all.

Defined results: one row per input row, in any order; null or empty texts have no spans; repeated
rows are repeated; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from kinfold.llm.common import map_batches, staged, strings

# The patterns of the base kinds, in their order.
ASSIGN = re.compile(
    r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: What is tested of a token: what stands between ``=``, in it what stands between ``/``, and in that
#: what stands between other marks.
CUTS = (
    re.compile(r"[A-Za-z0-9+/_-]+(?:=+\Z)?"),
    re.compile(r"[A-Za-z0-9+_-]+(?:=+\Z)?"),
    re.compile(r"[A-Za-z0-9]+(?:=+\Z)?"),
)
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Letters from common to rare ones in ordinary words, so that slices of the alphabet tell words apart.
COMMON = "eanirstoludcmpghbvfzkqywjx"
MIXED = COMMON + COMMON.upper()
#: The alphabets a token is read in, the first that holds all its characters, and the symbols of the
#: encoding that it counts as: one without digits may be any encoding's, less its digits.
ENCODINGS = (
    ("lower", COMMON, 26),
    ("upper", COMMON.upper(), 32),
    ("letters", MIXED, 62),
    ("letters64", MIXED + "+/", 64),
    ("letters64url", MIXED + "-_", 64),
    ("hex", DIGITS + "abcdef", 16),
    ("hex_upper", DIGITS + "ABCDEF", 16),
    ("base32", UPPER + "234567", 32),
    ("base62", DIGITS + UPPER + LOWER, 62),
    ("base64", UPPER + LOWER + DIGITS + "+/", 64),
    ("base64url", UPPER + LOWER + DIGITS + "-_", 64),
)
BINS = 20
ENOUGH, FEW, FEW_TOKENS = 100, 10, 30
SCHEMA = (
    "doc_id long, base array<struct<start:int,kind:int,end:int>>,"
    " tested array<struct<start:int,end:int,stratum:int,p:double,around:array<struct<stratum:int,p:double>>>>"
)
RESULT = [("stratum", pa.int32()), ("p", pa.float64())]
ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("base", pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))),
        (
            "tested",
            pa.list_(
                pa.struct(
                    [("start", pa.int32()), ("end", pa.int32()), *RESULT, ("around", pa.list_(pa.struct(RESULT)))]
                )
            ),
        ),
    ]
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns, leftmost and non-overlapping per kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def chi_squared_tail(x: float, k: int) -> float:
    """Upper tail of the chi-squared distribution, by the cube-root normal approximation."""
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def uniformity(values: np.ndarray, size: int) -> float:
    """Chi-squared over equal slices of the alphabet, about five symbols expected in each."""
    cells = int(min(size, max(2, len(values) // 5)))
    edges = np.arange(cells + 1) * size // cells
    seen = np.histogram(values, edges)[0]
    expected = np.diff(edges) / size * len(values)
    return chi_squared_tail(float(((seen - expected) ** 2 / expected).sum()), cells - 1)


def runs(values: np.ndarray, size: int) -> float:
    """Two-sided runs test of upper against lower half of the alphabet."""
    high = values >= size / 2
    n, a = len(high), int(high.sum())
    b = n - a
    if a == 0 or b == 0:
        return 2.0 ** (1 - n)
    mean = 2 * a * b / n + 1
    spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    return math.erfc(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / spread / math.sqrt(2))


def serial(values: np.ndarray) -> float:
    """Two-sided test of the correlation between neighbouring symbols."""
    v = values - values.mean()
    total = float((v * v).sum())
    if total == 0:
        return 0.0
    n = len(v)
    r = float((v[1:] * v[:-1]).sum()) / total
    return math.erfc(abs(r + 1 / n) * math.sqrt(n) / math.sqrt(2))


def repeated_pairs(values: np.ndarray, size: int, token: str) -> float:
    """Serial test of pairs: how many neighbouring pairs of symbols are equal to another one, which random
    symbols seldom have and words often; Poisson, with equal outcomes spread by a hash of the token."""
    n = len(values) - 1
    seen = np.unique(values[:-1] * size + values[1:], return_counts=True)[1]
    found, expected = int((seen * (seen - 1) // 2).sum()), n * (n - 1) / 2 / size**2
    own, above = math.exp(-expected), 1.0
    for k in range(found + 1):
        above -= own
        if k < found:
            own *= expected / (k + 1)
    return min(1.0, max(above, 0.0) + (zlib.crc32(token.encode()) + 0.5) / 2**32 * own)


def battery(token: str) -> tuple[int, float] | None:
    """Encoding number and joint p-value, or None when no alphabet fits."""
    body = token.rstrip("=")
    letters = set(body)
    if letters <= set(DIGITS):
        return None
    for number, (_, alphabet, _) in enumerate(ENCODINGS):
        if letters <= set(alphabet):
            values = np.array([alphabet.index(c) for c in body], dtype=float)
            size = len(alphabet)
            tests = uniformity(values, size), runs(values, size), serial(values), repeated_pairs(values, size, body)
            half = -sum(math.log(max(p, 1e-300)) for p in tests)
            return number, math.exp(-half) * (1 + half + half**2 / 2 + half**3 / 6)
    return None


def length_class(n: int) -> int:
    """Eight classes per doubling of the length."""
    return int(8 * math.log2(n))


def candidates(text: str, start: int, end: int, level: int, min_bits: int, spans: list, around: list) -> list[dict]:
    """What is tested of a run of token characters, each with the results of those around it."""
    rows = []
    for m in CUTS[level].finditer(text[start:end]):
        a, b, own = start + m.start(), start + m.end(), around
        body = m[0].rstrip("=")
        if len(body) * 6 < min_bits:
            continue
        # a whole that is the same as what is around it was tested there
        if not (level and (a, b) == (start, end)) and not any(s < b and a < e for s, _, e in spans):
            result = battery(m[0])
            if result is not None and len(body) * math.log2(ENCODINGS[result[0]][2]) >= min_bits:
                row = {"stratum": 1000 * result[0] + length_class(len(body)), "p": result[1]}
                rows.append({"start": a, "end": b, **row, "around": around})
                own = [*around, row]
        if level + 1 < len(CUTS):
            rows += candidates(text, a, b, level + 1, min_bits, spans, own)
    return rows


def measure(batch: pa.RecordBatch, min_bits: int) -> pa.RecordBatch:
    base, tested = [], []
    for text in strings(batch.column("text")):
        spans = base_spans(text)
        rows = []
        for m in TOKEN.finditer(text):
            near = [x for x in spans if x[0] < m.end() and m.start() < x[2]]
            rows += candidates(text, m.start(), m.end(), 0, min_bits, near, [])
        base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
        tested.append(rows)
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(base, ARROW.field("base").type), pa.array(tested, ARROW.field("tested").type)],
        schema=ARROW,
    )


def pools(strata: list[int], own: int) -> Iterator[tuple[list[int], int]]:
    """The stratum, then with ever more neighbouring lengths of its encoding, then with all encodings,
    each with the tokens that its upper half must hold, or the whole encoding be."""
    lengths = [x for x in strata if x // 1000 == own // 1000]
    reach, widest = 0, max(abs(x - own) for x in lengths)
    while reach < widest:
        yield [x for x in lengths if abs(x - own) <= reach], ENOUGH
        reach = 2 * reach or 1
    yield lengths, FEW
    yield strata, 0


def cut_offs(histogram: list[Row], max_false: float) -> dict[int, float]:
    """The smallest accepted p-value of each stratum under the false-discovery bound.

    A stratum's estimate is made from the smallest of its pools whose upper half holds ``ENOUGH``
    tokens, that of all encodings only if its own holds under ``FEW`` of ``FEW_TOKENS`` at most. The upper
    half counts one more (the finite-sample form of the estimate), but not for the lowest bin, where
    ordinary tokens are. Where that bin holds no more than chance would put there, nothing speaks for
    ordinary tokens, and three standard errors of the estimate are allowed."""
    by_stratum: dict[int, np.ndarray] = {}
    for row in histogram:
        by_stratum.setdefault(row["stratum"], np.zeros(BINS))[row["bin"]] = row["n"]
    strata, cuts = sorted(by_stratum), {}
    for stratum in strata:
        for pool, needed in pools(strata, stratum):
            counts = sum(by_stratum[x] for x in pool)
            upper = counts[BINS // 2 :].sum()
            if upper >= needed or (needed == FEW and counts.sum() >= FEW_TOKENS):
                break
        by_chance = counts[1:].sum() / (BINS - 1)
        even = counts[0] <= by_chance + 3 * math.sqrt(max(by_chance, 1.0))
        for b in range(BINS):
            accepted, share = counts[b:].sum(), 1 - b / BINS
            random = 2 * (upper + (b > 0)) * share
            error = 3 * math.sqrt(upper * max(2 * share - 1, 0) * 2 * share) if even else 0
            if accepted and accepted - random <= max_false * accepted + error:
                cuts[stratum] = b / BINS
                break
    return cuts


def find_secrets(docs: DataFrame, min_bits: int = 80, max_false: float = 0.05) -> DataFrame:
    """``doc_id`` and ``spans``: array of (start, kind, end) in code points, end exclusive, sorted by
    start, then kind in the order of ``KINDS``.

    ``min_bits``: least size, in bits of its alphabet, of a token that is tested; shorter ones give the
    tests no power. ``max_false``: bound on the share of ordinary tokens among the random ones.
    Texts are read once; what is collected is one histogram, bounded by encodings, length classes
    and bins.
    """
    measured = staged(
        map_batches(
            docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
            lambda: lambda batch: measure(batch, min_bits),
            SCHEMA,
        ),
        "secrets",
    )
    token = measured.select(F.explode("tested").alias("t")).select(
        F.col("t.stratum").alias("stratum"),
        F.least(F.floor(F.col("t.p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"),
    )
    cuts = cut_offs(token.groupBy("stratum", "bin").agg(F.count("*").alias("n")).collect(), max_false)
    if cuts:
        limit = F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair])

        def is_random(t: Column) -> Column:
            return F.coalesce(t["p"] >= F.element_at(limit, t["stratum"]), F.lit(False))

        random = F.transform(
            F.filter("tested", lambda t: is_random(t) & ~F.exists(t["around"], is_random)),
            lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")),
        )
        spans = F.array_sort(F.concat("base", random))
    else:
        spans = F.array_sort("base")
    return measured.select("doc_id", spans.alias("spans"))


def rendered(spans: Column) -> Column:
    """Spans as ``kind:start:end`` texts, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def digest(found: DataFrame) -> DataFrame:
    """The contract columns from the spans."""
    base = F.filter("spans", lambda s: s["kind"] < 3)

    def number(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(rendered(base).cast("binary"), 256).alias("base_sha256"),
        rendered(F.col("spans")).alias("spans"),
    )
