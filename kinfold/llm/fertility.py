"""Quality rules: how well a public vocabulary fits a text, beside plain repetition and size rules.

Each text is encoded whole. Measured are characters per token, the share of tokens that are
fragments of a character (byte fallback) and the entropy of its tokens, corrected for length. Each
language's own texts give its bands: median plus or minus ``width`` robust spreads, wider for short texts,
whose measures scatter more. Texts that fail the base rules don't shape them, the spread is that of the
narrower half of the texts, and the bands are fitted again without the texts far outside, so that junk of
a sixth of a language, or some more, doesn't make its own bands. A language with fewer than ``least``
texts takes the bands of its script, a script with fewer those of the whole corpus.

Defined results: one row per input row, in any order; texts of any length are encoded whole; null and empty texts have zero counts, fail
the base rules and have null measures; a null language counts as the empty one; repeated rows are
repeated; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm import vocabulary
from kinfold.llm.common import WORD, map_batches, staged, strings
from kinfold.operators import skew

WORDS = re.compile(WORD)
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MEASURES = ("chars_per_token", "fragment_share", "token_entropy")
#: Scripts by ranges of code points; the first of the list wins ties.
SCRIPTS = (
    ("latin", ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF))),
    ("greek", ((0x370, 0x3FF),)),
    ("cyrillic", ((0x400, 0x52F),)),
    ("hebrew", ((0x590, 0x5FF),)),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F))),
    ("devanagari", ((0x900, 0x97F),)),
    ("kana", ((0x3040, 0x30FF),)),
    ("hangul", ((0xAC00, 0xD7AF),)),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2A6DF))),
)
ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("lang", pa.string()),
        ("script", pa.string()),
        ("n_words", pa.int64()),
        ("word_chars", pa.int64()),
        ("n_symbols", pa.int64()),
        ("n_dup_lines", pa.int64()),
        ("n_repeat_words", pa.int64()),
        ("n_tokens", pa.int64()),
        *[(m, pa.float64()) for m in MEASURES],
    ]
)
SCHEMA = (
    "doc_id long, lang string, script string, n_words long, word_chars long, n_symbols long,"
    " n_dup_lines long, n_repeat_words long, n_tokens long,"
    " chars_per_token double, fragment_share double, token_entropy double"
)


def script_of(text: str) -> str:
    """The script of most letters; ``other`` without letters of a listed one."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else "other"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = [sum(int(((points >= a) & (points <= b)).sum()) for a, b in ranges) for _, ranges in SCRIPTS]
    best = int(np.argmax(counts))
    return SCRIPTS[best][0] if counts[best] else "other"


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if WORDS.search(line)]
    return len(lines) - len(set(lines))


def repeated_words(words: list[str]) -> int:
    """Words that lie in a window of five words found twice or more."""
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    first: dict[tuple, int] = {}
    inside = bytearray(len(words))
    mark = b"\x01" * WINDOW
    for at, window in enumerate(windows):
        before = first.setdefault(window, at)
        if before != at:
            inside[before : before + WINDOW] = mark
            inside[at : at + WINDOW] = mark
    return sum(inside)


def token_measures(path: str, text: str) -> tuple[int, float | None, float | None, float | None]:
    """Tokens, characters per token, fragment share, entropy in nats with the Miller-Madow correction."""
    ids = vocabulary.encode(path, text)
    n = len(ids)
    if n == 0:
        return 0, None, None, None
    ids.sort()
    ends = np.flatnonzero(np.append(ids[1:] != ids[:-1], True))
    share = np.diff(ends, prepend=-1) / n
    entropy = float(-(share * np.log(share)).sum()) + (len(share) - 1) / (2 * n)
    fragments = int(vocabulary.fragments(path)[ids].sum())
    return n, round(len(text) / n, 4), round(fragments / n, 4), round(entropy, 4)


def measure(batch: pa.RecordBatch, path: str) -> pa.RecordBatch:
    rows: list[tuple] = []
    for text in strings(batch.column("text")):
        words = WORDS.findall(text)
        rows.append(
            (
                script_of(text),
                len(words),
                sum(map(len, words)),
                sum(map(text.count, SYMBOLS)),
                duplicate_lines(text),
                repeated_words(words),
                *token_measures(path, text),
            )
        )
    columns = list(zip(*rows)) or [()] * (len(ARROW) - 2)
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("lang")]
        + [pa.array(c, f.type) for c, f in zip(columns, list(ARROW)[2:])],
        schema=ARROW,
    )


#: Texts with fewer tokens don't shape the bands.
FITTED_TOKENS = 32
#: Spreads beyond which a text no longer shapes the bands, and how often they are fitted again.
TRIMMED, ROUNDS = 4.0, 2
#: Least spread of each measure.
LEAST_SPREAD = {"chars_per_token": 0.05, "fragment_share": 0.01, "token_entropy": 0.05}


def off(m: str) -> Column:
    """Distance from the centre of the band in spreads, which are wider for texts of few tokens.

    The spread is that of the narrower half of the texts: junk lies on one side of the others, so that
    the other half tells how far these scatter.
    """
    q = F.col(f"band_{m}")
    half = F.least(q[1] - q[0], q[2] - q[1]) / 0.6745
    scatter = F.sqrt(1 + F.lit(256.0) / F.greatest(F.col("n_tokens"), F.lit(1)))
    return (F.col(m) - q[1]) / (F.greatest(half, F.lit(LEAST_SPREAD[m])) * scatter)


def fits(width: float) -> Column:
    """Whether a text lies within the bands; null without tokens."""
    return (
        (F.abs(off("chars_per_token")) <= width)
        & (off("fragment_share") <= width)
        & (F.abs(off("token_entropy")) <= width)
    )


def with_bands(measured: DataFrame, band: DataFrame) -> DataFrame:
    if skew.broadcastable(band):
        band = F.broadcast(band)
    return measured.join(band, ["lang", "script"], "left")


def fit_bands(fitted: DataFrame, keys: DataFrame, least: int) -> DataFrame:
    """Quartiles of each measure per language and script, from the finest group that has ``least`` texts."""
    quartiles = [
        F.percentile(m, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(m) for m in MEASURES
    ]
    whole = fitted.agg(*quartiles).first()
    script = fitted.groupBy("script").agg(F.count("*").alias("n"), *quartiles)
    lang = fitted.groupBy("lang", "script").agg(F.count("*").alias("n"), *quartiles)
    joined = (
        keys.join(lang.select("lang", "script", F.struct("n", *MEASURES).alias("l")), ["lang", "script"], "left")
        .join(script.select("script", F.struct("n", *MEASURES).alias("s")), "script", "left")
    )

    def chosen(m: str) -> Column:
        corpus = F.array(*[F.lit(x).cast("double") for x in whole[m] or [None] * 3])
        return (
            F.when(F.col("l.n") >= least, F.col(f"l.{m}"))
            .when(F.col("s.n") >= least, F.col(f"s.{m}"))
            .otherwise(corpus)
        )

    return staged(joined.select("lang", "script", *[chosen(m).alias(f"band_{m}") for m in MEASURES]), "bands")


def bands(measured: DataFrame, least: int) -> DataFrame:
    """One row per language and script: the bands of texts that pass the base rules, fitted again without
    the texts that lie far outside them, so that junk doesn't shape its own bands."""
    fitted = measured.where((F.col("n_tokens") >= FITTED_TOKENS) & ~base_failed())
    keys = measured.select("lang", "script").distinct()
    band = fit_bands(fitted, keys, least)
    for _ in range(ROUNDS):
        inside = with_bands(fitted, band).where(fits(TRIMMED)).select(*measured.columns)
        band = fit_bands(inside, keys, least)
    return band


def base_failed() -> Column:
    """Under 10 words, or more than a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def quality(
    docs: DataFrame,
    vocabulary_path: str = f"{vocabulary.TOKENIZERS}/byte_bpe_multi_50k.tiktoken",
    width: float = 6.0,
    least: int = 200,
) -> DataFrame:
    """One row per text: base counts, base verdict, token measures and ``kept``.

    A text fails the base rules with under 10 words, or more than a fifth of them in repeated
    windows. The method rejects a text whose characters per token or token entropy lie outside
    the bands of its language, or whose fragment share lies above them.
    """
    measured = staged(
        map_batches(
            docs.select(
                F.col("doc_id").cast("long").alias("doc_id"),
                F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
                "text",
            ),
            lambda: lambda batch: measure(batch, vocabulary_path),
            SCHEMA,
        ),
        "fertility",
    )
    failed = base_failed()
    return with_bands(measured, bands(measured, least)).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & F.coalesce(fits(width), F.lit(True))).alias("kept"),
        "script",
        "n_tokens",
        *MEASURES,
    )
