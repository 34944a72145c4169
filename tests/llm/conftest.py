import random

import pytest

SYLLABLES = ("ta", "ro", "min", "del", "sha", "ko", "ver", "lin", "pa", "ne", "su", "gra")


def prose(seed, n):
    """Invented words, a third of them common ones."""
    r = random.Random(seed)
    return " ".join(
        r.choice(("the", "of", "and", "in")) if r.random() < 0.35 else "".join(r.choices(SYLLABLES, k=r.randint(2, 3)))
        for _ in range(n)
    )


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def make_docs(spark):
    """Documents from texts, or from whole rows given as tuples."""

    def make(texts, schema=DOCS):
        rows = [t if isinstance(t, tuple) else (i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture()
def odd_texts():
    """Null, empty, blank, very long, repeated and non-Latin texts."""
    long = prose(1, 20_000)
    return [None, "", " \t\n", long, "word", "word", "Ünïcödé çà ñ 日本語 🙂 text", prose(2, 60), prose(2, 60), "x\x00y   z"]
