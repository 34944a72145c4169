import random
import re
from collections import Counter

import numpy as np
import pytest

from kinfold.llm import fertility as f
from kinfold.llm import vocabulary
from tests.llm.conftest import prose

PATH = f"{vocabulary.TOKENIZERS}/byte_bpe_multi_50k.tiktoken"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = (text or "").split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, dup, len(inside), failed


def test_base_columns_equal_brute_force(make_docs, odd_texts):
    texts = [*odd_texts, "a b c d e f " * 6, "x y z\n\nx y z\n \n \nx y z\r\nx y z", "#a $b <c> " * 9, prose(3, 30) + " " + prose(4, 400) + " " + prose(3, 30)]
    rows = {r.doc_id: r for r in f.quality(make_docs(texts)).collect()}
    for i, text in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text)
        assert not (r.kept and r.base_failed)


def test_measures_equal_a_plain_count():
    text = "Some words, naïve ones 日本 too"
    ids = vocabulary.encode(PATH, text)
    n, per, share, entropy = f.token_measures(PATH, text)
    counts = np.array(list(Counter(ids.tolist()).values())) / n
    assert n == len(ids) and per == round(len(text) / n, 4)
    assert entropy == round(float(-(counts * np.log(counts)).sum()) + (len(counts) - 1) / 2 / n, 4)
    e = vocabulary.encoder(PATH)
    broken = sum(b"\xef\xbf\xbd" in e.decode([int(i)]).encode() for i in ids)
    assert share == round(broken / n, 4)
    assert f.token_measures(PATH, "") == (0, None, None, None)


def test_bands_reject_what_does_not_fit_the_language(make_docs):
    clean = [prose(i, 150) for i in range(300)]
    junk = ["".join(chr(33 + (i * 7 + k * 13) % 90) for k in range(40)) + " " + " ".join(f"%{k}$#{i}~" for k in range(80)) for i in range(6)]
    rows = {r.doc_id: r for r in f.quality(make_docs(clean + junk)).collect()}
    assert all(rows[i].kept for i in range(300))
    assert not any(rows[i].kept for i in range(300, 306))


def test_scripts():
    assert f.script_of("plain") == "latin" and f.script_of("123") == "other"
    assert f.script_of("привет x") == "cyrillic" and f.script_of("日本 ab 漢字漢字") == "han"


def test_empty_table_null_languages_and_clashing_names(spark):
    schema = "doc_id long, text string, lang string, script string, n_words int, band_token_entropy int"
    assert f.quality(spark.createDataFrame([], schema)).collect() == []
    docs = spark.createDataFrame([(None, None, None, "q", 1, 2), (None, prose(1, 40), None, "q", 1, 2)], schema)
    assert sorted(r.n_words for r in f.quality(docs).collect()) == [0, 40]


@pytest.mark.parametrize("share", [0.01, 0.05, 0.16])
def test_junk_does_not_make_its_own_bands(make_docs, share):
    """Words of random letters or hex digits, 12 to 200 of them, beside ordinary texts of all lengths."""
    r = random.Random(6)
    clean = [prose(i, r.choice([30, 60, 120, 300])) for i in range(600)]
    junk = []
    for i in range(int(len(clean) * share / (1 - share)) + 1):
        alphabet = r.choice(["abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"])
        n = r.choice([12, 25, 50, 200])
        junk.append((n, " ".join("".join(r.choices(alphabet, k=r.randint(3, 9))) for _ in range(n))))
    rows = {x.doc_id: x for x in f.quality(make_docs(clean + [t for _, t in junk])).collect()}
    assert sum(rows[i].kept for i in range(600)) >= 590
    long = [i for i, (n, _) in enumerate(junk) if n >= 25]
    assert sum(rows[600 + i].kept for i in long) <= 0.05 * len(long)
    assert sum(rows[600 + i].kept for i in range(len(junk))) <= 0.3 * len(junk)
