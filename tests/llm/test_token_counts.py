import pytest
from tokenizers import Tokenizer

from kinfold.llm import token_counts as t
from kinfold.llm import vocabulary
from tests.llm.conftest import prose

TEXTS = ["One line", "a\nb\n\n\nc", "x\n\n", "ünï 日本語 🙂🙂\n  two  \n", "", None, prose(1, 3000) + "\n" + prose(2, 50), "\n"]


@pytest.fixture(scope="module")
def other():
    """The same vocabulary in another library, which has offsets of its own."""
    own = Tokenizer.from_file(f"{vocabulary.TOKENIZERS}/byte_bpe_50k.json")
    own.encode_special_tokens = True
    return own


def brute(own, text, source):
    """Tokens by their first character in sections of whole lines."""
    document = f"{source or ''}\n{text or ''}"
    starts = [a for a, _ in own.encode(document, add_special_tokens=False).offsets]
    edges, at = [], 0
    for part in [(source or "") + "\n", *t.cut(text or "")]:
        edges.append((at, at + len(part)))
        at += len(part)
    return [sum(a <= s < b for s in starts) for a, b in edges], edges


def test_counts_equal_another_library(make_docs, other):
    docs = make_docs([(i, x, "en", f"src{i}" if i % 2 else None, 0) for i, x in enumerate(TEXTS)])
    rows = t.count_tokens(docs, ["source", "text"], split=["text"]).collect()
    for i, text in enumerate(TEXTS):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: (r.field != "source", r.section))
        counts, edges = brute(other, text, f"src{i}" if i % 2 else None)
        assert [(r.first_char, r.last_char) for r in own] == edges
        assert [r.n_tokens for r in own] == counts


@pytest.mark.parametrize("rule", t.RULES)
def test_every_rule_keeps_the_total(rule):
    path = f"{vocabulary.TOKENIZERS}/byte_bpe_50k.tiktoken"
    for text in filter(None, TEXTS):
        n = len(text)
        cuts = sorted({0, n, *range(0, n, 7)})
        spans = [(0, k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        counts, _ = t.attribute(path, text, spans, rule)
        assert counts.sum() == pytest.approx(len(vocabulary.encode(path, text)))


def test_rules_on_a_crossing_token():
    path = f"{vocabulary.TOKENIZERS}/byte_bpe_50k.tiktoken"
    assert len(vocabulary.encode(path, " something")) == 1
    spans = [(0, 0, 0, 3), (0, 1, 3, 3), (0, 2, 3, 10)]
    got = {rule: t.attribute(path, " something", spans, rule) for rule in t.RULES}
    assert got["first"][0].tolist() == [1, 0, 0]
    assert got["most"][0].tolist() == [0, 0, 1]
    assert got["share"][0].tolist() == pytest.approx([0.3, 0, 0.7])
    assert got["first"][1].tolist() == [1, 0, 1]


def test_empty_table_nulls_and_clashing_names(spark):
    schema = "doc_id long, text string, section string, field string, f0 int"
    assert t.count_tokens(spark.createDataFrame([], schema), ["text"]).collect() == []
    rows = t.count_tokens(spark.createDataFrame([(None, None, "s", "f", 1), (None, "a b", "s", "f", 1)], schema), ["text", "section"]).collect()
    assert sorted((r.field, r.n_tokens) for r in rows) == [("section", 1.0), ("section", 1.0), ("text", 1.0), ("text", 3.0)]
    with pytest.raises(ValueError):
        t.count_tokens(spark.createDataFrame([], schema), ["text"], rule="other")
