import random

import numpy as np
import pytest

from kinfold.llm import decontaminate as d
from tests.llm.conftest import prose


def items(n, seed=3):
    r = random.Random(seed)
    return [(i, f"{prose(seed * 100 + i, r.randint(12, 50))}. {prose(seed * 200 + i, r.randint(1, 12))}.") for i in range(n)]


def scores(part, window_terms):
    """Plain BM25 share of every unit."""
    total, known = {}, set(window_terms)
    for entry, a, b in zip(part.entries, part.first, part.first[1:]):
        if entry // part.n_blocks in known:
            for unit, impact in zip(part.units[a:b].tolist(), part.impacts[a:b].tolist()):
                total[unit] = total.get(unit, 0) + impact
    return {u: round(x, 9) for u, x in total.items() if x >= 1 - 1e-9}


def index_of(own, threshold=0.6):
    units = [u for _, text in own for u in d.units_of(d.words_of(text))]
    frequency = {}
    for u in units:
        for w in set(u):
            frequency[w] = frequency.get(w, 0) + 1
    return d.build_index(own, frequency, len(units), sum(map(len, units)) / len(units), threshold)


def test_wand_finds_all_above_the_bar():
    index = index_of(items(60), 0.25)
    r = random.Random(4)
    found = 0
    for _ in range(200):
        terms = sorted({r.randrange(len(index.vocabulary)) for _ in range(r.randint(1, 90))})
        for part in index.parts:
            want = scores(part, terms)
            got = d.wand(part, np.array(terms), list(range(part.n_blocks)))
            assert {u: round(x, 9) for u, x in got} == want
            found += len(want)
    assert found > 50


def test_closed_blocks_hold_nothing_above_the_bar():
    index = index_of(items(60), 0.3)
    r = random.Random(5)
    for _ in range(100):
        terms = np.array(sorted({r.randrange(len(index.vocabulary)) for _ in range(40)}))
        for part in index.parts:
            blocks = {b for _, b in d.open_blocks(part, np.zeros(len(terms), int), terms)}
            assert {u // d.BLOCK for u in scores(part, terms.tolist())} <= blocks


def test_common_words_are_not_run_through():
    """Many windows at once: open blocks as by adding up every list, with far fewer entries read."""
    common = [f"c{i}" for i in range(8)]
    r = random.Random(6)
    own = []
    for i in range(900):
        words = [w for w in prose(i, 24).split()] + r.choices(common, k=8) + [f"rare{i}", f"rare{i // 3}"]
        r.shuffle(words)
        own.append((i, " ".join(words)))
    index = index_of(own, 0.6)
    assert len(index.parts) >= 1
    windows, words = [], []
    for k in range(40):
        ids = {index.vocabulary[w] for w in d.words_of(own[k][1]) + common if w in index.vocabulary}
        ids |= {r.randrange(len(index.vocabulary)) for _ in range(20)}
        windows += [k] * len(ids)
        words += sorted(ids)
    windows, words = np.array(windows), np.array(words)
    read = every = 0
    for part in index.parts:
        want = {}
        for w, t in zip(windows.tolist(), words.tolist()):
            for e in range(part.word_first[t], part.word_first[t + 1]):
                cell = w, int(part.entries[e] % part.n_blocks)
                want[cell] = want.get(cell, 0) + part.block_max[e]
        assert set(d.open_blocks(part, windows, words)) == {c for c, x in want.items() if x >= 1 - 1e-9}
        read += len(d.asked_entries(part, windows, words)[1])
        every += int((part.word_first[words + 1] - part.word_first[words]).sum())
    assert 0 < read < every / 3


@pytest.fixture(scope="module")
def planted():
    own = items(40)
    texts = []
    for i in range(60):
        text = prose(7000 + i, 30 + 13 * i)
        if i % 3 == 0:
            words = text.split()
            words.insert(len(words) * (i % 5) // 5, own[i % 40][1] if i % 2 else own[i % 40][1].upper())
            text = " ".join(words)
        texts.append(text)
    return own, texts


@pytest.mark.parametrize("piece_words", [1_000_000, 300])
def test_planted_items_are_found_and_nothing_else(spark, make_docs, planted, odd_texts, piece_words):
    own, texts = planted
    texts = texts + odd_texts + [prose(1, 20_000) + " " + own[7][1] + " " + prose(2, 500)]
    benchmark = spark.createDataFrame([*own, (None, None), (77, ""), (78, "...")], "item_id long, text string")
    rows = d.find_leaks(make_docs(texts), benchmark, piece_words=piece_words).collect()
    folded = [" ".join(d.words_of(t or "")) for t in texts]
    want = {(i, k) for i, t in enumerate(folded) for k, x in own if f" {' '.join(d.words_of(x))} " in f" {t} "}
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want)
    assert all(r.question_overlap >= 0.8 and r.answer_overlap >= 0.8 for r in rows)
    kept = d.drop_leaks(make_docs(texts), benchmark, piece_words=piece_words)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {i for i, _ in want}


def test_question_without_answer_is_no_leak(spark, make_docs):
    question, answer = prose(50, 24), prose(51, 16)
    benchmark = spark.createDataFrame([(1, f"{question}. {answer}.")], "item_id long, text string")
    docs = make_docs([f"{prose(52, 40)} {question} {prose(53, 40)}", f"{question}: {answer}"])
    assert [r.doc_id for r in d.find_leaks(docs, benchmark).collect()] == [1]


def test_empty_tables_and_clashing_names(spark, make_docs):
    docs = spark.createDataFrame([], "doc_id long, score int, text string, item_id int")
    benchmark = spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string")
    empty = spark.createDataFrame([], "item_id long, text string")
    assert d.find_leaks(docs, benchmark).collect() == [] and d.drop_leaks(docs, benchmark).columns == docs.columns
    assert d.find_leaks(make_docs(["a"]), empty).collect() == []
    assert d.drop_leaks(make_docs(["a", None]), empty).count() == 2


def edited(words, k):
    """The words with one changed, inserted or deleted at ``k``."""
    return [words[:k] + ["xyzzy"] + words[k + 1 :], words[:k] + ["xyzzy"] + words[k:], words[:k] + words[k + 1 :]]


def test_items_with_one_word_edited_are_found():
    own = items(40) + [(99, f"{prose(9, 70)}. {prose(10, 45)}.")]
    index = index_of(own)
    texts, wanted = [], []
    for place, (_, text) in enumerate(own):
        words, answer = d.words_of(text), index.items[place][3]
        for k in range(len(words)):
            # without its only word, or with none but changed ones, the answer isn't there
            if len(answer) == 1 and k == len(words) - 1:
                continue
            for variant in edited(words, k):
                texts.append(d.words_of(prose(500 + place, 40)) + variant + d.words_of(prose(900 + place, 40)))
                wanted.append(place)
    found = [{f[0] for f in own} for own in d.search(index, texts, 0.6)]
    missed = [w for w, f in zip(wanted, found) if w not in f]
    assert len(missed) <= 0.01 * len(wanted)
    assert not [f for w, f in zip(wanted, found) if f - {w}]


def test_near_copies_need_both_parts():
    question, answer = d.words_of(prose(60, 40)), d.words_of(prose(61, 6))
    index = index_of([(1, f"{' '.join(question)}. {' '.join(answer)}.")])
    around = d.words_of(prose(62, 50))
    texts = [around + question + around, around + question + answer[:2] + around, around + answer + around, around]
    assert d.search(index, texts, 0.6) == [[], [], [], []]
    assert d.search(index, [around + question[:7] + question[8:] + answer[:4] + ["no"] + answer[5:] + around], 0.6)[0]
