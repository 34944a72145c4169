import random
import zlib

import numpy as np
import pytest

from kinfold.llm import toxicity as t
from kinfold.llm.common import held_out
from tests.llm.conftest import prose


def corpus(n, seed=1):
    """A quarter of the texts holds words of two invented stems or of the fixed lists."""
    r = random.Random(seed)
    bad = [f"grumf{x}" for x in ("a", "ello", "is", "or")] + ["snorvel", "moron", "pathetic"]
    rows = []
    for i in range(n):
        words = prose(1000 * seed + i, r.randint(20, 80)).split()
        toxic = i % 4 == 0
        for _ in range(r.randint(1, 4) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(bad))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def fitted(spark):
    rows = corpus(800)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    # every second row is labelled, some twice, and some labels are missing
    labels = [(i, 1, y) for i, _, y in rows if i % 8 < 5] + [(0, 1, rows[0][2]), (None, 1, 1), (1, 1, None)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return rows, docs, frame, t.fit_toxicity(docs, frame)


def test_held_out_accuracy(fitted):
    rows, docs, _, model = fitted
    scored = {r.doc_id: r for r in t.score_toxicity(docs, model).collect()}
    own = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    right = np.mean([scored[i].predicted == rows[i][2] for i in own])
    assert len(own) > 100 and right > 0.97
    assert all((r.score >= 0.5) == (r.predicted == 1) and 0 <= r.score <= 1 for r in scored.values())


def test_labels_of_held_out_rows_change_nothing(spark, fitted):
    rows, docs, labels, model = fitted
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = t.fit_toxicity(docs, turned)
    assert again.mined == model.mined
    assert np.allclose(again.word_weights, model.word_weights)


def test_label_model_finds_rates_and_correlations(spark):
    rng = np.random.default_rng(3)
    y = rng.random(20_000) < 0.2
    votes = np.zeros((len(y), t.MASK_BITS), int)
    for j in range(6):
        votes[:, j] = rng.random(len(y)) < np.where(y, 0.5, 0.02)
    votes[:, 6] = votes[:, 5]  # repeats another voter
    known = rng.random(len(y)) < 0.5
    votes[:, t.VOTERS] = known & y
    votes[:, t.VOTERS + 1] = known & ~y
    masks, n = np.unique((votes << np.arange(t.MASK_BITS)).sum(1), return_counts=True)
    patterns = spark.createDataFrame([(int(m), int(k)) for m, k in zip(masks, n)], "mask long, n long")
    theta = t.fit_label_model(patterns, 12)
    assert abs(theta["prior"] - 0.2) < 0.03
    assert np.allclose(theta["toxic"][:6], 0.5, atol=0.06) and np.allclose(theta["other"][:6], 0.02, atol=0.02)
    assert theta["correlation"][5][6] > 0.9 and abs(theta["correlation"][0][1]) < 0.2
    assert theta["discount"][6] < 0.6 < theta["discount"][0]


def test_votes_equal_plain_search():
    votes = t.Votes(("^grum", "snorvel"))
    mask, words = votes("A moron; grumble grum xgrumble snorvels SNORVEL you are a!!")
    assert words == [0, 1]
    assert mask & 1 and mask >> len(t.LEXICONS) & 1 and mask >> len(t.LEXICONS) + 1 & 1
    assert votes("oxymorons remoron moronic") == (0, [])
    assert votes("") == (0, [])


def test_odd_texts_and_filter(fitted, make_docs, odd_texts):
    _, _, _, model = fitted
    docs = make_docs([*odd_texts, "such a pathetic moron, snorvel grumfello"])
    scored = t.score_toxicity(docs, model).collect()
    assert len(scored) == len(odd_texts) + 1
    kept = t.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(len(odd_texts)))


def test_without_labels_or_texts(spark):
    docs = spark.createDataFrame([(1, "a moron and an idiot"), (2, None), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = t.fit_toxicity(docs, labels)
    assert len(t.score_toxicity(docs, model).collect()) == 3
    none = spark.createDataFrame([], "doc_id long, text string, score double, mask int")
    model = t.fit_toxicity(none, labels)
    assert t.score_toxicity(none, model).collect() == [] and t.drop_toxic(none, model).columns == none.columns
