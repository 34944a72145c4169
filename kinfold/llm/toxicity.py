"""Toxicity by weak supervision: many weak voters, a label model, a linear classifier.

1. *Voters.* Short fixed word lists, phrase and shape patterns, and word lists mined from labelled
   rows: whole words and word beginnings that are far commoner in toxic than in other texts, dealt
   into lists. Annotations are a voter like any other.
2. *Label model.* Two latent classes, fitted by expectation maximisation on the vote patterns of all
   texts: each voter's rate of firing in either class. The votes' correlations inside the toxic class
   are then estimated, and each voter's evidence is divided by how much of it other voters repeat.
3. *Classifier.* Logistic regression on the posterior labels, over voters and mined words.

Labels of held-out rows are never read; language, source, ids and labels are no inputs of a score.

Defined results: one row per input row; null and empty texts score what the intercept gives;
conflicting labels of one id count by majority, ties and null labels not at all; repeated rows score
alike; with no labels or no texts the model has only its fixed voters.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import held_out, map_batches, staged, strings

#: Fixed word lists, one voter each.
LEXICONS = (
    ("idiot", "idiots", "moron", "morons", "imbecile", "stupid", "dumbass", "dimwit", "cretin", "halfwit"),
    ("loser", "losers", "pathetic", "worthless", "useless", "clown", "laughable", "failure"),
    ("scum", "trash", "vermin", "subhuman", "parasite", "disgusting", "filthy", "garbage"),
    ("dummkopf", "idioten", "abschaum", "versager", "widerlich", "wertlos", "arschloch", "schwachkopf"),
    ("imbécile", "crétin", "abruti", "minable", "ordure", "dégoûtant", "connard", "débile"),
    ("idiota", "imbécil", "estúpido", "basura", "escoria", "asqueroso", "patético", "perdedor"),
)
PHRASES = ("you are a", "you're a", "shut up", "kill yourself", "du bist ein", "tu es un", "eres un")
SHOUTING = re.compile(r"\b[A-Z]{4,}(?: [A-Z]{4,})+")
MASKED = re.compile(r"[a-z][*@$]{1,3}[a-z]")
WORDS = re.compile(r"[^\W\d_]+")
BEGINNINGS = (3, 4, 5, 6)
SHINGLE = 5

FIXED = len(LEXICONS) + 4
MINED_LISTS = 10
VOTERS = FIXED + MINED_LISTS
#: The two annotation votes follow the voters in a vote mask.
MASK_BITS = VOTERS + 2

VOTES = pa.schema([("doc_id", pa.int64()), ("mask", pa.int64()), ("words", pa.list_(pa.int32()))])


@dataclass(frozen=True)
class ToxicityModel:
    """All a score needs. Its size is bounded by ``max_words`` mined words."""

    mined: tuple[str, ...] = ()
    bias: float = -3.0
    voter_weights: tuple[float, ...] = (2.0,) * VOTERS
    word_weights: tuple[float, ...] = ()
    accuracies: dict = field(default_factory=dict)


def features(text: str) -> set[str]:
    """Distinct words, and as ``^abc`` the beginnings of longer ones."""
    words = set(WORDS.findall(text.lower()))
    return words | {f"^{w[:k]}" for w in words for k in BEGINNINGS if len(w) > k}


class Votes:
    """Votes and mined words of one text, by one pass of an automaton over it."""

    def __init__(self, mined: tuple[str, ...]):
        self.automaton = ahocorasick.Automaton()
        entries: dict[str, list[tuple[int, int]]] = {}  # text -> (kind, number)
        for k, lexicon in enumerate(LEXICONS):
            for word in lexicon:
                entries.setdefault(word, []).append((0, k))
        for phrase in PHRASES:
            entries.setdefault(phrase, []).append((0, len(LEXICONS)))
        for i, word in enumerate(mined):
            entries.setdefault(word.removeprefix("^"), []).append((2 if word[0] == "^" else 1, i))
        for word, uses in entries.items():
            self.automaton.add_word(word, (len(word), uses))
        self.automaton.make_automaton()

    def __call__(self, text: str) -> tuple[int, list[int]]:
        low = text.lower()
        mask, words, size = 0, set(), len(low)
        for last, (length, uses) in self.automaton.iter(low):
            start = last + 1 - length
            if start and (low[start - 1].isalnum() or low[start - 1] == "_"):
                continue
            longer = last + 1 < size and (low[last + 1].isalnum() or low[last + 1] == "_")
            for kind, number in uses:
                if kind == 0 and not longer:
                    mask |= 1 << number
                elif (kind == 1 and not longer) or (kind == 2 and longer):
                    words.add(number)
        if "!!" in text:
            mask |= 1 << len(LEXICONS) + 1
        if SHOUTING.search(text):
            mask |= 1 << len(LEXICONS) + 2
        if MASKED.search(text):
            mask |= 1 << len(LEXICONS) + 3
        for number in words:
            mask |= 1 << FIXED + number % MINED_LISTS
        return mask, sorted(words)


def usable_labels(labels: DataFrame) -> DataFrame:
    """``(doc_id, y)`` of the rows that labels may be learned from."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.avg(F.col("toxic").cast("double")).alias("mean"))
        .where("mean <> 0.5")
        .select("doc_id", F.when(F.col("mean") > 0.5, 1).otherwise(0).alias("y"))
    )


def sampled(rows: DataFrame, bound: int, seed: int) -> DataFrame:
    """At most about ``bound`` rows, chosen by a seeded hash of the id."""
    n = rows.count()
    if n <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * bound / n))


def with_key(batches):
    """Adds the smallest hash of the five-word shingles: near copies mostly share it."""
    schema = pa.schema([("key", pa.int64()), ("y", pa.int32()), ("text", pa.string())])
    for batch in batches:
        keys = []
        for text in strings(batch.column("text")):
            words = WORDS.findall(text.lower())
            runs = zip(*(words[k:] for k in range(SHINGLE))) if len(words) >= SHINGLE else [words]
            keys.append(min(xxhash.xxh64_intdigest(x) for x in map(" ".join, runs)) >> 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), batch.column("y").cast(pa.int32()), batch.column("text").cast(pa.string())], schema=schema
        )


def mine(docs: DataFrame, labels: DataFrame, mine_rows: int, max_words: int, least_evidence: float) -> tuple:
    """Words and beginnings that mark toxic texts, strongest first.

    From at most ``mine_rows`` labelled rows, whose ids (a bounded table) are broadcast. Near copies
    count once: of the texts that share their smallest five-word shingle hash only one is used.
    """
    chosen = F.broadcast(sampled(labels, mine_rows, 11))
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(chosen, "doc_id")
    texts = (
        labelled.select("text", "y")
        .mapInArrow(with_key, "key long, y int, text string")
        .groupBy("key", "y")
        .agg(F.min("text").alias("text"))
        .select("text", "y")
    )
    schema = pa.schema([("word", pa.string()), ("n1", pa.int64()), ("n0", pa.int64())])

    def count(batches):
        seen: dict[str, list[int]] = {}
        totals = [0, 0]
        for batch in batches:
            for text, y in zip(strings(batch.column("text")), batch.column("y").to_pylist()):
                totals[1 - y] += 1
                for word in features(text):
                    seen.setdefault(word, [0, 0])[1 - y] += 1
        seen[""] = totals
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), *[pa.array([v[i] for v in seen.values()], pa.int64()) for i in (0, 1)]],
            schema=schema,
        )

    counted = staged(
        texts.mapInArrow(count, "word string, n1 long, n0 long")
        .groupBy("word")
        .agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
        .where("word = '' or n1 >= 5"),
        "word-counts",
    )
    total = counted.where("word = ''").first()
    if total is None or not total["n1"] or not total["n0"]:
        return ()
    p = total["n1"] / (total["n1"] + total["n0"])
    n = F.col("n1") + F.col("n0")
    # log-likelihood ratio of the word's toxic share against the share of all texts
    part = 2 * (
        F.col("n1") * F.log(F.col("n1") / n / p)
        + F.when(F.col("n0") > 0, F.col("n0") * F.log(F.col("n0") / n / (1 - p))).otherwise(0)
    )
    best = (
        counted.where("word <> ''")
        .where((F.col("n1") * (1 - p) >= 4 * F.col("n0") * p) & (part >= least_evidence))
        .orderBy(part.desc(), "word")
        .limit(max_words)
    )
    return tuple(r["word"] for r in best.collect())


def voted(docs: DataFrame, mined: tuple[str, ...]) -> DataFrame:
    """``(doc_id, mask, words)``: each text's votes, as bits, and mined words."""

    def make():
        votes = Votes(mined)

        def work(batch):
            masks, words = zip(*map(votes, strings(batch.column("text")))) if batch.num_rows else ((), ())
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(masks, pa.int64()), pa.array(words, VOTES.field("words").type)],
                schema=VOTES,
            )

        return work

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(source, make, "doc_id long, mask long, words array<int>")


def bits(masks: np.ndarray) -> np.ndarray:
    return ((masks[:, None] >> np.arange(MASK_BITS)) & 1).astype(float)


def label_sums(patterns: DataFrame, theta: dict) -> tuple[np.ndarray, np.ndarray]:
    """Expected second moments of the votes in the toxic and the other class, with a constant vote
    added: one row per pattern in, ``(MASK_BITS + 1)^2`` numbers per class out."""
    size = MASK_BITS + 1
    schema = pa.schema([("i", pa.int32()), ("toxic", pa.float64()), ("other", pa.float64())])

    def work(batches):
        sums = np.zeros((2, size * size))
        for batch in batches:
            x = bits(np.asarray(batch.column("mask")))
            n = np.asarray(batch.column("n"), dtype=float)
            p = posterior(x, theta)
            x = np.hstack([x, np.ones((len(x), 1))])
            sums[0] += (x.T @ (x * (n * p)[:, None])).ravel()
            sums[1] += (x.T @ (x * (n * (1 - p))[:, None])).ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size * size), pa.int32()), pa.array(sums[0]), pa.array(sums[1])], schema=schema
        )

    rows = (
        patterns.mapInArrow(work, "i int, toxic double, other double")
        .groupBy("i")
        .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        .orderBy("i")
        .collect()
    )
    toxic, other = (np.array([r[c] for r in rows] or [0.0] * size * size).reshape(size, size) for c in ("toxic", "other"))
    return toxic, other


def posterior(x: np.ndarray, theta: dict) -> np.ndarray:
    """Probability of the toxic class given votes ``x``."""
    a, b, discount = (np.array(theta[k]) for k in ("toxic", "other", "discount"))
    logit = np.log(theta["prior"] / (1 - theta["prior"])) + x @ (discount * np.log(a / b))
    logit = logit + (1 - x) @ (discount * np.log((1 - a) / (1 - b)))
    return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def fit_label_model(patterns: DataFrame, rounds: int) -> dict:
    """Firing rates by expectation maximisation; every round also re-estimates the correlations, and with
    them how much each voter's evidence counts."""
    theta = {
        "prior": 0.1,
        "toxic": [0.3] * VOTERS + [0.4, 0.01],
        "other": [0.005] * VOTERS + [0.002, 0.4],
        "discount": [1.0] * MASK_BITS,
    }
    first = {k: np.array(theta[k]) for k in ("toxic", "other")}
    for _ in range(rounds):
        toxic, other = label_sums(patterns, theta)
        n1, n0 = toxic[-1, -1], other[-1, -1]
        if n1 < 1 or n0 < 1:
            return theta
        previous = np.array(theta["toxic"])
        # pseudo-counts: ten texts that vote as first assumed
        fitted = {
            "prior": float(np.clip((n1 + 1) / (n1 + n0 + 10), 0.001, 0.9)),
            "toxic": ((toxic[-1, :-1] + 10 * first["toxic"]) / (n1 + 10)).clip(1e-6, 1 - 1e-6).tolist(),
            "other": ((other[-1, :-1] + 10 * first["other"]) / (n0 + 10)).clip(1e-6, 1 - 1e-6).tolist(),
        }
        theta = fitted | correlations(toxic)
        if np.abs(np.array(theta["toxic"]) - previous).max() < 1e-4:
            break
    return theta


def correlations(toxic: np.ndarray) -> dict:
    """Correlations of the votes inside the toxic class, and the discounts of repeated evidence."""
    mean = toxic[-1, :-1] / toxic[-1, -1]
    covariance = toxic[:-1, :-1] / toxic[-1, -1] - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(covariance), 1e-9))
    correlation = covariance / np.outer(spread, spread)
    np.fill_diagonal(correlation, 0)
    discount = 1 / (1 + np.maximum(correlation, 0).sum(0))
    discount[VOTERS:] = 1.0  # an annotation is no repetition of a word list
    return {"correlation": np.round(correlation, 4).tolist(), "discount": discount.tolist()}


def fit_linear(masks: np.ndarray, words: list, target: np.ndarray, n_words: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic regression by Adam on sparse rows; L2 keeps words of few texts small."""
    rows, columns = [], []
    x = bits(masks)[:, :VOTERS]
    for i, own in enumerate(words):
        voter = np.flatnonzero(x[i])
        rows += [i] * (len(voter) + len(own))
        columns += [*voter, *(VOTERS + w for w in own)]
    r, c = np.array(rows, dtype=np.int64), np.array(columns, dtype=np.int64)
    size, n = VOTERS + n_words, len(target)
    w, bias = np.zeros(size), -2.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, 1201):
        logit = bias + np.bincount(r, w[c], n)
        error = 1 / (1 + np.exp(-np.clip(logit, -50, 50))) - target
        gradient = np.append(np.bincount(c, error[r], size) / n + 1e-6 * w, error.mean())
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return float(bias), w[:VOTERS], w[VOTERS:]


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    mine_rows: int = 20_000,
    fit_rows: int = 40_000,
    max_words: int = 1_500,
    least_evidence: float = 40.0,
    rounds: int = 12,
) -> ToxicityModel:
    """Fit on ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    ``mine_rows`` and ``fit_rows`` bound the rows from which words are mined and the classifier is
    fitted; the label model uses the votes of all texts. The driver holds only bounded things: mined
    words, moments of the votes, and the votes of ``fit_rows`` texts.
    """
    usable = usable_labels(labels)
    mined = mine(docs, usable, mine_rows, max_words, least_evidence)
    votes = staged(voted(docs, mined), "votes")
    annotated = votes.where("doc_id is not null").join(usable, "doc_id", "left").unionByName(
        votes.where("doc_id is null").withColumn("y", F.lit(None).cast("int"))
    )
    said = F.when(F.col("y") == 1, F.lit(1 << VOTERS)).when(F.col("y") == 0, F.lit(1 << VOTERS + 1)).otherwise(0)
    full = F.col("mask").bitwiseOR(said.cast("long")).alias("mask")
    # at most 2^MASK_BITS patterns, whatever the number of texts
    patterns = staged(annotated.groupBy(full).agg(F.count("*").alias("n")), "vote-patterns")
    theta = fit_label_model(patterns, rounds)

    chosen = sampled(votes.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))), fit_rows, 12)
    rows = chosen.join(usable, "doc_id", "left").select(full, "words").toArrow()
    if rows.num_rows == 0:
        return ToxicityModel(mined, word_weights=(0.0,) * len(mined), accuracies=theta)
    masks = rows.column("mask").to_numpy()
    target = posterior(bits(masks), theta)
    bias, voters, words = fit_linear(masks, rows.column("words").to_pylist(), target, len(mined))
    return ToxicityModel(mined, bias, tuple(voters.tolist()), tuple(words.tolist()), theta)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score, predicted`` of every text, read whole."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def make():
        score = scorer(model)

        def work(batch):
            scores = np.array([score(t) for t in strings(batch.column("text"))], dtype=float)
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], schema=schema
            )

        return work

    return map_batches(source, make, "doc_id long, score double, predicted int")


def scorer(model: ToxicityModel):
    votes = Votes(model.mined)

    def score(text: str) -> float:
        mask, words = votes(text)
        logit = model.bias + sum(model.word_weights[w] for w in words)
        logit += sum(w for j, w in enumerate(model.voter_weights) if mask >> j & 1)
        return float(1 / (1 + np.exp(-np.clip(logit, -50, 50))))

    return score


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows, all columns kept, whose texts score below ``threshold``. No shuffle."""
    place = docs.columns.index("text")

    def keep(batches):
        score = scorer(model)
        for batch in batches:
            clean = [score(t) < threshold for t in strings(batch.column(place))]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
