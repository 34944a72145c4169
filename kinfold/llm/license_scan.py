"""License scan with a positional index of rare words.

The index holds, of every licence notice, the places of its rarest words: so many, by inverse document
frequency over all scanned texts, that a text without any of them can't hold ``SHARE`` of the notice's
weight. Each text looks up the licence words that it holds in the index; a word at place ``p`` that
stands at place ``q`` of a notice proposes the alignment ``p - q``. Around proposed alignments the
places of all licence words of the notice are intersected by relative position, with ``SLACK`` words of
drift for names and dates that a copy puts in. Where words of at least ``SHARE`` of the notice's weight
agree, its mandatory phrases are verified at their relative places.

Phrases that name a licence by themselves are found in every text beside that. Texts are read once;
places of licence words and phrases are stored, and statistics and lookups run on those.

Words are runs of digits, a-z and characters beyond ASCII, after lower-casing A-Z. Licence words are the
words that at most ``COMMON`` of the notices hold.

Defined results: a null text is empty; an empty text has no words and score 0; texts of any length are
read whole; repeated rows are scanned each; null ids stay; other columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import staged
from kinfold.llm.license_texts import PHRASES, REPLACES, TEMPLATES

#: Share of a notice's weight that a copy must hold, in one alignment.
SHARE = 0.6
#: Words by which parts of a copy may be shifted against each other.
SLACK = 24
#: Share of the notices up to which a word is a licence word.
COMMON = 1 / 3
#: Score of a text that only names a licence.
NAMED = 0.5

#: Byte for byte: A-Z in lower case, word bytes as they are, the rest blank.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)

PLACES = "base array<struct<at:long,what:int>>, phrases array<struct<at:long,what:int>>, hits array<struct<at:long,what:int>>"
PLACE_TYPE = pa.list_(pa.struct([("at", pa.int64()), ("what", pa.int32())]))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


@dataclass(frozen=True)
class Notice:
    label: str
    words: list[bytes]
    phrases: list[tuple[int, int]]  # phrase number and its place in the notice


@dataclass
class Lexicon:
    """What is looked for in texts: naming phrases, mandatory phrases and licence words, numbered."""

    templates: list[tuple[str, str, list[str]]] = field(default_factory=lambda: TEMPLATES)
    names: dict[str, str] = field(default_factory=lambda: PHRASES)

    def __post_init__(self):
        self.mandatory = sorted({p for _, _, phrases in self.templates for p in phrases})
        numbers = {p: k for k, p in enumerate(self.mandatory)}
        self.notices = []
        for label, text, phrases in self.templates:
            words = words_of(text.encode())
            placed = []
            for phrase in phrases:
                wanted = words_of(phrase.encode())
                at = [i for i in range(len(words)) if words[i : i + len(wanted)] == wanted]
                if not at:
                    raise ValueError(f"{phrase!r} is not in the notice of {label}")
                placed.append((numbers[phrase], at[0]))
            self.notices.append(Notice(label, words, placed))
        held = Counter(w for n in self.notices for w in set(n.words))
        self.words = sorted(w for w, n in held.items() if n <= COMMON * len(self.notices))
        self.number = {w: k for k, w in enumerate(self.words)}
        self.starts: dict[bytes, list] = defaultdict(list)
        for group, phrases in enumerate((list(self.names), self.mandatory)):
            for k, phrase in enumerate(phrases):
                wanted = words_of(phrase.encode())
                self.starts[wanted[0]].append((group, k, wanted))
        self.known = frozenset(self.number) | frozenset(self.starts)

    def places(self, words: list[bytes]) -> tuple[list, list, list]:
        """``(at, number)`` of naming phrases, of mandatory phrases and of licence words."""
        found: tuple[list, list, list] = [], [], []
        known = self.known
        for at, word in [(i, w) for i, w in enumerate(words) if w in known]:
            for group, k, wanted in self.starts.get(word, ()):
                if words[at : at + len(wanted)] == wanted:
                    found[group].append((at, k))
            if word in self.number:
                found[2].append((at, self.number[word]))
        return found


class Index:
    """Places of the notices' rarest words, and of all their licence words for the intersection."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon = lexicon
        self.rare: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.postings, self.weights, self.totals = [], [], []
        for t, notice in enumerate(lexicon.notices):
            places = [(at, lexicon.number[w]) for at, w in enumerate(notice.words) if w in lexicon.number]
            own = np.zeros(len(notice.words))
            postings = defaultdict(list)
            for at, word in places:
                own[at] = weights[word]
                postings[word].append(at)
            total = left = float(own.sum())
            for at, word in sorted(places, key=lambda x: (-weights[x[1]], x[1], x[0])):
                if left < SHARE * total:
                    break
                self.rare[word].append((t, at))
                left -= own[at]
            self.postings.append({w: np.array(p) for w, p in postings.items()})
            self.weights.append(own)
            self.totals.append(total)

    def proposals(self, hits: Iterable[tuple[int, int]]) -> dict[int, set[int]]:
        """Notice -> alignments that the text's rare licence words propose."""
        proposed = defaultdict(set)
        for at, word in hits:
            for t, place in self.rare.get(word, ()):
                proposed[t].add(at - place)
        return proposed

    def matches(self, hits: list[tuple[int, int]], phrases: list[tuple[int, int]]) -> list[tuple[str, int, int, float]]:
        """``(label, first word, last word, share)`` of the notices in a text."""
        found: dict[str, list] = defaultdict(list)
        proposed = self.proposals(hits)
        if proposed:
            places = defaultdict(list)
            for at, word in hits:
                places[word].append(at)
            said = defaultdict(list)
            for at, phrase in phrases:
                said[phrase].append(at)
            for t, shifts in proposed.items():
                label = self.lexicon.notices[t].label
                found[label] += self.aligned(t, shifts, places, said)
        for label in [REPLACES[x] for x, m in found.items() if m and x in REPLACES]:
            found.pop(label, None)
        return [(label, *m) for label, spans in sorted(found.items()) for m in merged(spans)]

    def aligned(self, t: int, shifts: set[int], places: dict, said: dict) -> list[tuple[int, int, float]]:
        """Spans of one notice: words that agree by relative position, with its phrases at theirs."""
        notice, postings = self.lexicon.notices[t], self.postings[t]
        shared = [w for w in postings if w in places]
        reachable = sum(float(self.weights[t][postings[w]].sum()) for w in shared)
        if not all(k in said for k, _ in notice.phrases) or reachable < SHARE * self.totals[t]:
            return []
        at = [np.array(places[w])[:, None] + 0 * postings[w] for w in shared]
        at = np.concatenate([a.ravel() for a in at])
        own = np.concatenate([np.tile(postings[w], len(places[w])) for w in shared])
        shift, width, spans = at - own, 2 * SLACK, []
        for start in (0, SLACK):  # words at most SLACK apart in shift share a bin of one of the two grids
            bins = (shift + start) // width
            asked = np.isin(bins, [(s + start) // width for s in shifts])
            if not asked.any():
                continue
            low = bins[asked].min()
            code, first = np.unique((bins[asked] - low) * len(notice.words) + own[asked], return_index=True)
            held = code // len(notice.words)
            share = np.bincount(held, self.weights[t][code % len(notice.words)]) / self.totals[t]
            for b in np.flatnonzero(share >= SHARE):
                inside = at[asked][first[held == b]]
                near = (int(b + low) * width - start - SLACK, int(b + low + 1) * width - start + SLACK)
                if all(any(near[0] <= p - q < near[1] for p in said[k]) for k, q in notice.phrases):
                    spans.append((int(inside.min()), int(inside.max()), min(1.0, float(share[b]))))
        return spans


def merged(spans: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Overlapping spans of one label as one, with the best share."""
    out: list[tuple[int, int, float]] = []
    for first, last, share in sorted(spans):
        if out and first <= out[-1][1]:
            before = out.pop()
            first, last, share = before[0], max(last, before[1]), max(share, before[2])
        out.append((first, last, share))
    return out


def read_places(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Per row ``doc_id``, ``n_words`` and the places of phrases and licence words."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), *[(n, PLACE_TYPE) for n in ("base", "phrases", "hits")]]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, found = [], ([], [], [])
            for value in batch.column(1):
                words = words_of(value.as_buffer().to_pybytes()) if value.is_valid else []
                n_words.append(len(words))
                base, phrases, hits = lexicon.places(words)
                if not phrases:  # no notice can be verified: its words count once, for their frequency
                    hits = list({word: (at, word) for at, word in hits}.values())
                for column, places in zip(found, (base, phrases, hits)):
                    column.append([{"at": at, "what": k} for at, k in places])
            columns = [batch.column(0), pa.array(n_words, pa.int64()), *[pa.array(c, PLACE_TYPE) for c in found]]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, {PLACES}")


def word_weights(places: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """Inverse document frequency of every licence word over all texts; one number per licence word."""
    n = places.count()
    held = places.select(F.explode(F.array_distinct("hits.what")).alias("word")).groupBy("word").count().collect()
    frequency = np.zeros(len(lexicon.words))
    for row in held:
        frequency[row["word"]] = row["count"]
    return np.log1p((n - frequency + 0.5) / (frequency + 0.5))


def find_licenses(docs: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words``, ``base`` (``at``, ``label`` of the naming phrases) and
    ``notices`` (``label``, ``first``, ``last`` word, ``share`` of the notice's weight)."""
    lexicon = lexicon or Lexicon()
    places = staged(read_places(docs, lexicon), "licence-places")
    index = Index(lexicon, word_weights(places, lexicon))
    names = list(lexicon.names.values())
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_words", pa.int64()),
            ("base", pa.list_(pa.struct([("at", pa.int64()), ("label", pa.string())]))),
            ("notices", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())]))),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, notices = [], []
            for named, phrases, hits in zip(*(batch.column(k) for k in (2, 3, 4))):
                base.append([{"at": p["at"], "label": names[p["what"]]} for p in named.as_py()])
                if not len(phrases):  # every notice has a mandatory phrase
                    notices.append([])
                    continue
                found = index.matches(*([(p["at"], p["what"]) for p in x.as_py()] for x in (hits, phrases)))
                notices.append([dict(zip(("label", "first", "last", "share"), m)) for m in found])
            columns = [batch.column(0), batch.column(1), pa.array(base, schema[2].type), pa.array(notices, schema[3].type)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return places.mapInArrow(
        run,
        "doc_id long, n_words long, base array<struct<at:long,label:string>>,"
        " notices array<struct<label:string,first:long,last:long,share:double>>",
    )


def digest(found: DataFrame) -> DataFrame:
    """The contract columns."""

    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    named = F.when(F.size("base") > 0, F.lit(NAMED)).otherwise(F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.at").alias("first_word"),
        F.array_max("base.at").alias("last_word"),
        joined("base.label").alias("base_labels"),
        joined(F.concat("base.label", "notices.label")).alias("labels"),
        F.greatest(named, F.coalesce(F.array_max("notices.share"), F.lit(0.0))).alias("score"),
    )
