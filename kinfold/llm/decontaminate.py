"""Benchmark decontamination: a BM25 index of test items, searched by block-max WAND.

Test items are cut into units of at most ``UNIT`` words. Every training text is cut into passages of
``2 * UNIT`` words, one starting every ``UNIT`` words, so each run of ``UNIT`` words lies whole in one
of them. Each passage is a query: a unit's score is the sum of its BM25 impacts over the passage's
distinct words, divided by ``threshold`` times the unit's own full score, so 1 is the bar for all. Units
of like length are indexed together, so that the largest impacts of a word say much. A passage's words
whose largest impacts together miss the bar can't reach it alone: only blocks that hold one of its other,
rarer words are opened, and the lists of the common words are never run through, but looked up at those
blocks. The largest impacts in a block bound what it can reach; those that reach the bar are searched
document at a time with pivots. All units above the bar are then verified: the words of the item's question, and of its answer (its last
sentence), must be found near the passage as five-word shingles, four fifths of them each. One
changed word takes up to five shingles, so an item counts as found too if the words where question and
answer meet align with the text at four fifths or more, half of either part at least, and parts longer
than that junction hold four fifths of their shingles, or the whole item does.

The index goes to the tasks in pieces of at most ``piece_words`` words, each searched against all
texts, so what is broadcast does not grow with the benchmark.

Defined results: null or empty texts match nothing; items without words are ignored; repeated items
or rows are found as often as they occur; null item ids are kept; an empty table gives no findings.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import strings

WORDS = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
UNIT = 32
SHINGLE = 5
OVERLAP = 0.8
BLOCK = 8
K1, B = 1.2, 0.75
#: Words times blocks of a part up to which largest impacts are looked up in a table instead of a search.
TABLE = 1 << 21
#: Words of texts that are searched together.
BATCH_WORDS = 100_000

FOUND = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("item_id", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("score", pa.float64()),
        ("question_overlap", pa.float64()),
        ("answer_overlap", pa.float64()),
    ]
)
SCHEMA = (
    "doc_id long, item_id long, first_word long, last_word long, score double,"
    " question_overlap double, answer_overlap double"
)


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def shingles(words: list[str]) -> set[tuple]:
    """Five-word shingles; of fewer words the whole sequence."""
    return set(zip(*(words[k:] for k in range(SHINGLE)))) if len(words) >= SHINGLE else {tuple(words)}


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words before the last sentence, and of it; a single sentence is split after three quarters."""
    sentences = [w for w in map(words_of, SENTENCE.split(text)) if w]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0]
    cut = max(1, len(words) * 3 // 4) if len(words) > 1 else 0
    return words[:cut], words[cut:]


def overlap(part: list[str], there: list[str]) -> float:
    """Share of the part's shingles that a run of words holds; 1 for an empty part."""
    if not part:
        return 1.0
    if len(part) >= SHINGLE:
        own = shingles(part)
        return len(own & shingles(there)) / len(own)
    n = len(part)
    return float(any(there[i : i + n] == part for i in range(len(there) - n + 1)))


def aligned(part: list[str], there: list[str], cut: int) -> tuple[float, float, float]:
    """The best alignment of ``part`` with a run of words anywhere in ``there``: one less its edits
    (words changed, inserted, deleted) per word, and the shares of the words before and from ``cut``
    that it matches; 1 for no words."""
    numbers: dict[str, int] = {}
    text = np.array([numbers.setdefault(w, len(numbers)) for w in there], np.int64)
    steps = np.arange(len(text) + 1)
    rows = [np.zeros(len(text) + 1, np.int64)]
    for i, w in enumerate(part):
        above = rows[-1]
        row = above + 1
        row[1:] = np.minimum(row[1:], above[:-1] + (text != numbers.get(w, -1)))
        rows.append(np.minimum.accumulate(row - steps) + steps)
    at, matched = int(rows[-1].argmin()), [0, 0]
    edits = int(rows[-1][at])
    i = len(part)
    while i:
        cost = rows[i][at]
        if at and there[at - 1] == part[i - 1] and rows[i - 1][at - 1] == cost:
            matched[i - 1 >= cut] += 1
            i, at = i - 1, at - 1
        elif at and rows[i - 1][at - 1] + 1 == cost:
            i, at = i - 1, at - 1
        elif rows[i - 1][at] + 1 == cost:
            i -= 1
        else:
            at -= 1
    before, after = (m / n if n else 1.0 for m, n in zip(matched, (cut, len(part) - cut)))
    return 1 - edits / max(len(part), 1), before, after


def near_copy(question: list[str], answer: list[str], there: list[str], q: float, a: float) -> tuple[float, float] | None:
    """Matched shares of question and answer where a text holds an item with few words changed; ``q``
    and ``a`` are their shingle overlaps."""
    tail, head = question[-UNIT:], answer[:UNIT]
    whole = tail + head
    known = set(there)
    if sum(w in known for w in whole) < len(whole) / 2:
        return None
    share, before, after = aligned(whole, there, len(tail))
    if min(before, after) < 0.5:
        return None
    long = [x for part, x in ((question, q), (answer, a)) if len(part) > UNIT]
    if (share >= OVERLAP and all(x >= OVERLAP for x in long)) or overlap(question + answer, there) >= OVERLAP:
        return max(before, q), max(after, a)
    return None


@dataclass
class Part:
    """The inverted index of units of like length, impacts already divided by each unit's bar.

    An entry is a word in a block of units, numbered ``word * n_blocks + block``; entries are sorted, and
    so are the postings, each entry's from ``first`` on."""

    unit_item: list[int]  # unit -> place in items
    n_blocks: int
    entries: np.ndarray
    block: np.ndarray  # entry -> its block
    first: np.ndarray  # one more than entries
    block_max: np.ndarray
    word_max: np.ndarray  # word -> largest impact
    word_first: np.ndarray  # word -> its first entry, one more than words
    units: np.ndarray
    impacts: np.ndarray
    table: np.ndarray | None  # number -> largest impact, where there are few numbers


@dataclass
class Index:
    """One piece of the benchmark."""

    vocabulary: dict[str, int]
    items: list[tuple]  # (item_id, words, question, answer)
    parts: list[Part]


def build_index(items: list[tuple], frequency: dict[str, int], n_units: int, mean_length: float, threshold: float) -> Index:
    """``frequency``, ``n_units`` and ``mean_length`` are those of the whole benchmark."""
    vocabulary: dict[str, int] = {}
    kept: list[tuple] = []
    by_length: dict[int, list[tuple[int, dict[int, float]]]] = defaultdict(list)
    for item_id, text in items:
        words = words_of(text)
        kept.append((item_id, words, *question_and_answer(text)))
        for unit in units_of(words):
            counts: dict[str, int] = defaultdict(int)
            for w in unit:
                counts[w] += 1
            norm = K1 * (1 - B + B * len(unit) / mean_length)
            impacts = {}
            for w, n in counts.items():
                df = frequency[w]
                impact = math.log(1 + (n_units - df + 0.5) / (df + 0.5)) * n * (K1 + 1) / (n + norm)
                impacts[vocabulary.setdefault(w, len(vocabulary))] = impact
            bar = threshold * sum(impacts.values())
            by_length[len(counts).bit_length()].append((len(kept) - 1, {t: i / bar for t, i in impacts.items()}))
    return Index(vocabulary, kept, [build_part(units, len(vocabulary)) for _, units in sorted(by_length.items())])


def build_part(units: list[tuple[int, dict[int, float]]], n_words: int) -> Part:
    """From ``(place of the item, word -> impact)`` of each unit."""
    unit = np.repeat(np.arange(len(units)), [len(impacts) for _, impacts in units])
    word = np.array([t for _, impacts in units for t in impacts], np.int64)
    impact = np.array([i for _, impacts in units for i in impacts.values()])
    order = np.lexsort((unit, word))
    unit, word, impact = unit[order], word[order], impact[order]
    n_blocks = (len(units) + BLOCK - 1) // BLOCK
    entries, first = np.unique(word * n_blocks + unit // BLOCK, return_index=True)
    block_max = np.maximum.reduceat(impact, first)
    word_first = np.searchsorted(entries, np.arange(n_words + 1) * n_blocks)
    word_max = np.zeros(n_words)
    np.maximum.at(word_max, entries // n_blocks, block_max)
    first = np.append(first, len(unit))
    table = None
    if n_words * n_blocks <= TABLE:
        table = np.zeros(n_words * n_blocks)
        table[entries] = block_max
    return Part(
        [place for place, _ in units], n_blocks, entries, entries % n_blocks, first, block_max, word_max, word_first, unit, impact, table
    )


def units_of(words: list[str]) -> list[list[str]]:
    """Nearly equal runs of at most ``UNIT`` words."""
    n = -(-len(words) // UNIT)
    return [words[len(words) * i // n : len(words) * (i + 1) // n] for i in range(n)]


def asked_entries(part: Part, windows: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window and entry of all blocks of the words that a window can't do without, and for each pair of
    window and word whether it is one of those: the words, from the smallest largest impact on, whose sum
    reaches the bar."""
    largest = part.word_max[words]
    order = np.lexsort((largest, windows))
    total = np.cumsum(largest[order])
    new = np.append(True, windows[order][1:] != windows[order][:-1])
    before = np.maximum.accumulate(np.where(new, total - largest[order], 0.0))
    needed = np.zeros(len(words), bool)
    needed[order] = (total - before >= 1 - 1e-9) & (largest[order] > 0)
    own = words[needed]
    n = part.word_first[own + 1] - part.word_first[own]
    at = np.repeat(part.word_first[own] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
    return np.repeat(windows[needed], n), at, needed


def looked_up(part: Part, asked: np.ndarray) -> np.ndarray:
    """The largest impacts of entries by number, 0 for entries that there aren't."""
    if part.table is not None:
        return part.table[asked]
    found = np.minimum(np.searchsorted(part.entries, asked), len(part.entries) - 1)
    return np.where(part.entries[found] == asked, part.block_max[found], 0.0)


def open_blocks(part: Part, windows: np.ndarray, words: np.ndarray) -> list[tuple[int, int]]:
    """``(window, block)`` pairs whose block maxima reach the bar, given distinct (window, word) pairs
    sorted by window."""
    if not len(windows):
        return []
    window, at, needed = asked_entries(part, windows, words)
    if not len(at):
        return []
    asked = window * part.n_blocks + part.block[at]
    order = np.argsort(asked, kind="stable")
    asked, largest = asked[order], part.block_max[at][order]
    starts = np.flatnonzero(np.append(True, asked[1:] != asked[:-1]))
    cells, bound = asked[starts], np.add.reduceat(largest, starts)
    # what the common words may add at most, then what they add in these blocks
    common_windows, common = windows[~needed], words[~needed]
    owners = cells // part.n_blocks
    low, high = np.searchsorted(common_windows, owners), np.searchsorted(common_windows, owners, side="right")
    most = np.append(0.0, np.cumsum(part.word_max[common]))
    near = bound + most[high] - most[low] >= 1 - 1e-9
    cells, bound, low, high = cells[near], bound[near], low[near], high[near]
    n = high - low
    pair = np.repeat(low - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
    cell = np.repeat(np.arange(len(cells)), n)
    asked = common[pair] * part.n_blocks + cells[cell] % part.n_blocks
    bound = bound + np.bincount(cell, looked_up(part, asked), len(cells))
    return [divmod(int(c), part.n_blocks) for c in cells[bound >= 1 - 1e-9]]


def wand(part: Part, words: np.ndarray, blocks: list[int]) -> list[tuple[int, float]]:
    """All ``(unit, score)`` at or above the bar in the open blocks; only their postings are read."""
    asked = words[:, None] * part.n_blocks + np.array(sorted(blocks), np.int64)
    place = np.minimum(np.searchsorted(part.entries, asked), len(part.entries) - 1)
    held = part.entries[place] == asked
    lists = []
    for k in np.flatnonzero(held.any(axis=1)):
        entries = place[k][held[k]]
        ranges = [slice(part.first[e], part.first[e + 1]) for e in entries]
        units = [u for own in ranges for u in part.units[own].tolist()]
        impacts = [i for own in ranges for i in part.impacts[own].tolist()]
        bounds = dict(zip((part.entries[entries] % part.n_blocks).tolist(), part.block_max[entries].tolist()))
        lists.append([0, list(zip(units, impacts)), max(impacts), bounds])
    found = []
    while lists:
        lists.sort(key=lambda x: x[1][x[0]][0])
        bound, pivot = 0.0, None
        for k, (_, _, most, _) in enumerate(lists):
            bound += most
            if bound >= 1 - 1e-9:
                pivot = k
                break
        if pivot is None:
            break
        unit = lists[pivot][1][lists[pivot][0]][0]
        block = unit // BLOCK
        here = [x for x in lists if x[1][x[0]][0] <= unit]
        if sum(x[3].get(block, 0.0) for x in here) < 1 - 1e-9:
            # no unit up to the block's end, or the next list's unit, can reach the bar
            later = [x[1][x[0]][0] for x in lists if x[1][x[0]][0] > unit]
            target = min([(block + 1) * BLOCK, *later])
        elif lists[0][1][lists[0][0]][0] == unit:
            score = sum(x[1][x[0]][1] for x in here)
            if score >= 1 - 1e-9:
                found.append((unit, score))
            target = unit + 1
        else:
            target = unit
        for x in here:
            while x[0] < len(x[1]) and x[1][x[0]][0] < target:
                x[0] += 1
        lists = [x for x in lists if x[0] < len(x[1])]
    return found


def search(index: Index, texts: list[list[str]], threshold: float) -> list[list[tuple]]:
    """Verified findings of each text: ``(item place, first, last, score, question, answer)``."""
    get = index.vocabulary.get
    windows, terms, starts, known = [], [], [], 0
    for words in texts:
        ids = np.array([get(w, -1) for w in words], np.int64)
        at = np.flatnonzero(ids >= 0)
        n = max(1, -(-len(words) // UNIT))
        windows.append(at // UNIT + known + 1)  # windows k - 1 and k of the text hold words k * UNIT ...
        terms.append(ids[at])
        starts.append(known)
        known += n + 1
    last, term = np.concatenate(windows or [np.zeros(0, np.int64)]), np.concatenate(terms or [np.zeros(0, np.int64)])
    size = len(index.vocabulary)
    pairs = np.sort(np.concatenate([last * size + term, (last - 1) * size + term]))
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
    window, word = pairs // size, pairs % size
    by_window: dict[tuple[int, int], list[int]] = defaultdict(list)
    for k, part in enumerate(index.parts):
        for w, block in open_blocks(part, window, word):
            by_window[w, k].append(block)
    found: list[dict[int, tuple]] = [{} for _ in texts]
    for (w, k), blocks in sorted(by_window.items()):
        a, b = np.searchsorted(window, [w, w + 1])
        doc = int(np.searchsorted(starts, w, side="right")) - 1
        first = max(0, (w - starts[doc] - 1) * UNIT)
        for unit, score in wand(index.parts[k], word[a:b], blocks):
            place = index.parts[k].unit_item[unit]
            _, own, question, answer = index.items[place]
            low, high = max(0, first - len(own)), min(len(texts[doc]), first + 2 * UNIT + len(own))
            there = texts[doc][low:high]
            q, r = overlap(question, there), overlap(answer, there)
            if score * threshold <= found[doc].get(place, (0, 0, 0.0))[2]:
                continue
            verified = (q, r) if q >= OVERLAP and r >= OVERLAP else near_copy(question, answer, there, q, r)
            if verified:
                found[doc][place] = (low, high, score * threshold, *verified)
    return [[(place, *f) for place, f in sorted(own.items())] for own in found]


def searched(batch: pa.RecordBatch, column, index: Index, threshold: float):
    """Findings of each text of a batch, texts grouped so that one search has enough words."""
    texts, size = [], 0
    for text in strings(batch.column(column)):
        texts.append(words_of(text))
        size += len(texts[-1])
        if size >= BATCH_WORDS:
            yield from search(index, texts, threshold)
            texts, size = [], 0
    yield from search(index, texts, threshold)


def pieces(benchmark: DataFrame, threshold: float, piece_words: int) -> list:
    """The index in pieces, each broadcast; counts are those of the whole benchmark."""
    spark = benchmark.sparkSession
    lower = F.lower("text")
    items = benchmark.where("text is not null").select(
        F.col("item_id").cast("long").alias("item_id"), "text", F.regexp_extract_all(lower, F.lit(r"([\p{L}\p{N}_]+)"), 1).alias("w")
    )
    total = items.agg(F.sum(F.size("w"))).first()[0] or 0
    n_pieces = -(-total // piece_words)
    result = []
    if not n_pieces:
        return result
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_pieces))
    unit_schema = "piece long, words array<string>"
    unit_arrow = pa.schema([("piece", pa.int64()), ("words", pa.list_(pa.string()))])

    def cut(batches):
        for batch in batches:
            rows = [
                (p, u)
                for p, t in zip(batch.column("piece").to_pylist(), strings(batch.column("text")))
                for u in units_of(words_of(t))
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in rows], pa.int64()), pa.array([u for _, u in rows], unit_arrow.field("words").type)],
                schema=unit_arrow,
            )

    numbered = items.withColumn("piece", number)
    units = numbered.select("piece", "text").mapInArrow(cut, unit_schema)
    n_units, mean_length = units.agg(F.count("*"), F.avg(F.size("words"))).first()
    if not n_units:
        return result
    frequency = units.select("piece", F.explode(F.array_distinct("words")).alias("word"))
    frequency = frequency.groupBy("word").agg(F.count("*").alias("df"), F.collect_set("piece").alias("in_pieces"))
    for k in range(n_pieces):
        own = [(r["item_id"], r["text"]) for r in numbered.where(F.col("piece") == k).select("item_id", "text").collect()]
        own = sorted(((i, t) for i, t in own if words_of(t)), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        counts = {r["word"]: r["df"] for r in frequency.where(F.array_contains("in_pieces", k)).select("word", "df").collect()}
        if own:
            result.append(spark.sparkContext.broadcast(build_index(own, counts, n_units, mean_length, threshold)))
    return result


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, piece_words: int = 1_000_000) -> DataFrame:
    """One row per text and test item found in it: where (words, end exclusive), the score as a share
    of the item's own, and the verified overlaps. ``threshold``: the least such share."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    result = spark.createDataFrame([], SCHEMA)
    for index in pieces(benchmark, threshold, piece_words):

        def work(batches, index=index):
            for batch in batches:
                rows = [
                    (doc_id, index.value.items[place][0], *found)
                    for doc_id, own in zip(batch.column("doc_id").to_pylist(), searched(batch, "text", index.value, threshold))
                    for place, *found in own
                ]
                columns = list(zip(*rows)) or [()] * len(FOUND)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND)], schema=FOUND)

        result = result.unionByName(source.mapInArrow(work, SCHEMA))
    return result


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, piece_words: int = 1_000_000) -> DataFrame:
    """The rows, all columns kept, whose texts hold no test item. No shuffle."""
    place = docs.columns.index("text")
    for index in pieces(benchmark, threshold, piece_words):

        def keep(batches, index=index):
            for batch in batches:
                clean = [not own for own in searched(batch, place, index.value, threshold)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
