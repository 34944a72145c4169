"""Token counts by offset-mapped attribution.

The fields of a row are joined, in order and one line feed apart, into one document that is encoded
once, whole. Each token's character span is mapped from its bytes. A field is one section, or, if it is
split, one section per line with its line feed. Token spans are joined to section spans as intervals
inside the task. A token that crosses a boundary goes by an explicit rule: ``first`` gives it to the
section of its first character; ``most`` to the one that holds most of its bytes, the first of equals;
``share`` to each by its bytes. The separators between fields belong to the field before them, so the
sections cover the whole document and, under every rule, counts add up to the document's tokens.

Defined results: null fields are empty; an empty field is a section of its separator, a last empty one
a section without tokens; repeated rows are counted each; other columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm import vocabulary
from kinfold.llm.common import map_batches

RULES = ("first", "most", "share")
ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("field", pa.string()),
        ("section", pa.int32()),
        ("first_char", pa.int64()),
        ("last_char", pa.int64()),
        ("n_tokens", pa.float64()),
        ("n_crossing", pa.int64()),
    ]
)
SCHEMA = (
    "doc_id long, field string, section int, first_char long, last_char long, n_tokens double, n_crossing long"
)


def sections(values: list[str], split: list[bool]) -> tuple[str, list[tuple[int, int, int, int]]]:
    """The document and its ``(field, number, first, last)`` sections in characters, end exclusive."""
    found, at = [], 0
    for k, value in enumerate(values):
        text = value + "\n" if k + 1 < len(values) else value
        parts = cut(text) if split[k] else [text]
        for number, part in enumerate(parts):
            found.append((k, number, at, at + len(part)))
            at += len(part)
    return "\n".join(values), found


def cut(text: str) -> list[str]:
    """Lines with their line feeds; an empty text is one empty line."""
    lines = [line + "\n" for line in text.split("\n")]
    lines[-1] = lines[-1][:-1]
    return lines[:-1] if len(lines) > 1 and not lines[-1] else lines


def attribute(path: str, document: str, spans: list[tuple[int, int, int, int]], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of the tokens that touch it cross a boundary."""
    ids = vocabulary.encode(path, document)
    counts, crossing = np.zeros(len(spans)), np.zeros(len(spans), np.int64)
    if not len(ids):
        return counts, crossing
    raw = np.frombuffer(document.encode("utf-8", "replace"), np.uint8)
    lengths = vocabulary.token_bytes(path)[ids]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    if document.isascii():
        edges = np.array([s[3] for s in spans])
    else:
        places = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # byte of each character
        edges = places[[s[3] for s in spans]]
    # empty sections end where they begin: the search to the right passes over them
    first = np.searchsorted(edges, starts, side="right")
    last = np.searchsorted(edges, ends - 1, side="right")
    inside = first == last
    np.add.at(counts, first[inside], 1)
    for i in np.flatnonzero(~inside):
        touched = np.arange(first[i], last[i] + 1)
        low = np.maximum(starts[i], np.append(0, edges)[touched])
        held = np.maximum(np.minimum(ends[i], edges[touched]) - low, 0)
        crossing[touched[held > 0]] += 1
        if rule == "share":
            counts[touched] += held / lengths[i]
        else:
            counts[touched[0] if rule == "first" else touched[int(np.argmax(held))]] += 1
    return counts, crossing


def count_tokens(
    docs: DataFrame,
    fields: list[str],
    split: list[str] = (),
    rule: str = "first",
    vocabulary_path: str = f"{vocabulary.TOKENIZERS}/byte_bpe_50k.tiktoken",
) -> DataFrame:
    """One row per row of ``docs`` and section: ``doc_id, field, section, first_char, last_char,
    n_tokens, n_crossing``. ``split``: the fields whose lines are sections."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names, lines = list(fields), [f in split for f in fields]

    def work(batch):
        out: list[list] = [[] for _ in ARROW]
        for row in range(batch.num_rows):
            doc_id = batch.column(0)[row].as_py()
            document, spans = sections([batch.column(k + 1)[row].as_py() or "" for k in range(len(names))], lines)
            counts, crossing = attribute(vocabulary_path, document, spans, rule)
            out[0] += [doc_id] * len(spans)
            out[1] += [names[s[0]] for s in spans]
            for k in range(3):
                out[2 + k] += [s[1 + k] for s in spans]
            out[5] += counts.tolist()
            out[6] += crossing.tolist()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, ARROW)], schema=ARROW)

    source = docs.select(
        F.col("doc_id").cast("long"), *[F.col(f"`{f}`").cast("string").alias(f"f{k}") for k, f in enumerate(names)]
    )
    return map_batches(source, lambda: work, SCHEMA)
