"""Chat formatting by incremental black-box rendering.

A template is any function from a list of ``(role, text)`` turns to one string. Conversations are
rendered turn by turn: the outputs with and without the newest turn are compared, what was added is
that turn's piece, and a changed beginning means that the template rewrote history. Where in the piece
the text stands is found in the same way, by rendering the turn with two other texts: what all three
pieces share at either end is the template's frame.

A render holds the newest ``memory`` turns and, if there are more, the first one: so a turn costs the
same in a conversation of any length. ``audit`` renders long probe conversations whole and finds
templates that look back further. What the probes don't show is found in the conversations themselves:
their true beginnings are rendered whole after 8, 16, 32, ... turns and at the end, which is linear in
all, and compared with the joined pieces. Where they differ, the turns since the last equal beginning
and all later ones are rendered in full. Rows are given out once checked, so a task holds one
conversation.

Defined results: null texts and roles are empty; rows of equal conversation and turn are ordered by
role, then text, and all kept; null turns come first; a null conversation id is a conversation; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Template = Callable[[list[tuple[str, str]]], str]

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Strings that may steer a model, in this template or in others; escaped inside texts.
CONTROLS = (OPEN, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
MEMORY = 4
BATCH_ROWS, BATCH_CHARS = 10_000, 1 << 24
PROBES = ("① probe", "② other")


def escape(text: str) -> str:
    """Backslashes doubled, then a single one put after the first character of each control string."""
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def escape_role(role: str) -> str:
    """Roles are one line without control strings."""
    return "".join(f"%{ord(c):02X}" if c in "%\r\n<>[]|" else c for c in role)


def unescape_role(role: str) -> str:
    return re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), role)


def marked(turns: list[tuple[str, str]]) -> str:
    """The template: every turn between marks, its role on the first line."""
    return "".join(f"{OPEN}{escape_role(role)}\n{escape(text)}{CLOSE}\n" for role, text in turns)


def parse(piece: str) -> list[tuple[str, str]]:
    """Turns read back from output of ``marked``."""
    turns, at = [], 0
    while at < len(piece):
        line = piece.index("\n", at)
        end = piece.index(CLOSE, line)
        turns.append((unescape_role(piece[at + len(OPEN) : line]), unescape(piece[line + 1 : end])))
        at = end + len(CLOSE) + 1
    return turns


def shared_start(a: str, b: str) -> int:
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Renderer:
    """Renders one conversation turn by turn."""

    def __init__(self, template: Template, memory: int = MEMORY):
        self.template, self.memory = template, memory
        self.first: tuple[str, str] | None = None
        self.recent: list[tuple[str, str]] = []
        self.length = 0

    def add(self, role: str, text: str) -> tuple[str, int, int, bool]:
        """The turn's piece, where its text starts and ends in it, and whether history was rewritten."""
        context = list(self.recent)
        if self.first is not None and self.length > self.memory:
            context.insert(0, self.first)
        before = self.template(context) if context else ""
        after = self.template([*context, (role, text)])
        rewritten = not after.startswith(before)
        piece = after[len(before) :] if not rewritten else after[shared_start(before, after) :]
        probes = []
        for probe in PROBES:
            other = self.template([*context, (role, probe)])
            probes.append(other[len(before) :] if other.startswith(before) else other)
        head = shared_start(*probes)
        tail = shared_start(probes[0][head:][::-1], probes[1][head:][::-1])
        self.first = self.first or (role, text)
        self.recent = [*self.recent, (role, text)][-self.memory :]
        self.length += 1
        return piece, min(head, len(piece)), max(len(piece) - tail, min(head, len(piece))), rewritten


def audit(template: Template, memory: int = MEMORY, turns: int = 40) -> list[str]:
    """What is wrong with a template: history rewritten, or a look further back than ``memory``."""
    faults = []
    probe = [(("system", "user", "assistant")[min(i, 2 - i % 2)], f"probe {i} ①") for i in range(turns)]
    renderer, joined = Renderer(template, memory), ""
    for i, turn in enumerate(probe):
        piece, _, _, rewritten = renderer.add(*turn)
        joined += piece
        whole = template(probe[: i + 1])
        if rewritten or (i and not whole.startswith(template(probe[:i]))):
            faults.append(f"turn {i} rewrites history")
        elif joined != whole:
            faults.append(f"turn {i} depends on turns before the last {memory}")
        if faults:
            break
    return faults


PIECES = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("turn_no", pa.int64()),
        ("role", pa.string()),
        ("piece", pa.string()),
        ("text_start", pa.int64()),
        ("text_end", pa.int64()),
        ("loss", pa.bool_()),
        ("rewritten", pa.bool_()),
    ]
)
PIECES_SCHEMA = (
    "conv_id long, turn_no long, role string, piece string, text_start long, text_end long,"
    " loss boolean, rewritten boolean"
)


class Checked:
    """Rows of one conversation, given out once its true beginning was compared with their pieces."""

    def __init__(self, template: Template, memory: int, conv_id: int | None, loss_role: str):
        self.template, self.conv_id, self.loss_role = template, conv_id, loss_role
        self.renderer, self.exact = Renderer(template, memory), memory + 1
        self.turns: list[tuple[str, str]] = []
        self.waiting: list[tuple] = []
        self.state, self.length, self.full = hashlib.sha256(), 0, False
        self.next_check = 2 * MEMORY

    def row(self, number: int, role: str, text: str) -> tuple:
        piece, start, end, rewritten = self.renderer.add(role, text)
        return (self.conv_id, number, role, piece, start, end, role == self.loss_role, rewritten)

    def add(self, role: str, text: str) -> list[tuple]:
        self.waiting.append(self.row(len(self.turns), role, text))
        self.turns.append((role, text))
        if self.full:
            return self.release()
        if len(self.turns) < self.next_check:
            return []
        self.next_check *= 2
        return self.check()

    def release(self) -> list[tuple]:
        rows, self.waiting = self.waiting, []
        return rows

    def check(self) -> list[tuple]:
        """The waiting rows; rendered again with all turns before them where the whole differs."""
        # renders of so few turns held them all
        if self.full or len(self.turns) <= self.exact or not self.waiting:
            return self.release()
        state, length = self.state.copy(), self.length
        for row in self.waiting:
            state.update(row[3].encode("utf-8", "surrogatepass"))
            length += len(row[3])
        whole = self.template(self.turns)
        if len(whole) == length and hashlib.sha256(whole.encode("utf-8", "surrogatepass")).digest() == state.digest():
            self.state, self.length = state, length
            return self.release()
        self.full = True
        first = len(self.turns) - len(self.waiting)
        self.renderer = Renderer(self.template, sys.maxsize)
        self.renderer.recent, self.renderer.length = self.turns[:first], first
        self.renderer.first = self.turns[0] if first else None
        self.waiting = [self.row(first + i, *turn) for i, turn in enumerate(self.turns[first:])]
        return self.release()


def record_batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded number and size."""
    start, size = 0, 0
    for i, row in enumerate(rows):
        size += len(row[3])
        if size >= BATCH_CHARS or i + 1 - start >= BATCH_ROWS or i + 1 == len(rows):
            columns = zip(*rows[start : i + 1])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECES)], schema=PIECES)
            start, size = i + 1, 0


def in_turns(conversations: DataFrame) -> DataFrame:
    """Turns of a conversation together and in order; sorting spills, so any length will do."""
    empty = F.lit("")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), empty).alias("role"),
        F.coalesce(F.col("text").cast("string"), empty).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(
    conversations: DataFrame, template: Template = marked, loss_role: str = "assistant", memory: int = MEMORY
) -> DataFrame:
    """One row per turn, in order within its partition: its piece of the formatted conversation, the
    span of its text in the piece, and whether the text counts for the loss. The pieces of a
    conversation, joined by ``turn_no``, are its formatted text."""
    faults = audit(template, memory)
    if faults:
        raise ValueError(f"unfit template: {faults[0]}")

    def work(batches):
        current = None
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column("conv_id").to_pylist()
            for i, conv_id in enumerate(ids):
                role, text = batch.column("role")[i].as_py(), batch.column("text")[i].as_py()
                if current is None or conv_id != current.conv_id:
                    out += current.check() if current else []
                    current = Checked(template, memory, conv_id, loss_role)
                out += current.add(role, text)
            yield from record_batches(out)
        if current:
            yield from record_batches(current.check())

    return in_turns(conversations).mapInArrow(work, PIECES_SCHEMA)


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation what is read back from its pieces, hashed as they stream by: number and hash of
    the turns, length and hash of the text under the loss mask, length of the formatted text."""
    schema = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("n_turns", pa.int64()),
            ("turns_sha256", pa.string()),
            ("loss_chars", pa.int64()),
            ("loss_sha256", pa.string()),
            ("formatted_chars", pa.int64()),
        ]
    )

    def work(batches):
        current, state = None, None

        def done():
            return (current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for batch in batches:
            rows = []
            ids, numbers = batch.column("conv_id").to_pylist(), batch.column("turn_no").to_pylist()
            starts, ends = batch.column("text_start").to_pylist(), batch.column("text_end").to_pylist()
            losses = batch.column("loss").to_pylist()
            for i, conv_id in enumerate(ids):
                if numbers[i] == 0:
                    if state:
                        rows.append(done())
                    current, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                piece = batch.column("piece")[i].as_py()
                for role, text in parse(piece):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if losses[i]:
                    text = unescape(piece[starts[i] : ends[i]])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(piece)
            columns = list(zip(*rows)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(done(), schema)], schema=schema)

    ddl = (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
    return formatted.mapInArrow(work, ddl)
