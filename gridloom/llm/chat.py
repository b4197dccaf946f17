"""Chat formatting: a finite-state machine over roles and a declarative template.

Rows of a conversation stream through the machine in order of turn; it keeps one state per conversation, so memory
does not grow with a conversation's length. For every turn it emits text segments: the turn's opening, its escaped
text and its closing, each with a loss flag. Where a role may not follow the one before, the turn is marked and the
machine stays in the error state until the conversation ends; the turn is formatted all the same.

The template escapes, inside texts, whatever would read as a control string, so the formatted text can be read back.

Cases: null text is the empty text; a null or unknown role is written by name (null: the empty name) and is out of
order; rows are ordered by turn (null first), ties by role and text; a null conv_id is a conversation of its own;
repeated rows are turns of their own; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.text import Batches


@dataclass(frozen=True)
class Template:
    """``opening`` holds {role}; ``loss`` names the roles whose texts count for the loss; ``follows`` maps a state
    (the last role, or START) to the roles that may come next, and ``final`` holds states a conversation may end in."""

    opening: str = "### {role}: "
    closing: str = " </turn>\n"
    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            "START": frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user"}),
        }
    )
    final: frozenset[str] = frozenset({"assistant"})

    #: What must not stand unescaped in a text or a role's name: the escape itself, the mark that opens a turn and
    #: the one that closes it, and the colon that ends a name.
    CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)")
    NAME_CONTROL = re.compile(r"[\\#<:]")
    ESCAPED = re.compile(r"\\(.)", re.DOTALL)
    TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|(?!</turn>)[^\\])*) </turn>\n", re.DOTALL)

    def escape(self, text: str) -> str:
        return self.CONTROL.sub(r"\\\g<0>", text)

    def unescape(self, text: str) -> str:
        return self.ESCAPED.sub(r"\1", text)

    def open(self, role: str) -> str:
        label = self.names.get(role) or "role=" + self.NAME_CONTROL.sub(r"\\\g<0>", role)
        return self.opening.format(role=label)

    def role_of(self, label: str) -> str:
        known = {v: k for k, v in self.names.items()}
        return known[label] if label in known else self.unescape(label.removeprefix("role="))


@dataclass(frozen=True)
class Segment:
    text: str
    loss: bool


class Machine:
    """State of one conversation."""

    def __init__(self, template: Template):
        self.template, self.state, self.valid = template, "START", True

    def step(self, role: str, text: str) -> list[Segment]:
        t = self.template
        if self.valid and role in t.follows.get(self.state, ()):
            self.state = role
        else:
            self.valid = False
        return [Segment(t.open(role), False), Segment(t.escape(text), role in t.loss), Segment(t.closing, False)]

    def ends_well(self) -> bool:
        return self.valid and self.state in self.template.final


def rows_in_order(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def segments(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments of all conversations: conv_id, turn_no, segment (0 to 2), text, loss, in_order (whether the turn order
    held up to here)."""
    template = template or Template()

    def run(batches: Batches) -> Batches:
        current, machine, n = object(), None, 0
        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if conv != current or machine is None:
                    current, machine, n = conv, Machine(template), 0
                out += [(conv, n, k, s.text, s.loss, machine.valid) for k, s in enumerate(machine.step(role or "", text or ""))]
                n += 1
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_())
                names = ("conv_id", "turn_no", "segment", "text", "loss", "in_order")
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return rows_in_order(conversations).mapInArrow(run, "conv_id long, turn_no long, segment int, text string, loss boolean, in_order boolean")


def read_back(formatted: str, template: Template) -> Iterator[tuple[str, str]]:
    """Turns (role, text) of formatted text."""
    at = 0
    while at < len(formatted):
        m = template.TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"not a turn at {at}: {formatted[at : at + 60]!r}")
        yield template.role_of(m[1]), template.unescape(m[2])
        at = m.end()


class Digest:
    """Reads the segments of a conversation back, turn by turn."""

    def __init__(self, template: Template):
        self.template, self.machine = template, Machine(template)
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, role: str, text: str) -> None:
        parts = self.machine.step(role, text)
        written = "".join(s.text for s in parts)
        self.formatted_chars += len(written)
        for r, t in read_back(written, self.template):
            self.n_turns += 1
            self.turns.update(f"{r}\n{t}\n".encode())
        for s in parts:
            if s.loss:
                read = self.template.unescape(s.text)
                self.loss_chars += len(read)
                self.loss.update(read.encode())

    def row(self, conv: int | None) -> tuple:
        return (conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars, self.machine.ends_well())


DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])


def digests(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation, read back from its formatted text and loss mask; ``valid`` is the machine's verdict."""
    template = template or Template()

    def run(batches: Batches) -> Batches:
        current, digest, done = None, None, []
        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if digest is None or conv != current:
                    if digest is not None:
                        done.append(digest.row(current))
                    current, digest = conv, Digest(template)
                digest.add(role or "", text or "")
            if len(done) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), DIGEST, strict=True)], schema=DIGEST)
                done = []
        if digest is not None:
            done.append(digest.row(current))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), DIGEST, strict=True)], schema=DIGEST)

    return rows_in_order(conversations).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
