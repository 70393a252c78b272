"""Chat formatting by a finite-state machine over roles, and reading back what was formatted.

A template names, for each role, what stands before and after its text and whether the text counts
for the loss. Control strings inside texts are escaped with a backslash, reversibly, so the
formatted conversation can be parsed again. Turns stream through in order: a task holds one turn and a
running hash, never a whole conversation.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import ship


@dataclass(frozen=True)
class Template:
    """What marks the turns of each role; any other role gets `other` with its escaped name."""

    before: dict[str, str] = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other: str = "### Role"
    named: str = ": "
    after: str = " </turn>\n"
    loss: frozenset = frozenset({"assistant"})
    #: Which role may follow which; "" is the start. Where a conversation may end.
    follows: dict[str, frozenset] = field(
        default_factory=lambda: {"": frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user"})}
    )
    ends: frozenset = frozenset({"assistant"})
    #: Escaped wherever they occur in a text or a role's name.
    control: tuple = ("### ", "</turn>", "###")

    def header(self, role: str | None) -> str:
        if role in self.before:
            return self.before[role]
        name = "-" if role is None else "+" + self.escape(role).replace(":", "\\:")
        return f"{self.other}{name}{self.named}"

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        return re.sub("|".join(map(re.escape, self.control)), lambda m: "\\" + m[0], text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)


@dataclass
class RoleMachine:
    """Validates turn order: feeds on roles, remembers the first turn that may not follow."""

    template: Template
    state: str = ""
    turns: int = 0
    bad: int | None = None

    def feed(self, role: str | None) -> None:
        if self.bad is None and (role is None or role not in self.template.follows.get(self.state, ())):
            self.bad = self.turns
        self.state = role if role is not None else "\0"
        self.turns += 1

    @property
    def valid(self) -> bool:
        return self.bad is None and self.state in self.template.ends


def in_order(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, each conversation's turns in order within one partition.

    Equal turn numbers go by role, then text; null turns come first. Conversations with a null conv_id are one conversation.
    """
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


SEGMENT = "conv_id long, segment long, text string, loss boolean, valid boolean, bad_turn long"


def segments(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """The text segments of all conversations, in order, with their loss flags (schema SEGMENT).

    Null texts are empty ones; turns that repeat come as often as they occur; no conversation gives no segment; other
    columns aren't read. The last segment of a conversation is empty and carries the machine's verdict: valid, and the
    first turn that may not stand where it does, if any. Invalid conversations are formatted like any other.
    """
    ship(turns.sparkSession)

    def formatted(batches):
        rows: list[tuple] = []
        current, machine, n = None, None, 0

        def close():
            rows.append((current[0], n, "", False, machine.valid, machine.bad))

        for batch in batches:
            for conv, _, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if current != (conv,):
                    if current is not None:
                        close()
                    current, machine, n = (conv,), RoleMachine(template), 0
                machine.feed(role)
                for part, loss in ((template.header(role), False), (template.escape(text), role in template.loss), (template.after, False)):
                    rows.append((conv, n, part, loss, None, None))
                    n += 1
                if len(rows) >= 3000:
                    yield _batch(rows, SEGMENT)
                    rows.clear()
        if current is not None:
            close()
        if rows:
            yield _batch(rows, SEGMENT)

    return in_order(turns).mapInArrow(formatted, SEGMENT)


_KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])


class Reader:
    """Parses formatted text as it comes and hashes the turns found, and the text under the loss mask."""

    def __init__(self, template: Template):
        self.template = template
        self.opens = {v: k for k, v in template.before.items()}
        self.buffer = ""
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.sha, self.loss = hashlib.sha256(), hashlib.sha256()
        self.close = re.compile(r"\\.|" + re.escape(template.after), re.S)
        self.at = 0  # the buffer is searched up to here

    def feed(self, text: str, loss: bool) -> None:
        self.chars += len(text)
        if loss:
            plain = self.template.unescape(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode("utf-8", "surrogatepass"))
        self.buffer += text
        while m := self.close.search(self.buffer, self.at):
            if m[0] != self.template.after:
                self.at = m.end()
                continue
            self._turn(self.buffer[: m.start()])
            self.buffer, self.at = self.buffer[m.end() :], 0

    def _turn(self, text: str) -> None:
        for mark, role in self.opens.items():
            if text.startswith(mark):
                body = text[len(mark) :]
                break
        else:
            m = re.match(re.escape(self.template.other) + r"([-+])((?:\\.|[^\\:])*)" + re.escape(self.template.named), text, re.S)
            role = "" if m[1] == "-" else self.template.unescape(m[2])
            body = text[m.end() :]
        self.turns += 1
        self.sha.update(f"{role}\n{self.template.unescape(body)}\n".encode("utf-8", "surrogatepass"))


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, bad_turn long"


def read_back(parts: DataFrame, template: Template = Template()) -> DataFrame:
    """One row for each conversation of segments(), from its formatted text and loss flags alone (schema DIGEST).

    A null role reads back as an empty one.
    """

    def parsed(batches):
        rows, current, reader = [], None, None
        for batch in batches:
            for conv, _, text, loss, valid, bad in zip(*(c.to_pylist() for c in batch.columns)):
                if current != (conv,):
                    current, reader = (conv,), Reader(template)
                reader.feed(text, loss)
                if valid is not None:
                    rows.append((conv, reader.turns, reader.sha.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars, valid, bad))
                    current = None
                    if len(rows) >= 2000:
                        yield _batch(rows, DIGEST)
                        rows = []
        if rows:
            yield _batch(rows, DIGEST)

    return parts.mapInArrow(parsed, DIGEST)
