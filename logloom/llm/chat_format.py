"""Chat formatting: a finite-state machine over roles and a declarative template.

``format_conversations`` emits one row per turn: its segments (text, loss flag), whose texts put one
behind another are the formatted conversation, the state of the role machine after the turn and whether
the turn order was valid so far. ``read_conversations`` reads the formatted text back into turns.

The template names, per role, an opening and a closing control string and whether the role's text is under
the loss mask; other roles use the ``other`` form, which carries the role's name as a first line. Control
strings inside texts are broken reversibly: every backslash is doubled, and one backslash is put behind
the first character of each control string, so none occurs in a formatted body.

Both directions sort the turns of a conversation inside one partition and stream over them with one turn
in memory: a conversation's digest is sequential, but its length does not bound the memory.

Defined results: null text and null role count as empty; null conv_id is a conversation of its own; turns
sort by number (null first), then role and text, and repeated rows are turns of their own; turns in
a wrong order (or after one) are formatted all the same and flagged; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, INVALID = "start", "invalid"


@dataclass(frozen=True)
class Form:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Forms of turns, and the role machine: state -> role -> next state."""

    begin: str = "<s>"
    forms: dict[str, Form] = field(
        default_factory=lambda: {
            "system": Form("<<SYS>>", "<</SYS>>"),
            "user": Form("[INST]", "[/INST]"),
            "assistant": Form("[ANSWER]", "</s>", loss=True),
        }
    )
    other: Form = Form("[TURN]", "[/TURN]")
    machine: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            START: {"system": "instructed", "user": "asked"},
            "instructed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )

    def __post_init__(self):
        controls = self.controls()
        if len(set(controls)) < len(controls) or any("\\" in c or len(c) < 2 for c in controls):
            raise ValueError("control strings must differ, be longer than one character and hold no backslash")

    def controls(self) -> list[str]:
        return [self.begin, *[c for f in [*self.forms.values(), self.other] for c in (f.open, f.close)]]

    def pattern(self) -> str:
        return "|".join(re.escape(c) for c in sorted(self.controls(), key=len, reverse=True))

    def step(self, state: str, role: str) -> str:
        return self.machine.get(state, {}).get(role, INVALID)


class Codec:
    """Formats single turns and reads them back."""

    def __init__(self, template: Template):
        self.template = template
        self.inside = re.compile(f"(?=(?:{template.pattern()}))(.)", re.S)
        self.control = re.compile(template.pattern())
        self.by_open = {f.open: (role, f) for role, f in template.forms.items()} | {template.other.open: (None, template.other)}

    def escape(self, text: str) -> str:
        return self.inside.sub(r"\1\\", text.replace("\\", "\\\\"))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def segments(self, role: str, text: str, first: bool) -> list[tuple[str, bool]]:
        form = self.template.forms.get(role)
        head = self.template.begin if first else ""
        if form is None:
            form = self.template.other
            return [(f"{head}{form.open} {self.escape(json.dumps(role))}\n", False), (self.escape(text), form.loss), (f" {form.close}", False)]
        return [(f"{head}{form.open} ", False), (self.escape(text), form.loss), (f" {form.close}", False)]

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of all turns in a formatted text."""
        turns, at = [], 0
        while at < len(formatted):
            if formatted.startswith(self.template.begin, at):
                at += len(self.template.begin)
                continue
            opened = self.control.match(formatted, at)
            role, form = self.by_open[opened[0]]
            closed = self.control.search(formatted, opened.end())
            if closed is None or closed[0] != form.close:
                raise ValueError(f"{opened[0]} is not closed by {form.close}")
            body = formatted[opened.end() + 1 : closed.start() - 1]
            if role is None:
                name, _, body = body.partition("\n")
                role = json.loads(self.unescape(name))
            turns.append((role, self.unescape(body)))
            at = closed.end()
        return turns


def format_conversations(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, position, role, state, valid, segments of every turn of ``rows`` (conv_id, turn, role,
    text)."""
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, state, position, at, begun = Codec(template), START, 0, None, False
        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if not begun or conv != at:
                    begun, at, state, position = True, conv, START, 0
                state = template.step(state, role)
                segments = [{"text": t, "loss": loss} for t, loss in codec.segments(role, text, position == 0)]
                out.append({"conv_id": conv, "position": position, "role": role, "state": state, "valid": state != INVALID, "segments": segments})
                position += 1
            yield pa.RecordBatch.from_pylist(out, FORMATTED)

    ordered = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = "conv_id long, position long, role string, state string, valid boolean, segments array<struct<text:string,loss:boolean>>"
    return ordered.mapInArrow(run, schema)


FORMATTED = pa.schema([
    ("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("state", pa.string()), ("valid", pa.bool_()),
    ("segments", pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))),
])
DIGESTS = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_()), ("final_state", pa.string()),
])


class _Digest:
    """Running digests of one conversation, fed with the formatted text of its turns in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.n, self.loss_chars, self.chars, self.valid, self.state = conv_id, 0, 0, 0, True, START
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, codec: Codec, segments: list[dict], valid: bool, state: str) -> None:
        formatted = "".join(s["text"] for s in segments)
        for role, text in codec.read(formatted):
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            self.n += 1
        learned = codec.unescape("".join(s["text"] for s in segments if s["loss"]))
        self.loss.update(learned.encode("utf-8", "surrogatepass"))
        self.loss_chars += len(learned)
        self.chars += len(formatted)
        self.valid, self.state = self.valid and valid, state

    def row(self) -> dict:
        return {
            "conv_id": self.conv_id, "n_turns": self.n, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars,
            "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars, "valid": self.valid, "final_state": self.state,
        }


def read_conversations(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation, read back from its formatted turns: the columns of ``DIGESTS``."""
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, current, done = Codec(template), None, []
        for batch in batches:
            for row in batch.to_pylist():
                if current is None or row["conv_id"] != current.conv_id:
                    if current is not None:
                        done.append(current.row())
                    current = _Digest(row["conv_id"])
                current.feed(codec, row["segments"], row["valid"], row["state"])
            if done:
                yield pa.RecordBatch.from_pylist(done, DIGESTS)
                done = []
        if current is not None:
            yield pa.RecordBatch.from_pylist([current.row()], DIGESTS)

    ordered = formatted.select("conv_id", "position", "state", "valid", "segments").repartition("conv_id").sortWithinPartitions("conv_id", "position")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, final_state string"
    return ordered.mapInArrow(run, schema)
