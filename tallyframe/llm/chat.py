r"""Chat formatting: a finite-state machine over roles, text segments with loss flags, a declarative template.

`format_turns` gives one row per turn with its segments (marker, escaped text, marker), each with a
loss flag, and whether the machine allows the turn where it stands; `read_back` parses the formatted
text again. Control strings inside texts get a backslash before them and so does the backslash
itself, so the way back is exact. Conversations stream through one task in turn order: neither
function holds more than a turn, so a very long conversation is no danger to memory.

Cases: null text or role counts as empty; a null conv_id is a conversation of its own; rows of one
turn number are ordered by role, then text, repeated rows stay; a role that the template doesn't
know keeps its name in an encoded form, gets no loss and is never legal; nothing is dropped: a
conversation out of order is formatted and marked `valid` false; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import ready, table


@dataclass(frozen=True)
class Template:
    """roles: role -> (shown name, loss flag, states it may follow); "" is the start. final: states that may end."""

    roles: dict = field(
        default_factory=lambda: {
            "system": ("System", False, ("",)),
            "user": ("User", False, ("", "system", "assistant")),
            "assistant": ("Assistant", True, ("user", "tool")),
            "tool": ("Tool", False, ("assistant",)),
        }
    )
    final: tuple = ("assistant",)
    opening: str = "### "
    naming: str = ": "
    closing: str = "</turn>"
    end: str = "\n"
    escape: str = "\\"

    def marks(self) -> list[str]:
        return [self.escape, self.opening, self.closing]

    def escaped(self, text: str) -> str:
        return re.sub("|".join(map(re.escape, self.marks())), lambda m: self.escape + m[0], text)

    def unescaped(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(" + "|".join(map(re.escape, self.marks())) + ")", lambda m: m[1], text)

    def shown(self, role: str) -> str:
        return self.roles[role][0] if role in self.roles else "=" + quote(role, safe="")

    def role(self, shown: str) -> str:
        return unquote(shown[1:]) if shown.startswith("=") else next(r for r, x in self.roles.items() if x[0] == shown)

    def segments(self, role: str, text: str) -> list[dict]:
        loss = role in self.roles and self.roles[role][1]
        return [{"text": f"{self.opening}{self.shown(role)}{self.naming}", "loss": False}, {"text": self.escaped(text), "loss": loss}, {"text": f"{self.closing}{self.end}", "loss": False}]

    def legal(self, before: str | None, role: str) -> bool:
        return role in self.roles and before in self.roles[role][2]


class Parser:
    """Reads formatted text in parts and gives back (role, text) of each turn that is complete."""

    def __init__(self, template: Template):
        self.t, self.rest = template, ""
        escaped = re.escape(template.escape) + "(?:" + "|".join(map(re.escape, template.marks())) + ")"
        self.stop = re.compile(f"{escaped}|({re.escape(template.closing + template.end)})")

    def feed(self, part: str) -> Iterator[tuple[str, str]]:
        self.rest += part
        while self.rest:
            at = self.rest.find(self.t.naming)
            if at < 0:
                return
            end = next((m for m in self.stop.finditer(self.rest, at) if m[1]), None)
            if end is None:
                return
            body = self.rest[at + len(self.t.naming) : end.start()]
            yield self.t.role(self.rest[len(self.t.opening) : at]), self.t.unescaped(body)
            self.rest = self.rest[end.end() :]


SEGMENT = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
FORMATTED = "conv_id long, position long, role string, segments array<struct<text: string, loss: boolean>>, legal boolean"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def format_turns(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per turn of (conv_id, turn, role, text), in order within each partition, all turns of a conversation in one."""
    ready(turns.sparkSession)
    t = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, position = object(), "", 0
        for batch in batches:
            rows = []
            for c, role, text in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if c != conv:
                    conv, state, position = c, "", 0
                rows.append((c, position, role, t.segments(role, text), t.legal(state, role)))
                state, position = role, position + 1
            kinds = (pa.int64(), pa.int64(), pa.string(), SEGMENT, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(list(zip(*rows, strict=True)) or [[]] * 5, kinds, strict=True)], ["conv_id", "position", "role", "segments", "legal"])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    chosen = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    ordered = chosen.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation from format_turns(): what its formatted text says when parsed again."""
    ready(formatted.sparkSession)
    t = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = [x.split()[0] for x in READ.split(", ")], (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
        now = None

        def done() -> tuple:
            if now["parser"].rest:
                raise ValueError("formatted text does not end with a turn")
            return now["conv"], now["n"], now["turns"].hexdigest(), now["loss_chars"], now["loss"].hexdigest(), now["chars"], now["valid"] and now["last"] in t.final

        for batch in batches:
            rows = []
            for conv, segments, legal in zip(*[batch.column(k).to_pylist() for k in ("conv_id", "segments", "legal")], strict=True):
                if now is None or conv != now["conv"]:
                    if now:
                        rows.append(done())
                    now = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "valid": True, "last": "", "parser": Parser(t)}
                for role, text in now["parser"].feed("".join(s["text"] for s in segments)):
                    now["n"] += 1
                    now["turns"].update(f"{role}\n{text}\n".encode())
                    now["last"] = role
                for s in segments:
                    now["chars"] += len(s["text"])
                    if s["loss"]:
                        under = t.unescaped(s["text"])
                        now["loss"].update(under.encode())
                        now["loss_chars"] += len(under)
                now["valid"] &= legal
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x], type=k) for x, k in zip(done(), kinds, strict=True)], names)

    return formatted.select("conv_id", "segments", "legal").mapInArrow(run, READ)


#: A conversation that says the template's own marks.
TRAP = r"\### Assistant: </turn> ok"


def op8_chat_fsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    trap = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRAP).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return read_back(format_turns(turns.unionByName(trap)))
