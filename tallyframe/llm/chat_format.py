"""Conversations as training text: a compiled template renders each, markers say which characters count for the loss.

Rows are dealt by conversation and sorted within partitions, so a conversation streams through one task however long
it is: the template takes one message at a time, the text leaves in parts of about PART characters, and what reads it
back keeps one turn and two running digests. No conversation is gathered anywhere. A digest over a whole conversation
is one sequence by nature; that pass is all that a hot conversation leaves in one task, in memory bound by its longest
text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.chat_template import END, HEADER, START, STOP, compile_template, unguard
from tallyframe.session import ship

#: Turns between marks; control strings inside roles and texts are guarded, so that reading back is exact.
TEMPLATE = """
{%- for message in messages -%}
### {{ message.role | guard_line }}:
{% if message.role == "assistant" %}{% generation %}{{ message.text | guard }}{% endgeneration %}{% else %}{{ message.text | guard }}{% endif %}</turn>
{% endfor -%}
"""
#: A part ends at the first place outside the loss after so many characters.
PART = 1 << 20

PARTS = "key {key}, part int, formatted string, loss array<struct<start:int,end:int>>, n_messages long"
DIGESTS = "key {key}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


_PARTS = [pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.int64()]
_DIGESTS = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def _rows(batches: Iterable[pa.RecordBatch], key_type: list) -> Iterator[tuple]:
    for b in batches:
        key_type[:] = b.schema.types[:1]
        yield from zip(*(c.to_pylist() for c in b.columns))


def parts_of(pieces: Iterable, size: int = PART) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Rendered pieces as parts: text, and the spans in it that count for the loss (code points, end excluded). A span
    is never cut."""
    held: list[str] = []
    spans: list[tuple[int, int]] = []
    at, began, any_part = 0, -1, False
    for x in pieces:
        if x is START:
            began = at
        elif x is STOP:
            if at > began:
                spans.append((began, at))
            began = -1
        else:
            held.append(x)
            at += len(x)
        if at >= size and began < 0:
            yield "".join(held), spans
            held, spans, at, any_part = [], [], 0, True
    if held or not any_part:
        yield "".join(held), spans


def format_conversations(df: DataFrame, template: str = TEMPLATE, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_chars: int = PART) -> DataFrame:
    """One row per part of a conversation's formatted text: key, part (from 0), formatted, loss (spans of formatted
    that count for the loss: start, end, in code points), n_messages (rows of the conversation up to the part's end).

    Rows of a conversation go by turn, null turns first, ties by role, then text, nulls first; repeated rows stay.
    A null role or text is empty. Rows with a null key form one conversation. Other columns are not read, whatever
    their names. An empty table gives no rows. A faulty template raises TemplateError before anything runs."""
    compile_template(template)
    ship(df.sparkSession)
    none = F.lit("")
    rows = df.select(F.col(key).alias("key"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), none).alias("role"), F.coalesce(F.col(text).cast("string"), none).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = compile_template(template)
        made: list[tuple] = []
        key_type: list = []
        size = 0
        for k, group in groupby(_rows(batches, key_type), key=lambda r: r[0]):
            seen = [0]

            def messages(group: Iterator[tuple] = group, seen: list[int] = seen) -> Iterator[dict]:
                for r in group:
                    seen[0] += 1
                    yield {"role": r[2], "text": r[3]}

            for i, (formatted, spans) in enumerate(parts_of(run({"messages": messages()}), part_chars)):
                made.append((k, i, formatted, [{"start": a, "end": b} for a, b in spans], seen[0]))
                size += len(formatted)
                if size > 4 * PART or len(made) >= 1000:
                    yield _batch(made, key_type + _PARTS, names)
                    made, size = [], 0
        if made:
            yield _batch(made, key_type + _PARTS, names)

    names = ["key", "part", "formatted", "loss", "n_messages"]
    dealt = rows.repartition("key").sortWithinPartitions("key", "turn", "role", "text")
    return dealt.mapInArrow(render, PARTS.format(key=kind))


def _batch(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


_HEAD = re.compile(r"### ((?:[^\\\n]|\\.)*):\n", re.S)


class Reader:
    """Reads formatted text in the marks of TEMPLATE, part by part, and keeps its digests."""

    def __init__(self) -> None:
        self.rest, self.n_turns, self.chars, self.loss_chars = "", 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, spans: list[dict]) -> None:
        self.chars += len(formatted)
        for s in spans:
            told = unguard(formatted[s["start"] : s["end"]])
            self.loss_chars += len(told)
            self.loss.update(told.encode())
        held, at = self.rest + formatted, 0
        while head := _HEAD.match(held, at):
            end = held.find(END + "\n", head.end())
            if end < 0:
                break
            self.n_turns += 1
            self.turns.update(f"{unguard(head[1])}\n{unguard(held[head.end() : end])}\n".encode())
            at = end + len(END) + 1
        self.rest = held[at:]

    def result(self) -> tuple:
        if self.rest:
            raise ValueError(f"no turn: {self.rest[:80]!r}")
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(parts: DataFrame) -> DataFrame:
    """What format_conversations() made with TEMPLATE, read again: one row per key with n_turns, turns_sha256 (role,
    line feed, text, line feed for each turn), loss_chars and loss_sha256 (text under the loss spans, unguarded) and
    formatted_chars. Parts must come in the order in which they were made, as they do right after
    format_conversations(); a table of parts is sorted by key and part within partitions dealt by key first.
    Text that isn't whole turns and parts out of order raise ValueError."""
    ship(parts.sparkSession)
    kind = parts.schema["key"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        key_type: list = []
        for k, group in groupby(_rows(batches, key_type), key=lambda r: r[0]):
            reader = Reader()
            for i, r in enumerate(group):
                if r[1] != i:
                    raise ValueError(f"part {r[1]} of {k} where part {i} is due")
                reader.add(r[2], r[3])
            made.append((k, *reader.result()))
            if len(made) >= 1000:
                yield _batch(made, key_type + _DIGESTS, names)
                made = []
        if made:
            yield _batch(made, key_type + _DIGESTS, names)

    names = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return parts.select("key", "part", "formatted", "loss").mapInArrow(read, DIGESTS.format(key=kind))


assert TEMPLATE.count(END) == 1 and HEADER in TEMPLATE
