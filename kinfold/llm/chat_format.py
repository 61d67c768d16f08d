"""Conversations as training text with a loss mask, put together in one byte buffer at a time.

The turns of a batch are three columns of segments: headers, contents and closing marks. Their lengths give cumulative
offsets, the offsets give the place of every byte, and all bytes are scattered into one preallocated Arrow buffer whose
pieces are the formatted texts.

Contents cannot forge a mark: an escape sign goes before every escape sign and before every place where a control string
begins, so a mark without one is a real mark and taking one sign away each gives the content back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import tokens as T

#: Bytes of content put together in one buffer, or one longer turn, and of those scattered at once.
_PART = 1 << 20
_STEP = 1 << 20
_SPAN = pa.struct([("start", pa.int32()), ("length", pa.int32())])
_PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("loss", pa.list_(_SPAN))])
_PARTS_SQL = "conv_id long, part long, text string, loss array<struct<start: int, length: int>>"
_DIGEST = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
_DIGEST_SQL = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_READ = pa.schema([*_PARTS, *_DIGEST])


@dataclass(frozen=True)
class Template:
    """``### Name: content</turn>`` and a line end for each turn; a role without a name is written after ``=``."""

    open: str = "### "
    middle: str = ": "
    close: str = "</turn>"
    after: str = "\n"
    sign: str = "\\"
    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"})
    learnt: tuple[str, ...] = ("assistant",)

    def header(self, role: str) -> str:
        if role in self.names:
            return f"{self.open}{self.names[role]}{self.middle}"
        plain = role
        for mark in (self.sign, self.open[0], self.close[0], self.middle[0]):
            plain = plain.replace(mark, self.sign + mark)
        return f"{self.open}={plain}{self.middle}"

    def plain(self, text: str) -> str:
        """``text`` without its escape signs."""
        return re.sub(re.escape(self.sign) + "(.)", r"\1", text, flags=re.DOTALL) if self.sign in text else text

    def _mark(self, text: str, mark: str, at: int) -> int:
        """Where the next ``mark`` without an escape sign stands."""
        while True:
            at = signs = text.index(mark, at)
            while signs and text[signs - 1] == self.sign:
                signs -= 1
            if (at - signs) % 2 == 0:
                return at
            at += 1

    def turns(self, text: str) -> Iterator[tuple[str, str]]:
        """Role and content of every turn of a formatted text."""
        roles, at, end = {v: k for k, v in self.names.items()}, 0, self.close + self.after
        while at < len(text):
            if not text.startswith(self.open, at):
                raise ValueError(f"no turn begins at {at}")
            at += len(self.open)
            body = self._mark(text, self.middle, at)
            name = text[at:body]
            body += len(self.middle)
            at = self._mark(text, end, body)
            yield self.plain(name[1:]) if name.startswith("=") else roles[name], self.plain(text[body:at])
            at += len(end)


def _begins(data: np.ndarray, marks: np.ndarray, template: Template) -> np.ndarray:
    """Which bytes need an escape sign before them; a control string counts only where it lies within one text."""
    found = data == ord(template.sign)
    for control in (template.open.encode(), template.close.encode()):
        n = len(data) - len(control) + 1
        if n <= 0:
            continue
        here = data[:n] == control[0]
        for k in range(1, len(control)):
            here &= data[k: n + k] == control[k]
        at = np.flatnonzero(here)
        row = np.searchsorted(marks, at, side="right") - 1
        found[at[at + len(control) <= marks[row + 1]]] = True
    return found


@dataclass
class Assembled:
    """The formatted turns of a batch: one buffer, where each turn begins (turns + 1), and its content (start, end)."""

    buffer: pa.Buffer
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray


def assemble(roles: pa.Array, texts: pa.Array, template: Template) -> Assembled:
    """Format turns column by column; a null role or text is an empty one."""
    data, marks = T.buffers(texts)
    signs = _begins(data, marks, template)
    before = np.concatenate(([0], np.cumsum(np.add.reduceat(np.concatenate((signs, [False])), marks[:-1], dtype=np.int64) * (np.diff(marks) > 0)))) if len(texts) else np.zeros(1, np.int64)
    coded = roles.fill_null("").dictionary_encode()
    heads = [template.header(r).encode() for r in coded.dictionary.to_pylist()]
    shelf = np.frombuffer(b"".join(heads), np.uint8)
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.array([len(h) for h in heads], np.int64)
    shelf_first = np.concatenate(([0], np.cumsum(sizes)))
    close = np.frombuffer((template.close + template.after).encode(), np.uint8)
    head = sizes[code]
    body = np.diff(marks) + np.diff(before)
    first = np.concatenate(([0], np.cumsum(head + body + len(close))))
    start = first[:-1] + head
    buffer = pa.allocate_buffer(int(first[-1]))
    out = np.frombuffer(buffer, np.uint8)
    within = np.arange(int(head.sum())) - np.repeat(np.cumsum(head) - head, head)
    out[np.repeat(first[:-1], head) + within] = shelf[np.repeat(shelf_first[code], head) + within]
    out[(start + body)[:, None] + np.arange(len(close))] = close
    shift = start - marks[:-1] - before[:-1]
    done = 0
    for a in range(0, len(data), _STEP):
        piece = signs[a: a + _STEP]
        row = np.searchsorted(marks, np.arange(a, a + len(piece)), side="right") - 1
        running = done + np.cumsum(piece)
        target = np.arange(a, a + len(piece)) + running + shift[row]
        out[target] = data[a: a + _STEP]
        out[target[piece] - 1] = ord(template.sign)
        done = int(running[-1])
    return Assembled(buffer, first, start, start + body)


def _chars(made: Assembled) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points before each turn, before its content and before the content's end."""
    cuts = np.stack((made.first[:-1], made.start, made.end), axis=1).ravel()
    lead = (np.frombuffer(made.buffer, np.uint8) & 0xC0) != 0x80
    counts = np.add.reduceat(lead, cuts, dtype=np.int64)
    counts[:-1][np.diff(cuts) == 0] = 0
    upto = np.concatenate(([0], np.cumsum(counts)))[:-1].reshape(-1, 3)
    return upto[:, 0], upto[:, 1], upto[:, 2]


def _formatter(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 33
        for batch in (piece for whole in batches for piece in T.slices(whole, limit=_PART)):
            made = assemble(batch.column("role"), batch.column("text"), template)
            conv = batch.column("conv_id")
            ids, known = conv.fill_null(0).to_numpy(), np.asarray(conv.is_valid())
            new = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (known[1:] != known[:-1]))))
            learnt = np.isin(np.asarray(batch.column("role").fill_null("").to_pylist(), object), template.learnt)
            turn, start, end = _chars(made)
            origin = np.repeat(turn[new], np.diff(np.append(new, len(ids))))
            spans = pa.StructArray.from_arrays([pa.array((start - origin)[learnt], pa.int32()), pa.array((end - start)[learnt], pa.int32())], fields=list(_SPAN))
            many = np.concatenate(([0], np.cumsum(learnt)))[np.append(new, len(ids))].astype(np.int32)
            offsets = made.first[np.append(new, len(ids))].astype(np.int32)
            text = pa.StringArray.from_buffers(len(new), pa.py_buffer(offsets), made.buffer)
            yield pa.RecordBatch.from_arrays([conv.take(pa.array(new)), pa.array(part + np.arange(len(new)), pa.int64()), text, pa.ListArray.from_arrays(pa.array(many), spans)], schema=_PARTS)
            part += len(new)

    return run


def format_conversations(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """``(conv_id, part, text, loss)``: the turns of every conversation as text, and the spans a model learns from.

    ``loss`` holds start and length, in code points of ``text``, of each content by a role of ``template.learnt``, still
    escaped. A conversation is one row where it lies within one task and about 1 MB; else its rows, by rising ``part``,
    put together are its text, so that no conversation has to fit one task or one row. Turns go by ``turn``, equal ones
    by role and text, nulls first; repeated rows all count. Null roles and texts are empty; rows with a null ``conv_id``
    are one conversation with a null id. Other columns are ignored, whatever their names. No rows give no rows.
    """
    turns = conversations.select("conv_id", "turn", "role", "text")
    ranged = turns.repartitionByRange("conv_id", "turn", "role").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ranged.select("conv_id", "role", "text").mapInArrow(_formatter(template), _PARTS_SQL)


class _Reading:
    """Digests of one conversation, read part by part."""

    def __init__(self, template: Template):
        self.template = template
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, text: str, loss: list[dict]) -> _Reading:
        for role, content in self.template.turns(text):
            self.turns.update(f"{role}\n{content}\n".encode())
            self.n += 1
        for span in loss:
            learnt = self.template.plain(text[span["start"]: span["start"] + span["length"]])
            self.loss.update(learnt.encode())
            self.loss_chars += len(learnt)
        self.chars += len(text)
        return self

    def row(self, conv_id: int | None) -> dict:
        return {"conv_id": conv_id, "n_turns": self.n, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}


def _closed(template: Template):
    """Read conversations that surely lie in one part; hand on the parts of the others, at most one held back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, alone = None, False
        for batch in (piece for whole in batches for piece in T.slices(whole, limit=_PART)):
            out = []
            for row in batch.to_pylist():
                if held is None or held["conv_id"] != row["conv_id"]:
                    if held is not None:
                        out.append(_Reading(template).add(held["text"], held["loss"]).row(held["conv_id"]) if alone else held)
                    alone = held is not None
                else:
                    out.append(held)
                    alone = False
                held = row
            if out:
                yield pa.RecordBatch.from_pylist(out, _READ)
        if held is not None:
            yield pa.RecordBatch.from_pylist([held], _READ)

    return run


def _finished(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, reading, conv_id = ["conv_id", *(n for n, _ in _DIGEST)], None, None
        schema = pa.schema([_READ.field(n) for n in names])
        for batch in (piece for whole in batches for piece in T.slices(whole, limit=_PART)):
            out = []
            for row in batch.to_pylist():
                if row["text"] is None:
                    out.append({n: row[n] for n in names})
                    continue
                if reading is not None and conv_id != row["conv_id"]:
                    out.append(reading.row(conv_id))
                    reading = None
                reading, conv_id = (reading or _Reading(template)).add(row["text"], row["loss"]), row["conv_id"]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if reading is not None:
            yield pa.RecordBatch.from_pylist([reading.row(conv_id)], schema)

    return run


def read_back(parts: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of what formatted texts hold, one row a conversation: turns, text under the loss mask, lengths.

    ``parts`` is a frame of ``format_conversations``. A conversation of one part is read where it was made. Only parts at
    the edge of a task and those of long conversations are shuffled, and a long one is streamed through its digest.
    """
    read = parts.mapInArrow(_closed(template), f"{_PARTS_SQL}, {_DIGEST_SQL}")
    return read.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_finished(template), f"conv_id long, {_DIGEST_SQL}")
